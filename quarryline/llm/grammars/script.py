"""JavaScript (ECMAScript 2023) and TypeScript 5."""

from __future__ import annotations

import re
from functools import lru_cache

import regex

from quarryline.llm.grammars.lex import WRONG, Letters, alternatives, clean
from quarryline.llm.grammars.peg import Grammar

_JS_RULES = """
file = stmt* $
eos = ';' / &'}' / $ / BREAK
id = ID / SOFT
prop = ID / SOFT / WORD
stmt = block / ';' / var / function / class / 'if' par stmt ('else' stmt)? / 'for' 'await'? forhead stmt / 'while' par stmt
  / 'do' stmt 'while' par ';'? / 'return' (!BREAK expr)? eos / ('break' / 'continue') (!BREAK id)? eos / 'throw' !BREAK expr eos / try
  / 'switch' par cases / import / export / 'debugger' eos / id ':' stmt / exprstmt
@block = '{' stmt* '}'
@par = '(' expr ')'
exprstmt = !('function' / 'class' / '{' / 'async' ^'function') expr eos
var = varword binding % ',' eos
varword = 'var' / 'const' / 'let' &(id / '[' / '{')
binding = target ('=' assign)?
target = id / arraytarget / objecttarget
@arraytarget = '[' ','* (arrayitem (','+ arrayitem)* ','*)? ']'
arrayitem = '...' target / binding
@objecttarget = '{' (objectitem %% ',')? '}'
objectitem = '...' target / propname ':' binding / id ('=' assign)?
@forhead = '(' (forvar ('of' assign / 'in' expr) / (varword binding % ',' / expr)? ';' expr? ';' expr?) ')'
forvar = varword target / !('let' id 'of') lhs
try = 'try' block ('catch' catchhead? block ('finally' block)? / 'finally' block)
@catchhead = '(' target ')'
@cases = '{' (('case' expr / 'default') ':' stmt*)* '}'
function = ('async' ^'function' / 'function') '*'? id params block
@params = '(' (param %% ',')? ')'
param = '...' target / binding
class = 'class' id ('extends' lhs)? classbody
@classbody = '{' (member / ';')* '}'
member = 'static' block / 'static'? (('get' / 'set') propname params block / ('async' !BREAK)? '*'? propname params block) / 'static'? 'accessor'? propname !'(' ('=' assign)? eos
propname = prop / STR / NUM / PRIVATE / computed
@computed = '[' assign ']'
import = 'import' (STR / importwhat 'from' STR) ('with' object)? eos
importwhat = id (',' (star / names))? / star / names
star = '*' 'as' id
@names = '{' (((prop / STR) ('as' (prop / STR))?) %% ',')? '}'
export = 'export' ('default' (function / anonymous / class / assign eos) / '*' ('as' (prop / STR))? 'from' STR eos / names ('from' STR)? eos / var / function / class)
anonymous = ('async' ^'function' / 'function') '*'? params block / 'class' ('extends' lhs)? classbody
expr = assign % ','
assign = arrow / yield / (objecttarget / arraytarget) '=' assign / lhs assignop assign / cond
yield = 'yield' (!BREAK '*'? assign)?
arrow = &(id ^'=>' / 'async' ^ID / 'async' ^'(' / '(') ('async' !BREAK)? (id / params) ^'=>' (block / assign)
cond = binary ('?' assign ':' assign)?
binary = (PRIVATE 'in')? unary (binop unary)*
unary = ('!' / '~' / '+' / '-' / 'typeof' / 'void' / 'delete' / 'await' / '++' / '--') unary / lhs (^'++' / ^'--')?
~lhs = primary select*
select = '.' (prop / PRIVATE) / '?.' (prop / PRIVATE / index / args) / index / args / TEMPLATE
@index = '[' expr ']'
@args = '(' (('...'? assign) %% ',')? ')'
primary = TEMPLATE / REGEX / STR / NUM / 'this' / 'super' / 'null' / 'true' / 'false' / functionexpr / classexpr / array / object / par / new
  / 'import' (args / '.' id) / id
new = 'new' ('.' id / newtarget args?)
newtarget = new / primary ('.' (prop / PRIVATE) / index / TEMPLATE)*
functionexpr = ('async' ^'function' / 'function') '*'? id? params block
classexpr = 'class' id? ('extends' lhs)? classbody
@array = '[' ','* (element (','+ element)* ','*)? ']'
element = '...'? assign
@object = '{' (objectprop %% ',')? '}'
objectprop = '...' assign / ('get' / 'set') propname params block / ('async' !BREAK)? '*'? propname params block / propname ':' assign / id
binop = '||' / '&&' / '??' / '|' / '^' / '&' / '===' / '!==' / '==' / '!=' / '<=' / '<<' / '<' / '>' '>' '>' / '>' '>' / '>=' / '>' / '+' / '-' / '**' / '*' / '/' / '%'
  / 'instanceof' / 'in'
assignop = '=' / '+=' / '-=' / '*=' / '**=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>' '>=' / '>' '>=' / '&&=' / '||=' / '??='
"""

#: Words that are names in some places and mean something in others; reserved words.
_SOFT_JS = "as async from get set of static let yield await accessor".split()
_SOFT_TS = (
    _SOFT_JS
    + "type declare abstract namespace module readonly infer is keyof unique asserts satisfies override public private protected global require using out interface implements package".split()
)
_RESERVED = (
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return"
    " super switch this throw true try typeof var void while with enum"
).split()

_TS_RULES = """
stmt = block / ';' / var / function / class / 'if' par stmt ('else' stmt)? / 'for' 'await'? forhead stmt / 'while' par stmt
  / 'do' stmt 'while' par ';'? / 'return' (!BREAK expr)? eos / ('break' / 'continue') (!BREAK id)? eos / 'throw' !BREAK expr eos / try
  / 'switch' par cases / import / export / 'debugger' eos / tsdecl / id ':' stmt / exprstmt
tsdecl = 'interface' !BREAK id tparams? ('extends' type % ',')? tobject / 'type' !BREAK id tparams? '=' type eos / 'const'? 'enum' id enumbody
  / ('namespace' / 'module') !BREAK (id ('.' id)* / STR) block / 'global' block / 'declare' !BREAK stmt / 'abstract' !BREAK class
@enumbody = '{' (((prop / STR) ('=' assign)?) %% ',')? '}'
decorators = ('@' lhs)*
varword = 'var' / 'const' !'enum' / 'let' &(id / '[' / '{') / 'await'? 'using' !BREAK &(id !'in')
binding = target '!'? (':' type)? ('=' assign)?
function = ('async' ^'function' / 'function') '*'? id tparams? params returns? (block / eos)
param = decorators (('public' / 'private' / 'protected' / 'readonly' / 'override') &(id / '{' / '['))* '...'? (target / 'this') '?'? (':' type)? ('=' assign)?
returns = ':' (predicate / type)
predicate = 'asserts'? (id / 'this') 'is' type / 'asserts' (id / 'this')
class = decorators 'abstract'? 'class' id tparams? ('extends' lhs targs?)? ('implements' type % ',')? classbody
member = 'static' block / decorators (modifier !('(' / '=' / ';' / ':' / '?' / '!' / '}' / '<' / ','))* memberbody
modifier = 'public' / 'private' / 'protected' / 'static' / 'abstract' / 'override' / 'readonly' / 'declare' / 'accessor' / 'async'
memberbody = ('get' / 'set') propname params returns? (block / eos) / indexsig ':' type eos / '*'? propname ('?' / '!')? tparams? params returns? (block / eos)
  / propname ('?' / '!')? (':' type)? ('=' assign)? eos
@indexsig = '[' id ':' type ']'
@catchhead = '(' target (':' type)? ')'
import = 'import' (STR / 'type'? importwhat 'from' STR / 'type'? id '=' ('require' args / id ('.' id)*)) ('with' object)? eos
@names = '{' (('type' (prop / STR) ('as' (prop / STR))? / (prop / STR) ('as' (prop / STR))?) %% ',')? '}'
export = decorators 'export' ('default' (function / anonymous / 'abstract'? class / 'interface' id tparams? ('extends' type % ',')? tobject / assign eos) / 'type'? '*' ('as' (prop / STR))? 'from' STR eos
  / 'type'? names ('from' STR)? eos / '=' expr eos / 'as' 'namespace' id eos / 'import' id '=' ('require' args / id ('.' id)*) eos / var / function / class / tsdecl)
anonymous = ('async' ^'function' / 'function') '*'? tparams? params returns? (block / eos) / 'class' tparams? ('extends' lhs targs?)? ('implements' type % ',')? classbody
arrow = &(id ^'=>' / 'async' / '(' / '<') ('async' !BREAK)? (id ^'=>' / tparams? params returns? ^'=>') (block / assign)
cond = binary ('?' (assign ':' assign / cond ':' assign))?
binary = (PRIVATE 'in')? unary (binop unary / ^'as' ('const' / type) / ^'satisfies' type)*
unary = ('!' / '~' / '+' / '-' / 'typeof' / 'void' / 'delete' / 'await' / '++' / '--') unary / '<' ('const' / type) '>' unary / lhs (^'++' / ^'--')?
select = '.' (prop / PRIVATE) / '?.' (prop / PRIVATE / index / targs? args) / index / args / TEMPLATE / ^'!' !'=' / targs (args / TEMPLATE / !(id / STR / NUM / '('))
newtarget = new / primary ('.' (prop / PRIVATE) / index / TEMPLATE / ^'!')* targs?
functionexpr = ('async' ^'function' / 'function') '*'? id? tparams? params returns? block
classexpr = 'class' id? tparams? ('extends' lhs targs?)? ('implements' type % ',')? classbody
objectprop = '...' assign / ('get' / 'set') propname params returns? block / ('async' !BREAK)? '*'? propname tparams? params returns? block / propname ':' assign / id
~type = functiontype / union ('extends' (functiontype / union) '?' type ':' type)?
functiontype = &('abstract' / 'new' / '<' / '(') ('abstract'? 'new')? tparams? tparamlist '=>' (predicate / type)
union = '|'? intersection ('|' intersection)*
intersection = '&'? operator ('&' operator)*
operator = ('keyof' / 'unique' / 'readonly') operator / 'infer' id ('extends' union !'?')? / typeprimary typeindex*
typeindex = !BREAK bracket
@bracket = '[' type? ']'
typeprimary = parentype / tuple / tobject / 'typeof' ('import' args / prop) ('.' prop)* targs? / '-'? NUM / STR / TEMPLATE / 'import' args ('.' prop)* targs?
  / 'this' / 'void' / 'null' / 'true' / 'false' / id ('.' prop)* (!BREAK targs)?
@parentype = '(' type ')'
~targs = '<' (type %% ',') '>'
~tparams = '<' ((('const' / 'in' / 'out')* id ('extends' type)? ('=' type)?) %% ',') '>'
@tparamlist = '(' (('...'? (target / 'this') '?'? (':' type)?) %% ',')? ')'
@tuple = '[' (tupleitem %% ',')? ']'
tupleitem = '...'? prop '?'? ':' type / '...'? type '?'?
@tobject = '{' (mapped / (tmember (';' / ',' / eos))*) '}'
mapped = (('+' / '-')? 'readonly')? mapkey (('+' / '-')? '?')? (':' type)? ';'?
@mapkey = '[' id 'in' type ('as' type)? ']'
tmember = ('get' / 'set') propname params returns? / 'new'? tparams? tparamlist returns? / ('readonly' / '+' / '-')* indexsig '?'? ':' type
  / ('readonly' !(':' / '?' / '(' / '<' / ';' / ',' / '}'))? propname '?'? (tparams? tparamlist returns? / (':' type)?)
"""


def _merged(base: str, extra: str) -> str:
    """The rules of both; those of ``extra`` count where both have one."""
    def rules(text: str) -> dict[str, str]:
        joined = re.sub(r"\n[ \t]+", " ", text).strip().split("\n")
        return {re.match(r"[@~]?(\w+)", x)[1]: x for x in joined}  # type: ignore[index]
    return "\n".join((rules(base) | rules(extra)).values())


def _alphabet(text: str, soft: list[str]) -> str:
    """The rules with SOFT and WORD written out as the words of the language."""
    words = " / ".join(f"'{w}'" for w in _RESERVED)
    return text.replace("SOFT", " / ".join(f"'{w}'" for w in soft)).replace("WORD", words).replace("~lhs\n", "lhs\n")


JS = Grammar(_alphabet(_JS_RULES, _SOFT_JS), "file", breaks=True)
TS = Grammar(_alphabet(_merged(_JS_RULES, _TS_RULES), _SOFT_TS), "file", breaks=True)

_ESC = r"\\(?:\r\n|x[\da-fA-F]{2}|u(?:[\da-fA-F]{4}|\{[\da-fA-F]{1,6}\})|[^xu])"
_BODY = rf"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-zA-Z]*+"
_TEMPLATE = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{))*+`"
#: Operators after which a slash begins a regular expression, and words of that kind.
_BEFORE = "( [ { , ; : = ! & | ? + - * % < > ~ ^ && || ?? == === != !== <= >= => += -= *= &&= ||= ??= ...".split()
_WORDS_BEFORE = r"(?:return|typeof|case|in|of|delete|void|throw|new|else|do|instanceof|await|yield)\b"
_NESTED = rf"(?P<t>`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{(?P<b>(?:[(,=:!&|?]\s*{_BODY}|[^{{}}`'\"/]|/(?![*/])|//[^\n]*|/\*(?:(?!\*/)[\s\S])*\*/|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"|(?&t)|\{{(?&b)\}})*)\}})*+`)"
_TEMPLATES = regex.compile(_NESTED)
_HOLE = regex.compile(r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+" + rf"|\$\{{(?P<hole>(?:[^{{}}`'\"]|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"|{_NESTED}|(?P<c>\{{(?:[^{{}}`'\"]|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"|(?&t)|(?&c))*\}}))*)\}}|\\[\s\S]|[\s\S]")


class _Lexer:
    def __init__(self, grammar: Grammar) -> None:
        self.grammar, self.words = grammar, grammar.tokens()
        operators = [w for w in {*self.words, *_BEFORE} if not w[0].isalpha()]
        self.operators = operators
        self.pattern = re.compile(
            r"(?:[^\S\n]++|//[^\n]*+|/\*(?:(?!\*/)[^\n])*+\*/)*+"
            r"((?:/\*(?:(?!\*/)[\s\S])*+\*/|\n)(?:\s++|//[^\n]*+|/\*(?:(?!\*/)[\s\S])*+\*/)*+|/\*"
            rf"|(?:{alternatives(_BEFORE)})(?![=>])\s*{_BODY}|{_WORDS_BEFORE}\s*{_BODY}|(?:[^\W\d]|[$\\])(?:\w|[$\\‌‍])*+(?:\{{[\da-fA-F]+\}}\w*)?|\#[^\W\d][\w$]*+|\#[$_][\w$]*+"
            r"|(?:0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d[\d_]*)?n?)(?![\w$])"
            rf'|"(?:[^"\\\n]|{_ESC})*+"|\'(?:[^\'\\\n]|{_ESC})*+\'|{_TEMPLATE}|\x02\d+\x02|{alternatives(operators)}|[\s\S]|\Z)'
        )
        self.letters = Letters(self._classify)
        self.starts = re.compile(rf"({alternatives(_BEFORE)}|[a-z]+)\s*(/[\s\S]*)")

    def _classify(self, t: str) -> str:
        g = self.grammar.letters
        if not t:
            return ""
        c = t[0]
        if c == "\n" or (t[:2] == "/*" and len(t) > 2):
            return "\n"
        if t in self.words:
            return self.words[t]
        if c == "\x02":
            return g["TEMPLATE"]
        if len(t) > 2 and "/" in t and (m := self.starts.fullmatch(t)) and c not in "\"'`":
            if not re.fullmatch(r"[dgimsuvy]*", m[2].rpartition("/")[2]):
                return WRONG
            return self.words.get(m[1], g["ID"] if m[1].isalpha() else WRONG) + ("\n" if "\n" in t[len(m[1]) : len(t) - len(m[2])] else "") + g["REGEX"]
        if c == "#" and len(t) > 1:
            return g["PRIVATE"]
        if c.isalpha() or c in "_$\\":
            return WRONG if c == "\\" and len(t) < 6 else g["ID"]
        if len(t) > 1 and c in "\"'":
            return g["STR"]
        if len(t) > 1 and c == "`":
            return g["TEMPLATE"]
        if c.isdigit() or (c == "." and len(t) > 1):
            return WRONG if re.match(r"0\d+[_n]|.*__|.*_$", t) else g["NUM"]
        return WRONG

    @lru_cache(maxsize=20_000)  # noqa: B019
    def template_ok(self, text: str) -> bool:
        """Whether what stands in the holes of a template are expressions."""
        for m in _HOLE.finditer(text[1:-1]):
            hole = m["hole"]
            if hole is None:
                continue
            letters = self.lex(hole.strip())  # of TypeScript's templates some are types
            if not self.grammar.accepts(letters, "expr") and not ("type" in self.grammar.rules and self.grammar.accepts(letters, "type")):
                return False
        return True

    def without_holes(self, text: str) -> tuple[str, bool]:
        """The text with a stand-in of equal length for each template with holes, and whether a hole is wrong."""
        wrong = False

        def stand_in(m: regex.Match) -> str:
            nonlocal wrong
            if m[0][0] != "`" or "${" not in m[0]:
                return m[0]
            wrong |= not self.template_ok(m[0])
            return "\x02" + "0" * (len(m[0]) - 2) + "\x02"

        # strings and comments too, so that a backtick in them begins no template
        return (_SKIP.sub(stand_in, text), wrong) if "${" in text else (text, False)

    def lex(self, text: str) -> str:
        text, wrong = self.without_holes(text)
        letters = "".join(map(self.letters.__getitem__, self.pattern.findall(text)))
        return letters + WRONG if wrong else letters


_SKIP = regex.compile(rf"//[^\n]*+|/\*(?:(?!\*/)[\s\S])*+\*/|\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'|(?<=[=(,:;!&|?>{{}}\[]\s*){_BODY}|{_NESTED}")
_js, _ts = _Lexer(JS), _Lexer(TS)


def _prepared(text: str) -> str:
    body = clean(text).replace("\u2028", "\n").replace("\u2029", "\n")
    return body.partition("\n")[2] if body.startswith("#!") else body


def lex_js(text: str) -> str:
    return _js.lex(_prepared(text))


def lex_ts(text: str) -> str:
    return _ts.lex(_prepared(text))
