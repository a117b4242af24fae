"""Python 3.13."""

from __future__ import annotations

import re
from functools import lru_cache

from quarryline.llm.grammars.lex import WRONG, Letters, alternatives, clean
from quarryline.llm.grammars.peg import Grammar

PYTHON = Grammar(
    """
file = stmt*
id = ID / 'match' / 'case' / 'type'
stmt = compound / simple
simple = small (';' small)* ';'? NEWLINE
small = 'return' stars? / 'pass' / 'break' / 'continue' / 'raise' (expr ('from' expr)?)? / 'assert' expr (',' expr)? / import
  / ('global' / 'nonlocal') id % ',' / 'del' deltarget %% ',' / 'type' id tparams? '=' expr / assignment / yield / stars
assignment = (single / id) ':' expr ('=' (yield / stars))? / (targets '=')+ (yield / stars) !'=' / (id !augassign_no / single) augassign (yield / stars)
augassign_no = '='
augassign = '+=' / '-=' / '*=' / '@=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '**=' / '//='
single = atom (call* sub)+ !trailer / singleparen
@singleparen = '(' (single / id) ')'
targets = ('*'? target) %% ','
target = atom (call* sub)+ !trailer / id !trailer / targetparen / targetlist
@targetparen = '(' targets? ')'
@targetlist = '[' targets? ']'
deltarget = atom (call* sub)+ !trailer / id !trailer / delparen / dellist
@delparen = '(' (deltarget %% ',')? ')'
@dellist = '[' (deltarget %% ',')? ']'
import = 'import' (dotted ('as' id)?) % ',' / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' ('*' / names / name % ',')
dotted = id % '.'
name = id ('as' id)?
@names = '(' name %% ',' ')'
block = NEWLINE INDENT stmt+ DEDENT / simple
compound = decorator* ('async'? 'def' id tparams? params ('->' expr)? ':' block / 'class' id tparams? args? ':' block) / if / while / for / try / with / match
decorator = '@' named NEWLINE
if = 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
while = 'while' named ':' block ('else' ':' block)?
for = 'async'? 'for' targets 'in' stars ':' block ('else' ':' block)?
try = 'try' ':' block (('except' '*' expr ('as' id)? ':' block)+ else? finally? / except+ else? finally? / finally)
except = 'except' (expr ('as' id)?)? ':' block
else = 'else' ':' block
finally = 'finally' ':' block
with = 'async'? 'with' (withparen ':' / withitem % ',' ':') block
@withparen = '(' withitem %% ',' ')'
withitem = expr ('as' target)?
match = 'match' subject ':' NEWLINE INDENT ('case' patterns ('if' named)? ':' block)+ DEDENT
subject = starnamed %% ','
patterns = starpattern %% ','
starpattern = '*' id / pattern
pattern = orpattern ('as' id)?
orpattern = closed % '|'
closed = '-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False' / dotted classpattern? / patternparen / patternlist / patternmap
@classpattern = '(' ((id '=' pattern / pattern) %% ',')? ')'
@patternparen = '(' (starpattern %% ',')? ')'
@patternlist = '[' (starpattern %% ',')? ']'
@patternmap = '{' (('**' id / ('-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False' / dotted) ':' pattern) %% ',')? '}'
@params = '(' paramlist? ')'
paramlist = (id (':' expr)? !'=' / '/' / id (':' expr)? '=' expr / '**' id (':' expr)? / '*' (id (':' ('*'? expr))?)?) %% ','
lambdalist = (id !'=' / '/' / id '=' expr / '**' id / '*' id?) %% ','
@tparams = '[' ((('*' / '**')? id (':' expr)? ('=' '*'? expr)?) %% ',') ']'
stars = starnamed_no %% ','
starnamed_no = '*' bitor / expr
starnamed = '*' bitor / named
yield = 'yield' ('from' expr / stars)?
named = id ':=' expr / expr
expr = 'lambda' lambdalist? ':' expr / disjunction ('if' disjunction 'else' expr)?
disjunction = inversion (('and' / 'or') inversion)*
inversion = 'not'* comparison
comparison = bitor (compare bitor)*
compare = '==' / '!=' / '<=' / '<' / '>=' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
bitor = unary (binop unary)*
binop = '|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '/' / '//' / '%' / '@' / '**'
unary = ('-' / '+' / '~')* 'await'? atom trailer*
trailer = call / sub
call = args
sub = '.' id / subscript
atom = id / NUM / STR+ / '...' / 'None' / 'True' / 'False' / paren / list / braces
@paren = '(' (yield / starnamed comprehension / starnamed %% ',')? ')'
@list = '[' (starnamed comprehension / starnamed %% ',')? ']'
@braces = '{' (pair comprehension / pair %% ',' / starnamed comprehension / starnamed %% ',')? '}'
pair = '**' bitor / expr ':' expr
comprehension = ('async'? 'for' targets 'in' disjunction ('if' disjunction_or_named)*)+
disjunction_or_named = id ':=' expr / disjunction
@args = '(' (named comprehension / positional % ',' (',' keyword % ',')? ','? / keyword %% ',')? ')'
positional = '*' expr / !(id '=') named
keyword = '**' expr / id '=' expr / '*' expr
@subscript = '[' slice %% ',' ']'
slice = expr? ':' expr? (':' expr?)? / starnamed
hole = (yield / starnamed %% ',') '='? $
""".replace("(id !augassign_no / single)", "(single / id)").replace("augassign_no = '='\n", ""),
    "file",
)
_words = PYTHON.tokens()
_PRE = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"
_PY = re.compile(
    r"(?:[ \t\f]++|\\\n)*+"
    r"((?:#[^\n]*+)?(?:\n[ \t\f]*+(?:#[^\n]*+)?)++|#[^\n]*+"
    rf'|{_PRE}(?:"""(?:(?!""")(?:[^\\]|\\[\s\S]))*+"""|\'\'\'(?:(?!\'\'\')(?:[^\\]|\\[\s\S]))*+\'\'\'|"(?:[^"\\\n]|\\[\s\S])*+"|\'(?:[^\'\\\n]|\\[\s\S])*+\')'
    r"|(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    rf"|[^\W\d]\w*+|{alternatives([w for w in _words if not w[0].isalpha()] + ['!=', ':='])}|[\s\S]|\Z)"
)
_OLD_OCTAL = re.compile(r"0[\d_]*[1-9][\d_]*$")


def _class(t: str) -> str:
    if not t:
        return ""
    if t in _words:
        return _words[t]
    c = t[0]
    if c in "\n#":
        return "\n"
    if t[-1] in "\"'" and len(t) > 1:
        prefix = re.match(r"[a-zA-Z]*", t)[0].lower()  # type: ignore[index]
        if "f" in prefix and ("{" in t or "}" in t) and not fstring_ok(t[len(prefix) :], "r" in prefix):
            return WRONG
        if "b" in prefix and not t.isascii():
            return WRONG
        if "r" not in prefix and "b" not in prefix and not _escapes_ok(t):
            return WRONG
        return PYTHON.letters["STR"]
    if c.isalpha() or c == "_":
        return PYTHON.letters["ID"] if t.isidentifier() else WRONG
    if c.isdigit() or (c == "." and len(t) > 1):
        return WRONG if _OLD_OCTAL.match(t) else PYTHON.letters["NUM"]
    return WRONG


_BAD_ESCAPE = re.compile(r"\\(?:[^xuUN]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U(?:000[\da-fA-F]|0010)[\da-fA-F]{4}|N\{[^}]+\}|(x|u|U|N))", re.S)


def _escapes_ok(t: str) -> bool:
    return all(m[1] is None for m in _BAD_ESCAPE.finditer(t))


@lru_cache(maxsize=50_000)
def fstring_ok(quoted: str, raw: bool) -> bool:
    """Whether the holes of an f-string (given with its quotes) hold expressions."""
    width = 3 if quoted[:3] in ('"""', "'''") else 1
    return _holes_ok(quoted[width:-width], False)


def _holes_ok(text: str, spec: bool) -> bool:
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "\\" and i + 2 < n and text[i + 1] == "N" and text[i + 2] == "{":
            i = text.find("}", i) + 1 or n
            continue
        if c == "}":
            if spec or text[i : i + 2] != "}}":
                return False
            i += 2
            continue
        if c != "{":
            i += 1
            continue
        if not spec and text[i : i + 2] == "{{":
            i += 2
            continue
        depth, j, quote, spec_at = 0, i + 1, "", -1
        while j < n:
            d = text[j]
            if spec_at >= 0:  # inside a format: only nested holes count
                depth += (d == "{") - (d == "}")
                if depth < 0:
                    break
            elif quote:
                if text.startswith(quote, j):
                    j += len(quote) - 1
                    quote = ""
            elif d in "\"'":
                quote = d * 3 if text.startswith(d * 3, j) else d
                j += len(quote) - 1
            elif d in "([{":
                depth += 1
            elif d in ")]" or (d == "}" and depth):
                depth -= 1
            elif d == "}":
                break
            elif depth == 0 and (d == ":" or (d == "!" and text[j : j + 2] != "!=")):
                spec_at = j
                if d == "!":
                    m = re.match(r"!\s*[rsa]\s*", text[j:])
                    if not m or text[j + len(m[0]) : j + len(m[0]) + 1] not in (":", "}"):
                        return False
                    j += len(m[0]) - 1
                    if text[j + 1] == "}":
                        j += 1
                        break
                    j += 1
            j += 1
        if j >= n:
            return False
        end = spec_at if spec_at >= 0 else j
        if not PYTHON.accepts(lex_python(f"({text[i + 1 : end]}\n)", hole=True), "hole"):
            return False
        if spec_at >= 0 and ":" in text[spec_at:j]:
            if not _holes_ok(text[text.index(":", spec_at) + 1 : j], True):
                return False
        i = j + 1
    return True


_letters = Letters(_class)
_NEWLINE, _INDENT, _DEDENT = (PYTHON.letters[n] for n in ("NEWLINE", "INDENT", "DEDENT"))


def lex_python(text: str, hole: bool = False, places: list[int] | None = None) -> str:
    """Lines and indentation outside brackets become NEWLINE, INDENT and DEDENT.

    ``places``, where given, is filled with the offset of each letter in the text (its line ends cleaned).
    """
    body = text if hole else "\n" + clean(text) + "\n"
    tokens = _PY.findall(body)
    starts = [m.start(1) - 1 for m in _PY.finditer(body)] if places is not None else []
    get = _letters.__getitem__
    out: list[str] = []
    depth, stack, final = 0, [("", 0)], len(tokens) - 2
    for k, (t, c) in enumerate(zip(tokens, map(get, tokens), strict=True)):
        if c == "\n":
            if depth:
                continue
            if out and out[-1] not in (_NEWLINE, _INDENT, _DEDENT):
                out.append(_NEWLINE)
            last = t.rpartition("\n")[2]
            if k == final:  # the end of the text
                space, width = "", 0
            elif "#" in last or "\n" not in t:
                continue
            else:
                space, width = last, len(last.expandtabs(8))
            top, top_width = stack[-1]
            if width > top_width:
                # deeper by any size of tabs, or it isn't clear which block it is
                if len(space) <= len(top):
                    out.append(WRONG)
                stack.append((space, width))
                out.append(_INDENT)
            else:
                while width < stack[-1][1]:
                    stack.pop()
                    out.append(_DEDENT)
                if width != stack[-1][1] or len(space) != len(stack[-1][0]):
                    out.append(WRONG)
        else:
            out.append(c)
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth = max(0, depth - 1)
        if places is not None:
            places += [starts[k]] * (len(out) - len(places))
    letters = "".join(out)
    return letters[1:-1] if hole else letters
