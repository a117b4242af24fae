"""JSON, Go, Java and Rust."""

from __future__ import annotations

import re

from quarryline.llm.grammars.lex import WRONG, Letters, alternatives, clean
from quarryline.llm.grammars.peg import Grammar

# ---------------------------------------------------------------- JSON
JSON = Grammar(
    """
value = object / array / STR / NUM / 'true' / 'false' / 'null'
pair = STR ':' value
@object = '{' (pair % ',')? '}'
@array = '[' (value % ',')? ']'
""",
    "value",
)
_JSON = re.compile(r'[ \t\n\r]*+("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[a-z]+|[\s\S]|\Z)', re.A)
_json_words = JSON.tokens()


def _json_class(t: str) -> str:
    if not t:
        return ""
    if t[0] == '"' and len(t) > 1:
        return JSON.letters["STR"]
    if t[0].isdigit() or (t[0] == "-" and len(t) > 1):
        return JSON.letters["NUM"]
    return _json_words.get(t, WRONG)


_json_letters = Letters(_json_class)


def lex_json(text: str) -> str:
    return "".join(map(_json_letters.__getitem__, _JSON.findall(text)))


# ---------------------------------------------------------------- Go
_GO_EXPR = """
{h}expr = {h}unary (binop {h}unary)*
{h}exprs = {h}expr % ','
{h}unary = ('+' / '-' / '!' / '^' / '*' / '&' / '<-')* {h}operand postfix*
{h}simple = {h}exprs (':=' {h}exprs / assignop {h}exprs / '<-' {h}expr / '++' / '--')?
"""
GO = Grammar(
    """
file = 'package' ID ';' (importdecl ';')* (topdecl ';')*
importdecl = 'import' (importspec / importgroup)
@importgroup = '(' (importspec ';')* importspec? ')'
importspec = ('.' / ID)? STR
topdecl = funcdecl / decl
decl = 'const' (constspec / constgroup) / 'var' (varspec / vargroup) / 'type' (typespec / typegroup)
@constgroup = '(' (constspec ';')* constspec? ')'
@vargroup = '(' (varspec ';')* varspec? ')'
@typegroup = '(' (typespec ';')* typespec? ')'
ids = ID % ','
constspec = ids (type? '=' exprs)?
varspec = ids ('=' exprs / type ('=' exprs)?)
typespec = ID typeparams? '='? type
@typeparams = '[' ((ids constraint) %% ',') ']'
constraint = '~'? type ('|' '~'? type)*
funcdecl = 'func' params? ID typeparams? signature block?
signature = params (params / type)?
@params = '(' (param %% ',')? ')'
param = ID '...'? type / '...'? type
type = ID ('.' ID)? typeargs? / '*' type / array type / 'map' mapkey type / 'chan' '<-'? type / '<-' 'chan' type
  / 'func' signature / 'struct' fields / 'interface' methods / parentype
@parentype = '(' type ')'
@array = '[' (expr / '...')? ']'
@mapkey = '[' type ']'
@typeargs = '[' (type %% ',') ']'
@fields = '{' (field ';')* field? '}'
field = (ids type / '*'? ID ('.' ID)? typeargs?) STR?
@methods = '{' (method ';')* method? '}'
method = ID signature / constraint
@block = '{' stmts '}'
stmts = (stmt? ';')* stmt?
stmt = decl / if / for / 'switch' (hsimple? ';')? hsimple? cases / 'select' cases / 'return' exprs? / 'go' expr / 'defer' expr
  / 'break' ID? / 'continue' ID? / 'goto' ID / 'fallthrough' / block / ID ':' stmt? / simple
if = 'if' (hsimple? ';')? hsimple block ('else' (if / block))?
for = 'for' ((hexprs (':=' / '='))? 'range' hexpr / hsimple? ';' hexpr? ';' hsimple? / hexpr)? block
@cases = '{' (('case' (caseof % ',' / simple) / 'default') ':' stmts)* '}'
caseof = (expr / type) &(',' / ':')
operand = NUM / STR / CHAR / func / literal / ID literaltail? / paren
hoperand = NUM / STR / CHAR / func / literal / ID / paren
func = 'func' signature block?
literaltail = ('.' ID)? typeargs? literalvalue
literal = (array type / 'map' mapkey type / 'chan' type / 'struct' fields / 'interface' methods) literalvalue?
@literalvalue = '{' (element %% ',')? '}'
element = (literalvalue / expr) (':' (literalvalue / expr))?
@paren = '(' (expr / type) ')'
postfix = '.' ID / '.' assertion / index / args
@assertion = '(' ('type' / type) ')'
@index = '[' (expr? ':' expr? (':' expr?)? / (expr / type) %% ',') ']'
@args = '(' (((expr / type) '...'?) %% ',')? ')'
binop = '||' / '&&' / '==' / '!=' / '<' / '<=' / '>' / '>=' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&' / '&^'
assignop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
"""
    + _GO_EXPR.format(h="")
    + _GO_EXPR.format(h="h"),
    "file",
)
_go_words = GO.tokens()
_GO = re.compile(
    r"(?:[ \t\f\v]++|//[^\n]*+|/\*(?:(?!\*/)[^\n])*+\*/)*+"
    r"((?:/\*(?:(?!\*/)[\s\S])*+\*/|\n)(?:\s++|//[^\n]*+|/\*(?:(?!\*/)[\s\S])*+\*/)*+|/\*|[^\W\d]\w*+"
    r"|(?:0[xXbBoO][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d[\d_]*)?)i?(?!\w)"
    r'|"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}))*+"|`[^`]*+`'
    r"|'(?:[^'\\\n]|\\(?:[abfnrtv\\']|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}))'"
    rf"|{alternatives([w for w in _go_words if not w[0].isalpha()])}|[\s\S]|\Z)"
)


def _go_class(t: str) -> str:
    if not t:
        return ""
    c = t[0]
    if c == "\n" or (t[:2] == "/*" and len(t) > 2):
        return "\n"
    if t in _go_words:
        return _go_words[t]
    if c.isalpha() or c == "_":
        return GO.letters["ID"]
    if len(t) > 1 and c in "\"`":
        return GO.letters["STR"]
    if len(t) > 1 and c == "'":
        return GO.letters["CHAR"]
    return GO.letters["NUM"] if c.isdigit() or (c == "." and len(t) > 1) else WRONG


_go_letters = Letters(_go_class)
_ends = "".join(re.escape(x) for x in [*(GO.letters[n] for n in ("ID", "NUM", "STR", "CHAR")), *(_go_words[w] for w in ("break", "continue", "fallthrough", "return", "++", "--")), ")", "]", "}"])
_GO_BREAK = re.compile(rf"(?<=[{_ends}])\n")


def lex_go(text: str) -> str:
    """Line breaks after what can end a statement are semicolons."""
    raw = "".join(map(_go_letters.__getitem__, _GO.findall(clean(text) + "\n")))
    return _GO_BREAK.sub(";", raw).replace("\n", "")


# ---------------------------------------------------------------- Java
JAVA = Grammar(
    """
unit = (annot* 'package' qname ';')? (import / ';')* (typedecl / ';')*
id = ID / 'record' / 'sealed' / 'permits' / 'var' / 'yield' / 'non'
qname = id ('.' id)*
import = 'import' 'static'? qname ('.' '*')? ';'
modifier = annot / 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient'
  / 'volatile' / 'strictfp' / 'default' !(':' / '->') / 'sealed' &(ID / 'class' / 'interface' / 'abstract' / 'public') / 'non' '-' 'sealed'
annot = '@' !'interface' qname annargs?
@annargs = '(' ((id '=' annvalue) % ',' / annvalue)? ')'
annvalue = annot / annarray / cond
@annarray = '{' (annvalue %% ',')? '}'
typedecl = modifier* typebody
typebody = 'class' id tparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody
  / 'interface' id tparams? ('extends' types)? ('permits' types)? classbody
  / 'enum' id ('implements' types)? enumbody
  / 'record' id tparams? recordhead ('implements' types)? classbody
  / '@' 'interface' id classbody
types = type % ','
@recordhead = '(' ((annot* type '...'? id) % ',')? ')'
@enumbody = '{' (enumconst % ',')? ','? (';' member*)? '}'
enumconst = annot* id args? classbody?
@classbody = '{' member* '}'
member = ';' / 'static'? block / modifier* memberbody
memberbody = typebody / id block / tparams? id params throws? block
  / tparams? annot* (type / 'void') id params dims throws? (block / ('default' annvalue)? ';')
  / type variable % ',' ';'
variable = id dims ('=' (arrayinit / expr))?
dims = (annot* dim)*
@dim = '[' ']'
@params = '(' (param % ',')? ')'
param = modifier* type (annot* '...')? ((id '.')* 'this' / id dims)
throws = 'throws' types
~tparams = '<' ((annot* id ('extends' type ('&' type)*)?) % ',') '>'
prim = 'int' / 'long' / 'short' / 'byte' / 'char' / 'boolean' / 'float' / 'double'
type = annot* (prim / cname) dims
cname = id targs? ('.' annot* id targs?)*
~targs = '<' (targ % ',')? '>'
targ = annot* '?' (('extends' / 'super') type)? / type
@block = '{' bstmt* '}'
bstmt = modifier* ('class' / 'interface' / 'enum' / 'record') & (id) !'=' localtype / local ';' / stmt
localtype = .
local = modifier* type variable % ','
stmt = block / ';' / 'if' par stmt ('else' stmt)? / 'for' forhead stmt / 'while' par stmt / 'do' stmt 'while' par ';' / try
  / 'switch' par switchbody / 'return' expr? ';' / 'break' id? ';' / 'continue' id? ';' / 'throw' expr ';' / 'synchronized' par block
  / 'assert' expr (':' expr)? ';' / 'yield' expr ';' / id ':' stmt / exprstmt ';'
exprstmt = ('++' / '--') unary / lhs assignop expr / lhs ('++' / '--') / headcall (sel* call)* !sel / head (sel* call)+ !sel
~lhs = primary
@par = '(' expr ')'
@forhead = '(' (modifier* type id ':' expr / (local / expr % ',')? ';' expr? ';' (expr % ',')?) ')'
try = 'try' (resources block catch* ('finally' block)? / block (catch+ ('finally' block)? / 'finally' block))
@resources = '(' (resource %% ';') ')'
resource = modifier* type id '=' expr / expr
catch = 'catch' catchhead block
@catchhead = '(' modifier* type ('|' type)* id ')'
@switchbody = '{' (label '->' (expr ';' / block / 'throw' expr ';') / label ':' bstmt*)* '}'
label = 'case' (cond % ',') / 'default'
expr = lambda / cond (assignop expr)?
lambda = (id / lparams) '->' (block / expr)
@lparams = '(' ((modifier* type '...'? id dims / id) % ',')? ')'
cond = binary ('?' expr ':' (lambda / cond))?
binary = unary (binop unary / 'instanceof' 'final'? type id?)*
unary = ('+' / '-' / '!' / '~' / '++' / '--') unary / primcast unary / cast (lambda / ('!' / '~') unary / &castable unary) / primary ('++' / '--')*
castable = !('+' / '-' / '++' / '--') .
@primcast = '(' prim dims ')'
@cast = '(' type ('&' type)* ')'
primary = (headcall / head) (call / sel)*
headcall = (id / 'this' / 'super') args / 'new' creator
head = STR / NUM / CHAR / 'true' / 'false' / 'null' / 'this' / 'super' / par / 'switch' par switchbody / typeref / id
typeref = (prim dims / 'void' / &(id ('.' id)* ('<' / '[' ']')) cname dims) ('.' 'class' / '::' targs? (id / 'new'))
sel = '.' ('this' / 'class' / 'super' !'(' / targs? id !'(') / '::' targs? (id / 'new') / index
call = '.' (targs? id args / 'new' creator / 'super' args)
creator = annot* targs? (prim / cname) (index+ dims / dim dims arrayinit / args classbody?)
@arrayinit = '{' ((arrayinit / expr) %% ',')? ','? '}'
@index = '[' expr ']'
@args = '(' (expr % ',')? ')'
binop = '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '>=' / '<<' / '<' / '>' '>' '>' / '>' '>' / '>' / '+' / '-' / '*' / '/' / '%'
assignop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>' '>=' / '>' '>='
""".replace("bstmt = modifier* ('class' / 'interface' / 'enum' / 'record') & (id) !'=' localtype / local ';' / stmt\nlocaltype = .\n", "bstmt = modifier* typebody / local ';' / stmt\n"),
    "unit",
)
_java_words = JAVA.tokens()
_JESC = r"\\(?:[btnfrs0-7\"'\\\n]|u+[\da-fA-F]{4})"
_JAVA = re.compile(
    r"(?:\s++|//[^\n]*+|/\*(?:(?!\*/)[\s\S])*+\*/)*+"
    rf'(/\*|[^\W\d]\w*+(?:\$\w*)*|"""[ \t\f]*\n(?:(?!""")(?:[^\\]|\\[\s\S]))*+"""|"(?:[^"\\\n]|{_JESC})*+"|\'(?:[^\'\\\n]|\\[0-3]?[0-7]?[0-7]|{_JESC})\''
    r"|(?:0[xX](?:[\da-fA-F_]+\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?)|0[bB][01_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d[\d_]*)?)[lLfFdD]?(?!\w)"
    rf"|{alternatives([w for w in _java_words if not w[0].isalpha()] + ['>='])}|[\s\S]|\Z)"
)
#: Words of Java that no rule above takes as names.
_JAVA_RESERVED = frozenset("const goto _".split())


def _java_class(t: str) -> str:
    if not t:
        return ""
    if t in _java_words:
        return _java_words[t]
    c = t[0]
    if c.isalpha() or c in "_$":
        return WRONG if t in _JAVA_RESERVED else JAVA.letters["ID"]
    if len(t) > 1 and c == '"':
        return JAVA.letters["STR"]
    if len(t) > 1 and c == "'":
        return JAVA.letters["CHAR"]
    return JAVA.letters["NUM"] if c.isdigit() or (c == "." and len(t) > 1) else JAVA.letters["ID"] if c == "$" else WRONG


_java_letters = Letters(_java_class)


def lex_java(text: str) -> str:
    return "".join(map(_java_letters.__getitem__, _JAVA.findall(clean(text))))


# ---------------------------------------------------------------- Rust
_RUST_EXPR = """
{h}expr = {h}jump / {h}closure / {h}binary
{h}jump = ('return' / 'break' LIFE?) {h}expr? / 'continue' LIFE?
{h}closure = 'static'? 'async'? 'move'? ('||' / '|' (cparam %% ',')? '|') ('->' type block / {h}expr)
{h}binary = (('..=' / '..') {h}operand? / {h}operand) {h}more*
{h}more = 'as' type / binop ({h}jump / {h}closure / {h}operand) / '..=' {h}operand / '..' {h}operand?
{h}operand = ('-' / '!' / '*' / ('&&' / '&') ('raw' ('const' / 'mut'))? 'mut'?)* {h}primary postfix*
"""
RUST = Grammar(
    """
file = inner* item*
inner = '#' '!' attr
attrs = ('#' attr)*
@attr = '[' tree* ']'
tree = tparen / tbrack / tbrace / '$' / !('(' / '[' / '{' / ')' / ']' / '}') .
@tparen = '(' tree* ')'
@tbrack = '[' tree* ']'
@tbrace = '{' tree* '}'
id = ID / 'union' / 'auto' / 'default' / 'raw'
item = attrs vis? itembody
itembody = fn / 'struct' id generics? (tuple where? ';' / where? (fields / ';')) / 'enum' id generics? where? variants / 'union' id generics? where? fields
  / 'unsafe'? 'impl' generics? ('!'? type 'for')? type where? assocs / 'unsafe'? 'auto'? 'trait' id generics? (':' bounds?)? where? assocs
  / 'mod' id (';' / modbody) / 'use' usetree ';' / const / 'static' 'mut'? id ':' type ('=' expr)? ';' / alias
  / 'extern' 'crate' name ('as' id)? ';' / 'unsafe'? 'extern' STR? assocs / macroitem
macroitem = path '!' id? (tbrace / (tparen / tbrack) ';')
vis = 'pub' visscope?
@visscope = '(' ('crate' / 'self' / 'super' / 'in' path) ')'
fn = 'const'? 'async'? 'unsafe'? ('extern' STR?)? 'fn' id generics? fnparams ('->' type)? where? (block / ';')
@fnparams = '(' (fnparam %% ',')? ')'
fnparam = attrs (('&' LIFE?)? 'mut'? 'self' (':' type)? / pattern ':' type / '...')
~generics = '<' (gparam %% ',')? '>'
gparam = attrs (LIFE (':' (LIFE %% '+')?)? / 'const' id ':' type ('=' constarg)? / id (':' bounds?)? ('=' type)?)
where = 'where' (wpred %% ',')?
wpred = LIFE ':' (LIFE %% '+')? / ('for' generics)? type ':' bounds?
bounds = bound %% '+'
bound = LIFE / '?'? ('for' generics)? tpath / boundparen
@boundparen = '(' bound ')'
@fields = '{' ((attrs vis? id ':' type) %% ',')? '}'
@tuple = '(' ((attrs vis? type) %% ',')? ')'
@variants = '{' ((attrs vis? id (fields / tuple)? ('=' expr)?) %% ',')? '}'
@assocs = '{' inner* (attrs vis? ('default' !'!')? (fn / const / alias / 'static' 'mut'? id ':' type ';' / macroitem))* '}'
@modbody = '{' inner* item* '}'
const = 'const' (id / '_') ':' type ('=' expr)? ';'
alias = 'type' id generics? (':' bounds?)? where? ('=' type)? where? ';'
name = id / 'self' / 'super' / 'crate' / 'Self'
usetree = '::'? (name '::')* (uses / '*' / name ('as' (id / '_'))?)
@uses = '{' (usetree %% ',')? '}'
type = ('&&' / '&') LIFE? 'mut'? type / '*' ('const' / 'mut') type / ttuple / tarray / '!' / '_' / ('for' generics)? fnptr
  / ('dyn' / 'impl') bounds / path '!' (tparen / tbrack / tbrace) / tpath
fnptr = 'unsafe'? ('extern' STR?)? 'fn' fnptrparams ('->' type)?
@fnptrparams = '(' ((attrs ((id / '_') ':')? type / '...') %% ',')? ')'
@ttuple = '(' (type %% ',')? ')'
@tarray = '[' type (';' expr)? ']'
tpath = (qself '::' / '::')? tseg ('::' tseg)*
tseg = name ('::'? targs / sugar ('->' type)?)?
@sugar = '(' (type %% ',')? ')'
~qself = '<' type ('as' tpath)? '>'
~targs = '<' (targ %% ',')? '>'
targ = LIFE / id targs? '=' type / id targs? ':' bounds / constarg / type
constarg = '-'? NUM / STR / CHAR / 'true' / 'false' / block
path = '::'? name ('::' name)*
epath = (qself '::' / '::')? name ('::' (name / targs))*
binop = '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<=' / '<<' / '<' / '>' '>=' / '>' '>' / '>' / '+=' / '-=' / '*=' / '/=' / '%=' / '^=' / '&=' / '|='
  / '+' / '-' / '*' / '/' / '%' / '^' / '&' / '|' / '='
postfix = '?' / '.' ('await' / id ('::' targs)? / NUM) / args / index
@args = '(' (expr %% ',')? ')'
@index = '[' expr ']'
literal = STR+ / NUM / CHAR / 'true' / 'false'
common = literal / blocklike / paren / array / path '!' (tparen / tbrack / tbrace)
primary = common / epath structlit?
hprimary = common / epath
@paren = '(' (expr %% ',')? ')'
@array = '[' (expr ';' expr / expr %% ',')? ']'
@structlit = '{' (sfield % ',' (',' '..' expr / ',')? / '..' expr)? '}'
sfield = attrs ((id / NUM) ':' expr / id)
blocklike = LIFE ':' (loop / block) / loop / 'unsafe' block / 'async' 'move'? block / 'const' block / block / if / 'match' hexpr arms
loop = 'loop' block / 'while' condition block / 'for' pattern 'in' hexpr block
if = 'if' condition block ('else' (if / block))?
condition = hletexpr
hletexpr = ('let' pattern '=')? hexpr
@arms = '{' inner* arm* '}'
arm = attrs pattern ('if' ('let' pattern '=')? expr)? '=>' (expr (',' / &'}') / blocklike ','?)
@block = '{' inner* stmt* (attrs expr)? '}'
stmt = ';' / attrs 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' / item / attrs blocklike !('.' / '?') ';'? / macroitem / attrs expr ';'
cparam = attrs pat (':' type)?
pattern = '|'? pat ('|' pat)*
pat = ('&&' / '&') 'mut'? pat / 'ref' 'mut'? id ('@' pat)? / 'mut' id ('@' pat)? / id '@' pat / range / plit / '_' / '..' / ptuple / pslice
  / path '!' (tparen / tbrack / tbrace) / epath (ptuple / pstruct)?
plit = '-'? NUM / STR / CHAR / 'true' / 'false'
bound1 = plit / epath
range = bound1 ('..=' bound1 / '..' bound1?) / '..=' bound1
@ptuple = '(' (pattern %% ',')? ')'
@pslice = '[' (pattern %% ',')? ']'
@pstruct = '{' ((attrs ('..' / (id / NUM) ':' pattern / 'ref'? 'mut'? id)) %% ',')? '}'
"""
    + _RUST_EXPR.format(h="").replace("%", "%")
    + _RUST_EXPR.format(h="h"),
    "file",
)
_rust_words = RUST.tokens()
_RESC = r"\\(?:[nrt0\\'\"\n]|x[\da-fA-F]{2}|u\{[\da-fA-F_]{1,8}\})"
_C0 = r"/\*(?:(?!\*/|/\*)[\s\S])*+\*/"
_C1 = rf"/\*(?:(?!\*/|/\*)[\s\S]|{_C0})*+\*/"
_C2 = rf"/\*(?:(?!\*/|/\*)[\s\S]|{_C1})*+\*/"
_RUST = re.compile(
    rf"(?:\s++|//[^\n]*+|{_C2})*+"
    r'(/\*|[bc]?r"[^"]*+"|[bc]?r#"(?:(?!"#)[\s\S])*+"#|[bc]?r##"(?:(?!"##)[\s\S])*+"##|[bc]?r###"(?:(?!"###)[\s\S])*+"###'
    rf'|[bc]?"(?:[^"\\]|{_RESC})*+"|b?\'(?:[^\'\\\n]|{_RESC})\'|\'[^\W\d]\w*+|(?:r\#)?[^\W\d]\w*+'
    r"|(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*+(?:\.(?![._]|[^\W\d])(?:\d[\d_]*)?)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)"
    rf"|{alternatives([w for w in _rust_words if not (w[0].isalpha() or w[0] == '_')])}|[\s\S]|\Z)"
)
#: Words of Rust 2021 that no rule above takes as names.
_RUST_RESERVED = frozenset("abstract become box do final macro override priv try typeof unsized virtual yield".split())


def _rust_class(t: str) -> str:
    if not t:
        return ""
    if t in _rust_words:
        return _rust_words[t]
    c = t[0]
    if t[-1] in "\"'#" and len(t) > 1 and (c in "\"'" or t[1] in "\"'r" or c == "r"):
        return RUST.letters["CHAR" if t[-1] == "'" else "STR"]
    if c == "'" and len(t) > 1:
        return RUST.letters["LIFE"]
    if c.isalpha() or c == "_":
        return WRONG if t in _RUST_RESERVED else RUST.letters["ID"]
    return RUST.letters["NUM"] if c.isdigit() else WRONG


_rust_letters = Letters(_rust_class)


def lex_rust(text: str) -> str:
    body = clean(text)
    if body.startswith("#!") and not body.startswith("#!["):
        body = body.partition("\n")[2]
    return "".join(map(_rust_letters.__getitem__, _RUST.findall(body)))
