"""Grammars against Python's own parsers and hand-made cases; the query on odd rows."""

import ast
import json
import random
import warnings
from pathlib import Path

import pytest

from quarryline.llm import syntax
from quarryline.llm.grammars import check, peg, py, script, simple

GOOD = {
    ".py": [
        "", "x = 1\n", "def f(a, /, b=1, *c, d, **e) -> int: return a\n", "match x:\n    case [1, *_] | {'a': b, **r} if b: pass\n    case P(x=1) as q: ...\n", "print(f'{x!r:>{w}} {{}} {a[\"b\"]}')\n",
        "async def f():\n    async with a as b, c: await d\n    return [x async for x in y if (z := x)]\n", "try:\n    pass\nexcept* E as e:\n    raise\n", "type A[T: int] = list[T]\nclass B[*Ts](C, m=D): pass\n", "a = b = c, *d = e\nx[1:2, ...] += lambda *a: (yield)\n",
        "if a:\n\tb\nelse: c\n", "with (open(a) as b, c,): pass\n", "del a, (b, c[0])\n", "'''<<<<<<< HEAD\n=======\n'''\n", "x = 0xFF_00 + 1_0.5e-3j + 0o17\n", "match = case = type = 1\nmatch(case)\n", "@a.b(c)\ndef f(): pass\n", "# only a comment", "\\\nx = 1\n", "f(*a, b, *c, k=1, **d)\n", "x: int = 1\nself.y: str\n",
    ],
    ".js": [
        "", "let x = a ?? b?.c?.[d]?.(e);", "class A extends B { static #p = 1; get x() { return 1 } static { f() } async *g() {} [k] = 2; }", "const r = /[/\\]]+/giu.test(s) ? a / b / c : `x${`y${z}`}`", "for (const [k, v] of Object.entries(o)) { if (k) continue; else break }",
        "a\n++b\n", "export default async function* () {}\nimport d, { x as y, default as z } from 'm'\nexport * as n from 'k'", "label: for (;;) { break label }", "({ a, b: [c = 1, ...d] } = e)", "const f = async (x, { y }) => ({ x }), g = x => x", "#!/usr/bin/env node\n'use strict'\n", "return_ = a\n(b)", "do x(); while (y) z()", "if (a) ; else b\n/* <<<<<<< */", "new Foo", "x = y\n/re/g.exec(z)",
    ],
    ".ts": [
        "type A<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]?: T[K] } | `a${string}`;", "export abstract class B<T = string> implements C, D<T> { constructor(private readonly x: number, public y?: string) { super() } abstract f(this: B<T>): asserts this is D<T>; declare z: any; }",
        "function f<T>(a: T): a is string;\nfunction f(a: any) { return <T>a as unknown as T satisfies U }", "enum E { A = 1, B = 'x' }\nnamespace N.M { export const x = y!.z }\ndeclare module 'm' { export = x }", "const g = a < b ? f<string>(c) : (d): e is string => h", "@dec() export class X { @p() private readonly y: Map<string, Array<number>> = new Map<string, Array<number>>(); }",
        "import type { A } from './a'; export type { B } from './b'; import x = require('y')", "let t: [a: string, b?: number, ...rest: boolean[]] = u as const", "const { a, b }: { a: string; b: number } = c",
    ],
    ".go": [
        "package a\n\nimport (\n\t\"fmt\"\n\t_ \"os\"\n)\n\nfunc (s *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tfor i, v := range m {\n\t\tif x := f(); x > 0 {\n\t\t\tgo func() { <-c }()\n\t\t}\n\t}\n\treturn\n}\n", "package a\ntype S struct { A int `json:\"a\"`; *B; c.D }\nvar m = map[string][]int{\"a\": {1, 2}, \"{\": nil}\n",
        "package a\nfunc f[T any, K ~int | string](x T) { switch y := x.(type) { case int: fallthrough; default: } ; select { case v := <-c: _ = v; default: } }\n", "package a\nconst (\n\tA = iota\n\tB\n)\nvar r = 'x' + '\\'' + `raw\n`\n",
    ],
    ".java": [
        "package a.b; import static x.Y.*; @A(b = {1, 2}) public class C<T extends D & E> extends F<?> implements G { int[] x = {1, 2}, y; static { f(); } <U> C(U u) throws Z { this(u); } }", "record P(int x, String... y) { P { if (x < 0) throw new E(); } }\nsealed interface S permits A, B {}\nnon-sealed class A implements S {}",
        "class A { void f() { var x = switch (y) { case 1, 2 -> 3; default -> { yield 4; } }; for (int i = 0, j = 1; i < j; i++, j--) ; Function<A, B> g = A::b; int[][] z = new int[3][]; Object o = (Runnable & Serializable) () -> {}; if (o instanceof String s && s.length() > 1) {} String t = \"\"\"\n  x { \"\"\" ; } }",
        "enum E { A(1) { void g() {} }, B; int x; E() {} }\n@interface I { int value() default 1; }",
    ],
    ".rs": [
        "use a::{b, c::*, self as d};\n#[derive(Debug)]\npub(crate) struct S<'a, T: Fn(i32) -> u8 + 'a>(pub &'a T) where T: Sized;\n", "impl<T> A<T> for B where T: C { const X: u8 = b'x'; fn f(&mut self, (a, b): (u8, u8)) -> impl Iterator<Item = u8> + '_ { match x { Some(1..=3) | None if y => {} , S { a, .. } => a?.b::<T>().0, _ => return } } }",
        "fn f() { let Some(x) = y else { return }; if let Ok(a) = b { } 'l: loop { break 'l; } let c = |x: u8| -> u8 { x }; println!(\"{}\", r#\"\"x\"\"#); for i in 0..n { s[i] <<= 1 } let z = S { a: 1, ..d }; unsafe { *p } }", "#![allow(x)]\nmacro_rules! m { ($a:expr) => { $a }; }\nmod n { pub enum E { A = 1, B(u8), C { x: u8 } } }\n",
    ],
    ".json": ['{"a": [1, -2.5e3, "\\u00e9", null, true, {}]}', "1", ' "x" '],
}
BAD = {
    ".py": ["def f(\n", "x = = 1\n", "  x = 1\n", "if a:\nb\n", "print 'x'\n", "<<<<<<< HEAD\nx = 1\n", "f() = 1\n", "x = 'a\n", "class A\n    pass\n", "if a:\n        b\n    c\n", "try:\n    x\n", "x = 010\n", "f(a=1, b)\n", "return x y\n", "if x:\n        a\n\tb\n", "{\n", "f'{a b}'\n", "except X, e: pass\n"],
    ".js": ["let x = ;", "function f( {", "a b", "class { }", "`${a b}`", "{ \"a\": 1, \"b\": 2 }", "if (a {", "<<<<<<< HEAD\nx()", "'open", "for (let i of) {}", "x => {", "const a: number = 1"],
    ".ts": ["let x: = 1", "interface A { b: }", "function f(a: string { }", "=======\nx", "{ \"a\": 1, \"b\": 2 }", "class A { private x: Map<string, number }"],
    ".go": ["package a\nfunc f() {", "func f() {}", "package a\nx := 1\n", "package a\nvar x = \n", "package a\nfunc f()\n{\n}\n}", "package a\n>>>>>>> x\n"],
    ".java": ["class A { void f() { x + 1; } }", "class A { int }", "class A {", "public void f() {}", "class A { void f() { int x = ; } }", "class A { String s = \"x; }"],
    ".rs": ["fn f( {", "struct A { x }", "let x = 1;", "fn f() { a b }", "fn f() { match x { 1 = 2 } }", "||||||| base\n"],
    ".json": ["", "{", "{'a': 1}", "[1,]", '{"a" 1}', "NaN", "01", '"a\nb"', "// x\n1"],
}


@pytest.mark.parametrize("ext", list(GOOD))
def test_valid_and_invalid_texts(ext):
    for text in GOOD[ext]:
        assert check.conforms(text, ext), (ext, text, check.CHECKED[ext][1].failure(check.CHECKED[ext][0](text)))
    for text in BAD[ext]:
        assert check.invalid(text, ext), (ext, text)


@pytest.mark.parametrize("ext", list(GOOD))
def test_both_evaluations_agree_on_damaged_texts(ext):
    rng = random.Random(ext)
    lex, grammar = check.CHECKED[ext]
    for text in GOOD[ext]:
        for _ in range(12):
            k = rng.randrange(len(text) + 1)
            broken = rng.choice([text[:k], text[:k] + rng.choice("(){}[];,'\"\n=x") + text[k:], text[:k] + text[k + 1 :]])
            letters = lex(broken)
            assert grammar.accepts(letters) == (grammar.failure(letters) is None), (ext, broken)


def test_python_agrees_with_its_parser():
    folder = Path(ast.__file__).parent
    for name in ("ast.py", "json/decoder.py", "dataclasses.py", "asyncio/tasks.py", "argparse.py", "typing.py"):
        text = (folder / name).read_text()
        assert not check.invalid(text, ".py"), name
        lines = text.split("\n")
        rng = random.Random(name)
        for _ in range(6):
            k = rng.randrange(len(lines))
            cut = "\n".join(lines[:k]) + "\n" + lines[k][: rng.randrange(len(lines[k]) + 1)]
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                try:
                    ast.parse(cut)
                    ok = True
                except SyntaxError:
                    ok = False
            assert check.invalid(cut, ".py") != ok, (name, k)


def test_json_agrees_with_its_parser():
    rng = random.Random(4)
    text = json.dumps({"a": [1, 2.5, None, {"b": "x\"y"}], "c": {"d": []}})
    for _ in range(300):
        k = rng.randrange(len(text))
        t = text[:k] + rng.choice(["", ",", "}", "]", '"', "1", " "]) + text[k + rng.randrange(2) :]
        try:
            json.loads(t)
            ok = True
        except ValueError:
            ok = False
        assert check.conforms(t, ".json") == ok, t


def test_where_and_why():
    f = check.failure("def f():\n    return 1\n\ndef g(:\n    pass\n", ".py")
    assert (f.line, f.cause) == (4, "token") and f.found.startswith(":")
    assert check.failure("package a\nfunc f() {\n", ".go").cause == "truncated"
    assert check.failure("x = 1\n<<<<<<< HEAD\ny = 2\n=======\n", ".py").cause == "conflict"
    assert check.failure('{"a": 1, "b": [2]}', ".java").cause == "extension"
    assert check.failure("const x = `a${b}\nc`;\nlet y = = 1;", ".js").line == 3
    assert check.failure("x = 1\n", ".py") is None


def test_deep_and_long_texts_end():
    assert not check.invalid("[" * 300 + "]" * 300, ".json")
    assert check.invalid("(" * 100_000, ".js") and not check.invalid("[" * 100_000 + "]" * 100_000, ".json")
    assert check.invalid("[" * 50_000 + "1 1" + "]" * 50_000, ".json")
    for n in (3_000, 30_000):
        assert not check.invalid("x = " + "(" * n + "1" + ")" * n + ";\n", ".js") and check.invalid("x = " + "(" * n + "1 1" + ")" * n + ";\n", ".js")
        assert not check.invalid("package a\n\nvar x = " + "(" * n + "1" + ")" * n + "\n", ".go")
        assert not check.invalid("class A { int x = " + "(" * n + "1" + ")" * n + "; }\n", ".java")
        assert not check.invalid("fn f() { " + "{" * n + "}" * n + " }\n", ".rs")
        assert not check.invalid("let x: number[] = " + "[" * n + "]" * n + ";\n", ".ts")
    f = check.failure('{"a": ' + "[" * 5_000 + "1 1" + "]" * 5_000 + "}", ".json")
    assert f is not None and f.cause == "token"
    assert not check.invalid("x = 1\n" * 50_000, ".py")
    assert not check.invalid("f(a, b);\n" * 50_000, ".js")


def test_grammar_notation():
    g = peg.Grammar("a = 'x' (b % ',') $\nb = !'y' ID / NUM? 'y'\n", "a")
    at = g.letters
    assert g.accepts("".join([at["'x'"], at["ID"], ",", at["NUM"], at["'y'"]])) and not g.accepts(at["'x'"] + ",")
    with pytest.raises(ValueError):
        peg.Grammar("a = b\n", "a")
    assert simple.lex_go("x\n}") and script.lex_js("a") and py.lex_python("a\n")


SCHEMA = "file_id bigint, repo string, file_path string, skip_reason string, source_text string, parser_errors array<string>, _ext string"


def test_query_on_odd_rows(spark):
    rows = [
        (1, "r", "a.py", None, "x = ", None, "clash"), (1, "r", "a.py", None, "x = ", None, "clash"), (2, "r", "a.py", "too-large", "x = ", None, ""), (3, "r", "a.json", None, "", [], ""), (4, "r", "b.py", None, "", ["e"], ""),
        (5, "r", "c.md", None, "(((", None, ""), (6, None, "d.go", None, None, None, ""), (7, "r", None, None, "x =", None, ""), (8, None, "E.PY", None, "x = (\n", ["e"], ""), (9, "r", "no_extension", None, "(", None, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.file_id for r in syntax.invalid_files(df).collect()) == [1, 3, 8]
    assert {r.file_id: r.cause for r in syntax.failures(df).collect()}.keys() == {1, 3, 8}
    fresh = spark.createDataFrame([("r", None, 3)], "repo string, taken_at timestamp, parser_error_count bigint")
    got = {(r.repo, r.language): (r.files, r.invalid, r.claimed, r.differing, r.rate) for r in syntax.rates(df, fresh).collect()}
    assert got[("r", ".py")] == (2, 1, 1, 2, 0.5) and got[(None, ".py")] == (1, 1, 1, 0, 1.0)
    empty = df.limit(0)
    assert syntax.invalid_files(empty).count() == 0 and syntax.failures(empty).count() == 0 and syntax.rates(empty, fresh).count() == 0
