"""Facts from source files: extractors per language, registered by name; a file that breaks one gives an error row."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.paths import language_of

#: (fact, name, qualified name, kind, start line, end line, exported, specifier)
Fact = tuple[str, str, str, str, int, int, bool, str]
FACTS = "repo string, path string, fact string, name string, qualified_name string, kind string, start_line int, end_line int, exported boolean, specifier string"
EXTRACTORS: dict[str, Callable[[str], Iterator[Fact]]] = {}


def register_extractor(language: str) -> Callable[[Callable[[str], Iterator[Fact]]], Callable[[str], Iterator[Fact]]]:
    """Make a function from text to facts the extractor of a language."""

    def add(fn: Callable[[str], Iterator[Fact]]) -> Callable[[str], Iterator[Fact]]:
        EXTRACTORS[language] = fn
        return fn

    return add


@register_extractor("python")
def python_facts(text: str) -> Iterator[Fact]:
    """Definitions, assignments at the top, imports, calls and base classes of a Python file."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)

    def name_of(node: ast.expr) -> str:
        return ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""

    def walk(node: ast.AST, scope: tuple[str, ...]) -> Iterator[Fact]:
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = (*scope, child.name)
                if isinstance(child, ast.ClassDef):
                    kind = "class"
                    for base in child.bases:
                        if b := name_of(base):
                            yield ("usage", b, b, "extends", base.lineno, base.lineno, False, "")
                else:
                    kind = "test" if child.name.startswith("test_") else "method" if scope else "function"
                yield ("symbol", child.name, ".".join(inner), kind, child.lineno, child.end_lineno or child.lineno, not child.name.startswith("_"), "")
                for d in child.decorator_list:
                    target = d.func if isinstance(d, ast.Call) else d
                    if n := name_of(target):
                        yield ("usage", n, n, "decorator", d.lineno, d.lineno, False, ast.unparse(d))
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield ("import", a.asname or a.name, a.name, "import", child.lineno, child.lineno, False, a.name)
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                for a in child.names:
                    yield ("import", a.asname or a.name, a.name, "import", child.lineno, child.lineno, False, module)
            elif isinstance(child, ast.Assign) and not scope:
                for t in child.targets:
                    if isinstance(t, ast.Name):
                        yield ("symbol", t.id, t.id, "constant" if t.id.isupper() else "variable", child.lineno, child.end_lineno or child.lineno, not t.id.startswith("_"), "")
            elif isinstance(child, ast.Call) and (n := name_of(child.func)):
                yield ("usage", n.rpartition(".")[2], n, "call", child.lineno, child.lineno, False, "")
            yield from walk(child, inner)

    yield from walk(tree, ())


def masked(text: str, line_comment: str = "//", quotes: str = "\"'`") -> str:
    """The text with comments and the insides of strings as blanks; line ends stay where they are."""
    q = "|".join(rf"{c}(?:[^{c}\\\n]|\\.)*{c}" for c in quotes if c != "`") + (r"|`(?:[^`\\]|\\[\s\S])*`" if "`" in quotes else "")
    pattern = re.compile(rf"{re.escape(line_comment)}[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|{q}")
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], text)


def _shallow(rules: list[tuple[str, str, str]], imports: str, exported: Callable[[str, str], bool], quotes: str = "\"'`") -> Callable[[str], Iterator[Fact]]:
    """An extractor that reads declarations line by line outside comments and strings; a block ends where its braces do."""
    compiled = [(re.compile(p), kind, fact) for p, kind, fact in rules]
    find_import = re.compile(imports, re.M)

    def extract(text: str) -> Iterator[Fact]:
        lines = masked(text, quotes=quotes).split("\n")
        for k, line in enumerate(lines):
            for pattern, kind, fact in compiled:
                if m := pattern.search(line):
                    depth, end, opened = 0, k, False
                    for j in range(k, len(lines)):
                        depth += lines[j].count("{") - lines[j].count("}")
                        opened |= "{" in lines[j]
                        end = j
                        if (opened and depth <= 0) or (not opened and lines[j].rstrip().endswith(";")):
                            break
                    yield (fact, m["name"], m["name"], kind, k + 1, end + 1, exported(line, m["name"]), "")
                    break
        for m in find_import.finditer(text):
            spec = m["spec"]
            line = text.count("\n", 0, m.start("spec")) + 1
            yield ("import", spec, spec, "import", line, line, False, spec)

    return extract


_ecma = _shallow(
    [
        (r"\bclass\s+(?P<name>[A-Za-z_$][\w$]*)", "class", "symbol"), (r"\binterface\s+(?P<name>[A-Za-z_$][\w$]*)", "interface", "symbol"),
        (r"\benum\s+(?P<name>[A-Za-z_$][\w$]*)", "enum", "symbol"), (r"\bfunction\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)", "function", "symbol"),
        (r"^\s*(?:export\s+)?type\s+(?P<name>[A-Za-z_$][\w$]*)\s*[=<]", "type", "symbol"),
        (r"^(?:export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>", "function", "symbol"),
        (r"^(?:export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)", "variable", "symbol"),
    ],
    r"(?:^\s*(?:import|export)\b[^'\"\n;]*?(?:from\s*)?|\b(?:import|require)\s*\(\s*)['\"](?P<spec>[^'\"\n]+)['\"]",
    lambda line, _: line.lstrip().startswith("export"),
)
EXTRACTORS["typescript"] = EXTRACTORS["javascript"] = _ecma
EXTRACTORS["go"] = _shallow(
    [(r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)", "function", "symbol"), (r"^type\s+(?P<name>\w+)\s+interface\b", "interface", "symbol"), (r"^type\s+(?P<name>\w+)", "type", "symbol"), (r"^(?:var|const)\s+(?P<name>\w+)", "variable", "symbol")],
    r"^(?:import\s+)?\s*(?:\w+\s+|\.\s+)?\"(?P<spec>[\w./-]+)\"\s*$",
    lambda _, name: name[:1].isupper(),
)
EXTRACTORS["rust"] = _shallow(
    [(r"\bfn\s+(?P<name>\w+)", "function", "symbol"), (r"\bstruct\s+(?P<name>\w+)", "class", "symbol"), (r"\benum\s+(?P<name>\w+)", "enum", "symbol"), (r"\btrait\s+(?P<name>\w+)", "interface", "symbol"), (r"^\s*(?:pub\s+)?(?:const|static)\s+(?P<name>\w+)", "constant", "symbol")],
    r"^\s*(?:pub\s+)?use\s+(?P<spec>[\w:]+)",
    lambda line, _: bool(re.search(r"\bpub\b", line)),
    quotes='"',
)
EXTRACTORS["java"] = _shallow(
    [(r"\b(?:class|record)\s+(?P<name>\w+)", "class", "symbol"), (r"\binterface\s+(?P<name>\w+)", "interface", "symbol"), (r"\benum\s+(?P<name>\w+)", "enum", "symbol"),
     (r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)+[\w<>\[\], ?.]+\s+(?P<name>\w+)\s*\(", "method", "symbol")],
    r"^\s*import\s+(?:static\s+)?(?P<spec>[\w.*]+)\s*;",
    lambda line, _: "public" in line,
    quotes="\"'",
)


def extract_facts(files: DataFrame) -> DataFrame:
    """FACTS of files (repo, path, text): symbols, imports and usages of each language with an extractor.

    A file that its extractor can't read gives one row with the fact ``error`` and what went wrong as its name; a
    null text gives none. Each file is read in one task, and no rows are shuffled.
    """
    known = sorted(EXTRACTORS)
    rows = files.where("text is not null").withColumn("language", language_of(F.col("path"))).where(F.col("language").isin(known))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        for part in parts:
            out = []
            for repo, path, text, language in part.itertuples(index=False):
                try:
                    out += [(repo, path, *fact) for fact in EXTRACTORS[language](text)]
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append((repo, path, "error", str(e)[:200], "", type(e).__name__, getattr(e, "lineno", None) or 0, 0, False, ""))
            yield pd.DataFrame(out, columns=names)

    return rows.select("repo", "path", "text", "language").mapInPandas(run, FACTS)
