"""One checker per file extension: does a text conform to its grammar, and if not, where and why."""

from __future__ import annotations

import ast
import json
import re
import warnings
from dataclasses import dataclass

from quarryline.llm.grammars import py, script, simple
from quarryline.llm.grammars.lex import clean

#: Extension -> (lexer, grammar, pattern of tokens, their letters).
CHECKED = {
    ".json": (simple.lex_json, simple.JSON),
    ".go": (simple.lex_go, simple.GO),
    ".java": (simple.lex_java, simple.JAVA),
    ".rs": (simple.lex_rust, simple.RUST),
    ".js": (script.lex_js, script.JS),
    ".ts": (script.lex_ts, script.TS),
    ".py": (py.lex_python, py.PYTHON),
}
CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:\s|$)", re.M)


def extension(path: str | None) -> str:
    """The extension of a path with its dot, in lower case; empty without one."""
    name = (path or "").replace("\\", "/").rpartition("/")[2]
    return "." + name.rpartition(".")[2].lower() if "." in name else ""


def conforms(text: str, ext: str) -> bool:
    """Whether the grammar of the extension consumes all of the text."""
    lex, grammar = CHECKED[ext]
    if "\0" in text:
        return False
    letters = lex(text)
    return "\x01" not in letters and grammar.accepts(letters)


def exactly_invalid(text: str, ext: str) -> bool:
    """The exact check that follows for a text its grammar refused, where Python has one; else True.

    It spares nested quotes in f-strings and the like that the lexers don't follow all the way.
    """
    try:
        if ext == ".py":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return False
        if ext == ".json":
            def refuse(name: str) -> None:
                raise ValueError(name)
            json.loads(text, parse_constant=refuse)
            return False
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return True
    return True


def invalid(text: str, ext: str) -> bool:
    return not conforms(text, ext) and exactly_invalid(text, ext)


@dataclass
class Failure:
    line: int
    found: str
    expected: list[str]
    cause: str


def _offsets(text: str, ext: str) -> tuple[str, list[int]]:
    """The letters of a text and where in it each begins (the text's line ends cleaned)."""
    places: list[int] = []
    if ext == ".py":
        return py.lex_python(text, places=places), places
    patterns = {".json": (simple._JSON, simple._json_letters), ".go": (simple._GO, simple._go_letters), ".java": (simple._JAVA, simple._java_letters), ".rs": (simple._RUST, simple._rust_letters)}
    body = clean(text) + ("\n" if ext == ".go" else "")
    if ext in (".js", ".ts"):
        lexer = script._js if ext == ".js" else script._ts
        body, _ = lexer.without_holes(body)
        pattern, letters = lexer.pattern, lexer.letters
    else:
        pattern, letters = patterns[ext]
    out = []
    for m in pattern.finditer(body):
        for c in letters[m[1]]:
            if ext == ".go" and c == "\n":
                if not out or not simple._GO_BREAK.search(out[-1] + "\n"):
                    continue
                c = ";"
            out.append(c)
            places.append(m.start(1))
    return "".join(out), places


def failure(text: str, ext: str) -> Failure | None:
    """Where the furthest token was refused, what would have been accepted, and the likely cause; None if valid.

    Causes: ``conflict`` (a marker at or just above the place), ``extension`` (the text is a file of another of the
    languages), ``truncated`` (the text ends inside a construct), ``token`` (anything else).
    """
    if not invalid(text, ext):
        return None
    letters, places = _offsets(text, ext)
    grammar = CHECKED[ext][1]
    at, expected = grammar.failure(letters) or (len(letters), [])
    body = clean(text)
    offset = places[at] if at < len(places) else len(body)
    line = body.count("\n", 0, offset) + 1
    lines = body.split("\n")
    near = "\n".join(lines[max(0, line - 2) : line])
    if CONFLICT.search(near):
        cause = "conflict"
    elif any(body.strip() and conforms(text, other) for other in CHECKED if other != ext and {ext, other} != {".js", ".ts"}):
        cause = "extension"
    elif at >= len(letters) or not body[offset:].strip():
        cause = "truncated"
    else:
        cause = "conflict" if CONFLICT.search(body) else "token"
    found = body[offset:].lstrip().partition("\n")[0][:40] or "end of file"
    return Failure(line, found, expected, cause)
