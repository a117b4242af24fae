"""Evidence of a file's origin in its path and text, in bins whose meaning is fitted (``origin``)."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")

#: Directory names that tell of an origin, with the label they speak for.
DIRECTORIES = {
    "generated": "generated __generated__ autogen gen codegen generated-sources",
    "vendored": "vendor _vendor vendored node_modules third_party third-party thirdparty deps external bower_components",
    "minified": "dist min",
}
DIRECTORY = {name: label for label, names in DIRECTORIES.items() for name in names.split()}

#: Marks that generators and third parties commonly leave in the comments at the head of a file.
MADE_BY_TOOL = re.compile(
    r"@generated\b|\bauto-?\s?generated\b|\bcode generated by\b|\bautomatically (?:created|generated|produced)\b"
    r"|\b(?:written|created|produced|generated) by (?:a|the|an)?\s?(?:tool|generator|script|compiler|protoc)\b|\bcompiled output\b"
    r"|\bdo not (?:edit|modify)[.!]?\s*(?:\*/|-->)?$|\bdo not (?:edit|modify) (?:by hand|this file|manually)\b|\bchanges (?:will|would) be (?:lost|overwritten)\b",
    re.I,
)
FOREIGN = re.compile(
    r"^\W*@license\b|\bredistribution and use in source\b|\bpermission is (?:hereby )?granted, free of charge\b|\bSPDX-License-Identifier\b"
    r"|\blicen[cs]ed under the\b|\b(?:MIT|BSD|ISC|Apache|MPL)(?:[- ]\d[.\d]*)? licen[cs]e\b|\bcopyright\b.*\b(?:project authors|contributors)\b",
    re.I,
)
HOUSE = re.compile(r"\ball rights reserved\b|\binternal use only\b|\bconfidential\b", re.I)
LOCK_FILE = re.compile(r"(?:^|[/._-])(?:package-lock|npm-shrinkwrap|pnpm-lock|yarn|composer|cargo|poetry|pipfile|gemfile)?\.?lock(?:\.json|\.yaml|\.toml)?$|npm-shrinkwrap\.json$", re.I)
LOCK_TEXT = re.compile(r'"lockfileVersion"\s*:')
BUNDLE = re.compile(r"webpackJsonp|__webpack_require__|//[#@] sourceMappingURL=|System\.register\(|parcelRequire")
TOOL_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.py|\.pb\.go|\.generated\.\w+|\.g\.\w+|_generated\.\w+|\.designer\.\w+|\.freezed\.\w+)$", re.I)
MIN_NAME = re.compile(r"(?:[.-]min\.\w+|\.bundle\.\w+|\.chunk\.\w+|\.packed\.\w+)$", re.I)

#: Strings and comments: the only tokens that have to be told from the rest.
LITERAL = re.compile(
    r'"""[\s\S]*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/|(?m:^[ \t]*#(?![\[!])[^\n]*))'
)
#: Strings with a blank in so many characters are prose.
WORDY = 20
WORD = re.compile(r"(?<![\w$])[A-Za-z_$][\w$]*")
NUMBER = re.compile(r"\b(?:0[xX][\da-fA-F]+|\d[\d_.]*)")
LETTERS, DIGITS = re.compile(r"[A-Za-z]+"), re.compile(r"\d+")


def head_of(text: str) -> list[str]:
    """The comment lines before the first other line (a shebang, coding line or docstring at the front included)."""
    out: list[str] = []
    block, at = "", 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        s, at = text[at:end].strip(), end + 1
        if block:
            out.append(s)
            if block in s:
                block = ""
            continue
        if not s:
            continue
        if s.startswith("/*"):
            out.append(s)
            block = "" if "*/" in s else "*/"
        elif s[:3] in ('"""', "'''"):
            out.append(s)
            block = "" if s.count(s[:3]) > 1 else s[:3]
        elif s.startswith("<!--"):
            out.append(s)
            block = "" if "-->" in s else "-->"
        elif s.startswith(("//", "#", "--", ";;")) and not s.startswith("#["):
            out.append(s)
        else:
            break
    return out


def body_key(text: str, head: list[str] | None = None) -> tuple[str, int]:
    """A key that copies share whatever comments stand at their head, and the characters of what it stands for."""
    lines = [s for s in (x.strip() for x in text.replace("\r", "\n").split("\n")) if s]
    head = head_of(text) if head is None else head
    body = "\n".join(lines[len([x for x in head if x]) :])
    return hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest(), len(body)


def measures(text: str) -> dict[str, float]:
    """What tells of tools: how repetitive the lines are, how long, how much of the text is literal data."""
    literal = prose = 0

    def drop(m: re.Match) -> str:
        nonlocal literal, prose
        if m.lastgroup:
            return ""
        if m[0].count(" ") * WORDY >= len(m[0]):
            prose += len(m[0])
        else:
            literal += len(m[0]) - 2
        return m[0]

    kept = LITERAL.sub(drop, text)
    rows = kept.split("\n")
    lines = [s for s in map(str.strip, rows) if s]
    size = sum(map(len, lines)) or 1
    # a line's shape: its words and numbers reduced to what kind they are, so that alike lines become equal
    shaped = DIGITS.sub("9", LETTERS.sub("a", kept)).split("\n")
    shapes = Counter(s.strip() for x, s in zip(rows, shaped, strict=True) if len(x.strip()) > 3)
    code = LITERAL.sub('""', kept)
    names = WORD.findall(code)
    literal += sum(map(len, NUMBER.findall(code)))
    return {
        "lines": len(lines),
        "size": size,
        "mean": size / max(1, len(lines)),
        # lines of a shape that occurs often, as a part of all lines
        "alike": sum(n for n in shapes.values() if n >= 6) / max(1, shapes.total()),
        # of what isn't prose, be it of words or statements
        "literal": literal / max(1, size - prose),
        "names": len(names) / max(1, size - prose),
        "short": sum(len(x) <= 2 for x in names) / max(1, len(names)),
    }


#: Features of a file with the names of their bins; what no bin fits (-1) says nothing.
FEATURES: dict[str, tuple[str, ...]] = {
    "alike": ("under a fifth", "two fifths", "three fifths", "three quarters", "nine tenths", "more"),
    "dense": ("no", "long lines", "long lines of short names"),
    "literal": ("under two fifths", "three fifths", "more"),
    "names": ("one in over 80 characters", "in over 25", "in over 12", "more"),
    "head": ("none", "tool", "third party", "house"),
    "name": ("none", "lock", "tool", "minified"),
    "inside": ("none", "lock", "bundle"),
}


def is_json(text: str) -> bool:
    """Whether a text is JSON, whatever its name says."""
    if text.lstrip()[:1] not in ("{", "["):
        return False
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def bins(path: str, text: str, head: list[str] | None = None) -> list[int]:
    """The bin of each of FEATURES for one file. Shape (alike, dense, literal) is told of code only: records and
    prose are repetitive and literal by nature."""
    name = path.replace("\\", "/").rpartition("/")[2]
    ext = "." + name.rpartition(".")[2].lower() if "." in name else ""
    head = head_of(text) if head is None else head
    out = [-1] * len(FEATURES)
    out[4] = 1 if any(map(MADE_BY_TOOL.search, head)) else 3 if any(map(HOUSE.search, head)) else 2 if any(map(FOREIGN.search, head)) else 0
    out[5] = 1 if LOCK_FILE.search(name) else 2 if TOOL_NAME.search(name) else 3 if MIN_NAME.search(name) else 0
    out[6] = 1 if LOCK_TEXT.search(text) or text.count('"integrity"') >= 3 else 2 if BUNDLE.search(text) else 0
    if ext in (".json", ".md", ".txt", ".rst", ".lock") or is_json(text):
        return out
    m = measures(text)
    if m["lines"] >= 8:
        out[0] = sum(m["alike"] >= x for x in (0.2, 0.4, 0.6, 0.75, 0.9))
    out[1] = 0 if m["mean"] < 100 else 2 if m["short"] >= 0.35 and m["names"] >= 0.05 else 1
    if m["size"] >= 300:
        out[2] = sum(m["literal"] >= x for x in (0.4, 0.6))
        out[3] = sum(m["names"] >= x for x in (1 / 80, 1 / 25, 1 / 12))
    return out
