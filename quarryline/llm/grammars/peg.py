"""Packrat parsing-expression grammars over token strings.

A grammar is text: one rule per line (lines that begin with a blank go on), ``name = expression``. Expressions have
sequence, ordered choice ``/``, ``* + ?``, the predicates ``& !``, parentheses, ``x % y`` (one or more x with y in
between) and ``x %% y`` (the same with y allowed at the end), tokens in quotes, and token classes in capitals; ``.``
is any token and ``$`` the end. A lexer turns a text into a string with one letter per token; the grammar reads that.

Two evaluations of one grammar:

* ``accepts`` says whether the start rule consumes the whole input. What is regular in the grammar becomes possessive
  regular expressions, which have exactly PEG's meaning; the rest becomes functions. Rules that are marked ``@``
  begin with an opening bracket and end with its partner, so their result depends on the tokens between the two
  only: it is kept by those tokens, over all places and files. Rules marked ``~`` are kept by place. As nesting
  without brackets is marked so, no input is parsed more often than its length times the number of rules.
* ``failure`` is plain packrat parsing with every rule kept by place; it gives the furthest place at which a token
  was refused and the tokens that would have been accepted there.
"""

from __future__ import annotations

import re
import string
import sys
from collections.abc import Callable

OPEN, CLOSE = "([{", ")]}"
#: Results kept over files are thrown away beyond so many, and are kept by tokens only for so many tokens at most:
#: this bounds the memory of a worker; longer brackets are kept by their place while their text is read.
MOST_KEPT, LONGEST_KEY = 100_000, 256
#: Frames that one token can need. Calls of Python functions take no stack of the machine, so nesting as deep as a
#: text is long is parsed as any other.
FRAMES = 40


class Node:
    __slots__ = ("kind", "parts", "value")

    def __init__(self, kind: str, *parts: Node, value: object = None) -> None:
        self.kind, self.parts, self.value = kind, list(parts), value


LEXEME = re.compile(r"\s+|'(?:[^'\\]|\\.)+'|%%|[%/*+?&!()^.$]|[A-Z][A-Z0-9_]*|[a-z_][a-z0-9_]*")


def read_rules(text: str) -> dict[str, tuple[str, Node]]:
    """name -> (mark, expression); a mark is "", "@" or "~"."""
    rules: dict[str, tuple[str, Node]] = {}
    lines = re.sub(r"\n[ \t]+", " ", re.sub(r"(?m)^\s*#.*\n", "", text)).strip().split("\n")
    for line in filter(None, map(str.strip, lines)):
        m = re.match(r"([@~]?)([a-z_][a-z0-9_]*)\s*=\s*(.*)", line)
        if not m:
            raise ValueError(f"no rule: {line[:60]}")
        tokens, at = [], 0
        while at < len(m[3]):
            t = LEXEME.match(m[3], at)
            if not t:
                raise ValueError(f"{m[2]}: {m[3][at : at + 20]}")
            if t[0].strip():
                tokens.append(t[0])
            at = t.end()
        node, end = _choice(tokens, 0)
        if end != len(tokens) or m[2] in rules:
            raise ValueError(f"{m[2]}: can't read from {tokens[end:][:5]}")
        rules[m[2]] = (m[1], node)
    return rules


def _choice(t: list[str], i: int) -> tuple[Node, int]:
    node, i = _sequence(t, i)
    parts = [node]
    while i < len(t) and t[i] == "/":
        node, i = _sequence(t, i + 1)
        parts.append(node)
    return (Node("alt", *parts) if len(parts) > 1 else parts[0]), i


def _sequence(t: list[str], i: int) -> tuple[Node, int]:
    parts = []
    while i < len(t) and t[i] not in "/)":
        node, i = _item(t, i)
        while i < len(t) and t[i] in ("%", "%%"):
            mark = t[i]
            by, i = _item(t, i + 1)
            node = Node("seq", node, Node("star", Node("seq", by, node)), *([Node("opt", by)] if mark == "%%" else []))
        parts.append(node)
    return (parts[0] if len(parts) == 1 else Node("seq", *parts)), i


def _item(t: list[str], i: int) -> tuple[Node, int]:
    if t[i] in "&!":
        node, j = _item(t, i + 1)
        return Node("and" if t[i] == "&" else "not", node), j
    if t[i] == "(":
        node, i = _choice(t, i + 1)
        i += 1
    elif t[i] == "^":
        node, i = Node("tight", value=t[i + 1]), i + 2
    elif t[i] == ".":
        node, i = Node("any"), i + 1
    elif t[i] == "$":
        node, i = Node("end"), i + 1
    elif t[i][0] == "'" or t[i][0].isupper():
        node, i = Node("token", value=t[i]), i + 1
    else:
        node, i = Node("rule", value=t[i]), i + 1
    while i < len(t) and t[i] in ("*", "+", "?"):
        node, i = Node({"*": "star", "+": "plus", "?": "opt"}[t[i]], node), i + 1
    return node, i


class Grammar:
    """A grammar with its alphabet: ``letters`` maps each quoted token and class to its letter.

    With ``breaks``, line breaks are letters (``\\n``) that any token may follow; ``^'x'`` takes the token only
    without one, and ``BREAK`` is the line break itself.
    """

    def __init__(self, text: str, start: str, breaks: bool = False) -> None:
        self.rules, self.start, self.breaks = read_rules(text), start, breaks
        self.letters: dict[str, str] = {"BREAK": "\n"}
        spare = iter(c for c in string.ascii_letters + string.digits + "".join(map(chr, range(0xA1, 0x17F))))
        def visit(n: Node) -> None:
            if n.kind in ("token", "tight") and n.value not in self.letters:
                word = n.value[1:-1].replace("\\'", "'")
                self.letters[n.value] = word if len(word) == 1 and word in "()[]{};,.:=" and n.value[0] == "'" else next(spare)
            if n.kind == "rule" and n.value not in self.rules:
                raise ValueError(f"no rule {n.value}")
            for p in n.parts:
                visit(p)
        for _, node in self.rules.values():
            visit(node)
        self.names = {c: n for n, c in self.letters.items()}
        self._reach: dict[str, set[str]] = {n: self._refs(x) for n, (_, x) in self.rules.items()}
        changed = True
        while changed:
            changed = False
            for refs in self._reach.values():
                more = set().union(*(self._reach[r] for r in refs)) - refs if refs else set()
                if more:
                    refs |= more
                    changed = True
        self._firsts: dict[str, tuple[set[str] | None, bool]] = {}
        self.kept: dict[str, dict[str, bool]] = {n: {} for n, (m, _) in self.rules.items() if m == "@"}
        self._compile()

    def tokens(self) -> dict[str, str]:
        """Quoted tokens without their quotes -> letter."""
        return {n[1:-1].replace("\\'", "'"): c for n, c in self.letters.items() if n[0] == "'"}

    @staticmethod
    def _refs(node: Node) -> set[str]:
        own = {node.value} if node.kind == "rule" else set()
        return own.union(*(Grammar._refs(p) for p in node.parts))

    def _plain(self, node: Node) -> bool:
        """Whether a node is regular: it reaches no rule that is marked or reaches itself."""
        for r in self._refs(node):
            for x in {r} | self._reach[r]:
                if self.rules[x][0] or x in self._reach[x]:
                    return False
        return True

    def _regex(self, node: Node) -> str:
        k = node.kind
        lead = r"\n?+" if self.breaks else ""
        if k == "token":
            c = re.escape(self.letters[node.value])
            return c if node.value == "BREAK" else lead + c
        if k == "tight":
            return re.escape(self.letters[node.value])
        if k == "any":
            return lead + r"[^\0]"
        if k == "end":
            return lead + r"(?=\0)"
        if k == "rule":
            return f"(?>{self._regex(self.rules[node.value][1])})"
        inner = [self._regex(p) for p in node.parts]
        if k == "seq":
            return "".join(inner)
        if k == "alt":
            if all(p.kind == "token" and p.value != "BREAK" for p in node.parts):
                return lead + "[" + "".join(re.escape(self.letters[p.value]) for p in node.parts) + "]"
            return f"(?>{'|'.join(inner)})"
        return {"star": f"(?:{inner[0]})*+", "plus": f"(?:{inner[0]})++", "opt": f"(?:{inner[0]})?+", "and": f"(?={inner[0]})", "not": f"(?!{inner[0]})"}[k]

    def _first(self, node: Node, seen: frozenset[str] = frozenset()) -> tuple[set[str] | None, bool]:
        """The letters with which a match can begin (None: any), and whether it can be empty."""
        k = node.kind
        if k in ("token", "tight"):
            return (None if node.value == "BREAK" else {self.letters[node.value]}), False
        if k == "any":
            return None, False
        if k == "end":
            return {"\0"}, False
        if k == "rule":
            if node.value in self._firsts:
                return self._firsts[node.value]
            if node.value in seen:
                raise ValueError(f"left recursion in {node.value}")
            got = self._first(self.rules[node.value][1], seen | {node.value})
            self._firsts[node.value] = got
            return got
        if k in ("and", "not"):
            return set(), True
        if k == "seq":
            out: set[str] | None = set()
            for p in node.parts:
                f, empty = self._first(p, seen)
                out = None if out is None or f is None else out | f
                if not empty:
                    return out, False
            return out, True
        firsts = [self._first(p, seen) for p in node.parts]
        out = None if any(f is None for f, _ in firsts) else set().union(*(f for f, _ in firsts))
        return out, k in ("star", "opt") or any(e for _, e in firsts)

    def _compile(self) -> None:
        self._env: dict[str, object] = {"S": "", "P": [], "M": {}, "G": self.kept, "MOST": MOST_KEPT, "LONG": LONGEST_KEY}
        self._code: list[str] = []
        self._count = 0
        for name, (mark, node) in self.rules.items():
            body = self._function(node, f"b_{name}")
            if mark == "@":
                # the partner of the bracket is known; the tokens up to it are the key
                self._code.append(
                    f"def r_{name}(i):\n    a = i + 1 if S[i] == '\\n' else i\n    z = P.get(a)\n    if z is None: return -1\n"
                    f"    if z - a >= LONG:\n        ok = M.get(({name!r}, a))\n        if ok is None:\n            ok = M[({name!r}, a)] = {body}(a) == z + 1\n        return z + 1 if ok else -1\n"
                    f"    key = S[a:z + 1]\n    kept = G[{name!r}]\n    ok = kept.get(key)\n    if ok is None:\n"
                    f"        ok = {body}(a) == z + 1\n        if len(kept) > MOST: kept.clear()\n        kept[key] = ok\n    return z + 1 if ok else -1\n"
                )
            elif mark == "~":
                self._code.append(
                    f"def r_{name}(i):\n    r = M.get(({name!r}, i))\n    if r is None:\n        r = M[({name!r}, i)] = {body}(i)\n    return r\n"
                )
            else:
                self._code.append(f"r_{name} = {body}\n")
        exec(compile("\n".join(self._order()), f"<{self.start} grammar>", "exec"), self._env)  # noqa: S102

    def _order(self) -> list[str]:
        """Functions first, then the names and tables that refer to them."""
        functions = [c for c in self._code if c.startswith("def ")]
        aliases = [c for c in self._code if c.startswith("r_")]
        return functions + aliases + [c for c in self._code if c.startswith("T_")]

    def _name(self, kind: str) -> str:
        self._count += 1
        return f"{kind}_{self._count}"

    def _matcher(self, node: Node) -> str:
        name = self._name("x")
        self._env[name] = re.compile(self._regex(node)).match
        return name

    def _function(self, node: Node, name: str | None = None) -> str:
        """Write a function from a place to the place after a match, or -1; gives its name."""
        if node.kind == "rule" and name is None:
            return f"r_{node.value}"
        name = name or self._name("f")
        if self._plain(node):
            m = self._matcher(node)
            self._code.append(f"def {name}(i):\n    m = {m}(S, i)\n    return m.end() if m else -1\n")
            return name
        k = node.kind
        if k == "rule":
            self._code.append(f"def {name}(i):\n    return r_{node.value}(i)\n")
        elif k == "seq":
            lines, parts, at = [], node.parts, 0
            while at < len(parts):
                upto = at
                while upto < len(parts) and self._plain(parts[upto]):
                    upto += 1
                if upto > at:  # regular neighbours are one expression
                    m = self._matcher(Node("seq", *parts[at:upto]))
                    lines.append(f"    m = {m}(S, i)\n    if m is None: return -1\n    i = m.end()\n")
                    at = upto
                    continue
                p = parts[at]
                if p.kind == "opt":
                    lines.append(f"    j = {self._function(p.parts[0])}(i)\n    if j >= 0: i = j\n")
                elif p.kind == "star":
                    f = self._function(p.parts[0])
                    lines.append(f"    j = {f}(i)\n    while j > i:\n        i = j\n        j = {f}(i)\n")
                elif p.kind in ("and", "not"):
                    lines.append(f"    if {self._function(p.parts[0])}(i) {'<' if p.kind == 'and' else '>='} 0: return -1\n")
                else:
                    lines.append(f"    i = {self._function(p)}(i)\n    if i < 0: return -1\n")
                at += 1
            self._code.append(f"def {name}(i):\n" + "".join(lines) + "    return i\n")
        elif k == "alt":
            table, rest, functions = {}, [], []
            for p in node.parts:
                firsts, empty = self._first(p)
                functions.append((self._function(p), None if empty or firsts is None else firsts))
            letters = set().union(*(f for _, f in functions if f is not None))
            for c in sorted(letters):
                table[c] = [fn for fn, f in functions if f is None or c in f]
            rest = [fn for fn, f in functions if f is None]
            t = self._name("T")
            show = lambda fs: "(" + "".join(f"{f}, " for f in fs) + ")"
            self._code.append(f"{t} = {{{', '.join(f'{c!r}: {show(fs)}' for c, fs in table.items())}}}\n{t}_else = {show(rest)}\n")
            skip = "    if c == '\\n': c = S[i + 1]\n" if self.breaks else ""
            self._code.append(f"def {name}(i):\n    c = S[i]\n{skip}    for f in {t}.get(c, {t}_else):\n        j = f(i)\n        if j >= 0: return j\n    return -1\n")
        elif k in ("star", "plus"):
            f = self._function(node.parts[0])
            first = f"    i = {f}(i)\n    if i < 0: return -1\n" if k == "plus" else ""
            self._code.append(f"def {name}(i):\n{first}    j = {f}(i)\n    while j > i:\n        i = j\n        j = {f}(i)\n    return i\n")
        elif k == "opt":
            self._code.append(f"def {name}(i):\n    j = {self._function(node.parts[0])}(i)\n    return i if j < 0 else j\n")
        else:
            self._code.append(f"def {name}(i):\n    return {'i' if k == 'and' else '-1'} if {self._function(node.parts[0])}(i) >= 0 else {'-1' if k == 'and' else 'i'}\n")
        return name

    BRACKET = re.compile(r"[()\[\]{}]")

    def partners(self, letters: str) -> dict[int, int] | None:
        """The place of each opening bracket's partner; None if they aren't balanced."""
        stack: list[int] = []
        out: dict[int, int] = {}
        for m in self.BRACKET.finditer(letters):
            c = m[0]
            if c in OPEN:
                stack.append(m.start())
            elif not stack or OPEN.index(letters[stack[-1]]) != CLOSE.index(c):
                return None
            else:
                out[stack.pop()] = m.start()
        return None if stack else out

    def accepts(self, letters: str, start: str | None = None) -> bool:
        """Whether the start rule consumes all of a token string."""
        partners = self.partners(letters)
        if partners is None:
            return False
        env = self._env
        before = env["S"], env["P"], env["M"]
        sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES * len(letters) + 10_000))
        env["S"], env["P"], env["M"] = letters + "\0\0", partners, {}
        try:
            rule: Callable[[int], int] = env[f"r_{start or self.start}"]  # type: ignore[assignment]
            end = rule(0)
            if end >= 0 and self.breaks and letters[end:] == "\n":
                end += 1
            return end == len(letters)
        finally:
            env["S"], env["P"], env["M"] = before

    def failure(self, letters: str, start: str | None = None) -> tuple[int, list[str]] | None:
        """None if the start rule consumes all; else the furthest refused place and what was expected there."""
        s, n, memo = letters + "\0", len(letters), {}
        furthest, expected = -1, set()

        def refuse(i: int, what: str) -> int:
            nonlocal furthest, expected
            if quiet == 0:
                if i > furthest:
                    furthest, expected = i, {what}
                elif i == furthest:
                    expected.add(what)
            return -1

        quiet = 0

        def run(node: Node, i: int) -> int:
            nonlocal quiet
            k = node.kind
            if k in ("token", "tight", "any", "end"):
                a = i
                if self.breaks and k != "tight" and node.value != "BREAK" and s[i] == "\n" :
                    a = i + 1
                c = s[a] if a < len(s) else "\0"
                ok = c == "\0" if k == "end" else c != "\0" if k == "any" else c == self.letters[node.value]
                what = "end of file" if k == "end" else "any token" if k == "any" else str(node.value)
                return (a if k == "end" else a + 1) if ok else refuse(a, what)
            if k == "rule":
                key = (node.value, i)
                if key not in memo:
                    memo[key] = run(self.rules[node.value][1], i)
                return memo[key]
            if k == "seq":
                for p in node.parts:
                    i = run(p, i)
                    if i < 0:
                        return -1
                return i
            if k == "alt":
                for p in node.parts:
                    j = run(p, i)
                    if j >= 0:
                        return j
                return -1
            if k in ("and", "not"):
                quiet += 1
                j = run(node.parts[0], i)
                quiet -= 1
                return i if (j >= 0) == (k == "and") else refuse(i, "something else")
            j = run(node.parts[0], i)
            if k == "opt":
                return i if j < 0 else j
            if j < 0:
                return i if k == "star" else -1
            while j > i:
                i = j
                j = run(node.parts[0], i)
            return i

        sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES * len(letters) + 10_000))
        end = run(Node("rule", value=start or self.start), 0)
        if end >= 0 and self.breaks and letters[end:] == "\n":
            end += 1
        if end == n:
            return None
        if end > furthest:
            furthest, expected = end, {"end of file"}
        return min(furthest, n), sorted(expected)
