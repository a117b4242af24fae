"""Lexers: a text becomes a string with one letter per token of a grammar."""

from __future__ import annotations

import re
from collections.abc import Callable

#: The letter of anything that is no token of the language; no grammar takes it.
WRONG = "\x01"
#: Tokens whose letters are remembered, before the memory is emptied.
MOST_KNOWN = 200_000


class Letters(dict):
    """Token text -> letter(s), worked out once per distinct token."""

    def __init__(self, classify: Callable[[str], str]) -> None:
        super().__init__()
        self._classify = classify

    def __missing__(self, token: str) -> str:
        if len(self) > MOST_KNOWN:
            self.clear()
        letter = self[token] = self._classify(token)
        return letter


def alternatives(words: list[str]) -> str:
    """A regular expression for the longest of some operators."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def clean(text: str) -> str:
    """Line ends as \\n; a byte-order mark at the front left out."""
    return text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")
