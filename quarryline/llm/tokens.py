"""Encoding of a corpus with a public byte-level BPE tokenizer, by a monoid tree over the halves of each text."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of a leaf of the tree; every text goes through the tree.
LEAF = 512
#: Texts handed on at once, so that a batch of long ones stays small in memory.
AT_ONCE = 512

#: The white space of Unicode.
SPACES = frozenset("\t\n\v\f\r \x85\xa0                　")

Encode = Callable[[str], list[int]]


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a public vocabulary file on this machine."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


#: The pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):  # noqa: ANN201
    """The tiktoken encoding of a rank file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _kind(c: str) -> str:
    if c in SPACES:
        return "W"
    kind = unicodedata.category(c)
    return {"L": "L", "N": "N"}.get(kind[0], "?" if kind in ("Cn", "Co", "Cs") or c.isspace() else "P")


def stable(before: str, after: str) -> bool:
    """Whether the splitting pattern always ends a piece between these two characters, whatever surrounds them.

    No alternative of the pattern holds a letter, digit or sign followed by white space, nor two of letter, digit
    and sign next to each other, but for the apostrophe of a contraction; and none looks behind. So text to the
    left of such a place and text to the right of it are encoded alike alone and together.
    """
    a, b = _kind(before), _kind(after)
    return a != b and a in "LNP" and b in "LNPW" and not (before == "'" and b == "L")


def _last_stable(text: str, start: int, end: int) -> int:
    """The last stable place inside a part of ``text`` (its start if there is none)."""
    for at in range(end - 1, start, -1):
        if stable(text[at - 1], text[at]):
            return at
    return start


def _first_stable(text: str, start: int, end: int) -> int:
    """The first stable place inside a part of ``text``; its end if there is none."""
    for at in range(start + 1, end):
        if stable(text[at - 1], text[at]):
            return at
    return end


#: A part of a text with its encoding: where it begins and ends, and its tokens in pieces that are joined at the end.
Part = tuple[int, int, list[list[int]]]


def join(encode: Encode, text: str, left: Part, right: Part) -> Part:
    """The encoding of two neighbours from their encodings: associative, with an empty part as its unit.

    Only the window between the last stable place of the left and the first of the right is encoded anew; the
    tokens outside it are proved to stay. The parts refer to ``text`` by place, and token lists are handed up as
    they are, so a join costs its window and what it takes off the ends of the lists, not the length of the parts.
    """
    (start, middle, ids_a), (_, end, ids_b) = left, right
    if start == middle or middle == end or stable(text[middle - 1], text[middle]):
        return start, end, _linked(ids_a, ids_b)
    cut_a, cut_b = _last_stable(text, start, middle), _first_stable(text, middle, end)
    _drop_last(ids_a, len(encode(text[cut_a:middle])))
    _drop_first(ids_b, len(encode(text[middle:cut_b])))
    ids_a.append(encode(text[cut_a:cut_b]))
    return start, end, _linked(ids_a, ids_b)


def _linked(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Two lists of pieces as one; the shorter one's pieces are moved."""
    if len(a) >= len(b):
        a.extend(b)
        return a
    b[:0] = a
    return b


def _drop_last(pieces: list[list[int]], n: int) -> None:
    while n and n >= len(pieces[-1]):
        n -= len(pieces.pop())
    if n:
        pieces[-1] = pieces[-1][:-n]


def _drop_first(pieces: list[list[int]], n: int) -> None:
    at = 0
    while n and n >= len(pieces[at]):
        n -= len(pieces[at])
        at += 1
    del pieces[:at]
    if n:
        pieces[0] = pieces[0][n:]


def encode_text(encode: Encode, text: str | None, leaf: int = LEAF) -> list[int]:
    """The token ids of a text; of an empty or null one none.

    The tree is worked off from its leaves, left to right: two parts of equal height are joined as soon as both are
    there, as in a binary counter, and the rest at the end.
    """
    if not text:
        return []
    parts: list[tuple[int, Part]] = []
    for start in range(0, len(text), leaf):
        end = min(start + leaf, len(text))
        height, part = 0, (start, end, [encode(text[start:end])])
        while parts and parts[-1][0] == height:
            height, part = height + 1, join(encode, text, parts.pop()[1], part)
        parts.append((height, part))
    whole = parts.pop()[1]
    while parts:
        whole = join(encode, text, parts.pop()[1], whole)
    return [i for piece in whole[2] for i in piece]


def decode_tree(pieces: Callable[[list[int]], bytes], ids: list[int], leaf: int = LEAF) -> str:
    """The text of token ids: the bytes of halves, put together up a tree."""
    level = [pieces(ids[at : at + leaf]) for at in range(0, len(ids), leaf)]
    while len(level) > 1:
        level = [b"".join(level[at : at + 2]) for at in range(0, len(level), 2)]
    return level[0].decode("utf-8") if level else ""


def decode_ids(path: str, ids: list[int], leaf: int = LEAF) -> str:
    """The text of token ids."""
    return decode_tree(encoding(path).decode_bytes, ids, leaf)


def encode_texts(texts: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row of ``texts`` with ``ids``, the token ids (array<int>) of its ``text``, in the text's place.

    Null and empty texts get an empty list. Rows are neither dropped nor merged, so repeated rows come out
    repeatedly; an empty table gives an empty table. Other columns pass through (one already named like the result
    is replaced). Nothing is shuffled: a long text is a tree inside its task, of work in proportion to its length.
    """
    where = path or vocabulary_path()
    kept = [c for c in texts.columns if c not in (text, ids)]
    source = texts.select(*kept, text)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in source.dtypes if n != text), f"`{ids}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(where).encode_ordinary
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                lists = [encode_text(encode, x) for x in batch.column(len(kept)).to_pylist()]
                offsets = pa.array([0, *accumulate(map(len, lists))], pa.int32())
                values = pa.array([i for ids_ in lists for i in ids_], pa.int32())
                columns = [*batch.columns[: len(kept)], pa.ListArray.from_arrays(offsets, values)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids])

    return source.mapInArrow(run, schema)


def count_tokens(texts: DataFrame, path: str | None = None, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """As encode_texts, but with the number of tokens (int; 0 for null and empty texts) instead of the ids."""
    where = path or vocabulary_path()
    kept = [c for c in texts.columns if c not in (text, count)]
    source = texts.select(*kept, text)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in source.dtypes if n != text), f"`{count}` int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(where).encode_ordinary
        for batch in batches:
            sizes = [len(encode_text(encode, x.as_py())) for x in batch.column(len(kept))]
            columns = [*batch.columns[: len(kept)], pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, count])

    return source.mapInArrow(run, schema)


def decode_texts(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """Every row with ``text``, what its token ids stand for, in their place; of null and empty lists the empty text.
    Ids that are no token's, and bytes that are no text, are an error."""
    where = path or vocabulary_path()
    kept = [c for c in rows.columns if c not in (text, ids)]
    source = rows.select(*kept, ids)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in source.dtypes if n != ids), f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(where, x or []) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, text])

    return source.mapInArrow(run, schema)
