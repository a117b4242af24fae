"""Scores of all queries against all documents of a scope, a block of documents and a block of queries at a time.

Of two blocks only their contents are shuffled, never pairs: what matches is found in postings of the block, and a row
leaves a task only as a result. Blocks hold a bounded number of items, except in the fusion, which places documents
against all others of their scope.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import STOP_WORDS

#: Items (postings, values) of a block of documents, queries of a block, and rows of a batch of results.
MOST_ITEMS, MOST_QUERIES, MOST_ROWS = 32_768, 4_096, 65_536
#: Documents of a piece, in which a block that is a whole scope comes, so that no row holds all of it.
MOST_DOCS = 2_048
_HUMP, _GAP, _STOP = re.compile("([a-z0-9])([A-Z])"), re.compile("[^a-z0-9]+"), frozenset(STOP_WORDS)
_BYTES = np.arange(256)
_CAPITAL, _SMALL = (_BYTES >= 65) & (_BYTES <= 90), ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57))
_REDUCED = np.where(_CAPITAL, _BYTES + 32, np.where(_SMALL, _BYTES, 32)).astype(np.uint8)
_LINE, _RUN = re.compile("\r?\n"), re.compile("[A-Za-z0-9_.@/-]{3,}")


def cells(docs: DataFrame, queries: DataFrame, items: int | None = MOST_ITEMS, asked: int = MOST_QUERIES) -> DataFrame:
    """(scope, block, docs, queries): every block of ``docs`` (scope, doc, n, ...) with every block of ``queries`` (scope,
    query, ...) of its scope, packed into arrays. ``n`` is how many items a document has; without ``items`` a scope is
    one block, its documents in several rows that follow each other, with ``block`` and queries the same. Only scopes of several blocks are broadcast, at most one per ``items`` items or ``asked`` queries."""
    def large(df: DataFrame, size: Column, most: int, name: str) -> DataFrame:
        sums = df.groupBy("scope").agg(F.sum(size).alias("s")).where(F.col("s") > most)
        return F.broadcast(sums.select("scope", F.ceil(F.col("s") / most).cast("int").alias(name)))

    wide = large(docs, F.lit(1), MOST_DOCS, "_pb") if items is None else large(docs, F.col("n"), items, "_db")
    many = large(queries, F.lit(1), asked, "_qb")

    def counted(df: DataFrame) -> DataFrame:
        df = df.where("scope is not null").join(many, "scope", "left")
        df = (df.withColumn("_db", F.lit(1)) if items is None else df).join(wide, "scope", "left")
        return df.fillna(1, ["_db", "_qb", *wide.columns[1:]])

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = ["scope", "_d", "_q"]

    def packed(df: DataFrame, own: str, blocks: str, other: str, others: str, key: str, name: str, rest: list[str]) -> DataFrame:
        put = df.withColumn(own, F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        piece = [F.pmod(F.xxhash64(key), F.col("_pb")).alias("_p")] if items is None and name == "docs" else []
        return put.repartition(parts, *keys).groupBy(*keys, *piece).agg(F.collect_list(F.struct(*rest)).alias(name))

    left = packed(counted(docs), "_d", "_db", "_q", "_qb", "doc", "docs", [c for c in docs.columns if c not in ("scope", "n")])
    right = packed(counted(queries), "_q", "_qb", "_d", "_db", "query", "queries", [c for c in queries.columns if c != "scope"])
    return left.join(right.hint("shuffle_merge"), keys).sortWithinPartitions(*keys).select("scope", F.struct("_d", "_q").alias("block"), "docs", "queries")


def scored(grid: DataFrame, rows: Callable[[pa.StructArray, pa.StructArray], Iterator[tuple]], schema: str, scoped: bool = True) -> DataFrame:
    """The results of all cells: ``rows`` takes the documents and queries of one and gives, query by query, the query's
    number and the arrays of a result: the documents' numbers first, then as many as ``schema`` has beyond query, scope
    and doc. Without ``scoped`` the results have no scope."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = ([batch.column(c)[k] for c in ("scope", "block", "docs", "queries")] for batch in batches for k in range(batch.num_rows))
        for _, pieces in groupby(rest, key=lambda row: (row[0].as_py(), *row[1].as_py().values())):
            scope, _, docs, queries = next(pieces)
            docs, queries = docs.values, queries.values
            more = [piece[2].values for piece in pieces]
            docs = pa.concat_arrays([docs, *more]) if more else docs
            names, asked = docs.field("doc"), queries.field("query")
            kept, size = [], 0

            def flush(kept: list[tuple] , size: int) -> pa.RecordBatch:
                q = np.repeat([x[0] for x in kept], [len(x[1]) for x in kept])
                columns = [np.concatenate(c) for c in zip(*(x[1:] for x in kept), strict=True)]
                values = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns[1:]]
                return pa.RecordBatch.from_arrays([asked.take(pa.array(q)), *([pa.repeat(scope, size)] if scoped else []), names.take(pa.array(columns[0])), *values], out)

            for row in rows(docs, queries):
                kept.append(row)
                size += len(row[1])
                if size >= MOST_ROWS:
                    yield flush(kept, size)
                    kept, size = [], 0
            if size:
                yield flush(kept, size)

    schema = f"query {grid.schema['queries'].dataType.elementType['query'].dataType.simpleString()}, {'scope string, ' * scoped}doc string, {schema}"
    out = [x.split()[0] for x in schema.split(", ")]
    return grid.mapInArrow(run, schema)


def _groups(keys: np.ndarray, n: int, *values: np.ndarray) -> list[list[np.ndarray]]:
    """Per number below ``n`` the values whose key it is."""
    order = np.argsort(keys, kind="stable")
    at = np.searchsorted(keys[order], np.arange(n + 1))
    # all parts of one array are views of one copy of it
    return [[v[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] for v in (v[order] for v in values)]


def _lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of lists, and how many each has; null lists have none."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _asked(queries: pa.StructArray, name: str) -> tuple[pa.Array, pa.Array, list[np.ndarray]]:
    """The queries' terms one after the other, the distinct ones, and per query the numbers of its terms."""
    flat, lengths = _lists(queries.field(name))
    terms = flat.field("term") if pa.types.is_struct(flat.type) else flat
    distinct = pc.unique(terms)
    return flat, distinct, np.split(pc.index_in(terms, distinct).to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(lengths)[:-1])


class Terms:
    """BM25 of documents (terms of term and tf, length) for queries (asked of term and idf, avg_length)."""

    def __init__(self, docs: pa.StructArray, queries: pa.StructArray) -> None:
        flat, distinct, self.own = _asked(queries, "asked")
        self.docs, idf = len(docs), np.zeros(len(distinct))
        idf[np.concatenate(self.own)] = flat.field("idf").to_numpy(zero_copy_only=False)
        posted, lengths = _lists(docs.field("terms"))
        term = pc.fill_null(pc.index_in(posted.field("term"), distinct), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc, tf = np.repeat(np.arange(len(docs)), lengths), posted.field("tf").to_numpy(zero_copy_only=False).astype(np.float64)
        met = term >= 0
        term, doc, tf = term[met], doc[met], tf[met]
        length = pc.fill_null(docs.field("length"), 0).to_numpy(zero_copy_only=False)
        average = pc.max(queries.field("avg_length")).as_py() or 1.0
        part = idf[term] * tf * 2.2 / (tf + 1.2 * (1 - 0.72 + 0.72 * length[doc] / average))
        self.by_doc, self.by_part = _groups(term, len(distinct), doc, part)

    def scores(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all documents for a query the score and how many of its terms each has."""
        at = [self.by_doc[t] for t in self.own[k]]
        if not at:
            return np.zeros(self.docs), np.zeros(self.docs, np.int64)
        at = np.concatenate(at)
        return np.bincount(at, np.concatenate([self.by_part[t] for t in self.own[k]]), self.docs), np.bincount(at, minlength=self.docs)

    def score(self, k: int) -> np.ndarray:
        """Of all documents for a query the score alone."""
        if not len(self.own[k]):
            return np.zeros(self.docs)
        return np.bincount(np.concatenate([self.by_doc[t] for t in self.own[k]]), np.concatenate([self.by_part[t] for t in self.own[k]]), self.docs)


def bm25_rows(top: int | None = None, digits: int | None = None) -> Callable[[pa.StructArray, pa.StructArray], Iterator[tuple]]:
    """Score, rounded to ``digits`` where given, and number of terms of each document that has a term of a query; with
    ``top`` the first so many of the block alone, by score and then by name."""
    def rows(docs: pa.StructArray, queries: pa.StructArray) -> Iterator[tuple]:
        names = docs.field("doc").to_pylist() if top else []
        order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        terms = Terms(docs, queries)
        for k in range(len(queries)):
            score, n = terms.scores(k)
            score = score if digits is None else np.round(score, digits)
            hit = np.flatnonzero(n)
            if top:
                hit = order[n[order] > 0]
                hit = hit[np.argsort(-score[hit], kind="stable")[:top]]
            yield k, hit, score[hit], n[hit]

    return rows


def _plain(text: str | None) -> str:
    """As matchable() in functions/text.py."""
    return _GAP.sub(" ", _HUMP.sub(r"\1 \2", text or "").lower()).strip(" ")


def _plains(values: pa.Array) -> np.ndarray:
    """_plain() of all texts, each followed by a newline, in ASCII."""
    values = pc.fill_null(values.cast(pa.string()), "")
    if not pc.all(pc.string_is_ascii(values)).as_py():
        values = pa.array([v if v.isascii() else _plain(v) for v in values.to_pylist()], pa.string())
    if not len(values):
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    text = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    # a blank before each capital after a small letter or digit of the same text, a newline after each text
    hump = np.zeros(len(text) + 1, bool)
    hump[1:-1] = _CAPITAL[text[1:]] & _SMALL[text[:-1]]
    hump[ends] = False
    before = np.cumsum(hump)
    out = np.full(len(text) + before[-1] + len(values), 32, np.uint8)
    out[np.arange(len(text)) + before[:-1] + np.repeat(np.arange(len(values)), np.diff(ends))] = _REDUCED[text]
    out[ends[1:] + before[ends[1:]] + np.arange(len(values))] = 10
    # single blanks, none at the start or end of a text
    blank = out == 32
    blank[1:] &= out[:-1] <= 32
    out = out[~blank] if out[0] == 32 else out[~np.concatenate(([False], blank[1:]))]
    blank = out == 32
    blank[:-1] &= out[1:] == 10
    return out[~blank]


class Matches:
    """match_score() of values for queries (text, terms), doubled, so that it is whole."""

    def __init__(self, values: pa.Array | list[str | None], queries: pa.StructArray) -> None:
        values = values if isinstance(values, pa.Array) else pa.array(values, pa.string())
        plain = _plains(values)
        at = np.flatnonzero(plain <= 32)
        sizes = np.diff(at, prepend=-1) - 1
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.cumsum(np.concatenate(([0], sizes))).astype(np.int32)), pa.py_buffer(plain[plain > 32]))
        value = np.cumsum(plain[at] == 10) - (plain[at] == 10)
        if not sizes.all():
            words, value = words.filter(pa.array(sizes > 0)), value[sizes > 0]
        words = words.dictionary_encode()
        word, words = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        _, distinct, own = _asked(queries, "terms")
        terms = distinct.to_pylist()
        heads: dict[str, list[tuple[str, int]]] = {}
        for k, t in enumerate(terms):
            if len(t) >= 4:
                heads.setdefault(t[:4], []).append((t, k))
        wholes = np.array([len(t) >= 2 and t not in _STOP for t in terms] + [False])
        whole = pc.fill_null(pc.index_in(words, distinct.cast(pa.string())), len(terms)).to_numpy(zero_copy_only=False).astype(np.int64)
        whole[~wholes[whole]] = -1
        listed = words.to_pylist()
        parts = [{k for i in range(len(w) - 3) for t, k in heads.get(w[i : i + 4], ()) if w.startswith(t, i)} for w in listed]
        many = np.array([len(x) for x in parts], np.int64)
        first, flat = np.cumsum(many) - many, np.array([t for x in parts for t in x], np.int64)
        hit, some = whole[word] >= 0, many[word]
        inner = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        self.whole = _Levels(value[hit], whole[word[hit]], len(values), len(terms))
        self.part = _Levels(np.repeat(value, some), flat[np.repeat(first[word], some) + inner], len(values), len(terms))
        self.own, self.terms = own, len(terms)
        self.texts = _plains(queries.field("text")).tobytes().decode().split("\n")[:-1]
        self.values, self.words, self.blob = len(values), set(listed), plain.tobytes()
        self.starts = np.concatenate(([0], np.flatnonzero(plain == 10) + 1))
        self.longest = int(np.diff(self.starts).max(initial=1)) - 1

    def scores(self, a: int, b: int) -> np.ndarray:
        """Of all values (rows), and of none (the last row), for the queries from ``a`` to before ``b``."""
        own = self.own[a:b]
        sizes = np.array([len(x) for x in own])
        count = np.uint8 if sizes.max(initial=0) < 255 else np.uint32
        asks = np.zeros((self.terms, b - a), count)
        for k, x in enumerate(own):
            if self.texts[a + k]:
                asks[x, k] = 1
        hits, parts = self.whole.sums(asks), self.part.sums(asks)
        np.minimum(parts, 4, out=parts)
        parts *= 3
        parts *= hits == 0
        every = hits == np.where(sizes > 0, sizes, np.iinfo(count).max).astype(count)
        score = np.zeros((self.values + 1, b - a), np.uint8)
        best = score[:-1]
        np.minimum(hits, 5, out=best, casting="unsafe")
        best += every
        best *= 4
        np.minimum(best, 18, out=best)
        np.maximum(best, parts, out=best, casting="unsafe")
        for k, q in enumerate(self.texts[a:b]):
            if q and len(q) <= self.longest and all(w in self.words for w in q.split(" ")[1:-1]):
                q = q.encode()
                at = self.blob.find(q)
                while at >= 0:
                    v = int(np.searchsorted(self.starts, at, "right")) - 1
                    best[v, k] = 28 if self.starts[v + 1] - self.starts[v] - 1 == len(q) else 20
                    at = self.blob.find(q, int(self.starts[v + 1]))
        return score


class _Levels:
    """Distinct pairs of a row and a member, of ``rows`` rows and ``n`` members, to sum up members' vectors per row."""

    def __init__(self, row: np.ndarray, member: np.ndarray, rows: int, n: int) -> None:
        pairs = np.unique(row * max(n, 1) + member)
        row, member = np.divmod(pairs, max(n, 1))
        self.order, self.levels = _by_level(row, rows)
        self.levels = [member[x] for x in self.levels]

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.order), vectors.shape[1]), vectors.dtype)
        for members in self.levels:
            out[: len(members)] += vectors.take(members, 0, mode="clip")
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(back))
        return out.take(back, 0, mode="clip")


def _by_level(row: np.ndarray, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows, those with most entries first, and the places of the first entries of the first rows, of the second
    entries, and so on."""
    sizes = np.bincount(row, minlength=rows)
    order = np.argsort(-sizes, kind="stable")
    entry = np.argsort(row, kind="stable")
    starts, ends = (np.cumsum(sizes) - sizes)[order], np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    return order, [entry[starts[:m] + level] for level, m in enumerate(ends)]


class Items:
    """Per document the sum over its items (values, own, add, n) of n times the best match of an item's values (of the
    document's name too, if ``own``) and ``add``, not below 0, where one matches."""

    def __init__(self, docs: pa.StructArray, queries: pa.StructArray, column: str = "items") -> None:
        items, sizes = _lists(docs.field(column))
        flat, lengths = _lists(items.field("values"))
        codes = flat.dictionary_encode()
        values = pa.concat_arrays([codes.dictionary.cast(pa.string()), docs.field("doc").cast(pa.string())])
        self.docs, doc = len(docs), np.repeat(np.arange(len(docs)), sizes)
        width = int(lengths.max(initial=0))
        at = np.full((width + 1, len(items)), len(values), np.int64)
        at[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(np.arange(len(items)), lengths)] = codes.indices.to_numpy(zero_copy_only=False)
        own = items.field("own").to_numpy(zero_copy_only=False).astype(bool)
        at[width][own] = len(codes.dictionary) + doc[own]
        add, n = items.field("add").to_numpy(zero_copy_only=False).astype(np.float64), items.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        self.adds, which = np.unique(add * 2, return_inverse=True)
        self.whole = bool((self.adds == np.rint(self.adds)).all() and np.abs(self.adds).max(initial=0) < 200)
        # values for each add follow each other, as the greatest value stays the greatest when it is added
        rows = [np.where(row < len(values), row + which * (len(values) + 1), -1) for row in at if (row < len(values)).any()]
        self.matches, self.parts = Matches(values, queries), []
        for single in (True, False):
            some = np.flatnonzero((n == 1) == single)
            if not len(some):
                continue
            # documents are summed in pieces of 64 items, so that none has more levels
            rank = np.arange(len(some)) - np.searchsorted(doc[some], doc[some])
            starts = np.flatnonzero(rank % 64 == 0)
            order, levels = _by_level(np.cumsum(rank % 64 == 0) - 1, len(starts))
            taken = []
            for level in (some[x] for x in levels):
                used = [row[level] for row in rows]
                taken.append((len(level), [np.where(x < 0, len(values), x) for x in used if (x >= 0).any()], None if single else n[level][:, None]))
            piece = doc[some][starts]
            self.parts.append((np.argsort(order), piece, np.flatnonzero(np.diff(piece, prepend=-1)), taken))
        most = np.bincount(doc, n, self.docs).max(initial=0) * 256
        self.sum = (np.int32 if most < 2**31 else np.int64) if self.whole else np.float64
        self.step = max(8, min(128, (1 << 22) // (len(values) + 1)))

    def totals(self) -> Iterator[tuple[int, np.ndarray]]:
        """By blocks of queries: the first one's number, and of each (rows) the totals of all documents, doubled."""
        for a in range(0, len(self.matches.own), self.step):
            b = min(a + self.step, len(self.matches.own))
            if not self.parts:
                yield a, np.zeros((b - a, self.docs), self.sum)
                continue
            score = self.matches.scores(a, b)
            if self.whole:
                worth = [score + (score > 0) * np.uint8(x) if x >= 0 else np.maximum(score, np.uint8(-x)) - np.uint8(-x) for x in self.adds]
            else:
                worth = [np.where(score > 0, np.maximum(0.0, score + x), 0.0) for x in self.adds]
            worth = np.concatenate(worth) if len(worth) > 1 else worth[0]
            sums = np.zeros((self.docs, b - a), self.sum)
            for back, piece, firsts, taken in self.parts:
                part = np.zeros((len(piece), b - a), self.sum)
                for size, rows, n in taken:
                    if rows:
                        best = worth.take(rows[0], 0, mode="clip")
                        for row in rows[1:]:
                            np.maximum(best, worth.take(row, 0, mode="clip"), out=best)
                        part[:size] += best if n is None else best * n.astype(self.sum)
                part = part.take(back, 0, mode="clip")
                sums[piece[firsts]] += part if len(firsts) == len(piece) else np.add.reduceat(part, firsts)
            yield a, np.ascontiguousarray(sums.T)


def item_rows(least: float | None = None, add: float = 0.0) -> Callable[[pa.StructArray, pa.StructArray], Iterator[tuple]]:
    """The totals of documents' items, above 0 or of ``least`` and more, plus ``add``."""
    def rows(docs: pa.StructArray, queries: pa.StructArray) -> Iterator[tuple]:
        for a, totals in Items(docs, queries).totals():
            for k, total in enumerate(totals, a):
                hit = np.flatnonzero(total > 0 if least is None else total >= 2 * least)
                if len(hit):
                    yield k, hit, total[hit] / 2 + add

    return rows


def _first(hit: np.ndarray, score: np.ndarray, names: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` best of the documents ``hit``, by score and then by their places in order of names."""
    if len(hit) > most:
        hit = hit[score[hit] >= np.partition(score[hit], -most)[-most]]
    return hit[np.lexsort((names[hit], -score[hit]))][:most]


def fused_rows(weights: dict[str, float], top: int = 20, tops: int = 18, raw: int | None = None) -> Callable[[pa.StructArray, pa.StructArray], Iterator[tuple]]:
    """(score, lanes, place) of each query's ``top`` documents: what dirty_lane(), graph_lane() and fuse() in retrieve.py
    give with exact, symbol and term lanes, for all documents of a scope (doc, rank, dirty, items, paths, terms, length,
    imports, edges) at once. ``weights`` is by lane. With ``raw`` also each query's first so many documents by terms
    alone, by score rounded to 6 digits and then by name; their lanes are empty."""
    lanes = ("exact", "symbol", "bm25", "dirty", "graph")
    label = [",".join(sorted(n for k, n in enumerate(lanes) if mask >> k & 1)) for mask in range(1 << len(lanes))]

    def rows(docs: pa.StructArray, queries: pa.StructArray) -> Iterator[tuple]:
        names, size = docs.field("doc").to_pylist(), len(docs)
        by_name = np.array(sorted(range(size), key=names.__getitem__), np.int64)
        rank = docs.field("rank").to_numpy(zero_copy_only=False).astype(np.float64)
        least = np.where(np.isnan(rank), -np.inf, -np.round(rank, 9))
        static = by_name[np.argsort(least[by_name], kind="stable")]
        place_of_name = np.argsort(by_name)
        extra = np.log2(np.maximum(np.where(np.isfinite(rank), rank, 0.0), 0.0) + 1) * 0.05
        dirty = np.where(docs.field("dirty").to_numpy(zero_copy_only=False).astype(bool), 8 + rank * 0.02, 0.0)
        changing = queries.field("changing").to_numpy(zero_copy_only=False)
        symbols, paths, terms = Items(docs, queries, "items"), Items(docs, queries, "paths"), Terms(docs, queries)
        number = pa.array(names, pa.string())
        ends = []
        for column in ("imports", "edges"):
            flat, lengths = _lists(docs.field(column))
            far = pc.fill_null(pc.index_in(flat, number), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            near, known = np.repeat(np.arange(size), lengths), far >= 0
            ends += [_groups(far[known], size, near[known])[0], _groups(near[known], size, far[known])[0]]
        by_place = [100 * weights[n] / (60 + np.arange(1, size + 1)) for n in lanes]
        place = np.argsort(static)
        bits = int(size).bit_length()

        def placed(score: np.ndarray, met: np.ndarray) -> np.ndarray:
            """The documents ``met``, by score rounded to 9 digits and then by their static places."""
            scaled = np.rint(score[met] * 1e9)
            if scaled.max(initial=0) >= 2.0 ** (62 - bits):
                met = static[np.sort(place[met])]
                return met[np.argsort(-np.round(score[met], 9), kind="stable")]
            return static[np.sort((-scaled.astype(np.int64) << bits) + place[met]) & ((1 << bits) - 1)]

        def add(sums: tuple[np.ndarray, ...], lane: int, score: np.ndarray, met: np.ndarray) -> None:
            reciprocal, raw, mask = sums
            met = placed(score, met)
            reciprocal[met] += by_place[lane][: len(met)]
            raw[met] += score[met] * weights[lanes[lane]]
            mask[met] |= 1 << lane

        def totals(items: Items) -> Iterator[np.ndarray]:
            return (total for _, block in items.totals() for total in block)

        some_dirty = np.flatnonzero(dirty > 0)
        for k, (exact, symbol) in enumerate(zip(totals(paths), totals(symbols), strict=True)):
            sums = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
            near = np.flatnonzero(exact >= 12)
            if len(near):
                add(sums, 0, exact / 2 + 8, near)
            alone = terms.score(k)
            if raw:
                score = np.round(alone, 6)
                best = _first(np.flatnonzero(alone), score, place_of_name, raw)
                yield k, best, score[best], np.full(len(best), "", object), np.arange(1, len(best) + 1, dtype=np.int32)
            for lane, score in ((1, symbol / 2), (2, alone)):
                met = np.flatnonzero(score > 0)
                if len(met):
                    add(sums, lane, score, met)
            if changing[k] and len(some_dirty):
                add(sums, 3, dirty, some_dirty)
            total = sums[0] + np.log(1 + sums[1]) + extra
            anchors = _first(np.flatnonzero(sums[2]), total, place_of_name, tops)
            met, worth = [], []
            for a in anchors:
                boosts = [min(18.0, 4 + total[a] * f) for f in (0.12, 0.1, 0.08, 0.06)]
                for side, s in zip(ends, (*boosts[:3], max(3.0, boosts[3] - 2)), strict=True):
                    if len(side[a]):
                        met.append(side[a])
                        worth.append(np.full(len(side[a]), s))
            if met:
                score = np.bincount(np.concatenate(met), np.concatenate(worth), size)
                met = np.flatnonzero(score > 0)
                add(sums, 4, score, met)
                total[met] = sums[0][met] + np.log(1 + sums[1][met]) + extra[met]
            total = np.round(total, 6)
            best = _first(np.flatnonzero(sums[2]), total, place_of_name, top)
            yield k, best, total[best], np.array([label[m] for m in sums[2][best]], object), np.arange(1, len(best) + 1, dtype=np.int32)

    return rows


def literal_rows(per_file: int, top: int | None = None) -> Callable[[pa.StructArray, pa.StructArray], Iterator[tuple]]:
    """On how many lines documents (texts) hold a term of a query (terms) literally, at most ``per_file``; with ``top`` of
    the first so many of the block alone, by hits and then by name, the first with the number of all and of their hits."""
    def rows(docs: pa.StructArray, queries: pa.StructArray) -> Iterator[tuple]:
        _, distinct, own = _asked(queries, "terms")
        terms = {t: k for k, t in enumerate(distinct.to_pylist())}
        lengths = sorted({len(t) for t in terms})
        held: dict[str, list[int]] = {}
        met: set[tuple[int, int]] = set()
        doc_of: list[int] = []
        for d, texts in enumerate(docs.field("texts").to_pylist()):
            lines: dict[int, int] = {}
            for text in texts:
                for number, line in enumerate(_LINE.split(text)):
                    for run in set(_RUN.findall(line)):
                        if (has := held.get(run)) is None:
                            has = held[run] = [terms[t] for t in {run[i : i + n] for n in lengths for i in range(len(run) - n + 1)} if t in terms]
                        if has:
                            at = lines.get(number)
                            if at is None:
                                at = lines[number] = len(doc_of)
                                doc_of.append(d)
                            met.update((t, at) for t in has)
        term, line = np.array(list(met), np.int64).reshape(-1, 2).T
        (by_term,) = _groups(term, len(terms), line)
        doc = np.array(doc_of, np.int64)
        names = docs.field("doc").to_pylist()
        place = np.argsort(np.array(sorted(range(len(names)), key=names.__getitem__), np.int64))
        for k, asked in enumerate(own):
            if any(len(by_term[t]) for t in asked):
                hits = np.minimum(np.bincount(doc[np.unique(np.concatenate([by_term[t] for t in asked]))], minlength=len(names)), per_file)
                hit = np.flatnonzero(hits)
                if not top:
                    yield k, hit, hits[hit]
                    continue
                first = _first(hit, hits, place, top)
                sums = np.zeros((2, len(first)), np.int64)
                sums[:, 0] = len(hit), hits.sum()
                yield k, first, hits[first], sums[0], sums[1]

    return rows
