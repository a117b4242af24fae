"""Hybrid retrieval: lanes of evidence per query and their fusion by weighted reciprocal ranks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.paths import base_name, module_of, stem
from quarryline.functions.text import bm25_idf, rank_log2, tokenize
from quarryline.operators import pairs
from quarryline.schema import LANE_WEIGHT
from quarryline.session import cut


def weighted_terms(parts: list[tuple[DataFrame, list[tuple[Column, Column | int]]]]) -> DataFrame:
    """(scope, doc, term, tf) from (rows with scope and doc, their texts with weights): a term counts a text's weight
    once per row. Texts are shuffled to their document, as they are shorter than their terms."""
    texts = [df.select("scope", "doc", F.array(*(F.struct(text.alias("text"), (w if isinstance(w, Column) else F.lit(w)).cast("long").alias("w")) for text, w in some)).alias("texts")) for df, some in parts]
    each = reduce(DataFrame.unionByName, texts).repartition("scope", "doc").select("scope", "doc", F.explode("texts").alias("t"))
    counted = each.groupBy("scope", "doc", "t.text").agg(F.sum("t.w").alias("w")).where("text is not null")
    return counted.select("scope", "doc", F.explode(tokenize(F.col("text"))).alias("term"), "w").groupBy("scope", "doc", "term").agg(F.sum("w").alias("tf"))


def file_terms(files: DataFrame, symbols: DataFrame, imports: DataFrame, risks: DataFrame) -> DataFrame:
    """Weighted terms of files from their paths, modules, stems, languages, symbols, imports and risks."""
    def at(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({"repo": "scope", "path": "doc"})
    f, s, i, r = at(files), at(symbols), at(imports), at(risks)
    doc = F.col("doc")
    loud = F.when(F.col("exported"), 3).otherwise(2)
    return weighted_terms([
        (f, [(doc, 3), (module_of(doc), 2), (stem(doc), 3), (F.col("language"), 1), (F.when(F.col("is_test"), "test spec verification"), 2), (F.when(F.col("dirty"), "dirty changed worktree"), 2)]),
        (s, [(F.col("name"), loud), (F.col("qualified_name"), loud), (F.col("kind"), F.lit(2))]),
        (i, [(F.col("specifier"), 2), (F.col("imported_name"), 1), (F.col("local_name"), 1), (F.col("resolved"), 1)]),
        (r.groupBy("scope", "doc", "signal_id").agg(F.count("*").alias("n")), [(F.col("signal_id"), F.col("n") * 2)]),
    ])


def term_lists(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(scope, doc, terms, length, n): the terms of each known document in one row, and the sum and number of them."""
    lists = terms.groupBy("scope", "doc").agg(F.collect_list(F.struct("term", "tf")).alias("terms"), F.sum("tf").alias("length"), F.count("*").alias("n"))
    return lists.join(docs.select("scope", "doc").distinct(), ["scope", "doc"], "left_semi")


def asked_terms(lists: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, scope, asked, avg_length): per query (query, scope, terms) those of its terms that occur in its scope,
    with their weight in it, and the documents' mean length there."""
    sizes = docs.select("scope", "doc").distinct().join(lists.select("scope", "doc", "length"), ["scope", "doc"], "left")
    scopes = sizes.groupBy("scope").agg(F.count("*").alias("docs"), F.avg(F.greatest(F.lit(1), F.coalesce("length", F.lit(0)))).alias("avg_length"))
    df = lists.select("scope", F.explode("terms.term").alias("term")).groupBy("scope", "term").agg(F.count("*").alias("df"))
    asked = queries.select("query", "scope", F.explode("terms").alias("term")).join(df, ["scope", "term"]).join(scopes, "scope")
    term = F.struct("term", bm25_idf(F.col("docs"), F.col("df")).alias("idf"))
    return asked.groupBy("query", "scope").agg(F.array_sort(F.collect_list(term)).alias("asked"), F.max("avg_length").alias("avg_length"))


def bm25(terms: DataFrame, docs: DataFrame, queries: DataFrame, top: int | None = None, digits: int | None = None) -> DataFrame:
    """(query, scope, doc, score, matched): BM25 of documents (scope, doc) for queries (query, scope, terms).

    Statistics are those of the query's scope, over all its documents. Only documents that share a term appear. Scores
    are rounded to ``digits`` where given. With ``top`` only those come that can be among the first so many of a query,
    by score and then by name, and a few others.
    """
    lists = cut(term_lists(terms, docs))
    grid = pairs.cells(lists, asked_terms(lists, docs, queries), 2 * pairs.MOST_ITEMS)
    return pairs.scored(grid, pairs.bm25_rows(top, digits), "score double, matched long")


def item(add: Column, n: Column, own: Column, *values: str | Column) -> Column:
    """Values to match, beside the path if ``own``, what to add, and how often."""
    some = F.array_distinct(F.array_compact(F.array(*values)))
    return F.struct(some.alias("values"), own.alias("own"), add.alias("add"), n.cast("long").alias("n"))


def items(df: DataFrame, add: Column, n: Column, *values: str | Column) -> DataFrame:
    """(scope, doc, item) from rows (repo, path): values to match beside the path, what to add, and how often."""
    return df.select(F.col("repo").alias("scope"), F.col("path").alias("doc"), item(add, n, F.col("path").isNotNull(), *values).alias("item"))


def item_lists(parts: list[DataFrame]) -> DataFrame:
    """(scope, doc, items, n): the items of each document in one row, and the number of their values."""
    size = F.size("item.values") + 1
    return reduce(DataFrame.unionByName, parts).groupBy("scope", "doc").agg(F.collect_list("item").alias("items"), F.sum(size).alias("n"))


def matched(lists: DataFrame, queries: DataFrame, least: float | None = None, add: float = 0.0, scoped: bool = True) -> DataFrame:
    """(query, scope, doc, score): the sums of the items that match, above 0 or of ``least`` and more, plus ``add``;
    without ``scoped`` no scope."""
    grid = pairs.cells(cut(lists), queries.select("query", "scope", "text", "terms"))
    return pairs.scored(grid, pairs.item_rows(least, add), "score double", scoped)


def exact_lane(queries: DataFrame, files: DataFrame, scoped: bool = True) -> DataFrame:
    """(query, scope, doc, score): files whose path, name or stem matches the query with 6 or more, plus 8."""
    path = F.col("path")
    lists = item_lists([items(files.where("path is not null"), F.lit(0.0), F.lit(1), base_name(path), stem(path))])
    return matched(lists, queries, 6.0, 8.0, scoped)


def symbol_items(symbols: DataFrame, imports: DataFrame | None = None, usages: DataFrame | None = None, bound: Column | None = None) -> DataFrame:
    """(scope, doc, items, n) of symbols, imports and usages, as symbol_lane() scores them. Rows are shuffled to their
    document as they are, as few of one document are near each other before."""
    parts = [items(symbols, F.when(F.col("exported"), 4.0).otherwise(1.0), F.lit(1), "name", "qualified_name")]
    if imports is not None:
        some = [item(F.lit(1.0), F.lit(1), F.lit(False), "specifier", "imported_name", "local_name", "resolved")]
        if bound is not None:
            some.append(F.when(bound.isNotNull(), item(F.lit(-1.0), F.lit(1), F.col("path").isNotNull(), bound)))
        parts.append(imports.select(F.col("repo").alias("scope"), F.col("path").alias("doc"), F.explode(F.array_compact(F.array(*some))).alias("item")))
    if usages is not None:
        parts.append(items(usages, F.lit(-1.0), F.col("n"), "name", "text"))
    return item_lists([reduce(DataFrame.unionByName, parts).repartition("scope", "doc")])


def symbol_lane(queries: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, usages: DataFrame | None = None, scoped: bool = True, bound: Column | None = None) -> DataFrame:
    """(query, scope, doc, score): per file the sum over its symbols that match by name, qualified name or path, 4
    more for exported ones, 1 for others; over its imports that match by specifier, imported, local or resolved name, 1
    more; and over its usages (repo, path, name, text, n) that match by name, text or path, 1 less, but no less than 0.
    With ``bound`` each import that has such a name is a usage of it too."""
    return matched(symbol_items(symbols, imports, usages, bound), queries, scoped=scoped)


def dirty_lane(queries: DataFrame, files: DataFrame) -> DataFrame:
    """(query, scope, doc, score): dirty files, for queries about changing, debugging or testing."""
    asks = queries.where(F.arrays_overlap("intents", F.array(*map(F.lit, ("implementation", "debugging", "testing")))))
    f = files.where("dirty").select(F.col("repo").alias("scope"), F.col("path").alias("doc"), (8 + F.col("rank") * 0.02).alias("score"))
    return asks.select("query", "scope").join(f, "scope")


def graph_lane(anchors: DataFrame, imports: DataFrame, edges: DataFrame, tops: int = 18) -> DataFrame:
    """(query, scope, doc, score): files next to the ``tops`` best anchors (query, scope, doc, score) of each query."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc()))
    best = anchors.withColumn("p", place).where(F.col("p") <= tops).select("query", "scope", F.col("doc").alias("anchor"), "score")
    def boost(factor: float) -> Column:
        return F.least(F.lit(18.0), 4 + F.col("score") * factor)
    i = imports.where("resolved is not null").select(F.col("repo").alias("scope"), "path", "resolved")
    e = edges.where("from_path is not null and to_path is not null").select(F.col("repo").alias("scope"), "from_path", "to_path")
    parts = [
        best.join(i.withColumnRenamed("resolved", "anchor"), ["scope", "anchor"]).select("query", "scope", F.col("path").alias("doc"), boost(0.12).alias("s")),
        best.join(i.withColumnRenamed("path", "anchor"), ["scope", "anchor"]).select("query", "scope", F.col("resolved").alias("doc"), boost(0.1).alias("s")),
        best.join(e.withColumnRenamed("to_path", "anchor"), ["scope", "anchor"]).select("query", "scope", F.col("from_path").alias("doc"), boost(0.08).alias("s")),
        best.join(e.withColumnRenamed("from_path", "anchor"), ["scope", "anchor"]).select("query", "scope", F.col("to_path").alias("doc"), F.greatest(F.lit(3.0), boost(0.06) - 2).alias("s")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("query", "scope", "doc").agg(F.sum("s").alias("score"))


def fuse(lanes: dict[str, DataFrame], ranks: DataFrame) -> DataFrame:
    """(query, scope, doc, score, lanes): lanes (query, scope, doc, score) fused: the sum of 100 * weight / (60 +
    place in the lane) and the log of 1 + weighted scores, and a little of the file's rank.

    ``ranks`` has (scope, doc, rank). Within a lane entries with a positive score are placed by score, rank, name.
    """
    tagged = [df.where("score > 0").select("query", "scope", "doc", "score", F.lit(name).alias("lane"), F.lit(LANE_WEIGHT[name]).alias("w")) for name, df in lanes.items()]
    every = reduce(DataFrame.unionByName, tagged).join(ranks.select("scope", "doc", "rank"), ["scope", "doc"])
    place = F.row_number().over(Window.partitionBy("query", "lane").orderBy(F.round("score", 9).desc(), F.round("rank", 9).desc(), F.col("doc").asc()))
    placed = every.withColumn("place", place)
    sums = placed.groupBy("query", "scope", "doc").agg(
        F.sum(100 * F.col("w") / (60 + F.col("place"))).alias("reciprocal"), F.sum(F.col("score") * F.col("w")).alias("raw"),
        F.max("rank").alias("rank"), F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes"),
    )
    score = F.col("reciprocal") + F.log(1 + F.col("raw")) + rank_log2(F.col("rank")) * 0.05
    return sums.select("query", "scope", "doc", score.alias("score"), "lanes")


def fused(queries: DataFrame, ranked: DataFrame, symbol_items: DataFrame, terms: DataFrame, imports: DataFrame, edges: DataFrame, top: int = 20, raw: int | None = None) -> DataFrame:
    """(query, scope, doc, score, lanes, place): the ``top`` best documents of each query (query, scope, text, terms,
    intents) by the exact, symbol, term, dirty and graph lanes fused, as fuse() does it. With ``raw`` also the first so
    many by terms alone, with empty lanes.

    A query is placed against all documents of its scope where these are packed together, so no lane is written or
    shuffled; memory of a task grows with the largest scope's files, symbols and terms. ``symbol_items`` is of
    symbol_items(), ``terms`` of file_terms().
    """
    def far(df: DataFrame, path: str, target: str, name: str) -> DataFrame:
        some = df.where(F.col(path).isNotNull() & F.col(target).isNotNull())
        return some.groupBy(F.col("repo").alias("scope"), F.col(path).alias("doc")).agg(F.collect_list(target).alias(name))

    key = ["scope", "doc"]
    path = F.col("path")
    f = ranked.select(F.col("repo").alias("scope"), path.alias("doc"), "rank", "dirty", F.array(F.struct(F.array(base_name(path), stem(path)).alias("values"), F.lit(True).alias("own"), F.lit(0.0).alias("add"), F.lit(1).cast("long").alias("n"))).alias("paths"))
    lists = cut(term_lists(terms, f))
    docs = f.join(symbol_items.drop("n"), key, "left").join(lists.drop("n"), key, "left").join(far(imports, "path", "resolved", "imports"), key, "left").join(far(edges, "from_path", "to_path", "edges"), key, "left").withColumn("n", F.lit(1))
    changing = F.arrays_overlap("intents", F.array(*map(F.lit, ("implementation", "debugging", "testing")))).alias("changing")
    q = queries.select("query", "scope", "text", "terms", changing).join(asked_terms(lists, f, queries), ["query", "scope"], "left")
    return pairs.scored(pairs.cells(cut(docs), q, None, 2048), pairs.fused_rows(LANE_WEIGHT, top, raw=raw), "score double, lanes string, place int")


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, least: float, block: int = 256, rows: int = 4096) -> DataFrame:
    """(query_id, vec_id, score): the k vectors (vec_id, embedding) of greatest cosine above ``least`` per query.

    Exact and in blocks: vectors are packed into blocks of ``rows``, queries into blocks of ``block``; every pair of
    blocks is one matrix product in a task, of which at most k per query and block go on. No side is broadcast.
    A vector is no neighbour of the query with its own id. Null, empty and zero vectors have no neighbours.
    """
    def packed(df: DataFrame, id_: str, size: int, name: str) -> DataFrame:
        good = df.where(F.col(id_).isNotNull() & (F.size("embedding") > 0)).select(F.col(id_).alias("id"), "embedding")
        count = good.count()
        blocks = max(1, -(-count // size))
        put = good.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        return put.groupBy(name).agg(F.collect_list(F.struct("id", "embedding")).alias(f"{name}_rows")), blocks

    left, many = packed(queries, "query_id", block, "q")
    right, _ = packed(vectors, "vec_id", rows, "v")
    grid = right.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).join(left, "q").select("q_rows", "v_rows")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for qs, vs in part.itertuples(index=False):
                qi, vi = np.array([x["id"] for x in qs]), np.array([x["id"] for x in vs])
                a, b = np.array([x["embedding"] for x in qs], np.float64), np.array([x["embedding"] for x in vs], np.float64)
                na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
                a, b = a / np.where(na > 0, na, 1)[:, None], b / np.where(nb > 0, nb, 1)[:, None]
                scores = a @ b.T
                scores[qi[:, None] == vi[None, :]] = -2
                for i in range(len(qi)):
                    good = np.flatnonzero(scores[i] > least)
                    order = good[np.lexsort((vi[good], -np.round(scores[i][good], 9)))][:k]
                    if len(order):
                        yield pd.DataFrame({"query_id": qi[i], "vec_id": vi[order], "score": scores[i][order]})

    near = grid.mapInPandas(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("vec_id").asc()))
    return near.withColumn("place", place).where(F.col("place") <= k)


def covering_lane(queries: DataFrame, files: DataFrame, tested: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query, scope, doc, score): tests that cover a seed file (20, 16 or 10 by confidence) or match by their path.

    ``tested`` has (repo, path, target, confidence), ``seeds`` (query, scope, doc), the files found so far.
    """
    worth = F.when(F.col("confidence") == "authoritative", 20.0).when(F.col("confidence") == "derived", 16.0).otherwise(10.0)
    edges = tested.select(F.col("repo").alias("scope"), F.col("path").alias("test"), F.col("target").alias("doc"), worth.alias("s"))
    covering = seeds.select("query", "scope", "doc").distinct().join(edges, ["scope", "doc"]).select("query", "scope", F.col("test").alias("doc"), "s")
    tests = item_lists([items(files.where("is_test"), F.lit(4.0), F.lit(1), base_name(F.col("path")))])
    named = matched(tests, queries).withColumnRenamed("score", "s")
    return covering.unionByName(named).groupBy("query", "scope", "doc").agg(F.sum("s").alias("score"))


def workflow_lane(workflows: DataFrame, steps: DataFrame) -> DataFrame:
    """(query, scope, doc, score): files of the workflows of each query: entries by rank, steps by their kind, and the
    targets of steps a little less. ``workflows`` (query, scope, workflow, entry, rank), ``steps`` (workflow, kind,
    path, target)."""
    worth = F.coalesce(*(F.when(F.col("kind").isin(*kinds), s) for kinds, s in ((("entry", "ui"), 18.0), (("endpoint",), 16.0), (("store", "adapter", "manifest"), 15.0), (("test",), 12.0))), F.lit(7.0))
    entries = workflows.select("query", "scope", F.col("entry").alias("doc"), (18 + F.col("rank") * 0.1).alias("s"))
    met = workflows.select("query", "scope", "workflow").join(steps, "workflow").withColumn("s", worth)
    own = met.select("query", "scope", F.col("path").alias("doc"), "s")
    far = met.where("target is not null").select("query", "scope", F.col("target").alias("doc"), F.greatest(F.lit(5.0), F.col("s") - 4).alias("s"))
    return entries.unionByName(own).unionByName(far).groupBy("query", "scope", "doc").agg(F.sum("s").alias("score"))


def chunks(files: DataFrame, symbols: DataFrame, imports: DataFrame, most: int = 80) -> DataFrame:
    """(repo, path, chunk): the text under which a file is embedded: its path, its first symbols and imports."""
    def listed(df: DataFrame, value: str, order: list[Column]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("repo", "path").orderBy(*order))
        some = df.where(F.col(value).isNotNull()).withColumn("p", place).where(F.col("p") <= most)
        return some.groupBy("repo", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", value))), lambda x: x[value]), " ").alias(f"{value}s"))

    s = listed(symbols, "name", [F.col("start_line").asc_nulls_last(), F.col("symbol_id").asc()])
    i = listed(imports, "specifier", [F.col("specifier").asc(), F.col("import_id").asc()])
    out = files.select("repo", "path").join(s, ["repo", "path"], "left").join(i, ["repo", "path"], "left")
    return out.select("repo", "path", F.concat_ws("\n", "path", "names", "specifiers").alias("chunk"))
