"""Aggregations, ranks and top-k over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.schema import CONFIDENCE
from quarryline.session import cut


def count_by(rows: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows per key; a null key is a group of its own."""
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def composite_rank(
    files: DataFrame, imports: DataFrame, symbols: DataFrame, risks: DataFrame, tested: DataFrame,
    usages: DataFrame | None = None, churn: DataFrame | None = None, outcomes: DataFrame | None = None,
) -> DataFrame:
    """Files with the parts of their rank and the rank: importers, usages and symbols (damped), surface, tests, dirt,
    churn, risk, outcomes.

    ``usages`` has a row (repo, path) for each place where a file uses a symbol, ``churn`` (repo, path, commits),
    ``outcomes`` (repo, path, boost); without one its part is 0.

    Each fact table is counted per (repo, path) before it meets the files, so a hub is one row. Files without facts
    get zeros; facts of unknown files are ignored.
    """
    key = ["repo", "path"]
    incoming = count_by(imports.where("resolved is not null").select("repo", F.col("resolved").alias("path")), key, "importers")
    outgoing, syms = count_by(imports, key, "imported"), count_by(symbols, key, "symbols")
    risk = risks.groupBy(*key).agg(F.sum("score").alias("risk"))
    covered = tested.select(*key).distinct().withColumn("covered", F.lit(True))
    wide = files
    extra = {"used": None if usages is None else count_by(usages, key, "used"), "commits": None if churn is None else churn.groupBy(*key).agg(F.sum("commits").alias("commits")),
             "boost": None if outcomes is None else outcomes.groupBy(*key).agg(F.max("boost").alias("boost"))}
    for side in (incoming, outgoing, syms, risk, covered, *(x for x in extra.values() if x is not None)):
        wide = wide.join(side, key, "left")
    wide = wide.withColumns({name: F.lit(0) for name, x in extra.items() if x is None})
    wide = wide.fillna(0, ["importers", "imported", "symbols", "used", "commits"]).fillna(0.0, ["risk", "boost"])
    path = F.col("path")
    parts = {
        "centrality": F.log2(F.col("importers") + 1),
        "usage": F.log2(F.col("used") + 1),
        "symbol_part": F.least(F.col("symbols"), F.lit(20)) / 4,
        "surface": F.when(path.contains("/api/") | path.contains("app.") | path.contains("index."), 2.0).otherwise(0.0),
        "near_tests": F.when(F.col("is_test"), 0.5).when(F.col("covered"), 1.5).otherwise(0.0),
        "dirt": F.when(F.col("dirty"), 3.0).otherwise(0.0),
        "risk_part": F.least(F.col("risk"), F.lit(12.0)),
        "made": F.when(F.col("generated"), -2.0).otherwise(0.0),
        "churn": F.least(F.col("commits"), F.lit(20)) / 4,
        "outcome": F.least(F.col("boost"), F.lit(3.0)).cast("double"),
    }
    wide = wide.withColumns(parts)
    total = F.lit(0.0)
    for name in parts:
        total = total + F.col(name)
    return wide.withColumn("rank", total)


def counts_map(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the counts of a value as sorted text ``value=n, ...``; null values are left out."""
    inner = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    entry = F.concat_ws("=", F.col(value), F.col("n"))
    return inner.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("counts"))


def tier_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key one column for each confidence."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col("confidence") == c).alias(c) for c in CONFIDENCE))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their ``place``; for bounded groups (see topn for unbounded ones).

    The window's limit is pushed below its shuffle, so at most k rows of a key leave any task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def with_total(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """As top_k, and beside each row ``total``, the number of rows before the limit."""
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    return top_k(rows, keys, order, k).join(totals, keys)


def within_budget(rows: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The rows of each key up to which the running sum of sizes stays within the budget."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(window)).where(F.col("used") <= budget)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by ``order``: an aggregation, so nothing is sorted."""
    rest = [c for c in rows.columns if c not in keys]
    picked = F.min(F.struct(*order, *(c for c in rest if c not in order)))
    return rows.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*")


def latest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last by ``order``, ties going to the greatest of the other columns."""
    rest = [c for c in rows.columns if c not in keys]
    picked = F.max(F.struct(*order, *(c for c in rest if c not in order)))
    return rows.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*")


def module_rollup(ranked: DataFrame, edges: DataFrame, top: int = 8) -> DataFrame:
    """(repo, module, files, rank, top_files, relations, cross_relations): relations touch a file of the module;
    those between two modules are counted in both."""
    sums = ranked.groupBy("repo", "module").agg(F.count("*").alias("files"), F.sum("rank").alias("rank"))
    best = top_k(ranked, ["repo", "module"], [F.col("rank").desc(), F.col("path").asc()], top)
    names = best.groupBy("repo", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]), ",").alias("top_files"))
    modules = ranked.select("repo", "path", "module")
    ends = edges.select("repo", "edge_id", "from_path", "to_path")
    a = modules.select("repo", F.col("path").alias("from_path"), F.col("module").alias("m1"))
    b = modules.select("repo", F.col("path").alias("to_path"), F.col("module").alias("m2"))
    placed = ends.join(a, ["repo", "from_path"], "left").join(b, ["repo", "to_path"], "left")
    touched = placed.select("repo", F.explode(F.array_distinct(F.array_compact(F.array("m1", "m2")))).alias("module"), (F.col("m1") != F.col("m2")).alias("cross"))
    relations = touched.groupBy("repo", "module").agg(F.count("*").alias("relations"), F.count_if("cross").alias("cross_relations"))
    return sums.join(names, ["repo", "module"]).join(relations, ["repo", "module"], "left").fillna(0, ["relations", "cross_relations"])


def centrality(nodes: DataFrame, links: DataFrame, rounds: int = 4, damping: float = 0.85, most: float = 2.0) -> DataFrame:
    """(scope, node, score, part): damped importance passed along links (scope, source, target), within each scope.

    Parallel links count each; what nodes without links hold is not passed on; a fixed number of rounds, each one
    join and one aggregation over link counts. ``part`` is log2(score * nodes + 1) - 1, between 0 and ``most``.
    """
    sizes = nodes.groupBy("scope").agg(F.count("*").alias("n"))
    base = cut(nodes.select("scope", "node").join(sizes, "scope"))
    inside = links.join(base.select("scope", F.col("node").alias("source")), ["scope", "source"], "left_semi")
    inside = inside.join(base.select("scope", F.col("node").alias("target")), ["scope", "target"], "left_semi")
    out = inside.groupBy("scope", "source").agg(F.count("*").alias("degree"))
    multi = cut(inside.groupBy("scope", "source", "target").agg(F.count("*").alias("k")).join(out, ["scope", "source"]))
    score = base.withColumn("score", 1 / F.col("n"))
    for _ in range(rounds):
        sent = multi.join(score.select("scope", F.col("node").alias("source"), "score"), ["scope", "source"])
        got = sent.groupBy("scope", F.col("target").alias("node")).agg(F.sum(F.lit(damping) * F.col("score") * F.col("k") / F.col("degree")).alias("got"))
        score = base.join(got, ["scope", "node"], "left").select("scope", "node", "n", ((1 - damping) / F.col("n") + F.coalesce("got", F.lit(0.0))).alias("score"))
    part = F.least(F.lit(most), F.greatest(F.lit(0.0), F.log2(F.col("score") * F.col("n") + 1) - 1))
    return score.select("scope", "node", "score", part.alias("part"))


def diffusion(nodes: DataFrame, links: DataFrame, rounds: int = 8, base: float = 0.15, forward: float = 0.12, back: float = 0.04, cap: float = 50.0) -> DataFrame:
    """(scope, node, score): weight spread along links (scope, source, target, weight, reflects) for some rounds.

    A node starts with 1 and keeps ``base`` of its start each round; a link gives its target ``forward`` times its
    weight (between .1 and 4) of the source's score, and where it reflects gives ``back`` the other way.
    """
    start = cut(nodes.select("scope", "node").distinct())
    strength = F.least(F.lit(4.0), F.greatest(F.lit(0.1), F.col("weight")))
    ahead = links.groupBy("scope", "source", "target").agg(F.sum(strength * forward).alias("w"))
    behind = links.where("reflects").groupBy("scope", F.col("target").alias("source"), F.col("source").alias("target")).agg((F.count("*") * back).alias("w"))
    flow = cut(ahead.unionByName(behind))
    score = start.withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        got = flow.join(score.select("scope", F.col("node").alias("source"), "score"), ["scope", "source"])
        got = got.groupBy("scope", F.col("target").alias("node")).agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        score = start.join(got, ["scope", "node"], "left").select("scope", "node", F.least(F.lit(cap), F.lit(base) + F.coalesce("got", F.lit(0.0))).alias("score"))
    return score
