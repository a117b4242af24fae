"""Packets: evidence of several sources merged per file, split into what to read first, and fitted to a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.ranking import top_k
from quarryline.schema import TIERS, ordinal

#: Files to read first for a kind of change, and tests among them.
READ_FIRST = {"style": (8, 3), "api": (24, 6), "rename": (24, 6), "delete": (24, 6)}
READ_ELSE = (14, 6)
#: Characters that count as a token of a text budget.
CHARACTERS_PER_TOKEN = 4


def merge_evidence(sources: dict[str, DataFrame], most: int = 8) -> DataFrame:
    """(query, path, tier, score, sources): evidence (query, path, confidence, score) of several sources per file: the
    best confidence, the sum of scores, and up to ``most`` source names."""
    tagged = [df.select("query", "path", "confidence", "score", F.lit(name).alias("source")) for name, df in sources.items()]
    every = reduce(DataFrame.unionByName, tagged)
    out = every.groupBy("query", "path").agg(F.min(ordinal(F.col("confidence"))).alias("t"), F.sum("score").alias("score"), F.array_join(F.slice(F.array_sort(F.collect_set("source")), 1, most), ",").alias("sources"))
    return out.select("query", "path", F.element_at(F.array(*map(F.lit, TIERS)), F.col("t") + 1).alias("tier"), "score", "sources")


def source_summary(evidence: DataFrame) -> DataFrame:
    """Per source how many files it gave by their best tier there: (source, authoritative, derived, heuristic)."""
    best = evidence.groupBy("source", "path").agg(F.min(ordinal(F.col("confidence"))).alias("t"))
    return best.groupBy("source").agg(*(F.count_if(F.col("t") == k).alias(n) for k, n in enumerate(TIERS[:3])))


def split_fanout(affected: DataFrame) -> DataFrame:
    """Affected files (query, path, change_type, is_target, is_test, tier, risk, rank) with ``read_first`` and ``place``.

    Targets come first, then some tests, then others by tier, risk and rank, up to a number that depends on the kind
    of change; the rest is collapsed.
    """
    kind = F.col("change_type")
    breadth = F.coalesce(*(F.when(kind == k, b) for k, (b, _) in READ_FIRST.items()), F.lit(READ_ELSE[0]))
    tests = F.coalesce(*(F.when(kind == k, t) for k, (_, t) in READ_FIRST.items()), F.lit(READ_ELSE[1]))
    order = [ordinal(F.col("tier")).asc(), F.col("risk").desc(), F.col("rank").desc(), F.col("path").asc()]
    group = F.when(F.col("is_target"), 0).when(F.col("is_test"), 1).otherwise(2)
    within = F.row_number().over(Window.partitionBy("query", group).orderBy(*order))
    late = (group == 1) & (within > tests)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("_late").asc(), F.col("_group").asc(), *order))
    rows = affected.withColumns({"_group": group, "_late": late}).withColumn("place", place)
    return rows.withColumn("read_first", ~F.col("_late") & (F.col("place") <= breadth)).drop("_group", "_late")


def combined_search(raw: DataFrame, ranked: DataFrame, limit: int = 20, few_files: int = 3, few_hits: int = 20) -> DataFrame:
    """(query, path, origin, place): raw hits (query, path, hits) first and then ranked files (query, path, score); a
    query whose raw hits are few is answered by them alone. ``raw`` may hold only the first hits of a query, if it says
    in ``files`` and ``all_hits``, summed over these, how many there are."""
    sums = (F.sum("files"), F.sum("all_hits")) if "files" in raw.columns else (F.count("*"), F.sum("hits"))
    size = raw.groupBy("query").agg(sums[0].alias("files"), sums[1].alias("all_hits"))
    enough = size.where((F.col("files") <= few_files) & (F.col("all_hits") <= few_hits)).select("query").withColumn("_enough", F.lit(True))
    a = raw.select("query", "path", F.lit("raw").alias("origin"), F.lit(0).alias("o"), F.col("hits").cast("double").alias("s"))
    b = ranked.join(enough, "query", "left_anti").select("query", "path", F.lit("ranked").alias("origin"), F.lit(1).alias("o"), F.col("score").alias("s"))
    first = a.unionByName(b).groupBy("query", "path").agg(F.min(F.struct("o", (-F.col("s")).alias("n"), "origin")).alias("r")).select("query", "path", "r.*")
    return top_k(first, ["query"], [F.col("o").asc(), F.round("n", 9).asc(), F.col("path").asc()], limit).select("query", "path", "origin", "place")


def required_checks(checks: DataFrame, touched: DataFrame, ran: DataFrame) -> DataFrame:
    """Checks (check_id, files, tests) as ``covered`` (one of their tests ran), ``missing``, or ``not_applicable``
    (none of their files was touched). ``touched`` has (path), ``ran`` (path)."""
    f = checks.select("check_id", F.explode("files").alias("path")).join(touched.select("path").distinct(), "path", "left_semi").select("check_id").distinct().withColumn("_t", F.lit(True))
    t = checks.select("check_id", F.explode("tests").alias("path")).join(ran.select("path").distinct(), "path", "left_semi").select("check_id").distinct().withColumn("_r", F.lit(True))
    state = F.when(F.col("_t").isNull(), "not_applicable").when(F.col("_r"), "covered").otherwise("missing")
    return checks.join(f, "check_id", "left").join(t, "check_id", "left").select("check_id", state.alias("state"))


def fit_tokens(lines: DataFrame, keys: list[str], order: list[Column], tokens: int) -> DataFrame:
    """Lines (text) of each key in order as long as they fit the budget, counted in characters with line ends."""
    size = F.length("text") + 1
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("used", F.sum(size).over(window)).where(F.col("used") <= max(1000, tokens * CHARACTERS_PER_TOKEN))


def quality(evidence: DataFrame) -> DataFrame:
    """(query, authoritative, derived, heuristic, level): high with an authoritative source and no majority of guesses,
    low where guesses outnumber the rest, else medium."""
    c = evidence.groupBy("query").agg(*(F.count_if(ordinal(F.col("confidence")) == k).alias(n) for k, n in enumerate(TIERS[:3])))
    guesses = F.col("heuristic") > F.col("authoritative") + F.col("derived")
    return c.withColumn("level", F.when(guesses, "low").when(F.col("authoritative") > 0, "high").otherwise("medium"))
