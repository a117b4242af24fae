"""Joins: candidates in order, tiers, nearest scope, ranges, prefixes, containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may stand behind an import's path before it is a file, in order.
SUFFIXES = (
    "", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".json", ".rs", ".go", ".java", ".md", "/index.ts", "/index.tsx", "/index.js", "/index.jsx",
    "/__init__.py", "/mod.rs", "/index.json", "/README.md",
)


def first_hit(rows: DataFrame, candidates: Column, targets: DataFrame, scope: str, target: str) -> DataFrame:
    """Rows with ``hit``: the first of their candidates that is a target of the same scope; null if none is.

    Candidates (an array, best first) become rows with their place, meet the targets by equality, and the least
    place wins. ``rows`` must tell its rows apart by ``row_id``.
    """
    tried = rows.select("row_id", scope, F.posexplode(candidates).alias("place", target))
    found = tried.join(targets.select(scope, target).distinct(), [scope, target])
    best = found.groupBy("row_id").agg(F.min_by(target, "place").alias("hit"))
    return rows.join(best, "row_id", "left")


def import_candidates(path: Column, specifier: Column) -> Column:
    """Where a relative or dotted import of a file may lead, best first; a package outside has no candidates."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    relative = specifier.startswith(".")
    ups = F.size(F.split(F.regexp_extract(specifier, r"^((?:\.\./)*)", 1), r"\.\./")) - 1
    rest = F.regexp_replace(specifier, r"^(?:\./|(?:\.\./)+)", "")
    parts = F.split(folder, "/")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - ups)), "/")
    joined = F.when(base == "", rest).otherwise(F.concat_ws("/", base, rest))
    swapped = F.regexp_replace(joined, r"\.js$", ".ts")
    dotted = F.translate(specifier, ".", "/")
    ends = F.array(*map(F.lit, SUFFIXES))
    near = F.concat(F.transform(ends, lambda e: F.concat(joined, e)), F.array(swapped))
    far = F.concat(F.transform(F.slice(ends, 2, len(SUFFIXES)), lambda e: F.concat(dotted, e)), F.array(dotted))
    return F.when(relative, near).otherwise(far)


def unique_or_none(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key its value if there is exactly one distinct one; keys with more are left out."""
    return rows.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_other")).where(F.col(value) == F.col("_other")).drop("_other")


def tiered(rows: DataFrame, tiers: list[DataFrame], keys: list[list[str]]) -> DataFrame:
    """Rows with ``hit`` and ``tier``: the first of several lookups (each with ``hit`` unique per key) that answers."""
    out = rows
    hits = []
    for k, (side, on) in enumerate(zip(tiers, keys, strict=True)):
        out = out.join(side.withColumnRenamed("hit", f"_hit{k}"), on, "left")
        hits.append(F.col(f"_hit{k}"))
    tier = F.coalesce(*(F.when(h.isNotNull(), F.lit(k)) for k, h in enumerate(hits)))
    return out.withColumn("hit", F.coalesce(*hits)).withColumn("tier", tier).drop(*(f"_hit{k}" for k in range(len(hits))))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = 64) -> DataFrame:
    """Pairs of rows of equal keys whose closed ranges overlap: left (a_from, a_to), right (b_from, b_to).

    Ranges fall into buckets of lines, and the keys are joined together with the bucket, so a large group is spread;
    a pair that shares several buckets is kept in the first of them. Ranges with a null end have no place.
    """
    def spread(df: DataFrame, low: str, high: str) -> DataFrame:
        first, last = F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket)
        return df.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    met = spread(left, "a_from", "a_to").join(spread(right, "b_from", "b_to"), [*keys, "_bucket"])
    met = met.where((F.col("a_from") <= F.col("b_to")) & (F.col("b_from") <= F.col("a_to")))
    return met.where(F.col("_bucket") == F.floor(F.greatest("a_from", "b_from") / bucket)).drop("_bucket")


def narrowest(pairs: DataFrame, key: str, low: str, high: str, name: str) -> DataFrame:
    """Of the ranges that hold each row the narrowest, ties going to the lesser start, then name."""
    return pairs.groupBy(key).agg(F.min_by(name, F.struct(F.col(high) - F.col(low), F.col(low), F.col(name))).alias("enclosing"))


def nearest_scope(rows: DataFrame, folders: Column, scopes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the nearest of their ancestor folders that ``scopes`` (keys..., folder) knows; null if none is."""
    tried = rows.select("row_id", *keys, F.posexplode(folders).alias("distance", "folder"))
    found = tried.join(scopes.select(*keys, "folder").distinct(), [*keys, "folder"])
    best = found.groupBy("row_id").agg(F.min_by("folder", "distance").alias("scope"))
    return rows.join(best, "row_id", "left")


def longest_prefix(rows: DataFrame, value: str, prefixes: DataFrame) -> DataFrame:
    """Rows with the longest of ``prefixes`` (prefix, replacement) that their value begins with.

    Every beginning of the value that has the length of some prefix is looked up by equality, so no row is compared
    with all prefixes; the distinct lengths are few and are read first.
    """
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]
    starts = F.array(*(F.substring(F.col(value), 1, n) for n in sorted(lengths, reverse=True))) if lengths else F.array().cast("array<string>")
    tried = rows.select("row_id", F.explode(F.array_distinct(starts)).alias("prefix"))
    found = tried.join(prefixes, "prefix").groupBy("row_id").agg(F.max_by(F.struct("prefix", "replacement"), F.length("prefix")).alias("p"))
    return rows.join(found, "row_id", "left").select(*rows.columns, "p.prefix", "p.replacement")


def endpoint_key(endpoint: Column) -> Column:
    """A route without query, host and final slash, its dynamic segments as ``{}``, so that routes meet by equality."""
    path = F.regexp_replace(F.regexp_replace(endpoint, r"[?#].*$", ""), r"^https?://[^/]+", "")
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(r"^(\{.*\}|\$\{.*\}|:.+|<.+>|\[.+\])$"), F.lit("{}")).otherwise(s))
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def resolved_targets(asked: DataFrame, symbols: DataFrame, most: int = 20) -> DataFrame:
    """(scope, name, tier, symbol_id, ambiguous): what each asked name (scope, name) means.

    ``symbols`` has (scope, symbol_id, qualified_name, name), each id once. An id counts first, then a qualified name,
    then a name; a tier that has any symbol decides: one is the answer, of several the first ``most`` ids are listed
    and the answer is null. Names of no symbol come out with nothing; null scopes and names aren't answered.
    """
    want = asked.where("scope is not null and name is not null").select("scope", "name").distinct()
    tiers = (("id", "symbol_id"), ("qualified", "qualified_name"), ("name", "name"))
    known = [symbols.select("scope", F.col(c).alias("name"), F.lit(n).alias("tier"), F.lit(k).alias("_k"), "symbol_id") for k, (n, c) in enumerate(tiers)]
    # per name and tier the count and the least ids only: a name that millions of symbols bear is one row
    least = reduce(DataFrame.unionByName, known).join(want, ["scope", "name"], "left_semi").groupBy("scope", "name", "tier", "_k", "symbol_id").agg(F.count("*").alias("_c"))
    place = F.row_number().over(Window.partitionBy("scope", "name", "_k").orderBy("symbol_id"))
    least = least.withColumn("_p", place).where(F.col("_p") <= most)
    listed = least.groupBy("scope", "name", "_k", "tier").agg(F.array_sort(F.collect_list("symbol_id")).alias("ids"))
    first = listed.groupBy("scope", "name").agg(F.min_by(F.struct("tier", "ids"), "_k").alias("r"))
    one = F.size("r.ids") == 1
    got = want.join(first, ["scope", "name"], "left")
    return got.select("scope", "name", F.col("r.tier").alias("tier"), F.when(one, F.col("r.ids")[0]).alias("symbol_id"), F.when(~one, F.col("r.ids")).alias("ambiguous"))


def planned_changes(changed: DataFrame, planned: DataFrame) -> DataFrame:
    """``changed`` (scope, path, old_path, ...) with ``planned``: whether the plan (scope, path) of its scope has its
    path or the path that it had before a rename. Repeated plans count once; a null old path is none."""
    plan = planned.where("path is not null").select("scope", "path").distinct().withColumn("_hit", F.lit(True))
    now = changed.join(plan, ["scope", "path"], "left").withColumnRenamed("_hit", "_now")
    before = plan.select("scope", F.col("path").alias("old_path"), F.col("_hit").alias("_before"))
    both = now.join(before, ["scope", "old_path"], "left")
    return both.withColumn("planned", F.coalesce("_now", "_before", F.lit(False))).select(*changed.columns, "planned")
