"""Set operations: deltas, multiset differences, unions where the existing wins, plan against actual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys only after (``new``) or only before (``removed``)."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    new = b.exceptAll(a).withColumn("change", F.lit("new"))
    return new.unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def multiset_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that ``after`` has more often than ``before``, with how many more."""
    cols = before.columns
    return after.select(*cols).exceptAll(before).groupBy(*cols).agg(F.count("*").alias("more"))


def existing_wins(existing: DataFrame, external: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those external ones whose keys aren't there yet; columns only one has are null."""
    fresh = external.join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def plan_against_actual(planned: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with ``state``: ``planned`` (both), ``unplanned`` (changed only) or ``untouched`` (planned only)."""
    p = planned.select(*keys).distinct().withColumn("_p", F.lit(True))
    c = changed.select(*keys).distinct().withColumn("_c", F.lit(True))
    state = F.when(F.col("_p").isNull(), "unplanned").when(F.col("_c").isNull(), "untouched").otherwise("planned")
    return p.join(c, keys, "full").select(*keys, state.alias("state"))


def changed_since(baseline: DataFrame, now: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of ``now`` whose key the baseline lacks or whose value differs from it (null equals null only)."""
    old = baseline.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_there"))
    met = now.join(old, keys, "left")
    return met.where(F.col("_there").isNull() | ~F.col(value).eqNullSafe(F.col("_old"))).select(*now.columns)
