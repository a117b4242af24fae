"""What changed between consecutive full snapshots of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Snapshots of one series are numbered; so many numbers share a block, within which predecessors are found.
BLOCK = 1024


def with_predecessor(snapshots: DataFrame) -> DataFrame:
    """Add ``prev_id``, the snapshot before, to (series, snap_id, seq); null for the first of a series.

    Two levels, so that no series is ever sorted in one task: inside blocks of the sequence, then over one row
    per block. Equal numbers are ordered by snap_id. An empty input gives an empty result.
    """
    placed = snapshots.withColumn("block", F.floor(F.col("seq") / F.lit(BLOCK)))
    inside = Window.partitionBy("series", "block").orderBy("seq", "snap_id")
    placed = placed.withColumn("prev_in", F.lag("snap_id").over(inside))
    ends = placed.groupBy("series", "block").agg(F.max(F.struct("seq", "snap_id")).alias("tail"))
    over = Window.partitionBy("series").orderBy("block")
    ends = ends.select("series", "block", F.lag("tail.snap_id").over(over).alias("prev_out"))
    return placed.join(ends, ["series", "block"]).select(
        "series", "snap_id", "seq", F.coalesce("prev_in", "prev_out").alias("prev_id")
    )


def snapshot_changes(snapshots: DataFrame, rows: DataFrame, values: list[str]) -> DataFrame:
    """Rows (series, snap_id, key, change_kind) that were added, removed or changed against the snapshot before.

    ``snapshots`` has (series, snap_id, seq), one row per full snapshot; ``rows`` has (snap_id, key, *values), at
    most one row per snapshot and key. EXCEPT ALL in both directions removes what is identical (null equals null
    only), a full join by key labels the residues. The first snapshot of a series has no changes; a snapshot
    without rows removes all of its predecessor's. Snapshots whose series, id or number is null have no place in
    any order and are left out, as are rows of unknown snapshots or with a null key. Empty tables give no rows.
    Other columns of either table, whatever their names, are not read.
    """
    known = snapshots.where("series is not null and snap_id is not null and seq is not null")
    linked = with_predecessor(known.select("series", "snap_id", "seq").distinct()).where("prev_id is not null")
    held = rows.where("snap_id is not null and key is not null").select("snap_id", "key", *values)
    links = linked.select("snap_id", "prev_id")
    # each entry counts twice: as the content of its own snapshot and as the past of the one after
    now = held.join(links.select("snap_id"), "snap_id", "left_semi")
    past = held.withColumnRenamed("snap_id", "prev_id").join(links, "prev_id").select("snap_id", "key", *values)
    came = now.exceptAll(past).select("snap_id", "key", F.lit(True).alias("came"))
    went = past.exceptAll(now).select("snap_id", "key", F.lit(True).alias("went"))
    kind = (
        F.when(F.col("went").isNull(), "added").when(F.col("came").isNull(), "removed").otherwise("changed")
    )
    found = came.join(went, ["snap_id", "key"], "full").select("snap_id", "key", kind.alias("change_kind"))
    return found.join(linked.select("series", "snap_id"), "snap_id").select("series", "snap_id", "key", "change_kind")
