"""Structured Streaming: memory entries kept per key, change signatures, and windows over event streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryline.operators.memory import ENTRY, fold_frame


def memory_stream(events: DataFrame) -> DataFrame:
    """A stream of entries (ENTRY) from a stream of events: each batch's events of an entry are folded into its state
    and the entry as it is then comes out. Events that arrive late are folded when they arrive."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry = json.loads(state.get[0]) if state.exists else None
        if entry:
            entry |= {k: pd.Timestamp(entry[k]) for k in ("created_at", "updated_at")}
        entry = fold_frame(entry, pd.concat(list(frames)))
        if entry is None:
            return
        state.update((json.dumps(entry, default=str),))
        yield pd.DataFrame([entry])[[c.split()[0] for c in ENTRY.split(", ")]]

    keyed = events.where("entry_id is not null and at is not null").groupBy("entry_id")
    return keyed.applyInPandasWithState(update, ENTRY, "entry string", "update", GroupStateTimeout.NoTimeout)


def signature(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, signature, entries) that tells whether (path, hash) entries changed, per ``keys`` where some are given and
    else in one row: their order doesn't matter."""
    one = F.sha1(F.concat_ws("\0", "path", F.coalesce("hash", F.lit("missing"))))
    # digests are added up, so the table is never gathered or sorted
    part = F.conv(F.substring(one, 1, 12), 16, 10).cast("decimal(38,0)")
    return entries.distinct().groupBy(*keys).agg(F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("signature"), F.count("*").alias("entries"))


def on_change(rebuild: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that calls ``rebuild`` with a batch of changes unless its signature is the last one's."""
    last: list[str] = []

    def each(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        now = signature(batch.select("path", "hash")).first()["signature"]
        if last != [now]:
            rebuild(batch)
            last[:] = [now]

    return each


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type of events (ts, event_type, value), closed once their time has passed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: events no further apart than ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", "s.start", "s.end", "n")
