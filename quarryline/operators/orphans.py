"""References to records that do not exist, by bitmaps of keys per key range and period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import cut, skew_join

#: Bits of one bitmap (Spark's bitmap functions), and keys that one range is planned for.
BITS, KEYS_PER_RANGE = 32_768, 16_384
#: A key with more than this part of all references is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 64


def month(t: Column) -> Column:
    """Months since year 0."""
    return F.year(t) * 12 + F.month(t) - 1


def pack(bitmap: bytes) -> bytes:
    """A compressed bitmap: the sorted places of its bits while those are shorter, else the bits; at its front a or b."""
    bits = np.frombuffer(bitmap, np.uint8)
    places = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    return b"a" + places.astype("<u2").tobytes() if 2 * len(places) < len(bits) else b"b" + bitmap


def unpack(packed: bytes) -> np.ndarray:
    """The bits of a packed bitmap as one uint8 array of BITS / 8 bytes."""
    if packed[:1] == b"b":
        return np.frombuffer(packed, np.uint8, offset=1)
    flags = np.zeros(BITS, np.uint8)
    flags[np.frombuffer(packed, "<u2", offset=1)] = 1
    return np.packbits(flags, bitorder="little")


def _packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for name in ("refs", "whole", "some"):
            part[name] = part[name].map(pack)
        yield part


def _survivors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decode refs AND NOT whole; a surviving bit that is also in some needs a look at the hour."""
    for part in parts:
        out: list[pd.DataFrame] = []
        for key_range, period, refs, whole, some in part.itertuples(index=False):
            left = unpack(refs) & ~unpack(whole)
            at = np.flatnonzero(np.unpackbits(left, bitorder="little"))
            if len(at):
                unsure = np.unpackbits(unpack(some), bitorder="little")[at].astype(bool)
                out.append(pd.DataFrame({"key_id": (key_range - 1) * BITS + 1 + at, "period": period, "unsure": unsure}))
        if out:
            yield pd.concat(out)


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``references`` (ref, t, ...) for which ``parents`` (ref, since, until) has no row alive at t.

    A parent is alive from ``since`` up to, not at, ``until`` (null: for good); one without ``since`` never is.
    A reference with a null ``ref`` is none; one with a null ``t`` has no parent at that time and comes out.
    All other columns of ``references`` pass through, repeated rows too. Empty tables are allowed.

    Keys of both sides are reduced to distinct (key, month) pairs before any shuffle, numbered densely within key
    ranges, and put into one bitmap per key range and month each for: referenced, parent alive all month, parent
    alive for a part of it. Referenced AND NOT alive-all-month leaves the bits to decode. Of these only keys with
    a parent for a part of the month are compared hour by hour. Hot keys are spread over salts where the decoded
    keys meet the references again.
    """
    named = references.where("ref is not null").withColumn("_period", F.coalesce(month(F.col("t")), F.lit(-1)))
    used = named.groupBy("ref", "_period").agg(F.count("*").alias("n"))
    used = cut(used)
    total, pairs = (x or 0 for x in used.agg(F.sum("n"), F.count("*")).first())
    hot = used.groupBy("ref").agg(F.sum("n").alias("n")).where(F.col("n") > max(total * HOT_SHARE, 10_000)).select("ref")

    lives = parents.where("ref is not null and since is not null and (until is null or until > since)")
    # only keys that are referred to are numbered, so a range holds as many keys as it was planned for
    lives = lives.select("ref", "since", "until").distinct().join(used.select("ref").distinct(), "ref", "left_semi")
    # a parent is marked in the months in which its key is referred to, not in all months of its life
    born, dead = month(F.col("since")), month(F.col("until"))
    spans = lives.select("ref", born.alias("born"), dead.alias("dead")).distinct().join(used.where("_period >= 0").select("ref", "_period"), "ref")
    spans = spans.where("_period >= born and (dead is null or _period <= dead)")
    partial = F.col("_period").isin(0) | (F.col("_period") == F.col("born")) | F.coalesce(F.col("_period") == F.col("dead"), F.lit(False))
    spans = spans.select("ref", "_period", F.when(partial, 2).otherwise(1).alias("role")).distinct()

    marks = used.select("ref", "_period", F.lit(0).alias("role")).unionByName(spans)
    ranges = max(1, -(-pairs // KEYS_PER_RANGE))
    marks = marks.withColumn("_range", F.pmod(F.xxhash64("ref"), F.lit(ranges)))
    place = F.dense_rank().over(Window.partitionBy("_range").orderBy("ref"))
    marks = cut(marks.withColumn("key_id", F.col("_range") * 2**24 + place))

    def bitmap(role: int) -> Column:
        return F.bitmap_construct_agg(F.when(F.col("role") == role, F.bitmap_bit_position("key_id")))

    # Spark's bitmaps count from 1: bitmap k holds the ids from (k - 1) * BITS + 1
    maps = marks.groupBy(F.bitmap_bucket_number("key_id").alias("key_range"), F.col("_period").alias("period")).agg(
        bitmap(0).alias("refs"), bitmap(1).alias("whole"), bitmap(2).alias("some")
    )
    maps = maps.mapInPandas(_packed, "key_range long, period int, refs binary, whole binary, some binary")
    missing = maps.mapInPandas(_survivors, "key_id long, period int, unsure boolean")
    words = marks.where("role = 0").select("key_id", "_period", "ref")
    missing = missing.withColumnRenamed("period", "_period").join(words, ["key_id", "_period"]).drop("key_id")

    spread = F.xxhash64(*references.columns)
    suspects = skew_join(named, missing, ["ref", "_period"], _per_period(hot, used), spread)
    sure = suspects.where("not unsure")
    unsure = suspects.where("unsure").withColumn("_t", F.col("t"))
    alive = skew_join(unsure, lives, ["ref"], hot, spread).where("since <= _t and (until is null or until > _t)")
    unsure = unsure.join(alive.select("ref", "_t").distinct(), ["ref", "_t"], "left_anti")
    return sure.select(*references.columns).unionByName(unsure.select(*references.columns))


def _per_period(hot: DataFrame, used: DataFrame) -> DataFrame:
    """The (key, month) pairs of hot keys: their number is bounded by the hot keys times the months."""
    return used.join(F.broadcast(hot), "ref").select("ref", "_period")
