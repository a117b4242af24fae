"""The N best items of every group by simultaneous bisection of order-preserving codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import cut, skew_join

#: A group with more than this part of all rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 64


def code_of_double(value: Column) -> Column:
    """A long that orders as the double does (minus zero equals zero); value must be neither null nor NaN."""
    plain = F.when(value == 0, F.lit(0.0)).otherwise(value)
    bits = F.call_function(
        "java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain
    ).cast("long")
    return F.when(bits >= 0, bits).otherwise(F.lit(-(2**63)) - bits)


def text_word(value: Column, i: Column) -> Column:
    """The ``i``-th word (from 0) of a text's code: seven bytes and how many of them are there, as one long. A text's
    words order, one after the other, as texts do by code point; its last word has fewer than seven bytes, so no
    code begins another. Null has one word, before all others."""
    raw = F.substring(value.cast("binary"), (i * 7 + 1).cast("int"), F.lit(7))
    word = F.conv(F.rpad(F.hex(raw), 14, "0"), 16, 10).cast("long") * 8 + F.octet_length(raw)
    return F.when(value.isNull(), F.lit(-1)).otherwise(word)


def text_words(value: Column) -> Column:
    """How many words a text's code has."""
    return F.when(value.isNull(), F.lit(1)).otherwise((F.octet_length(value.cast("binary")) / 7).cast("int") + 1)


def word_at(i: Column) -> Column:
    """The ``i``-th word (from 0) of a row's code: the longs of ``_before``, the words of ``_text`` from the greatest
    down, the longs of ``_after``; null beyond them. Words of texts are made where they are asked for."""
    first, last = F.size("_before"), F.size("_before") + text_words(F.col("_text"))
    return F.when(i < first, F.get("_before", i)).when(i < last, -text_word(F.col("_text"), i - first)).otherwise(F.get("_after", i - last))


def top_n(items: DataFrame, n: int, before: list[Column], text: Column, after: list[Column], bins: int = 6) -> DataFrame:
    """The ``n`` rows of each ``grp`` whose code is greatest; all rows of groups with no more than ``n``.

    The code of a row is a sequence of longs, compared one after the other: ``before``, the words of ``text``
    (ascending texts come first, null foremost; a text of any length has as many words as it needs) and ``after``.
    All of them together should tell any two rows of a group apart, so that the choice is always the same; rows that
    are equal in every word are kept or left together. All groups are refined at once:
    a round counts the rows of each open group in up to 2 ** (bins + 1) slices of its interval, keeps what lies
    above the slice that holds the n-th row, and goes on inside that slice, or with the next word where the slice
    is one value. Per round and group only the counts are moved (added up before the shuffle); rows are joined to
    their group's interval with hot groups spread. A group ends when exactly n rows lie at or above its cutoff.

    ``grp`` must not be null, nor the longs. An empty input gives an empty result. Columns other than ``grp`` pass
    through, whatever their names but ``_before``, ``_text`` and ``_after``.
    """
    names = items.columns
    longs = lambda cs: F.array(*cs).cast("array<bigint>")
    base = cut(items.withColumns({"_before": longs(before), "_text": text, "_after": longs(after)}))  # codes are made once
    first = cut(
        base.groupBy("grp")
        .agg(F.count("*").alias("_n"), F.min(word_at(F.lit(0))).alias("_lo"), F.max(word_at(F.lit(0))).alias("_hi"))
    )
    total = first.agg(F.sum("_n")).first()[0] or 0
    first = first.where(F.col("_n") > n)
    hot = first.where(F.col("_n") > F.lit(max(total * HOT_SHARE, 10_000))).select("grp")
    spread = F.xxhash64("_before", "_text", "_after")
    state = first.select(
        "grp", F.lit(0).alias("_at"), "_lo", "_hi", F.lit(n).cast("long").alias("_need"),
        F.array().cast("array<bigint>").alias("_cut"),
    )
    code = ["_before", "_text", "_after"]
    active, closed = base.select("grp", *code), []
    while True:
        here = word_at(F.col("_at"))
        joined = skew_join(active, state, ["grp"], hot, spread).withColumn("_w", here).where(F.col("_w").between(F.col("_lo"), F.col("_hi")))
        span = F.col("_hi").cast("double") - F.col("_lo").cast("double")
        shift = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(span, F.lit(1.0)))) - bins).cast("int")
        joined = joined.withColumn("_next", word_at(F.col("_at") + 1))
        joined = joined.withColumn("_k", shift).withColumn("_bin", F.expr("shiftright(_w, _k) - shiftright(_lo, _k)"))
        counts = joined.groupBy("grp", "_at", "_need", "_cut", "_bin").agg(
            F.count("*").alias("_n"), F.min("_w").alias("_min"), F.max("_w").alias("_max"),
            F.min("_next").alias("_nmin"), F.max("_next").alias("_nmax"),
        )
        down = Window.partitionBy("grp").orderBy(F.col("_bin").desc())
        counts = counts.withColumn("_upto", F.sum("_n").over(down))
        edge = counts.where("_upto >= _need and _upto - _n < _need").withColumn("_left", F.expr("_need - (_upto - _n)"))
        one = F.col("_min") == F.col("_max")
        # rows that no word tells apart stay together
        full = (F.col("_left") == F.col("_n")) | (one & F.col("_nmin").isNull())
        edge = cut(
            edge.select(
                "grp",
                full.alias("_done"),
                F.when(one, F.col("_at") + 1).otherwise(F.col("_at")).alias("_at"),
                F.when(one, F.col("_nmin")).otherwise(F.col("_min")).alias("_lo"),
                F.when(one, F.col("_nmax")).otherwise(F.col("_max")).alias("_hi"),
                F.col("_left").alias("_need"),
                F.when(full | one, F.concat("_cut", F.array("_min"))).otherwise(F.col("_cut")).alias("_cut"),
            )
        )
        closed.append(edge.where("_done").select("grp", "_cut"))
        state = edge.where("not _done").drop("_done")
        if state.isEmpty():
            break
        inside = skew_join(active, state, ["grp"], hot, spread)
        inside = inside.where(word_at(F.col("_at")).between(F.col("_lo"), F.col("_hi")))
        # the last word of the cutoff decides: rows that differ from an earlier one have left before
        last = F.size("_cut") - 1
        inside = inside.where((last < 0) | (word_at(last) == F.try_element_at("_cut", F.lit(-1))))
        active = cut(inside.select("grp", *code))
    limits = reduce(DataFrame.unionByName, closed)
    kept = skew_join(base, limits, ["grp"], hot, spread, how="left")
    # arrays compare element by element; texts are looked at where the longs before them are equal only
    head, least = F.slice("_before", F.lit(1), F.size("_cut")), F.slice("_cut", F.lit(1), F.size("_before"))
    above = F.when(head > least, True).when(head < least, False).otherwise(_prefix() >= F.col("_cut"))
    return kept.where(F.col("_cut").isNull() | above).select(*names)


def _prefix() -> Column:
    """As many words of a row's code as its group's cutoff has."""
    return F.transform(F.sequence(F.lit(0), F.size("_cut") - 1), word_at)
