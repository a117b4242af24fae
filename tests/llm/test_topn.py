"""The N best of every group against sorting."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarryline.llm.topn import code_of_double, text_word, text_words, top_n


def test_codes_keep_the_order(spark):
    xs = [float("-inf"), -1e300, -2.5, -1.0, -5e-324, 0.0, 5e-324, 1.0, 2.0, 1e300, float("inf")]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", code_of_double(F.col("x")).alias("c")).collect()
    codes = {r.x: r.c for r in rows}
    assert [codes[x] for x in xs] == sorted(codes.values()) and len(set(codes.values())) == len(xs)
    minus = spark.createDataFrame([(-0.0,)], "x double").select(code_of_double(F.col("x"))).first()[0]
    assert minus == codes[0.0]
    words = [None, "", "a", "a\0", "aa", "abcdefg", "abcdefgh", "b", "é", "😀"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    coded = df.select("w", F.transform(F.sequence(F.lit(0), text_words(F.col("w")) - 1), lambda i: text_word(F.col("w"), i)).alias("c")).collect()
    by = {r.w: r.c for r in coded}
    assert [by[w] for w in sorted(filter(lambda w: w is not None, words), key=lambda w: w.encode())] == sorted(v for w, v in by.items() if w is not None)
    assert len(set(map(tuple, by.values()))) == len(words)


@pytest.mark.parametrize("n", [1, 3, 10])
def test_top_n_equals_sorting(spark, n):
    rng = random.Random(n)
    rows = [("hot", rng.choice([1.0, 2.0, 2.0, 7.5, -3.0]), rng.choice(["a", "b", None, "a long signal", "a long signal with more"]), i, "x") for i in range(3000)]
    rows += [(f"g{rng.randrange(40)}", rng.uniform(-1, 1), "s", 10_000 + i, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "grp string, score double, signal string, id bigint, _words string").withColumnRenamed("_words", "words")
    got = defaultdict(set)
    for r in top_n(df, n, [code_of_double(F.col("score"))], F.col("signal"), [-F.col("id")]).collect():
        got[r.grp].add(r.id)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2] is not None, r[2] or "", r[3]))
        assert got[g] == {r[3] for r in own[:n]}, g


def test_top_n_keeps_indistinguishable_rows_together_and_takes_empty_tables(spark):
    df = spark.createDataFrame([("g", 1)] * 5 + [("g", 2)], "grp string, x bigint")
    assert Counter(r.x for r in top_n(df, 2, [F.col("x")], F.lit(""), []).collect()) == {2: 1, 1: 5}
    assert top_n(df.limit(0), 2, [F.col("x")], F.lit(""), []).count() == 0


def test_texts_of_any_length_break_ties(spark):
    """A tie of a hundred thousand equal characters is broken behind them, without a column per word."""
    same = "x" * 10_000
    df = spark.createDataFrame([("g", 1.0, same + c, i) for i, c in enumerate("dcba")], "grp string, score double, path string, id int")
    got = top_n(df, 2, [code_of_double(F.col("score"))], F.substring("path", 9_900, 200), []).collect()
    assert sorted(r.id for r in got) == [2, 3]
