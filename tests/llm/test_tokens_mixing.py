"""Encoding against the tokenizer itself; mixing by its marginals and totals."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import tokens
from quarryline.llm.mixing import mix_sources, pivotal, pivotal_chain, plan_mix, shares

PATH = tokens.vocabulary_path()
ENCODE = tokens.encoding(PATH).encode_ordinary
PIECES = ["'s", "'ll", "s", "a", "A", " ", "  ", "\n", "\r\n", "1", "²", "é", "ñ", "😀", "👩‍👩‍👧", "　", "\u2028", "\x1c", "\x85", "!", "--", "中文", "\t", "‍", "Ⅷ", "٣", "_", "'"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 9))
def test_tree_equals_the_encoding_of_the_whole(parts, leaf):
    text = "".join(parts)
    ids = tokens.encode_text(ENCODE, text, leaf)
    assert ids == ENCODE(text) and tokens.decode_ids(PATH, ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(1, 6))
def test_any_text(text, leaf):
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.encode_text(ENCODE, text, leaf) == ENCODE(text)


def test_join_is_a_monoid():
    rng = random.Random(2)
    for _ in range(300):
        a, b, c = (("".join(rng.choices(PIECES, k=rng.randrange(8)))) for _ in range(3))
        text, m, n = a + b + c, len(a), len(a + b)

        def part(start, end, text=text):
            return start, end, [ENCODE(text[start:end])] if end > start else []

        flat = lambda p: (p[0], p[1], [i for x in p[2] for i in x])
        left = tokens.join(ENCODE, text, tokens.join(ENCODE, text, part(0, m), part(m, n)), part(n, len(text)))
        right = tokens.join(ENCODE, text, part(0, m), tokens.join(ENCODE, text, part(m, n), part(n, len(text))))
        assert flat(left) == flat(right) == (0, len(text), ENCODE(text))
        assert flat(tokens.join(ENCODE, text, part(0, 0), part(0, n))) == flat(part(0, n)) == flat(tokens.join(ENCODE, text, part(0, n), part(n, n)))


def test_every_text_goes_through_the_tree():
    """No size of text is encoded another way: a text of two leaves and one of many both join."""
    calls = []

    def encode(x):
        calls.append(len(x))
        return ENCODE(x)

    for n in (tokens.LEAF + 1, tokens.LEAF * 9 + 5):
        calls.clear()
        text = ("some words, and more; " * n)[:n]
        assert tokens.encode_text(encode, text) == ENCODE(text)
        assert max(calls) <= tokens.LEAF and len(calls) > 1 + n // tokens.LEAF


def test_long_texts_without_boundaries():
    for text in ("a" * 50_000, " " * 40_000, "ab1 " * 20_000, "中" * 40_000):
        assert tokens.encode_text(ENCODE, text) == ENCODE(text)
        assert tokens.decode_ids(PATH, ENCODE(text)) == text


def test_query_rows(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "y " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = Counter((r.doc_id, tuple(r.ids)) for r in tokens.encode_texts(df).collect())
    assert got == Counter((i, tuple(ENCODE(t) if t else [])) for i, t, _ in rows)
    counted = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert counted == {1: 2, 2: 0, 3: 0, 4: len(ENCODE("y " * 30_000))}
    back = tokens.decode_texts(tokens.encode_texts(df)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t, _ in rows)
    assert tokens.encode_texts(df.limit(0)).count() == 0 and tokens.encode_texts(df.limit(0)).columns == ["doc_id", "ids"]


def test_pivotal_keeps_means_and_sums():
    sizes, p = [3, 5, 2, 8, 1], [0.3, 0.7, 0.5, 0.2, 0.9]
    mean = [0.0] * 5
    for seed in range(4000):
        out = pivotal(sizes, p, random.Random(seed))
        assert sum(0 < x < 1 for x in out) <= 1
        assert sum(s * x for s, x in zip(sizes, out, strict=True)) == pytest.approx(sum(s * x for s, x in zip(sizes, p, strict=True)))
        mean = [m + x / 4000 for m, x in zip(mean, out, strict=True)]
    assert mean == pytest.approx(p, abs=0.03)


def test_chains_keep_means_and_sums():
    for sizes, p in (([9, 4, 2, 2, 1], 0.4), ([100, 3, 2], 0.7), ([5], 0.3), ([3, 3, 3], 0.5)):
        mean = [0.0] * len(sizes)
        for seed in range(4000):
            out = pivotal_chain(sizes, p, random.Random(seed))
            assert len(out) == len(sizes) and sum(0 < x < 1 for x in out) <= 1 and all(0 <= x <= 1 for x in out)
            assert sum(s * x for s, x in zip(sizes, out, strict=True)) == pytest.approx(p * sum(sizes))
            mean = [m + x / 4000 for m, x in zip(mean, out, strict=True)]
        assert mean == pytest.approx([p] * len(sizes), abs=0.03)


def test_every_document_keeps_its_mean_and_every_source_its_share(spark):
    """Over seeds, one document of half a source's tokens and many small ones come up as often as planned; in each
    mix a source is off its target by less than its smallest document's class allows, whatever the heavy one does."""
    sizes = [4000, 900, 850, *([40] * 60), *([3] * 400)]
    docs = spark.createDataFrame([(i, "a", n) for i, n in enumerate(sizes)], "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    total, seeds = sum(sizes) * 1.4, 12
    heavy = 0
    for seed in range(seeds):
        rows = mix_sources(docs, targets, total=total, seed=seed).collect()
        assert abs(sum(r.copies * r.n_tokens for r in rows) - total) < 4000
        heavy += sum(r.copies for r in rows if r.doc_id == 0) - 1
    assert 0.05 <= heavy / seeds <= 0.8
    off = [abs(sum(r.copies * r.n_tokens for r in mix_sources(docs.where("n_tokens < 100"), targets, total=1.4 * 3600, seed=s).collect()) - 1.4 * 3600) for s in range(2)]
    assert max(off) < 4  # the smallest ones are the last to be open


def test_plans():
    assert plan_mix({"a": (10, 100), "b": (10, 300)}, {"a": (0.5, 2), "b": (0.5, 1)}) == {"a": 2.0, "b": pytest.approx(200 / 300)}
    assert plan_mix({"a": (1, 10)}, {"a": (0.2, 3), "gone": (0.8, 1)}) == {"a": 3.0}
    assert plan_mix({}, {"a": (1.0, 1)}) == {} and plan_mix({"a": (1, 10)}, {"a": (1.0, 4)}, total=15) == {"a": 1.5}


def test_mix_reaches_its_shares(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice("aaab"), rng.randrange(1, 200)) for i in range(3000)] + [(9000 + i, "b", 5000) for i in range(3)]
    docs += docs[:50] + [(5001, None, 10), (5002, "other", 10), (5003, "a", 0), (None, "a", 5), (5004, "c", 40)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 2), ("c", 0.1, 500), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = mix_sources(df, targets).cache()
    rows = mix.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.copies <= {"a": 1, "b": 2, "c": 500}[r.source] for r in rows)
    got = {r.source: r for r in shares(mix, targets).collect()}
    assert [got[s].actual_share for s in "ab"] == pytest.approx([0.3, 0.6], abs=0.003) and got["d"].docs == 0
    again = {(r.doc_id, r.copies) for r in mix_sources(df.repartition(7), targets).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    assert mix_sources(df.limit(0), targets).count() == 0 and mix_sources(df, targets.limit(0)).count() == 0
