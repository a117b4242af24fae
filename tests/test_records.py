"""The operators of p2 to p5 against brute force, and their defined results in the odd cases."""

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarryline.operators import schema_drift
from quarryline.operators.orphans import orphan_references, pack, unpack
from quarryline.operators.schema_drift import CHANGES, best_matching, canonical, name_similarity, schema_changes, unified_records
from quarryline.operators.snapshot_diff import BLOCK, snapshot_changes, with_predecessor

T0 = datetime(2025, 1, 1)
REF = "rid int, ref string, t timestamp_ntz, extra string"
PAR = "ref string, since timestamp_ntz, until timestamp_ntz, rid string"


def brute_orphans(refs, parents):
    out = Counter()
    for r in refs:
        if r[1] is None:
            continue
        alive = any(p[0] == r[1] and p[1] is not None and r[2] is not None and p[1] <= r[2] and (p[2] is None or p[2] > r[2]) for p in parents)
        if not alive:
            out[r] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_orphans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    def when():
        return T0 + timedelta(hours=rng.randrange(24 * 200))
    refs = [(i, rng.choice(["hot", None, "", *"abcdefgh"]), rng.choice([when(), when(), None]), "x") for i in range(400)]
    refs += refs[:20]  # repeated rows
    parents = []
    for k in "abcdehot":
        for _ in range(rng.randrange(3)):
            a = when()
            parents.append((k, rng.choice([a, a, None]), rng.choice([None, a + timedelta(days=rng.randrange(-3, 60))]), "clash"))
    parents += parents[:2]
    got = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR))
    assert got.columns == ["rid", "ref", "t", "extra"]
    assert Counter(map(tuple, got.collect())) == brute_orphans(refs, parents)


def test_orphans_on_month_edges_and_empty_tables(spark):
    first = datetime(2025, 3, 1)
    refs = [(1, "k", first, ""), (2, "k", first - timedelta(microseconds=1), ""), (3, "k", datetime(2025, 4, 1), "")]
    parents = [("k", first, datetime(2025, 4, 1), "")]
    got = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR))
    assert sorted(r.rid for r in got.collect()) == [2, 3]
    none, no_parent = spark.createDataFrame([], REF), spark.createDataFrame([], PAR)
    assert orphan_references(none, no_parent).count() == 0
    assert orphan_references(spark.createDataFrame(refs, REF), no_parent).count() == 3
    assert orphan_references(none, spark.createDataFrame(parents, PAR)).count() == 0


def test_packed_bitmaps_round_trip():
    for places in ([], [0], [7, 8, 32767], range(0, 32768, 3)):
        bits = bytearray(4096)
        for p in places:
            bits[p // 8] |= 1 << (p % 8)
        assert unpack(pack(bytes(bits))).tobytes() == bytes(bits)


def test_predecessors_across_blocks(spark):
    seqs = [1, 2, 5, BLOCK - 1, BLOCK, BLOCK * 7 + 3, BLOCK * 7 + 4]
    df = spark.createDataFrame([("s", f"n{n:06d}", n) for n in seqs] + [("t", "x", 9)], "series string, snap_id string, seq bigint")
    got = {r.snap_id: r.prev_id for r in with_predecessor(df).collect()}
    names = [f"n{n:06d}" for n in seqs]
    assert got == dict(zip(names, [None, *names[:-1]], strict=True)) | {"x": None}


SNAPS, ROWS = "series string, snap_id string, seq bigint, key string", "snap_id string, key string, h string, k string, seq string"


def test_snapshot_changes_equal_brute_force(spark):
    rng = random.Random(3)
    snaps = [(s, f"{s}{n}", n, "clash") for s in "ab" for n in sorted(rng.sample(range(3000), 9))]
    held = {x[1]: {f"p{k}": (rng.choice(["1", "2", None]), rng.choice(["m", "a"])) for k in rng.sample(range(12), rng.randrange(12))} for x in snaps if rng.random() > 0.2}
    rows = [(s, p, h, k, "clash") for s, d in held.items() for p, (h, k) in d.items()] + [("unknown", "p", "1", "m", ""), (None, "p", "1", "m", ""), ("a0", None, "1", "m", "")]
    want = set()
    for s in "ab":
        own = sorted((x for x in snaps if x[0] == s), key=lambda x: x[2])
        for a, b in zip(own, own[1:], strict=False):
            old, new = held.get(a[1], {}), held.get(b[1], {})
            want |= {(s, b[1], p, "added") for p in new.keys() - old.keys()} | {(s, b[1], p, "removed") for p in old.keys() - new.keys()}
            want |= {(s, b[1], p, "changed") for p in new.keys() & old.keys() if new[p] != old[p]}
    got = snapshot_changes(spark.createDataFrame(snaps + snaps[:3] + [(None, "z", 1, ""), ("a", "z", None, "")], SNAPS), spark.createDataFrame(rows, ROWS), ["h", "k"])
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert snapshot_changes(spark.createDataFrame([], SNAPS), spark.createDataFrame([], ROWS), ["h", "k"]).count() == 0


RAW = "rec_id bigint, producer string, file_name string, file_seq int, line_no int, delivered_at timestamp_ntz, payload string"


def records(files):
    """files: (producer, seq, [payload object or text])"""
    rows, n = [], 0
    for producer, seq, payloads in files:
        for k, p in enumerate(payloads):
            n += 1
            rows.append((n, producer, f"{producer}/{seq}", seq, k, T0, p if isinstance(p, str) or p is None else json.dumps(p)))
    return rows


def changes(spark, files):
    got = schema_changes(spark.createDataFrame(records(files), RAW))
    return sorted((r.file_name, r.change_kind, r.old_field, r.new_field) for r in got.collect())


def rec(i, **fields):
    return {"runId": f"r{i}", "id": f"i{i}"} | fields


def test_schema_changes(spark):
    a = [rec(i, n={"textChars": 1000 + 7 * i, "ok": True}, gone="x", kept=1) for i in range(8)]
    b = [rec(i, n={"characters": 1000 + 7 * i, "ok": 1}, kept=None, fresh=[1]) for i in range(5, 12)] + [rec(20, kept="s")]
    got = changes(spark, [("p", 1, a), ("p", 4, b), ("q", 2, [rec(1, z=1)])])
    assert got == sorted([
        ("p/4", "renamed", "n.textChars", "n.characters"), ("p/4", "type_changed", "n.ok", "n.ok"), ("p/4", "removed", "gone", ""), ("p/4", "added", "", "fresh"),
        ("p/4", "type_changed", "kept", "kept"),
    ])


def test_a_similar_name_with_other_values_is_no_rename(spark):
    a = [rec(i, dataBytes=1000 + i) for i in range(6)]
    b = [rec(i, structuredBytes=9000 - i) for i in range(6)]
    assert changes(spark, [("p", 1, a), ("p", 2, b)]) == [("p/2", "added", "", "structuredBytes"), ("p/2", "removed", "dataBytes", "")]


def test_invalid_payloads_repeats_and_empty_tables(spark):
    a = [rec(1, x=1), "{", None, "[1]", "NaN", '{"y": Infinity}']
    assert changes(spark, [("p", 1, a + a), ("p", 2, ["broken"])]) == [("p/2", "removed", f, "") for f in ("id", "runId", "x")]
    assert schema_changes(spark.createDataFrame([], RAW)).count() == 0
    wide = spark.createDataFrame(records([("p", 1, a)]), RAW).withColumn("field", F.lit("clash")).withColumn("kind", F.lit(1))
    assert schema_changes(wide).count() == 0


def test_unified_table(spark):
    a = [rec(i, flag=True, ts="2025-01-01T00:00:00Z", count=i) for i in range(6)]
    b = [rec(i, flag="no", created=1735689600000, count=str(i)) for i in range(3, 9)] + ["{"]
    df = unified_records(spark.createDataFrame(records([("p", 1, a), ("p", 2, b)]), RAW))
    rows = sorted(df.collect(), key=lambda r: r.rec_id)
    assert len(rows) == 13 and [r.valid for r in rows].count(False) == 1
    assert dict(df.dtypes)["flag"] == "boolean" and dict(df.dtypes)["count"] == "bigint"
    assert rows[0].flag is True and rows[6].flag is False and rows[7]["count"] == 4


def test_unified_table_loses_nothing(spark):
    """Every value of a valid payload is in its row: in the column of its field's quantity, or in unfitted."""
    p1 = [[rec(i, durationMs=i * 17.25 + 1000) for i in range(8)], [rec(i, durationTotalMs=i * 17.25 + 1000) for i in range(4, 12)]]
    p2 = [rec(i, durationMs=1.5 + i, durationTotalMs=99.5 + i) for i in range(4)]  # both at once: two quantities here
    odd = ['{"a": {"b": 1}, "a__b": "x", "A__B": true, "a.b": 7}', "[1, 2]", "3", '{"big": 9007199254740993}', '{"big": 9007199254740992}', '{"mixed": 1}', '{"mixed": 2}', '{"mixed": "n/a"}', '{"mixed": [1, {"k": null}]}', '{"huge": 123456789012345678901234567890}', "{"]
    df = unified_records(spark.createDataFrame(records([("p1", 1, p1[0]), ("p1", 2, p1[1]), ("p2", 1, p2), (None, 1, odd)]), RAW))
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    rows = sorted(df.collect(), key=lambda r: r.rec_id)
    one = [r for r in rows if r.producer == "p1"]
    name = "durationMs" if one[0].durationMs is not None else "durationTotalMs"
    assert [r[name] for r in one] == [i * 17.25 + 1000 for i in [*range(8), *range(4, 12)]]
    assert [(r.durationMs, r.durationTotalMs) for r in rows if r.producer == "p2"] == [(1.5 + i, 99.5 + i) for i in range(4)]
    o = [r for r in rows if r.producer is None]
    dotted, flat_name, upper = (next(c for c in df.columns if c in options) for options in (("a__b", "a__b_2", "a__b_3"), ("a__b_2", "a__b_3"), ("A__B", "A__B_2", "A__B_3")))
    values = {str(o[0][c]) for c in df.columns if c.lower().startswith("a__b")}
    assert {"x", "True"} <= values and dotted and flat_name and upper and json.loads(o[0].unfitted["a.b"]) in (1, 7) and values & {"1", "7"}
    assert o[1].valid and json.loads(o[1].unfitted[""]) == [1, 2] and json.loads(o[2].unfitted[""]) == 3
    assert (o[3].big, o[4].big) == (9007199254740993, 9007199254740992) and (o[5].mixed, o[6].mixed) == (1, 2)
    assert json.loads(o[7].unfitted["mixed"]) == "n/a" and json.loads(o[8].unfitted["mixed"]) == [1, {"k": None}]
    assert o[9].huge is None and json.loads(o[9].unfitted["huge"]) == 123456789012345678901234567890 and not o[10].valid


def test_large_ids_are_told_apart():
    assert canonical(9007199254740993) != canonical(9007199254740992) and canonical("9007199254740993") == canonical(9007199254740993)
    assert canonical(3) == canonical("3") == canonical(3.0) == canonical("3.0")


def test_matching_is_optimal():
    rng = random.Random(5)
    from itertools import permutations

    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        w = [[rng.choice([0.0, rng.random()]) for _ in range(m)] for _ in range(n)]
        got = sum(w[i][j] for i, j in best_matching(w))
        size = max(n, m)
        best = max(sum(w[i][p[i]] for i in range(n) if p[i] < m) for p in permutations(range(size)))
        assert got == pytest.approx(best)
    assert best_matching([]) == [] and best_matching([[]]) == []


def test_names_and_values():
    assert name_similarity("metrics.textChars", "metrics.text_chars") > 0.9
    assert name_similarity("freshness.schemaVersion", "freshnessSchemaVersion") > 0.8
    assert name_similarity("metrics.textChars", "freshness.dirtyFiles") < 0.3
    assert canonical("2025-01-01T00:00:00Z") == canonical(1735689600000)
    assert schema_drift.strict_json('{"a": 1}') == {"a": 1}
    assert CHANGES.count(",") == 4
