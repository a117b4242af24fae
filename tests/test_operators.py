"""Operators on small hand-made tables: golden numbers, brute force, odd cases."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarryline.functions import paths as P
from quarryline.functions import text as X
from quarryline.operators import changes, evaluate, graph, ledger, memory, ranking, relations, retrieve
from quarryline.schema import PATH_KINDS, REVERSIBLE_KINDS, weakest


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_golden_numbers(spark):
    lit = F.lit
    assert one(spark, X.stable_id(lit("file"), lit(None).cast("string"), lit("src/util.ts"))) == "170513e660494797"
    assert one(spark, X.bm25_term(lit(10), lit(3), lit(4), lit(50), lit(40))) == pytest.approx(1.860629, abs=1e-6)
    assert [one(spark, X.rank_log2(lit(x))) for x in (7.0, -2.0, float("nan"))] == [3, 0, 0]
    assert one(spark, weakest(lit("derived"), lit("heuristic"))) == "heuristic"
    q, terms = lit("alpha beta gamma"), F.array(*map(lit, ("alpha", "beta", "gamma")))
    assert [one(spark, X.match_score(q, terms, lit(v))) for v in ("alphaBetaGamma", "x alpha beta gamma", "beta alpha z", "gamma beta alpha", "zz", "")] == [14, 10, 4, 8, 0, 0]


def test_fusion_golden(spark):
    lanes = {"exact": [("q", "s", "d", 22.0)], "symbol": [("q", "s", "e", 20.0), ("q", "s", "d", 18.0)]}
    frames = {k: spark.createDataFrame(v, "query string, scope string, doc string, score double") for k, v in lanes.items()}
    ranks = spark.createDataFrame([("s", "d", 7.0), ("s", "e", 0.0)], "scope string, doc string, rank double")
    got = {r.doc: r.score for r in retrieve.fuse(frames, ranks).collect()}
    assert got["d"] == pytest.approx(16.856375, abs=1e-6)


def test_centrality_golden(spark):
    nodes = spark.createDataFrame([("s", n) for n in "abcd"], "scope string, node string")
    links = spark.createDataFrame([("s", "a", "c"), ("s", "b", "c"), ("s", "c", "d")], "scope string, source string, target string")
    got = {r.node: (round(r.score, 6), r.part) for r in ranking.centrality(nodes, links).collect()}
    assert got == {"a": (0.0375, 0), "b": (0.0375, 0), "c": (0.10125, 0), "d": (0.123563, 0)} or got["d"][0] in (0.123562, 0.123563)
    hub = spark.createDataFrame([("s", f"l{i}") for i in range(19)] + [("s", "hub")], "scope string, node string")
    spokes = spark.createDataFrame([("s", f"l{i}", "hub") for i in range(19)], "scope string, source string, target string")
    r = ranking.centrality(hub, spokes).where("node = 'hub'").first()
    assert (round(r.score, 6), round(r.part, 6)) == (0.128625, 0.836934)


def test_paths(spark):
    rows = [
        ("src/a.test.ts", "typescript", True, False, "src"), ("tests/x.py", "python", True, False, "tests"), ("pkg/b_pb2.py", "python", False, True, "pkg"),
        ("web/ui/App.tsx", "typescript", False, False, "web/ui"), ("my_api/store.py", "python", False, False, "my_api/store.py"), ("main.go", "go", False, False, "root"), ("x/.hidden", "unknown", False, False, "x"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string")
    p = F.col("p")
    got = df.select("p", P.language_of(p), P.is_test(p), P.is_generated(p), P.module_of(p)).collect()
    assert [tuple(r) for r in got] == rows
    assert one(spark, P.ancestors(F.lit("a/b/c.py"))) == ["a/b", "a", ""]
    assert one(spark, P.normal_path(F.lit(".\\a\\b"))) == "a/b"
    assert one(spark, P.is_skipped(F.lit("a/node_modules/x.js"))) is True
    assert one(spark, P.is_decoy(F.lit("src/apiMock.ts"))) is True


def test_redaction_and_limits(spark):
    assert "abc123" not in one(spark, X.redacted(F.lit("curl -H 'Authorization: Bearer abc123' token=abc123")))
    assert one(spark, X.limit_text(F.lit("x" * 50), 30)) == "x" * 10 + "\n... truncated ..."
    assert one(spark, X.slug(F.lit("--A b//C--"))) == "a-b/c"
    assert one(spark, X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0


def test_first_hit_and_candidates(spark):
    rows = spark.createDataFrame([("1", "r", "src/api/a.ts", "./util"), ("2", "r", "src/api/a.ts", "../lib/x.js"), ("3", "r", "m/a.py", "pkg.mod"), ("4", "r", "a.ts", "react")], "row_id string, repo string, path string, specifier string")
    files = spark.createDataFrame([("r", p) for p in ("src/api/util.ts", "src/api/util/index.ts", "src/lib/x.ts", "pkg/mod.py", "a.ts")] + [("z", "react.ts")], "repo string, target string")
    got = {r.row_id: r.hit for r in relations.first_hit(rows, relations.import_candidates(F.col("path"), F.col("specifier")), files, "repo", "target").collect()}
    assert got == {"1": "src/api/util.ts", "2": "src/lib/x.ts", "3": "pkg/mod.py", "4": None}


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(1)
    def ranges():
        return [(rng.choice("kl"), i, a, a + rng.randrange(-2, 300)) for i in range(60) for a in [rng.randrange(1000)]]
    a, b = ranges(), ranges()
    left, right = spark.createDataFrame(a, "g string, i int, a_from int, a_to int"), spark.createDataFrame(b, "g string, j int, b_from int, b_to int")
    got = sorted((r.i, r.j) for r in relations.overlapping(left, right, ["g"]).collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want


def test_prefix_scope_endpoint(spark):
    rows = spark.createDataFrame([("1", "@app/x/y"), ("2", "@app/z"), ("3", "none")], "row_id string, v string")
    prefixes = spark.createDataFrame([("@app/", "src/"), ("@app/x/", "lib/")], "prefix string, replacement string")
    assert {r.row_id: r.replacement for r in relations.longest_prefix(rows, "v", prefixes).collect()} == {"1": "lib/", "2": "src/", "3": None}
    assert one(spark, relations.endpoint_key(F.lit("https://h/api/users/${id}/?q=1"))) == one(spark, relations.endpoint_key(F.lit("/api/users/:user"))) == "/api/users/{}"


def test_reexports_and_ambiguity(spark):
    defined = spark.createDataFrame([("s", "a", "x", "ax"), ("s", "b", "x", "bx"), ("s", "b", "y", "by")], "scope string, path string, name string, symbol_id string")
    links = [("s", "barrel", "a", "*", None), ("s", "barrel", "b", "*", None), ("s", "chain", "barrel", "y", "z"), ("s", "loop", "loop", "*", None)]
    got = graph.reexport_bindings(defined, spark.createDataFrame(links, "scope string, path string, source string, name string, alias string"))
    assert sorted((r.path, r.name, r.symbol_id) for r in got.collect()) == [("barrel", "y", "by"), ("chain", "z", "by")]


EDGE = "scope string, edge_id string, edge_kind string, confidence string, weight double, from_path string, to_path string, source string, target string"


def test_dependency_path_is_the_first_of_a_breadth_first_search(spark):
    rng = random.Random(7)
    kinds = ["CALLS", "IMPORTS", "DEFINES", "RISK"]
    edges = [("s", f"e{i}", rng.choice(kinds), rng.choice(["derived", "heuristic"]), rng.choice([1.0, 2.0]), a, b, a, b) for i in range(60) for a, b in [rng.sample("abcdefghijklmn", 2)]]
    order = {"DEFINES": 0, "CALLS": 4, "IMPORTS": 6}
    adjacency = {}
    for e in edges:
        if e[2] not in PATH_KINDS:
            continue
        adjacency.setdefault(e[7], []).append((order[e[2]], e[3] != "derived", -e[4], e[5], e[6], e[1], e[8]))
        if e[2] in REVERSIBLE_KINDS:
            adjacency.setdefault(e[8], []).append((order[e[2]], e[3] != "derived", -e[4], e[6], e[5], e[1], e[7]))
    def search(start, goal):
        queue, seen = deque([(start, [start])]), {start}
        while queue:
            node, path = queue.popleft()
            if node == goal:
                return path
            if len(path) > 6:
                continue
            for e in sorted(adjacency.get(node, [])):
                if e[-1] not in seen:
                    seen.add(e[-1])
                    queue.append((e[-1], [*path, e[-1]]))
        return None
    pairs = [("s", a, b) for a in "abc" for b in "cdefgn"]
    got = {(r.start, r.goal): list(r.path) for r in graph.dependency_paths(spark.createDataFrame(pairs, "scope string, start string, goal string"), spark.createDataFrame(edges, EDGE)).collect()}
    want = {(a, b): p for _, a, b in pairs if (p := search(a, b))}
    assert got == want


def test_sets(spark):
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string")
    assert sorted(tuple(r) for r in changes.delta(df("aab"), df("bc"), ["x"]).collect()) == [("a", "removed"), ("c", "new")]
    assert [tuple(r) for r in changes.multiset_delta(df("a"), df("aab")).orderBy("x").collect()] == [("a", 1), ("b", 1)]
    assert sorted(tuple(r) for r in changes.plan_against_actual(df("ab"), df("bc"), ["x"]).collect()) == [("a", "untouched"), ("b", "planned"), ("c", "unplanned")]
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "k string, v string")
    now = spark.createDataFrame([("a", "1"), ("b", None), ("c", "4"), ("d", None)], "k string, v string")
    assert sorted(r.k for r in changes.changed_since(old, now, ["k"], "v").collect()) == ["c", "d"]


EVENT = memory.EVENT
T0 = datetime(2025, 1, 1)


def random_events(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = rng.choice(["hot", "hot", *"abc"])
        out.append((key, T0 + timedelta(minutes=i), rng.choice(["note", "viewed"]), rng.choice(["s1", "s2", None]), rng.choice(["active", "resolved", "rejected", "stale", None]), rng.choice(["derived", "heuristic", None, "odd"]), rng.choice([f"e{i}", None, "same"]), rng.choice([["f1"], ["f2", "f1"], [], None])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_memory_fold_in_spark_equals_the_fold_in_order(spark, seed):
    events = random_events(seed)
    keys = [c.split()[0] for c in EVENT.split(", ")]
    want = {}
    for e in events:
        row = dict(zip(keys, e, strict=True))
        want[e[0]] = memory.fold(want.get(e[0]), [row])
    got = {r.entry_id: r.asDict() for r in memory.fold_events(spark.createDataFrame(events, EVENT)).collect()}
    assert got.keys() == want.keys()
    for k in want:
        for name in ("created_at", "updated_at", "kind", "summary", "status", "tier", "files", "revisions"):
            assert got[k][name] == want[k][name], (k, name)
        assert set(got[k]["evidence"]) == set(want[k]["evidence"])


def test_staleness_and_boosts(spark):
    entries = spark.createDataFrame([("a", "active", ["x"], "h1"), ("b", "stale", ["y"], "h1"), ("c", "resolved", ["x"], "h0"), ("d", "active", [], "h0")], "entry_id string, status string, files array<string>, head string")
    dirty = spark.createDataFrame([("x",)], "path string")
    got = {r.entry_id: r.status for r in memory.mark_stale(entries, dirty, "h1").collect()}
    assert got == {"a": "stale", "b": "active", "c": "resolved", "d": "stale"}
    o = spark.createDataFrame([("1", "p", 2.0), ("1", "p", 2.0), ("2", "p", 2.0), ("3", "q", 0.5)], "outcome_id string, path string, amount double")
    assert {r.path: r.boost for r in memory.outcome_boosts(o).collect()} == {"p": 3.0, "q": 0.5}


@pytest.mark.parametrize(("command", "trusted"), [
    ("pytest tests -q", True), ("pytest tests || true", False), ("pytest tests; echo done", False), ("pytest tests | tee log", False), ("set -o pipefail; pytest tests | tee log", True),
    ("cd x && pytest tests", True), ("pytest tests &", False), ("if pytest; then echo; fi", False), ("echo 'pytest tests'", None), ("pytest --help", False), ("CI=1 npx vitest run src/a.test.ts", True),
    ("npm test", True), ("npm run masked", False), ("npm run loop", False), ("set -e; pytest tests; echo", True), ("pytest 'open", False), ("# pytest tests", None), ("! pytest tests", None), ("false || pytest tests", False),
])
def test_what_a_command_verifies(command, trusted):
    scripts = {"test": "vitest run", "masked": "vitest run || true", "loop": "npm run loop"}
    got = ledger.analyse(command, scripts)
    kinds = [c for c in got if c.kind in ledger.TOOLS]
    if trusted:
        assert any(c.trusted and c.kind == "test" for c in kinds)
    else:
        assert not any(c.trusted for c in got)


def test_heredocs_are_no_commands():
    assert [s for s, _ in ledger.split_shell("cat <<EOF\npytest tests\nEOF\nls")][-1] == "ls"
    assert not any(c.trusted for c in ledger.analyse("cat <<EOF\npytest tests\nEOF\nls"))


def test_ledger(spark):
    checks = spark.createDataFrame([("1", "test", "tests/a/x.py"), ("2", "test", "src/x.py"), ("3", "lint", "src/x.py")], "check_id string, kind string, path string")
    reports = spark.createDataFrame([("a", "pytest tests/a", 0, "/w"), ("b", "ruff src/x.py", None, "/w"), ("c", "pytest src", 1, "/w")], "row_id string, command string, exit_code int, cwd string")
    waived = spark.createDataFrame([("3",)], "check_id string")
    assert {r.check_id: r.state for r in ledger.ledger(checks, ledger.coverage(reports), waived).collect()} == {"1": "covered", "2": "missing", "3": "waived"}


def test_scores(spark):
    rows = [("a", ["x", "y"], ["x"], [], [], ["x"], [], None), ("b", ["z"], ["x"], [], [], ["x"], ["z"], None)]
    s = spark.createDataFrame(rows, "scenario string, found array<string>, expected array<string>, tests_found array<string>, tests_expected array<string>, baseline array<string>, forbidden array<string>, min_recall double")
    got = {r.scenario: r for r in evaluate.score_scenarios(s).collect()}
    assert (got["a"].score, got["a"].failures) == (1.0, 0) and (got["b"].score, got["b"].failures) == (0.0, 3)
    assert evaluate.synthetic_repository(1) == evaluate.synthetic_repository(1) != evaluate.synthetic_repository(2)


def test_vector_search_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8)).round(3)
    m[5] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, []), (901, None)], "vec_id bigint, embedding array<float>")
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in retrieve.vector_search(df, q, 5, 0.2, block=3, rows=40).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    f = m.astype(np.float32).astype(float)
    n = np.linalg.norm(f, axis=1)
    for i in range(0, 300, 50):
        s = {j: f[i] @ f[j] / n[i] / n[j] for j in range(300) if j != i and n[j] > 0}
        want = sorted((j for j in s if s[j] > 0.2), key=lambda j: (-round(s[j], 9), j))[:5]
        assert sorted(got.get(i, {})) == sorted(want)
