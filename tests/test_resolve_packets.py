"""Linking by text and packets on small tables."""

from pyspark.sql import functions as F

from quarryline.operators import packets, resolve


def test_endpoints(spark):
    files = spark.createDataFrame([("r", "a.ts", "fetch('/api/users/${id}', { method: 'POST' })\nget(`/api/x`)"), ("r", "b.go", "'/api/no'"), ("r", "n.ts", None)], "repo string, path string, text string")
    got = sorted((r.method, r.endpoint) for r in resolve.endpoint_references(files).collect())
    assert got == [("GET", "/api/x"), ("POST", "/api/users/${id}")]
    refs = spark.createDataFrame([("1", "r", "POST", "/api/users/${id}"), ("2", "r", "GET", "/api/x?q=1"), ("3", "r", "GET", "/api/users/7/x"), ("4", "r", "PUT", "/api/x")], "ref_id string, repo string, method string, endpoint string")
    handlers = spark.createDataFrame([("h1", "r", "POST", "/api/users/{uid}"), ("h2", "r", "ANY", "/api/x/"), ("h3", "r", "GET", "/api/x")], "handler_id string, repo string, method string, endpoint string")
    assert sorted((r.ref_id, r.handler_id, r.exact) for r in resolve.endpoint_matches(refs, handlers).collect()) == [("1", "h1", True), ("2", "h3", True), ("4", "h2", False)]


def test_members_and_packages(spark):
    usages = spark.createDataFrame([("u1", "r", "a.py", "ns.f.g"), ("u2", "r", "a.py", "ns.twice"), ("u3", "r", "a.py", "plain")], "usage_id string, repo string, path string, name string")
    bindings = spark.createDataFrame([("r", "a.py", "ns", "b.py"), ("r", "a.py", None, "c.py")], "repo string, path string, local_name string, resolved string")
    symbols = spark.createDataFrame([("r", "b.py", "f", "s1"), ("r", "b.py", "twice", "s2"), ("r", "b.py", "twice", "s3")], "repo string, path string, name string, symbol_id string")
    assert [(r.usage_id, r.symbol_id) for r in resolve.member_targets(usages, bindings, symbols).collect()] == [("u1", "s1")]
    files = spark.createDataFrame([("r", "pkg/x_test.go", True), ("r", "pkg/sub/a.go", False), ("r", "pkg/z.go", False), ("r", "pkg/y.go", False)], "repo string, path string, is_test boolean")
    imports = spark.createDataFrame([("i", "r", "pkg"), ("j", "r", "none"), ("k", "r", "pkg/sub")], "import_id string, repo string, folder string")
    assert {r.import_id: r.target for r in resolve.package_files(imports, files).collect()} == {"i": "pkg/y.go", "k": "pkg/sub/a.go"}


def test_python_modules(spark):
    files = spark.createDataFrame([("r", p) for p in ("pkg/__init__.py", "pkg/mod.py", "src/lib/core.py", "bare/x.py")], "repo string, path string")
    imports = spark.createDataFrame([("1", "r", "pkg", "mod"), ("2", "r", "pkg", "name"), ("3", "r", "lib.core", "f"), ("4", "r", "bare.x", None), ("5", "r", "gone", "x"), ("6", "r", ".rel", "x"), ("7", "r", None, "x")], "import_id string, repo string, module string, name string")
    got = {r.import_id: (r.target, r.authoritative) for r in resolve.python_modules(imports, files).collect()}
    assert got == {"1": ("pkg/mod.py", True), "2": ("pkg/__init__.py", True), "3": ("src/lib/core.py", False), "4": ("bare/x.py", False)}


def test_fixtures(spark):
    fixtures = spark.createDataFrame([("f0", "r", "conftest.py", "client"), ("f1", "r", "tests/api/conftest.py", "client"), ("f2", "r", "tests/x.py", "own"), ("f3", "r", "lib/f.py", "only")], "fixture_id string, repo string, path string, name string")
    usages = spark.createDataFrame([("1", "r", "tests/api/a.py", "client"), ("2", "r", "tests/b.py", "client"), ("3", "r", "tests/x.py", "own"), ("4", "r", "q.py", "only"), ("5", "r", "q.py", "gone")], "usage_id string, repo string, path string, name string")
    got = {r.usage_id: (r.fixture_id, r.how) for r in resolve.visible_fixtures(usages, fixtures).collect()}
    assert got == {"1": ("f1", "conftest"), "2": ("f0", "conftest"), "3": ("f2", "file"), "4": ("f3", "unique")}


def test_text_facts(spark):
    text = "from pydantic import BaseModel\n__all__ = ['A', \"b\"]\nclass A(BaseModel):\n    name: str = 'app.tasks.run'\n    size: int\nx = 'example.com'\n"
    files = spark.createDataFrame([("r", "a.py", text), ("r", "e.py", ""), ("r", "n.py", None)], "repo string, path string, text string")
    assert sorted(r.name for r in resolve.exported_names(files).collect()) == ["A", "b"]
    assert [r.reference for r in resolve.dotted_references(files).collect()] == ["app.tasks.run"]
    assert sorted(r.name for r in resolve.model_attributes(files).collect()) == ["name", "size"]


def test_packets(spark):
    a = spark.createDataFrame([("q", "x", "heuristic", 1.0), ("q", "x", "derived", 2.0), ("q", "y", None, 1.0)], "query string, path string, confidence string, score double")
    b = spark.createDataFrame([("q", "x", "authoritative", 4.0)], "query string, path string, confidence string, score double")
    got = {r.path: (r.tier, r.score, r.sources) for r in packets.merge_evidence({"a": a, "b": b}).collect()}
    assert got == {"x": ("authoritative", 7.0, "a,b"), "y": ("heuristic", 1.0, "a")}
    rows = [("q", f"t{i}", "style", i == 0, 0 < i < 6, "derived", float(i), 0.0) for i in range(15)]
    fan = packets.split_fanout(spark.createDataFrame(rows, "query string, path string, change_type string, is_target boolean, is_test boolean, tier string, risk double, rank double")).collect()
    first = [r.path for r in sorted(fan, key=lambda r: r.place) if r.read_first]
    assert first == ["t0", "t5", "t4", "t3", "t14", "t13", "t12", "t11"] and len(fan) == 15
    raw = spark.createDataFrame([("few", "a", 2), ("many", "a", 50)], "query string, path string, hits bigint")
    ranked = spark.createDataFrame([("few", "b", 1.0), ("many", "a", 9.0), ("many", "c", 3.0)], "query string, path string, score double")
    assert sorted((r.query, r.path, r.origin, r.place) for r in packets.combined_search(raw, ranked).collect()) == [("few", "a", "raw", 1), ("many", "a", "raw", 1), ("many", "c", "ranked", 2)]
    checks = spark.createDataFrame([("1", ["a"], ["t"]), ("2", ["a"], ["u"]), ("3", ["z"], ["t"])], "check_id string, files array<string>, tests array<string>")
    one = lambda x: spark.createDataFrame([(x,)], "path string")
    assert {r.check_id: r.state for r in packets.required_checks(checks, one("a"), one("t")).collect()} == {"1": "covered", "2": "missing", "3": "not_applicable"}
    lines = spark.createDataFrame([("q", i, "x" * 399) for i in range(5)], "query string, i int, text string")
    assert packets.fit_tokens(lines, ["query"], [F.col("i").asc()], 300).count() == 3
    assert {r["level"] for r in packets.quality(a).collect()} == {"low"}
    assert resolve.decided(one("a"), (F.col("path") == "b", "no"), (F.col("path") == "a", "yes"), default="x").first().verdict == "yes"


def test_workflow_traces(spark):
    from quarryline.operators import graph

    e = [("s", f"e{i}", k, "derived", w, a, b) for i, (k, w, a, b) in enumerate([("ROUTE_HANDLES", 4.0, "r", "h"), ("CALLS", 2.0, "r", "u"), ("CALLS", 1.0, "h", "store"), ("CALLS", 1.0, "h", "r"), ("RISK", 9.0, "r", "x"), ("CALLS", 1.0, "store", "far")])]
    edges = spark.createDataFrame(e, "scope string, edge_id string, edge_kind string, confidence string, weight double, from_path string, to_path string")
    entries = spark.createDataFrame([("w", "s", "r")], "workflow string, scope string, path string")
    tests = spark.createDataFrame([("s", "t1", "store"), ("s", "t2", "far")], "scope string, path string, target string")
    steps = graph.workflow_traces(entries, edges, tests)
    got = [(r.kind, r.path, r.target) for r in steps.orderBy("place").collect()]
    assert got == [("entry", "r", None), ("route_handles", "r", "h"), ("calls", "r", "u"), ("calls", "h", "store"), ("test", "t1", None)]
    ranks = spark.createDataFrame([("s", p, 3.0, p[0]) for p in ("r", "h", "u", "store", "t1")], "scope string, path string, rank double, module string")
    w = graph.workflow_summary(steps, ranks).first()
    assert (w.steps, w.files, w.tests, w.rank, w.terminal) == (5, 5, 1, 12.0, "store,u")


def test_manifests_chunks_and_lanes(spark):
    from quarryline.operators import retrieve, scan

    files = spark.createDataFrame([("r", "package.json", '{"name": "n", "version": 2, "scripts": {"test": "vitest"}, "dependencies": {"a": "1"}}'), ("r", "x.json", "{"), ("r", "y.json", "[1]"), ("r", "z.json", None)], "repo string, path string, text string")
    assert sorted((r.key, r.value) for r in scan.manifests(files).collect()) == [("dependencies.a", "1"), ("name", "n"), ("scripts.test", "vitest"), ("version", "2")]
    s = spark.createDataFrame([("r", "a.ts", "s1", "B", 2), ("r", "a.ts", "s2", "A", 1)], "repo string, path string, symbol_id string, name string, start_line int")
    i = spark.createDataFrame([("r", "a.ts", "i1", "./x")], "repo string, path string, import_id string, specifier string")
    f = spark.createDataFrame([("r", "a.ts", False), ("r", "b.test.ts", True)], "repo string, path string, is_test boolean")
    assert {r.path: r.chunk for r in retrieve.chunks(f, s, i).collect()} == {"a.ts": "a.ts\nA B\n./x", "b.test.ts": "b.test.ts"}
    q = spark.createDataFrame([("q", "r", "b test", ["test"])], "query string, scope string, text string, terms array<string>")
    tested = spark.createDataFrame([("r", "b.test.ts", "a.ts", "derived")], "repo string, path string, target string, confidence string")
    seeds = spark.createDataFrame([("q", "r", "a.ts")], "query string, scope string, doc string")
    assert [(r.doc, r.score) for r in retrieve.covering_lane(q, f, tested, seeds).collect()] == [("b.test.ts", 16.0 + 14.0)]
    w = spark.createDataFrame([("q", "r", "w", "e.ts", 10.0)], "query string, scope string, workflow string, entry string, rank double")
    steps = spark.createDataFrame([("w", "store", "s.ts", "t.ts"), ("w", "other", "t.ts", None)], "workflow string, kind string, path string, target string")
    assert {r.doc: r.score for r in retrieve.workflow_lane(w, steps).collect()} == {"e.ts": 19.0, "s.ts": 15.0, "t.ts": 18.0}


def test_packets_fit_and_snapshots(tmp_path, spark):
    from quarryline.operators import memory
    from quarryline.sources import sinks

    packet = {"files": [{"path": "x" * 50, "n": i} for i in range(500)], "note": "y" * 5000, "few": [1, 2]}
    small = sinks.fit_packet(packet, 3000)
    assert len(__import__("json").dumps(small)) <= 3200 and small["truncation"]["files"]["total"] == 500 and small["few"] == [1, 2]
    assert sinks.fit_packet({"a": [1]}, 3000) == {"a": [1]}
    folder = str(tmp_path / "tasks")
    assert sinks.load_snapshot(folder) is None
    sinks.save_snapshot(folder, "task/1", {"planned": ["a"]})
    (tmp_path / "tasks" / "broken.json").write_text("{")
    assert sinks.load_snapshot(folder, "task/1")["planned"] == ["a"] and sinks.load_snapshot(folder, "gone") is None
    o = spark.createDataFrame([("1", 1, "h"), ("1", 2, "h"), ("2", 3, "g"), (None, 9, "h")], "outcome_id string, at int, head string")
    assert [(r.outcome_id, r.at) for r in memory.newest_outcomes(o).collect()] == [("2", 3), ("1", 2)] and memory.newest_outcomes(o, "h").count() == 1
    log = spark.createDataFrame([("x",)] * 201, "line string")
    assert memory.needs_compaction(log) and not memory.needs_compaction(log.limit(5))
    entries = spark.createDataFrame([("a", "resolved"), ("b", None), ("c", "stale")], "entry_id string, status string")
    assert sorted(r.entry_id for r in memory.compacted(entries).collect()) == ["b", "c"]
