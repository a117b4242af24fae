"""Search functions, targets, renames and workflow edges on small tables."""

from pyspark.sql import functions as F

from quarryline.functions import search as Z
from quarryline.operators import relations, workflows


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return row.asDict()


def test_search_scores(spark):
    cases = [
        ("src/util.ts", "src/util.ts", 10), ("util", "src/Util.ts", 9), ("fix the util code", "src/my-util/x.ts", 6), ("uti", "src/util.ts", 2), ("nothing", "src/util.ts", 0),
        ("util", "src/util_mock/util_copy.ts", 0), ("util mock", "src/util_mock/a.ts", 6), ("mock", "mock.ts", 9), ("", "a", 0), ("a", "", 0), (None, "a", 0), ("a", None, 0), ("see src/app.ts", "lib/app/x.py", 6),
    ]
    df = spark.createDataFrame([(i, q, v) for i, (q, v, _) in enumerate(cases)], "i int, q string, v string").withColumn("s", Z.search_score(F.col("q"), F.col("v")))
    got = {r.i: (r.s, r.w) for r in df.withColumn("w", Z.search_reason(F.col("s"))).collect()}
    words = {10: "exact", 9: "stem", 6: "token", 2: "substring", 0: "miss"}
    assert got == {i: (s, words[s]) for i, (_, _, s) in enumerate(cases)}


def test_code_queries_and_kinds(spark):
    df = spark.createDataFrame([("Fix runStore.load and src/a.py, the HTTP2 dep-graph package in QueueState", 0), ("update the safe test", 1), (None, 2), ("look at dep-graph please", 3)], "t string, i int")
    got = {r.i: r.c for r in df.select("i", Z.code_query(F.col("t")).alias("c")).collect()}
    assert got == {0: "HTTP2 QueueState dep-graph runStore.load", 1: "", 2: "", 3: ""}
    paths = [("web/a.gen.ts", "generated"), ("tests/a.py", "test"), ("docs/x.py", "docs"), ("a/package.json", "config"), ("scripts/run.sh", "config"), ("a.py", "source"), ("b.py", "unknown")]
    df = spark.createDataFrame([(p, p == "a.py") for p, _ in paths], "p string, known boolean").select("p", Z.impact_kind(F.col("p"), F.col("known")).alias("k"))
    assert {r.p: r.k for r in df.collect()} == dict(paths)
    got = one(
        spark, a=Z.is_store_path(F.lit("x/stores/a.py")), b=Z.is_store_path(F.lit("x/storest.py")), c=Z.is_adapter_path(F.lit("x/my_adapter.py")), d=Z.is_manifest_path(F.lit("packages/x.json")),
        e=Z.is_store_name(F.lit("RunStore")), f=Z.is_store_name(F.lit("storey")), g=Z.is_job_decorator(F.lit("@Celery.task")), h=Z.asks_for_copies(F.lit("an Old one")), i=Z.asks_for_copies(F.lit(None).cast("string")),
    )
    assert got == dict(a=True, b=False, c=True, d=True, e=True, f=False, g=True, h=True, i=False)
    boosts = one(spark, x=Z.intent_boost(F.array(F.lit("testing"), F.lit("risk"), F.lit("debugging")), F.lit("tests/a.py"), F.lit(True), F.lit(True), F.lit(20.0)), y=Z.intent_boost(F.array(F.lit("unknown")), F.lit("a"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(0.0)))
    assert boosts == {"x": 8.5, "y": 0.0}


def test_targets_by_tier(spark):
    symbols = spark.createDataFrame([("r", "s1", "a.X", "X"), ("r", "s2", "b.X", "X"), ("r", "s3", "s1", "Y"), ("r", "s4", "q", None), ("r", "s5", "q", "Z"), ("t", "s6", "a.X", "X"), ("t", "s6", "a.X", "X")], "scope string, symbol_id string, qualified_name string, name string")
    asked = spark.createDataFrame([("r", n) for n in ("s1", "a.X", "X", "q", "Y", "none")] + [("t", "X"), ("r", "X"), (None, "X"), ("r", None)], "scope string, name string")
    got = {(r.scope, r.name): (r.tier, r.symbol_id, r.ambiguous) for r in relations.resolved_targets(asked, symbols).collect()}
    assert got == {
        ("r", "s1"): ("id", "s1", None), ("r", "a.X"): ("qualified", "s1", None), ("r", "X"): ("name", None, ["s1", "s2"]), ("r", "q"): ("qualified", None, ["s4", "s5"]),
        ("r", "Y"): ("name", "s3", None), ("r", "none"): (None, None, None), ("t", "X"): ("name", "s6", None),
    }
    assert relations.resolved_targets(asked.limit(0), symbols).count() == 0
    many = spark.range(100).selectExpr("'r' scope", "concat('k', lpad(id, 3, '0')) symbol_id", "null qualified_name", "'same' name")
    assert relations.resolved_targets(asked.limit(1).selectExpr("'r' scope", "'same' name"), many).first().ambiguous == [f"k{i:03}" for i in range(20)]


def test_plans_follow_renames(spark):
    changed = spark.createDataFrame([("t", "b.py", "a.py", 1), ("t", "c.py", None, 2), ("t", "d.py", "x.py", 3), ("u", "b.py", "a.py", 4), ("t", None, "a.py", 5)], "scope string, path string, old_path string, planned_line int")
    planned = spark.createDataFrame([("t", "a.py"), ("t", "a.py"), ("t", "c.py"), ("t", None)], "scope string, path string")
    got = {r.planned_line: r.planned for r in relations.planned_changes(changed, planned).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_workflow_edges(spark):
    symbols = spark.createDataFrame(
        [("r", "a/routes.py", "rt", "get_x", "get_x", "route", 1), ("r", "a/store.py", "ld", "load", "RunStore.load", "method", 5), ("r", "b/keep.py", "kp", "Keep", "KeepRepository", "class", 1), ("r", "c/adapters/http.py", "ad", "send", "send", "function", 1), ("q", "z/routes.py", "zr", "z", "z", "route", 1)],
        "repo string, path string, symbol_id string, name string, qualified_name string, kind string, start_line int",
    )
    files = spark.createDataFrame([("r", p) for p in ("a/routes.py", "a/store.py", "b/keep.py", "c/adapters/http.py", "d/adapters/ftp.py", "store/main.py")] + [("q", "z/routes.py"), ("q", "db/x.py")], "repo string, path string")
    stores = workflows.store_files(files, symbols)
    assert {(r.repo, r.path) for r in stores.collect()} == {("r", "a/store.py"), ("r", "b/keep.py"), ("r", "store/main.py"), ("q", "db/x.py")}
    usages = spark.createDataFrame(
        [("r", "a/routes.py", "keep", "rt", "kp", "derived"), ("r", "a/routes.py", "store.load", "rt", None, "heuristic"), ("r", "a/routes.py", "store.gone", "rt", None, "heuristic"), ("r", "a/store.py", "send", None, "ad", "authoritative"), ("q", "z/routes.py", "store.any", "zr", None, "heuristic")],
        "repo string, path string, name string, from_symbol string, to_symbol string, confidence string",
    )
    imports = spark.createDataFrame([("r", "a/routes.py", "a/store.py"), ("r", "a/store.py", "c/adapters/http.py"), ("r", "a/store.py", "d/adapters/ftp.py"), ("r", "a/store.py", "d/adapters/ftp.py")], "repo string, path string, resolved string")
    parts = [workflows.route_store_calls(usages, symbols, stores, imports), workflows.store_adapter_calls(usages, symbols, stores, workflows.adapter_files(files), imports)]
    handlers = spark.createDataFrame([("h", "r", "a/routes.py", "rt", "GET", "/api/{id}", "authoritative")], "handler_id string, repo string, path string, symbol_id string, method string, endpoint string, confidence string")
    refs = spark.createDataFrame([("1", "r", "web/a.ts", None, "GET", "/api/:x", "authoritative"), ("2", "r", "tests/test_a.py", None, "GET", "/api/${y}", "derived"), ("3", "r", "web/b.ts", None, "POST", "/api/:x", "derived")], "ref_id string, repo string, path string, from_symbol string, method string, endpoint string, confidence string")
    edges = workflows.workflow_edges([*parts, workflows.endpoint_edges(handlers, refs)])
    got = {(r.edge_kind, r.from_path, r.to_path, r.to_symbol): (r.weight, r.confidence) for r in edges.collect()}
    assert got == {
        ("ROUTE_CALLS_STORE", "a/routes.py", "b/keep.py", "kp"): (3.0, "derived"), ("ROUTE_CALLS_STORE", "a/routes.py", "a/store.py", "ld"): (2.2, "heuristic"), ("ROUTE_CALLS_STORE", "a/routes.py", "a/store.py", None): (2.2, "heuristic"),
        ("ROUTE_CALLS_STORE", "z/routes.py", "db/x.py", None): (2.2, "heuristic"), ("STORE_DISPATCHES_ADAPTER", "a/store.py", "c/adapters/http.py", "ad"): (3.2, "authoritative"), ("STORE_DISPATCHES_ADAPTER", "a/store.py", "d/adapters/ftp.py", None): (2.4, "derived"),
        ("ROUTE_HANDLES", "a/routes.py", "a/routes.py", None): (4.5, "authoritative"), ("UI_CALLS_ENDPOINT", "web/a.ts", "a/routes.py", "rt"): (3.8, "authoritative"), ("TEST_COVERS_WORKFLOW", "tests/test_a.py", "a/routes.py", "rt"): (3.2, "derived"),
    }
    paths = {r.path: r.edges for r in workflows.workflow_paths(edges).collect()}
    assert paths["a/routes.py"] == 6 and paths["d/adapters/ftp.py"] == 1
    assert workflows.workflow_edges([p.limit(0) for p in parts]).count() == 0
