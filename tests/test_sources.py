"""Reports, repositories, extractors, sinks and streams over small files."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarryline.operators import memory, scan
from quarryline.sources import extract, repo, reports, sinks
from quarryline.streaming import live


def put(folder, name, value):
    p = Path(folder, name)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(p)


def test_reports(spark, tmp_path):
    place = {"physicalLocation": {"artifactLocation": {"uri": "src/a%20b.py"}, "region": {"startLine": 3}}}
    sarif = {"runs": [{"tool": {"driver": {"name": "t", "rules": [{"id": "R", "properties": {"security-severity": "7.5"}}]}}, "results": [{"ruleId": "R", "message": {"text": "m"}, "locations": [place]}, {"ruleId": "Q", "level": "warning", "message": {"text": "n"}, "locations": [place, place]}]}]}
    rows = reports.sarif_risks(reports.read_reports(spark, put(tmp_path, "s.sarif", sarif), reports.SARIF)).collect()
    assert sorted((r.path, r.signal, r.line, r.score) for r in rows) == [("src/a b.py", "Q", 3, 2.0)] * 2 + [("src/a b.py", "R", 3, 3.0)]
    semgrep = {"results": [{"check_id": "c", "path": "x.py", "start": {"line": 1}, "extra": {"severity": "WARNING", "message": "m"}}]}
    assert reports.semgrep_risks(reports.read_reports(spark, put(tmp_path, "g.json", semgrep), reports.SEMGREP)).first().score == 2.0
    generic = {"findings": [{"file": "x.py", "rule": "r", "startLine": 4, "severity": "high"}, {"path": "y.py", "id": "i", "score": 0.5}]}
    got = reports.generic_risks(spark, put(tmp_path, "r.json", generic))
    assert sorted((r.path, r.signal, r.line, r.score) for r in got.collect()) == [("x.py", "r", 4, 3.0), ("y.py", "i", None, 0.5)]
    files = spark.createDataFrame([("x.py",)], "path string")
    assert [r.path for r in reports.admitted(got.unionByName(got), files).collect()] == ["x.py"]
    broken = reports.read_reports(spark, put(tmp_path, "b.json", "{"), reports.SEMGREP)
    assert reports.semgrep_risks(broken).count() == 0


def test_symbol_report_and_scip(spark, tmp_path):
    r = {"schemaVersion": 1, "tool": "t", "language": "go", "symbols": [{"id": "a", "name": "A", "path": "a.go", "line": 1, "confidence": "authoritative"}, {"id": "b", "name": "B", "path": "b.go"}], "relationships": [{"kind": "calls", "fromSymbol": "a", "toSymbol": "b"}]}
    symbols, edges = reports.symbol_report(reports.read_reports(spark, put(tmp_path, "sym.json", r), reports.SYMBOL_REPORT))
    assert {s.symbol_id: s.confidence for s in symbols.collect()} == {"a": "derived", "b": "derived"}
    assert [(e.edge_kind, e.from_path, e.to_path) for e in edges.collect()] == [("CALLS", "a.go", "b.go")]
    old = reports.read_reports(spark, put(tmp_path, "old.json", r | {"schemaVersion": 2}), reports.SYMBOL_REPORT)
    assert reports.symbol_report(old)[0].count() == 0
    scip = {"documents": [{"relativePath": "a.ts", "language": "ts", "occurrences": [
        {"symbol": "f", "symbolRoles": 1, "range": [0, 0, 3], "enclosingRange": [0, 0, 9, 0]}, {"symbol": "g", "symbolRoles": 1, "range": [2, 0, 3], "enclosingRange": [2, 0, 4, 0]},
        {"symbol": "f", "symbolRoles": 0, "range": [3, 0, 3]}, {"symbol": "f", "symbolRoles": 2, "range": [20, 0, 3]}], "symbols": []}]}
    symbols, edges = reports.scip_facts(reports.read_reports(spark, put(tmp_path, "scip.json", scip), reports.SCIP))
    assert sorted((e.edge_kind, e.from_symbol, e.to_symbol) for e in edges.collect() if e.from_symbol) == [("REFERENCES", "g", "f")]
    assert [e.edge_kind for e in edges.collect() if e.from_symbol is None] == ["IMPORTS"] and symbols.count() == 2


def test_repository(spark, tmp_path):
    put(tmp_path, "src/a.py", "def f():\n    return 1\n")
    put(tmp_path, "node_modules/x.js", "x")
    put(tmp_path, "b.bin", "x")
    Path(tmp_path, "bad.py").write_bytes(b"\xff\xfe\xfa")
    files = repo.read_files(spark, str(tmp_path), "r")
    got = {r.path: (r.skip_reason, r.size_bytes) for r in files.collect()}
    assert got == {"src/a.py": (None, 22), "bad.py": ("unreadable", 3)}
    assert repo.porcelain("R  new\0old\0?? u\0 M m\0") == [("R ", "new", "old"), ("??", "u", None), (" M", "m", None)]
    assert [repo.changed_kind(s) for s in ("R ", "??", " M", "AD")] == ["renamed", "untracked", "modified", "deleted"]
    assert repo.dirty_files(spark, str(tmp_path)).count() == 0
    log = spark.createDataFrame([("a",), ("a",), ("",), ("b",)], "value string")
    assert {r.path: r.commits for r in repo.churn(log).collect()} == {"a": 2, "b": 1}
    def parse(parts):
        for p in parts:
            yield p.assign(n=[len(t) for t in p["text"]])[["path", "content_hash", "n"]]
    cached = files.where("path = 'src/a.py'").select("path", "content_hash", F.lit(-1).cast("bigint").alias("n"))
    assert [r.n for r in repo.parse_incrementally(files, cached, parse, "path string, content_hash string, n bigint").collect()] == [-1]


def test_extractors(spark):
    code = {
        "a.py": "import os\nfrom .b import c as d\nclass K(Base):\n    @app.get('/x')\n    def m(self): return f()\nLIMIT = 1\ndef test_x(): pass\n",
        "a.ts": 'import { x } from "./x";\n// class No {}\nconst s = "class No {}";\nexport class Yes { }\nexport const go = (a) => a;\nfunction h() {\n  return 1;\n}\n',
        "a.go": 'package a\n\nimport "fmt"\n\nfunc (s *T) Run() {\n}\n\ntype T struct {\n}\n', "a.rs": "use std::fmt;\npub fn f() {}\nstruct S;\n", "A.java": "import java.util.*;\npublic class A {\n    public int f(int x) { return x; }\n}\n", "bad.py": "def (",
    }
    df = spark.createDataFrame([("r", p, t) for p, t in code.items()] + [("r", "n.py", None)], "repo string, path string, text string")
    got = {(r.path, r.fact, r.name) for r in extract.extract_facts(df).collect()}
    for want in [("a.py", "symbol", "K"), ("a.py", "symbol", "m"), ("a.py", "import", "d"), ("a.py", "usage", "f"), ("a.py", "symbol", "LIMIT"), ("a.ts", "symbol", "Yes"), ("a.ts", "symbol", "go"), ("a.ts", "symbol", "h"), ("a.ts", "import", "./x"),
                 ("a.go", "symbol", "Run"), ("a.go", "import", "fmt"), ("a.rs", "symbol", "f"), ("a.rs", "import", "std::fmt"), ("A.java", "symbol", "A"), ("A.java", "symbol", "f")]:
        assert want in got, want
    assert not any(n == "No" for _, _, n in got) and any(p == "bad.py" and f == "error" for p, f, _ in got)


def test_scans(spark):
    text = "# TODO later\nimport subprocess\n\ndef f():\n    subprocess.run(x)\n    raise NotImplementedError\n"
    files = spark.createDataFrame([("r", "src/a.py", text), ("r", "tests/a.py", text), ("r", "d.md", "# Title\n\n[a](b.md) ![i](p.png)\n### Deep #\n"), ("r", "n.py", None)], "repo string, path string, text string")
    hits = {(r.path, r.rule): r.hits for r in scan.pattern_hits(files).collect()}
    assert hits[("src/a.py", "shell-execution-boundary")] == 1
    p = {(r.path, r.signal): r.score for r in scan.placeholders(files).collect()}
    assert p[("src/a.py", "placeholder.not-implemented")] == 3.5 and p[("tests/a.py", "placeholder.todo-comment")] == pytest.approx(0.32, abs=0.01)
    assert [(r.title, r.level, r.exported) for r in scan.markdown_headings(files).orderBy("line_no").collect()] == [("Title", 1, True), ("Deep", 3, False)]
    assert [r.target for r in scan.markdown_links(files).collect()] == ["b.md"]
    assert scan.raw_search(files, ["import "]).count() == 2
    d = spark.createDataFrame([("1", "@app.route('/a', methods=['GET', 'post'])"), ("2", '@r.get("/b")'), ("3", "@app.route('/c')"), ("4", "@other")], "row_id string, text string")
    assert sorted((r.method, r.endpoint) for r in scan.route_endpoints(d).collect()) == [("ANY", "/c"), ("GET", "/a"), ("GET", "/b"), ("POST", "/a")]


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "bundles")
    Path(root).mkdir()
    first = sinks.publish({"t": spark.range(3)}, root)
    sinks.publish({"t": spark.range(5)}, root)
    assert sinks.recover(spark, root, "t").count() == 5
    newest = Path(root, "CURRENT").read_text().split("\n")[0]
    for p in Path(root, newest, "t").iterdir():
        p.unlink()
    assert sinks.recover(spark, root, "t").count() == 3 and first in Path(root, "CURRENT").read_text()
    with pytest.raises(Exception):  # noqa: B017, PT011
        sinks.publish({"t": spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))}, root)
    assert sinks.recover(spark, root, "t").count() == 3
    sinks.write_ndjson(spark.range(2), str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n")).count() == 2
    path = str(tmp_path / "lock")
    with sinks.lock(path), pytest.raises(TimeoutError):
        with sinks.lock(path, wait=0.2):
            pass
    assert not Path(path).exists()


def test_memory_stream_equals_the_batch(spark, tmp_path):
    from tests.test_operators import random_events

    events = random_events(9, 60)
    df = spark.createDataFrame(events, memory.EVENT)
    batch = {r.entry_id: r.asDict() for r in memory.fold_events(df).collect()}
    for k in range(3):
        spark.createDataFrame(events[k * 20 : k * 20 + 20], memory.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows: dict = {}
    def keep(part, _):
        rows.update({r.entry_id: r.asDict() for r in part.collect()})
    q = live.memory_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(keep).start()
    q.processAllAvailable()
    q.stop()
    assert rows.keys() == batch.keys()
    for k in rows:
        assert {n: rows[k][n] for n in ("summary", "status", "tier", "revisions", "files")} == {n: batch[k][n] for n in ("summary", "status", "tier", "revisions", "files")}


def test_signature_and_change_stream(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None)], "path string, hash string")
    b = spark.createDataFrame([("y", None), ("x", "1"), ("x", "1")], "path string, hash string")
    c = spark.createDataFrame([("x", "2"), ("y", None)], "path string, hash string")
    assert live.signature(a).first() == live.signature(b).first() != live.signature(c).first()
    assert live.signature(a.limit(0)).first().entries == 0
    seen = []
    each = live.on_change(lambda df: seen.append(df.count()))
    for k, df in enumerate((a, b, c, c, a.limit(0))):
        each(df, k)
    assert seen == [2, 2]


def test_windows_and_sessions(spark):
    rows = [("2025-01-01 00:00:00", "view", 1.0, 1), ("2025-01-01 00:04:00", "view", 2.0, 1), ("2025-01-01 02:00:00", "view", 4.0, 1)]
    e = spark.createDataFrame(rows, "t string, event_type string, value double, user_id bigint").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.n, r.total) for r in live.windowed(e).collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in live.sessions(e).collect()) == [1, 2]
