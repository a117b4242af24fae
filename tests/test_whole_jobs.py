"""Queries over small tables in which a smaller job gives other results."""

from datetime import datetime
from pathlib import Path

import pytest

from quarryline.operators import ranking, scan
from quarryline.plans import analysis

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
AT = datetime(2024, 1, 1)


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a folder of tables (name to rows as dicts) with the columns of the test tables; columns not given are null."""

    def write(**rows):
        for name, given in rows.items():
            schema = spark.read.parquet(f"{SMALL}/{name}.parquet").schema
            spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in given], schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_tests_of_importers_within_two_steps(spark, tables):
    paths = "pkg/a.py pkg/b.py pkg/c.py pkg/d.py tests/test_b.py tests/test_c.py tests/test_d.py tests/test_p.py tests/test_q.py".split()
    links = [("pkg/b.py", "pkg/a.py"), ("pkg/c.py", "pkg/b.py"), ("pkg/d.py", "pkg/c.py"), ("tests/test_b.py", "pkg/b.py"), ("tests/test_c.py", "pkg/c.py"), ("tests/test_d.py", "pkg/d.py")]
    imports = [dict(import_id=f"i{n}", repo="r", file_path=p, specifier="x", resolved_path=q) for n, (p, q) in enumerate(links)]
    imports.append(dict(import_id="p", repo="r", file_path="tests/test_p.py", specifier="..pkg.other"))
    folder = tables(
        source_files=[dict(file_id=n, repo="r", file_path=p) for n, p in enumerate(paths)],
        import_edges=imports,
        task_snapshots=[dict(task_id="t", repo="r", received_at=AT, planned_edit_targets=["pkg/a.py"]), dict(task_id="u", repo="r", received_at=AT, planned_edit_targets=["tests/test_c.py"]), dict(task_id="v", repo="s", received_at=AT, planned_edit_targets=["tests/test_b.py"])],
    )
    got = {(r.task_id, r.test): (r.score, r.tier) for r in analysis.q13_recommend_tests(spark, folder).collect()}
    # test_b is two steps above a and tests b; test_c tests c, two steps above a, and was planned once; test_d is too far
    want = {("t", "tests/test_b.py"): (8.0, 0), ("t", "tests/test_c.py"): (4.5, 1), ("t", "tests/test_p.py"): (3.0, 1), ("u", "tests/test_c.py"): (8.5, 0)}
    assert got == want


def test_edges_of_every_kind_with_facts(spark, tables):
    code = "@app.task\ndef run():\n    helper()\n    other.far()\n\n\nclass Sub(Base):\n    pass\n"
    symbols = [("s1", "a.py", "run", "function", 2, 4), ("s2", "a.py", "Sub", "class", 7, 8), ("s3", "b.py", "helper", "function", 1, 2), ("s4", "b.py", "Base", "class", 3, 4), ("s5", "c.py", "far", "route", 1, 2), ("s6", "c.py", "Shape", "interface", 3, 4)]
    folder = tables(
        source_files=[dict(file_id=n, repo="r", file_path=p, source_text=t) for n, (p, t) in enumerate([("a.py", code), ("b.py", ""), ("c.py", ""), ("test_b.py", "")])],
        symbols=[dict(symbol_id=i, repo="r", file_path=p, sym_name=n, qualified_name=n, sym_kind=k, is_exported=True, start_line=x, end_line=y, indexed_at=AT) for i, p, n, k, x, y in symbols],
        import_edges=[
            dict(import_id="1", repo="r", file_path="a.py", specifier="b", imported_name="helper", resolved_path="b.py"), dict(import_id="2", repo="r", file_path="a.py", specifier="b", imported_name="Base", resolved_path="b.py", is_type_only=True),
            dict(import_id="3", repo="r", file_path="a.py", specifier="c", imported_name="*", local_name="other", resolved_path="c.py"), dict(import_id="4", repo="r", file_path="test_b.py", specifier="b", resolved_path="b.py"),
        ],
        placeholder_findings=[],
    )
    got = {(r.edge_kind, r.from_path, r.from_symbol, r.to_path, r.to_symbol): r.weight for r in analysis.g1_typed_edges(spark, folder).collect() if r.edge_kind != "DEFINES"}
    want = {("EXPORTS", p, None, p, i): 2.8 for i, p, _, k, *_ in symbols if k != "interface"} | {
        ("TYPE_EXPORTS", "c.py", None, "c.py", "s6"): 2.8, ("ROUTE", "c.py", None, "c.py", "s5"): 4.0, ("JOB", "a.py", None, "a.py", "s1"): 4.0,
        ("IMPORTS", "a.py", None, "b.py", None): 3.0, ("IMPORTS", "a.py", None, "c.py", None): 3.0, ("IMPORTS", "test_b.py", None, "b.py", None): 3.0, ("IMPORTS", "a.py", None, "b.py", "s3"): 3.2,
        ("REFERENCES", "a.py", None, "b.py", "s3"): 2.0, ("REFERENCES", "a.py", None, "b.py", "s4"): 2.0, ("REFERENCES", "a.py", "s2", "b.py", "s4"): 1.5, ("EXTENDS", "a.py", "s2", "b.py", "s4"): 2.5,
        ("CALLS", "a.py", "s1", "b.py", "s3"): 2.5, ("CALLS", "a.py", "s1", "c.py", "s5"): 2.5, ("TESTS", "test_b.py", None, "b.py", None): 3.0, ("TEST_COVERS_WORKFLOW", "test_b.py", None, "b.py", None): 2.8,
    }
    assert got == want


def test_symbol_lane_counts_imports_and_usages(spark, tables):
    folder = tables(
        task_snapshots=[dict(task_id="t", repo="r", received_at=AT, task_text="quota planner")],
        symbols=[dict(symbol_id="s", repo="r", file_path="a.py", sym_name="planner", qualified_name="planner", sym_kind="function", indexed_at=AT)],
        import_edges=[dict(import_id="1", repo="r", file_path="b.go", specifier="quota", imported_name="zzz"), dict(import_id="2", repo="r", file_path="d.go", specifier="yyy")],
        source_files=[dict(file_id=1, repo="r", file_path="c.py", source_text="planner()\nplanner()\nxxx()\n")],
    )
    got = {r.doc: r.score for r in analysis.q1c_symbols(spark, folder).collect()}
    # one of two terms scores 2: a symbol 2 + 1, an import 2 + 1 (its bound name matches nothing), two usages 2 * (2 - 1)
    assert got == {"a.py": 3.0, "b.go": 3.0, "c.py": 2.0}


def test_rank_has_usages_churn_and_outcomes(spark, tables):
    calls = [dict(edge_id=str(n), repo="r", edge_kind=k, from_path="a.py", to_path="b.py") for n, k in enumerate(["CALLS", "CALLS", "REFERENCES", "IMPORTS"])]
    folder = tables(
        source_files=[dict(file_id=n, repo="r", file_path=p) for n, p in enumerate(["a.py", "b.py"])], import_edges=[], symbols=[], placeholder_findings=[], graph_edges=calls,
        task_snapshots=[dict(task_id=str(n), repo=r, received_at=AT, planned_edit_targets=["b.py"]) for n, r in enumerate("r" * 7 + "s")],
    )
    got = {r.path: (r.usage, r.churn, r.outcome, r["rank"]) for r in analysis.a3_composite_rank(spark, folder).collect()}
    assert got == {"a.py": (2.0, 0.0, 0.0, 2.0), "b.py": (0.0, 0.0, 3.0, 3.0)}
    files = spark.createDataFrame([("r", "a.py", False, False, False)], "repo string, path string, is_test boolean, dirty boolean, generated boolean")
    none = spark.createDataFrame([], "repo string, path string, resolved string, score double")
    log = spark.createDataFrame([("r", "a.py", 6), ("r", "a.py", 4)], "repo string, path string, commits int")
    assert ranking.composite_rank(files, none, none, none, none, churn=log).first()["rank"] == 2.5


def test_search_takes_every_term_also_inside_words(spark, tables):
    text = {"a.py": "x = preloadBar()\n", "b.py": "the tax\n" * 30, "c.py": "nothing\n", "d.py": "fix it\nload tax\n"}
    folder = tables(
        task_snapshots=[dict(task_id="t", repo="r", received_at=AT, task_text="fix load of tax"), dict(task_id="u", repo="r", received_at=AT, task_text="an of it")],
        source_files=[dict(file_id=n, repo="r", file_path=p, source_text=t) for n, (p, t) in enumerate(text.items())] + [dict(file_id=9, repo="s", file_path="e.py", source_text="load")],
        symbols=[], import_edges=[], placeholder_findings=[],
    )
    got = {(r.query, r.path): (r.origin, r.place) for r in analysis.q2_search(spark, folder).collect() if r.origin == "raw"}
    assert got == {("t", "b.py"): ("raw", 1), ("t", "d.py"): ("raw", 2), ("t", "a.py"): ("raw", 3)}
    asked = spark.createDataFrame([("t", "r", w) for w in ("fix", "load", "tax")], "query string, repo string, term string")
    files = spark.createDataFrame([("r", p, t) for p, t in text.items()], "repo string, path string, text string")
    assert {r.path: r.hits for r in scan.literal_hits(files, asked).collect()} == {"a.py": 1, "b.py": 25, "d.py": 2}


def test_signature_of_each_snapshot(spark, tables):
    entries = [("1", "w", "x", "h"), ("1", "w", "y", "h"), ("2", "w", "x", "h"), ("3", "v", "x", "h"), ("3", "v", "x", "h"), ("4", "v", "x", "g")]
    folder = tables(
        dirty_files=[dict(snapshot_id=s, repo_root=w, file_path=p, dirty_hash=h) for s, w, p, h in entries],
        freshness=[dict(snapshot_id=s, repo_root=w, head_commit=c, received_at=AT) for s, w, c in [("1", "w", "c"), ("2", "w", "c"), ("3", "v", "c"), ("4", "v", "c"), ("5", "v", "c"), ("6", "v", "d")]],
    )
    got = {r.snapshot_id: r for r in analysis.t2_signature(spark, folder).collect()}
    assert {k: (r.repo_root, r.entries) for k, r in got.items()} == {"1": ("w", 2), "2": ("w", 1), "3": ("v", 1), "4": ("v", 1), "5": ("v", 0), "6": ("v", 0)}
    assert got["2"].signature == got["3"].signature  # the same entries on the same commit
    assert len({r.signature for r in got.values()}) == 5
