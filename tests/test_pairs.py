"""Pairs of queries and documents: against brute force over several blocks, and without a shuffle of pairs."""

import random
import tracemalloc
from collections import Counter
from math import log
from pathlib import Path
from time import process_time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import pairs, retrieve
from quarryline.plans import analysis as A

SMALL = Path("/root/testdata/sf0.001")
WORDS = "queue poll run status hook planner quota tenant cache parse".split()


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(pairs, "MOST_ITEMS", 40)
    monkeypatch.setattr(pairs, "MOST_ROWS", 7)
    keep = pairs.cells
    monkeypatch.setattr(pairs, "cells", lambda docs, queries, items=40: keep(docs, queries, items, 5))


@pytest.fixture
def asked(spark):
    rng = random.Random(3)
    rows = [(n, "rs"[n % 2], " ".join(rng.choices(WORDS, k=rng.randint(1, 3)))) for n in range(24)] + [(90, "r", ""), (91, "none", "queue"), (92, "r", "code"), (93, None, "queue")]
    q = spark.createDataFrame(rows, "query long, scope string, text string").withColumn("terms", X.expanded_terms(F.col("text")))
    return q.cache()


def shuffles_pairs(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return any("hashpartitioning(query" in line and "doc" in line for line in plan.splitlines())


def test_bm25_of_blocks(spark, small, asked):
    rng = random.Random(4)
    tf = {(s, f"d{n}", t): rng.randint(1, 4) for s in "rs" for n in range(30) for t in rng.sample(WORDS, 4)}
    terms = spark.createDataFrame([(*k, n) for k, n in tf.items()], "scope string, doc string, term string, tf long")
    docs = spark.createDataFrame([(s, f"d{n}") for s in "rs" for n in range(33)], "scope string, doc string")
    df = retrieve.bm25(terms, docs, asked)
    assert not shuffles_pairs(df)
    got = {(r.query, r.doc): (round(r.score, 9), r.matched) for r in df.collect()}
    length = Counter()
    for (s, d, _), n in tf.items():
        length[s, d] += n
    want = {}
    for r in asked.collect():
        average = sum(max(1, length[r.scope, f"d{n}"]) for n in range(33)) / 33
        for n in range(33):
            d = f"d{n}"
            score, met = 0.0, 0
            for t in r.terms:
                if (r.scope, d, t) in tf:
                    f, df = tf[r.scope, d, t], sum((r.scope, f"d{m}", t) in tf for m in range(33))
                    score += log(1 + (33 - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.28 + 0.72 * length[r.scope, d] / average))
                    met += 1
            if met:
                want[r.query, d] = (round(score, 9), met)
    assert got == want and len(got) > 400
    top = retrieve.bm25(terms, docs, asked, 3, 6).collect()
    for q in {q for q, _ in want}:
        best = sorted((-round(s, 6), d) for (p, d), (s, _) in want.items() if p == q)[:3]
        assert sorted((-r.score, r.doc) for r in top if r.query == q)[:3] == best


def test_symbol_lane_of_blocks(spark, small, asked):
    rng = random.Random(5)
    names = [*("".join(w.capitalize() for w in rng.choices(WORDS, k=2)) for _ in range(20)), "queues_x", "repolling", "a", "", "code system", "décodeQueue"]
    path = {n: f"src/{rng.choice(WORDS)}/f{n}.py" for n in range(40)}
    syms = [(f"{n}", rng.choice("rs"), path[rng.randrange(40)], rng.choice(names), rng.choice([None, *names]), rng.random() < 0.5) for n in range(150)]
    symbols = spark.createDataFrame(syms, "symbol_id string, repo string, path string, name string, qualified_name string, exported boolean")
    imps = [(f"{n}", rng.choice("rs"), path[rng.randrange(40)], rng.choice(names), None, rng.choice([None, *names]), None) for n in range(100)]
    imports = spark.createDataFrame(imps, "import_id string, repo string, path string, specifier string, imported_name string, local_name string, resolved string")
    used = [(rng.choice("rs"), path[rng.randrange(40)], x, x, rng.randint(1, 3)) for x in names for _ in range(4)]
    usages = spark.createDataFrame(used, "repo string, path string, name string, text string, n long").distinct()
    df = retrieve.symbol_lane(asked, symbols, imports, usages)
    assert not shuffles_pairs(df)
    got = {(r.query, r.doc): r.score for r in df.collect()}
    one = lambda c: X.match_score(F.col("text"), F.col("terms"), c)

    def parts(df, add, n, *values):
        df = df.withColumnRenamed("text", "value")
        best = F.greatest(*(F.when(F.col(v).isNull(), 0.0).otherwise(one(F.col(v))) for v in values), F.lit(0.0))
        return df.join(asked, F.col("repo") == F.col("scope")).withColumn("b", best).where("b > 0").select("query", "path", (n * F.greatest(F.lit(0.0), F.col("b") + add)).alias("s"))

    every = parts(symbols, F.when(F.col("exported"), 4.0).otherwise(1.0), F.lit(1), "name", "qualified_name", "path")
    every = every.union(parts(imports, F.lit(1.0), F.lit(1), "specifier", "local_name")).union(parts(usages, F.lit(-1.0), F.col("n"), "name", "value", "path"))
    want = {(r["query"], r.path): r.s for r in every.groupBy("query", "path").agg(F.sum("s").alias("s")).where("s > 0").collect()}
    assert got == want and len(got) > 200


def test_exact_lane_of_blocks(spark, small, asked):
    rng = random.Random(6)
    files = spark.createDataFrame([(s, f"{rng.choice(WORDS)}/{'_'.join(rng.choices(WORDS, k=rng.randint(1, 3)))}.py") for s in "rs" for _ in range(40)], "repo string, path string").distinct()
    df = retrieve.exact_lane(asked, files)
    assert not shuffles_pairs(df)
    got = {(r.query, r.doc): r.score for r in df.collect()}
    best = F.greatest(*(X.match_score(F.col("text"), F.col("terms"), v) for v in (F.col("path"), retrieve.base_name(F.col("path")), retrieve.stem(F.col("path")))))
    want = {(r["query"], r.path): r.s + 8 for r in files.join(asked, F.col("repo") == F.col("scope")).withColumn("s", best).where("s >= 6").collect()}
    assert got == want and got


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
def test_fusion_is_that_of_whole_lanes(spark):
    q, r = A._queries(spark, str(SMALL)), A.ranked(spark, str(SMALL)).cache()
    ranks = r.select(F.col("repo").alias("scope"), F.col("path").alias("doc"), "rank")
    lanes = {"exact": retrieve.exact_lane(q, r), "symbol": A._symbol_lane(spark, str(SMALL)), "bm25": A._bm25(spark, str(SMALL)).drop("matched"), "dirty": retrieve.dirty_lane(q, r)}
    lanes = {name: lane.cache() for name, lane in lanes.items()}
    lanes["graph"] = retrieve.graph_lane(retrieve.fuse(lanes, ranks), A.facts.imports(spark, str(SMALL)), A.facts.edges(spark, str(SMALL)))
    want = {}
    for x in retrieve.fuse(lanes, ranks).collect():
        want.setdefault(x.query, []).append((-round(x.score, 6), x.doc, x.lanes))
    df = A.q1i_fusion(spark, str(SMALL))
    assert not shuffles_pairs(df)
    got = {}
    for x in sorted(df.collect(), key=lambda x: x.place):
        got.setdefault(x.query, []).append((-x.score, x.doc, x.lanes))
    assert got == {k: sorted(v)[:20] for k, v in want.items()}


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["e1_scenarios", "q2_search", "q1c_bound_symbols"])
def test_pairs_stay_in_their_tasks(spark, name):
    df = A.QUERIES[name](spark, str(SMALL))
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString() and not shuffles_pairs(df)


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
def test_only_covered_files_are_asked_for_as_seeds(spark, monkeypatch):
    seen, keep = [], retrieve.matched
    monkeypatch.setattr(retrieve, "matched", lambda lists, *rest: (seen.append({(r.scope, r.doc) for r in lists.select("scope", "doc").collect()}), keep(lists, *rest))[1])
    A.q1f_tests(spark, str(SMALL))
    assert seen[0] and seen[0] <= {(r.repo, r.target) for r in A.tested(spark, str(SMALL)).collect()}


def cell():
    """Documents with 12 items each of two values, and queries, as a cell has them."""
    rng = random.Random(7)
    names = ["_".join(rng.choices(WORDS, k=3)) + str(n) for n in range(6_000)]
    one = lambda: dict(values=rng.sample(names, 2), own=rng.random() < 0.5, add=rng.choice([1.0, 4.0, -1.0]), n=rng.choice([1, 1, 3]))
    docs = pa.array([dict(doc=f"src/{rng.choice(WORDS)}/f{d}.py", items=[one() for _ in range(12)]) for d in range(2_000)])
    texts = ["rename " + "_".join(rng.choices(WORDS, k=3)) for _ in range(160)]
    return docs, pa.array([dict(query=k, text=t, terms=sorted({"rename", *t.split()[1].split("_")})) for k, t in enumerate(texts)])


def test_items_take_less_time_than_a_few_passes_for_each_query():
    docs, queries = cell()

    def seconds(job):
        began = process_time()
        job()
        return process_time() - began

    doc, worth = np.repeat(np.arange(2_000), 12), np.ones(24_000)
    items = min(seconds(lambda: sum(len(x[1]) for x in pairs.item_rows()(docs, queries))) for _ in range(3)) - min(seconds(lambda: pairs.Items(docs, queries)) for _ in range(3))
    passes = min(seconds(lambda: [np.bincount(doc, worth) for _ in range(6 * 160)]) for _ in range(3))
    assert items < passes


def test_texts_are_reduced_all_at_once():
    rng = random.Random(9)
    pieces = [*"abAB09_- .\n\0/éİKß", "queue", "Poll", "PollHTTP"]
    texts = [None, "", " ", " a", "a ", "A", "aB", "é", "Z9a", *("".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(3_000))]
    for some in (pa.array(texts), pa.array(texts).slice(4), pa.array([], pa.string()), pa.array([None], pa.null())):
        assert pairs._plains(some).tobytes().decode() == "".join(pairs._plain(t) + "\n" for t in some.to_pylist())


def test_values_are_read_in_less_time_than_one_by_one():
    rng = random.Random(10)
    texts = [f"src/{rng.choice(WORDS)}/{rng.choice(WORDS)}{rng.choice(WORDS).capitalize()}_{rng.getrandbits(20):x}.py" for _ in range(30_000)]
    docs = pa.array([dict(doc=t, items=[dict(values=[t.split("/")[-1]], own=True, add=0.0, n=1)]) for t in texts])
    queries = pa.array([dict(query=k, text=f"rename {a}_{b}", terms=sorted({"rename", a, b})) for k, (a, b) in enumerate((a, b) for a in WORDS for b in WORDS)])

    def seconds(job):
        began = process_time()
        job()
        return process_time() - began

    one = min(seconds(lambda: [pairs._plain(t) for _ in range(2) for t in texts]) for _ in range(3))
    assert min(seconds(lambda: pairs.Items(docs, queries)) for _ in range(3)) < 1.5 * one


def test_documents_of_many_items_and_odd_sums():
    words = [f"{a}_{b}" for a in WORDS for b in WORDS]
    for adds in ((1.0, 4.0, -1.0, 0.0), (0.3, -0.2), (200.0,)):
        rng = random.Random(8)
        items = [[dict(values=rng.sample(words, rng.randint(0, 2)), own=False, add=rng.choice(adds), n=rng.choice([1, 2, 5])) for _ in range(m)] for m in (0, 300, 1, 64, 65, 200)]
        docs = pa.array([dict(doc=f"d{d}", items=x) for d, x in enumerate(items)])
        queries = pa.array([dict(query=k, text=t, terms=t.split()) for k, t in enumerate(["", "queue poll", "hook", "tenant quota cache", "oll"])])
        value = {w: pairs.Matches([w], queries).scores(0, 5)[0] / 2 for w in words}
        got = {(k, d): round(s, 6) for k, hit, score in pairs.item_rows()(docs, queries) for d, s in zip(hit.tolist(), score.tolist(), strict=True)}
        want = Counter()
        for d, x in enumerate(items):
            for k in range(5):
                best = [(max((value[v][k] for v in i["values"]), default=0), i) for i in x]
                want[k, d] = round(sum(i["n"] * max(0.0, b + i["add"]) for b, i in best if b > 0), 6)
        assert got == {k: s for k, s in want.items() if s > 0} and len(got) > 8


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["q1b_exact", "q1c_bound_symbols"])
def test_rows_go_out_as_they_leave_their_tasks(spark, name):
    df = A.QUERIES[name](spark, str(SMALL))
    assert df.columns == ["query", "doc", "score"] and df._jdf.queryExecution().optimizedPlan().nodeName() == "MapInArrow"


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
def test_bound_names_come_from_the_same_reading_of_imports(spark, monkeypatch):
    seen, keep = [], retrieve.matched
    monkeypatch.setattr(retrieve, "matched", lambda lists, *rest, **more: (seen.append(lists._jdf.queryExecution().executedPlan().toString()), keep(lists, *rest, **more))[1])
    A.q1c_bound_symbols(spark, str(SMALL))
    assert seen[0].count("FileScan parquet") == 2 and seen[0].count("hashpartitioning(scope") == 1


def test_bound_names_are_usages(spark):
    q = spark.createDataFrame([(1, "r", "queue", ["queue"])], "query long, scope string, text string, terms array<string>")
    symbols = spark.createDataFrame([], "symbol_id string, repo string, path string, name string, qualified_name string, exported boolean")
    rows = [("r", "a.py", "x", None, "queue", None), ("r", "a.py", "y", None, "queue", None), ("r", "b.py", "z", None, None, None), ("r", "c.py", "my_queue", None, None, None), ("r", "queue/d.py", None, None, None, None), ("r", "queue/e.py", None, None, "z", None)]
    imports = spark.createDataFrame(rows, "repo string, path string, specifier string, imported_name string, local_name string, resolved string")
    bound = F.coalesce("local_name", "imported_name", "specifier")
    usages = imports.select("repo", "path", bound.alias("name"), bound.alias("text")).where("name is not null").groupBy("repo", "path", "name", "text").agg(F.count("*").alias("n"))
    got = {r.doc: r.score for r in retrieve.symbol_lane(q, symbols, imports, bound=bound).collect()}
    assert got == {r.doc: r.score for r in retrieve.symbol_lane(q, symbols, imports, usages).collect()}
    assert got == {"a.py": 2 * (14 + 1) + 2 * (14 - 1), "c.py": 10 + 1 + 10 - 1, "queue/e.py": 10 - 1}


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
def test_scenarios_take_both_rankings_from_one_pass(spark):
    df = A.e1_scenarios(spark, str(SMALL))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    t = A.facts.tasks(spark, str(SMALL)).where(F.size("planned") > 0).select(F.col("task_id").alias("query"), F.array_distinct("planned").alias("expected"))
    terms = A.ranking.top_k(A._bm25(spark, str(SMALL), digits=6), ["query"], [F.col("score").desc(), F.col("doc").asc()], 20)
    lists = [x.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc"))), lambda y: y["doc"]).alias(n)) for x, n in ((A.q1i_fusion(spark, str(SMALL)), "found"), (terms, "baseline"))]
    none = F.array().cast("array<string>")
    s = t.join(lists[0], "query", "left").join(lists[1], "query", "left").select(F.col("query").alias("scenario"), "expected", F.coalesce("found", none).alias("found"), F.coalesce("baseline", none).alias("baseline"), *(none.alias(n) for n in ("tests_found", "tests_expected", "forbidden")), F.lit(0.0).alias("min_recall"))
    assert sorted(map(str, df.collect())) == sorted(map(str, A.evaluate.score_scenarios(s).collect()))


def test_groups_are_views_of_one_copy():
    rng = np.random.default_rng(11)
    keys, values = rng.integers(0, 50, 2_000), rng.integers(0, 9, 2_000)
    got, twice = pairs._groups(keys, 60, values, values * 2)
    assert [x.tolist() for x in got] == [values[keys == k].tolist() for k in range(60)]
    assert [x.tolist() for x in twice] == [(values[keys == k] * 2).tolist() for k in range(60)]
    assert len({id(x.base) for x in got}) == 1


def test_fusion_holds_links_of_a_scope_once():
    rng = random.Random(12)
    names = [f"src/{rng.choice(WORDS)}/f{d}.py" for d in range(1_000)]
    one = lambda d: dict(doc=d, rank=1.0, dirty=False, paths=[dict(values=[d.split("/")[-1]], own=True, add=0.0, n=1)], items=[dict(values=[d[:-3]], own=True, add=1.0, n=1)], terms=[dict(term=rng.choice(WORDS), tf=2)], length=2, imports=rng.sample(names, 8), edges=rng.sample(names, 8))
    docs = pa.array([one(d) for d in names])
    queries = pa.array([dict(query=k, text=t, terms=[t], changing=False, asked=[dict(term=t, idf=1.0)], avg_length=2.0) for k, t in enumerate(WORDS)])
    tracemalloc.start()
    rows = list(pairs.fused_rows(retrieve.LANE_WEIGHT, raw=20)(docs, queries))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a copy for each document of its scope's links took 4 * 1,000 * 64 KB
    assert len(rows) == 20 and most < 32e6


def test_postings_of_raw_term_ranks_are_held_once():
    rng = random.Random(13)
    terms = [f"{a}{n}" for a in WORDS for n in range(30)]
    docs = pa.array([dict(doc=f"d{d}", terms=[dict(term=t, tf=2) for t in rng.sample(terms, 10)], length=20) for d in range(2_000)])
    queries = pa.array([dict(query=k, asked=[dict(term=t, idf=1.0)], avg_length=20.0) for k, t in enumerate(terms)])
    tracemalloc.start()
    found = pairs.Terms(docs, queries)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a copy for each term of all postings took 2 * 300 * 160 KB
    assert sum(len(x) for x in found.by_doc) == 20_000 and most < 16e6


def test_a_whole_scope_comes_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_DOCS", 10)
    docs = spark.createDataFrame([("r", f"d{n}", 1) for n in range(60)] + [("s", "e", 1)], "scope string, doc string, n int")
    grid = pairs.cells(docs, spark.createDataFrame([("r", 1), ("s", 2)], "scope string, query int"), None)
    assert max(len(r.docs) for r in grid.collect()) < 60
    rows = lambda docs, queries: iter([(0, np.arange(len(docs)), np.full(len(docs), len(docs)))])
    assert sorted((r.query, r.doc, r.n) for r in pairs.scored(grid, rows, "n long").collect()) == sorted([(1, f"d{n}", 60) for n in range(60)] + [(2, "e", 1)])
