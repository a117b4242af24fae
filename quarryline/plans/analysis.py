"""Queries of the code-intelligence operators over the fact tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import paths as P
from quarryline.functions import search as Z
from quarryline.functions import text as X
from quarryline.operators import changes, evaluate, exports, graph, ledger, memory, packets, ranking, relations, resolve, retrieve, scan, workflows
from quarryline.plans import facts
from quarryline.plans import sqlparts as S
from quarryline.schema import CALLEE_KINDS, CALLER_KINDS, EDGE_ORDER, FUNCTIONAL_WEIGHT, IMPACT_KINDS, ordinal
from quarryline.session import cut, table
from quarryline.sources import config
from quarryline.sources.extract import extract_facts
from quarryline.streaming import live

KEY = ["repo", "path"]
#: First directories that are too broad to be a package.
BROAD_ROOTS = "api backend server service src web tests scripts".split()
SQL: dict[str, str] = {}


def tested(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, path, target, confidence): tests that import a file of their repository."""
    known = facts.files(spark, folder)
    i = facts.imports(spark, folder, ("repo", "path", "type_only", "resolved")).where("not type_only and resolved is not null")
    i = i.join(known.where("is_test").select(*KEY), KEY, "left_semi")
    i = i.join(known.select("repo", F.col("path").alias("resolved")), ["repo", "resolved"], "left_semi")
    return i.select("repo", "path", F.col("resolved").alias("target"), F.lit("authoritative").alias("confidence")).distinct()


def ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Files with their rank. A usage is a call or reference out of a file; no table tells churn."""
    e = facts.edges(spark, folder, ("repo", "edge_kind", "from_path")).where("edge_kind in ('CALLS', 'REFERENCES') and from_path is not null")
    return ranking.composite_rank(
        facts.files(spark, folder), facts.imports(spark, folder, ("repo", "path", "resolved")), facts.symbols(spark, folder, ("repo", "path")),
        facts.risks(spark, folder, ("repo", "path")), tested(spark, folder).select("repo", F.col("target").alias("path")),
        usages=e.select("repo", F.col("from_path").alias("path")), outcomes=planned_boosts(spark, folder).select("repo", "path", "boost"),
    )


def planned_boosts(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, path, boost, outcomes): as t8_outcome_boost, per repository; the tables hold no other outcomes than plans."""
    t = facts.tasks(spark, folder)
    o = t.select("repo", F.col("task_id").alias("outcome_id"), F.explode(F.coalesce("planned", F.array().cast("array<string>"))).alias("path"), F.lit(0.5).alias("amount"))
    return memory.outcome_boosts(o, KEY)


# ------------------------------------------------------------ functions
def f1_stable_id(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of files and symbols."""
    f = facts.files(spark, folder).select(X.stable_id(F.lit("file"), "repo", "path").alias("id"))
    s = facts.symbols(spark, folder).select(X.stable_id(F.lit("symbol"), "repo", "path", "qualified_name", "kind", F.col("start_line").cast("string")).alias("id"))
    return f.unionByName(s)


SQL["f1_stable_id"] = (
    S.facts("files", "syms") + " select substr(sha1(concat_ws(chr(0), 'file', repo, path)), 1, 16) id from files union all"
    " select substr(sha1(concat_ws(chr(0), 'symbol', repo, path, qualified_name, kind, start_line::varchar)), 1, 16) from syms"
)


def f2_path_classes(spark: SparkSession, folder: str) -> DataFrame:
    """What the path alone tells of every file."""
    p = F.col("path")
    return facts.files(spark, folder).select(
        "repo", "path", "language", "is_test", "generated", "module", P.is_public(p).alias("public"), P.is_skipped(p).alias("skipped"), P.is_decoy(p).alias("decoy")
    )


SQL["f2_path_classes"] = S.facts("files") + f"""
    select repo, path, lang as "language", is_test, generated, module, regexp_matches(path, {S.quoted(P.PUBLIC)}) public,
    len(list_intersect(string_split_regex(path, '[/\\\\]'), [{",".join(map(S.quoted, P.SKIPPED_DIRECTORIES))}])) > 0 or {" or ".join(f"ends_with(path, {S.quoted(e)})" for e in P.SKIPPED_ENDS)} skipped,
    regexp_matches(lower(regexp_replace(path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), {S.quoted(P.DECOY_WORD)})
    or regexp_matches(regexp_replace(lower(regexp_replace(path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', '', 'g'), {S.quoted(P.DECOY_PART)}) decoy from files"""


def f7_token_doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    """In how many documents each term occurs."""
    terms = table(spark, folder, "documents").select("doc_id", F.explode(X.tokenize(F.col("text"))).alias("term")).distinct()
    return terms.groupBy("term").agg(F.count("*").alias("df"))


SQL["f7_token_doc_freq"] = f"select term, count(distinct doc_id) df from (select doc_id, unnest({S.tokens('text')}) term from documents) group by term"


def f9_task_intents(spark: SparkSession, folder: str) -> DataFrame:
    """Expanded terms and intents of every task."""
    t = facts.tasks(spark, folder).withColumn("terms", X.expanded_terms(F.col("task_text")))
    return t.select("task_id", F.array_join("terms", ",").alias("terms"), F.array_join(X.intents(F.col("task_text"), F.col("terms")), ",").alias("intents"))


_INTENT = "list_filter([" + ",".join(f"case when regexp_matches(j, {S.quoted(p)}) then {S.quoted(n)} end" for n, p in X.INTENTS.items()) + "], lambda x: x is not null)"
SQL["f9_task_intents"] = S.facts("tasks") + f""", e as (select task_id, task_text, {S.expanded("task_text")} terms from tasks),
    j as (select *, lower(coalesce(task_text, '')) || ' ' || array_to_string(terms, ' ') j from e)
    select task_id, array_to_string(terms, ',') terms, case when len({_INTENT}) > 0 then array_to_string({_INTENT}, ',') else 'unknown' end intents from j"""


def f10_match_score(spark: SparkSession, folder: str) -> DataFrame:
    """How well the text of each task matches each of its focus files."""
    t = facts.tasks(spark, folder).withColumn("terms", X.expanded_terms(F.col("task_text")))
    each = t.select("task_id", "task_text", "terms", F.explode(F.array_distinct("focus")).alias("path"))
    return each.select("task_id", "path", X.match_score(F.col("task_text"), F.col("terms"), F.col("path")).alias("score"))


SQL["f10_match_score"] = S.facts("tasks") + f""", e as (select task_id, task_text, {S.expanded("task_text")} terms, unnest(list_distinct(focus)) path from tasks)
    select task_id, path, {S.match_score("task_text", "terms", "path")}::double score from e"""


# ------------------------------------------------------------ aggregation
def a1_in_degree(spark: SparkSession, folder: str) -> DataFrame:
    """How many imports lead to each file."""
    i = facts.imports(spark, folder, ("repo", "resolved")).where("resolved is not null")
    return ranking.count_by(i, ["repo", "resolved"], "importers")


SQL["a1_in_degree"] = S.facts("imps") + " select repo, resolved, count(*) importers from imps where resolved is not null group by all"


def a2_risk_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Sum and number of the findings of each file."""
    return facts.risks(spark, folder, ("repo", "path")).groupBy(*KEY).agg(F.round(F.sum("score"), 6).alias("risk"), F.count("*").alias("findings"))


SQL["a2_risk_sum"] = S.facts("risks") + " select repo, path, round(sum(score), 6) risk, count(*) findings from risks group by all"


def a3_composite_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The rank of every file and its parts."""
    parts = ("centrality", "symbol_part", "surface", "near_tests", "dirt", "risk_part", "made", "usage", "churn", "outcome", "rank")
    return ranked(spark, folder).select(*KEY, *(F.round(p, 6).alias(p) for p in parts))


_RANKED = S.facts("files", "syms", "imps", "risks", "tasks") + f",\n{S.TESTED},\n{S.RANKED}"
SQL["a3_composite_rank"] = _RANKED + " select repo, path, " + ", ".join(f"round({p}, 6)::double {p}" for p in ("centrality", "symbol_part", "surface", "near_tests", "dirt", "risk_part", "made", "usage", "churn", "outcome", "rank")) + " from ranked"


def a5_module_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Files, rank, best files and relations of every module."""
    rows = ranking.module_rollup(ranked(spark, folder).withColumn("rank", F.round("rank", 6)), facts.edges(spark, folder))
    return rows.withColumn("rank", F.round("rank", 4))


SQL["a5_module_rollup"] = _RANKED + f""", r as (select repo, path, module, round(rank, 6) rank from ranked),
    p as (select *, row_number() over (partition by repo, module order by rank desc, path) pl from r),
    t as (select e.repo, e.edge_id, unnest(list_distinct(list_filter([a.module, b.module], lambda x: x is not null))) module, a.module <> b.module cr from edges e
        left join r a on a.repo = e.repo and a.path = e.from_path left join r b on b.repo = e.repo and b.path = e.to_path),
    c as (select repo, module, count(*) relations, count_if(cr) cross_relations from t group by all)
    select p.repo, p.module, count(*) files, round(sum(rank), 4) rank, string_agg(path, ',' order by pl) filter (where pl <= 8) top_files,
    coalesce(any_value(c.relations), 0) relations, coalesce(any_value(c.cross_relations), 0)::bigint cross_relations from p left join c on c.repo = p.repo and c.module = p.module group by p.repo, p.module"""


def a6_evidence_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of edges by confidence and by source, as text, for each kind."""
    e = facts.edges(spark, folder, ("edge_kind", "confidence", "fact_source"))
    c = ranking.counts_map(e, ["edge_kind"], "confidence").withColumnRenamed("counts", "confidences")
    return c.join(ranking.counts_map(e, ["edge_kind"], "fact_source").withColumnRenamed("counts", "sources"), "edge_kind")


SQL["a6_evidence_counts"] = S.facts("edges") + """, c as (select edge_kind, confidence v, count(*) n from edges where confidence is not null group by all), s as (select edge_kind, fact_source v, count(*) n from edges where fact_source is not null group by all)
    select edge_kind, confidences, sources from (select edge_kind, string_agg(v || '=' || n, ', ' order by v || '=' || n) confidences from c group by all)
    join (select edge_kind, string_agg(v || '=' || n, ', ' order by v || '=' || n) sources from s group by all) using (edge_kind)"""


def a7_change_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty files grouped by language and module, with their rank and risk."""
    r = ranked(spark, folder).where("dirty")
    return r.groupBy("repo", "language", "module").agg(
        F.count("*").alias("files"), F.round(F.sum("rank"), 4).alias("rank"), F.round(F.sum("risk"), 4).alias("risk"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths")
    )


SQL["a7_change_groups"] = _RANKED + """ select f.repo, lang as "language", module, count(*) files, round(sum(rank), 4) rank, round(sum(coalesce(r.s, 0.0)), 4) risk, string_agg(f.path, ',' order by f.path) paths
    from ranked f left join (select repo, path, sum(score) s from risks group by all) r on r.repo = f.repo and r.path = f.path where dirty group by f.repo, lang, module"""


def a8_placeholder_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of each file: how many, in production, the highest, and counts by category."""
    r = facts.risks(spark, folder)
    sums = r.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(F.col("context") == "production").alias("in_production"), F.max("score").alias("highest"))
    return sums.join(ranking.counts_map(r, KEY, "category"), KEY, "left")


SQL["a8_placeholder_summary"] = S.facts("risks") + """, c as (select repo, path, category, count(*) n from risks where category is not null group by all), m as (select repo, path, string_agg(category || '=' || n, ', ' order by category || '=' || n) counts from c group by all)
    select r.repo, r.path, count(*) n, count(*) filter (where context = 'production') in_production, max(score) highest, any_value(m.counts) counts from risks r left join m on m.repo = r.repo and m.path = r.path group by r.repo, r.path"""


def a14_tier_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Edges by confidence for each repository and kind."""
    return ranking.tier_counts(facts.edges(spark, folder, ("repo", "edge_kind", "confidence")), ["repo", "edge_kind"])


SQL["a14_tier_counts"] = S.facts("edges") + " select repo, edge_kind, count_if(confidence = 'authoritative')::bigint authoritative, count_if(confidence = 'derived')::bigint derived, count_if(confidence = 'heuristic')::bigint heuristic from edges group by all"


def a17_weight_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank median and 95th percentile of edge weights by kind."""
    return facts.edges(spark, folder, ("edge_kind", "weight")).groupBy("edge_kind").agg(F.expr("percentile_disc(0.5) within group (order by weight)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by weight)").alias("p95"))


SQL["a17_weight_percentiles"] = S.facts("edges") + " select edge_kind, quantile_disc(weight, 0.5) p50, quantile_disc(weight, 0.95) p95 from edges group by all"


# ------------------------------------------------------------ top-k, dedupe, sets
def w2_top_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The first three symbols of each file, exported ones first, with the number there are."""
    s = facts.symbols(spark, folder).where("repo is not null and path is not null")
    order = [F.col("exported").desc(), F.col("start_line").asc_nulls_last(), F.col("symbol_id").asc()]
    return ranking.with_total(s, KEY, order, 3).select(*KEY, "symbol_id", "place", "total")


SQL["w2_top_symbols"] = S.facts("syms") + """ select * exclude (e) from (select repo, path, symbol_id, exported e, row_number() over (partition by repo, path order by exported desc, start_line nulls last, symbol_id)::int place,
    count(*) over (partition by repo, path) total from syms where repo is not null and path is not null) where place <= 3"""


def w5_character_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Of each repository the files of highest rank whose sizes together stay within 64 KiB."""
    r = ranked(spark, folder).where("size_bytes is not null").withColumn("rank", F.round("rank", 6))
    return ranking.within_budget(r, ["repo"], [F.col("rank").desc(), F.col("path").asc()], F.col("size_bytes"), 65536).select(*KEY, "used")


SQL["w5_character_budget"] = _RANKED + """ select repo, path, used from (select repo, path, sum(size_bytes) over (partition by repo order by round(rank, 6) desc, path rows unbounded preceding)::bigint used from ranked where size_bytes is not null) where used <= 65536"""


def w7_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Of the findings of a file with equal signal and line the first."""
    r = facts.risks(spark, folder).select(*KEY, "signal_id", "line_no", "finding_id")
    return ranking.first_wins(r.where("line_no is not null"), [*KEY, "signal_id", "line_no"], ["finding_id"])


SQL["w7_first_wins"] = S.facts("risks") + " select repo, path, signal_id, line_no, min(finding_id) finding_id from risks where line_no is not null group by all"


def w8_latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Of each symbol's rows the last."""
    raw = table(spark, folder, "symbols").where("symbol_id is not null").select("symbol_id", "indexed_at", "deleted_at")
    return ranking.latest_wins(raw, ["symbol_id"], ["indexed_at"])


SQL["w8_latest_wins"] = "select symbol_id, indexed_at, deleted_at from (select *, row_number() over (partition by symbol_id order by indexed_at desc nulls last, deleted_at desc nulls last) rn from symbols where symbol_id is not null) where rn = 1"


def u1_fact_union(spark: SparkSession, folder: str) -> DataFrame:
    """All facts in one table with their kind."""
    def tag(df: DataFrame, kind: str, id_: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), "repo", "path")
    e = facts.edges(spark, folder).withColumn("path", F.col("from_path"))
    out = tag(facts.files(spark, folder), "File", "file_id").unionByName(tag(facts.symbols(spark, folder), "Symbol", "symbol_id"))
    return out.unionByName(tag(facts.imports(spark, folder), "ImportEdge", "import_id")).unionByName(tag(e, "GraphEdge", "edge_id")).unionByName(tag(facts.risks(spark, folder), "RiskSignal", "finding_id"))


SQL["u1_fact_union"] = S.facts("files", "syms", "imps", "edges", "risks") + """ select 'File' kind, file_id::varchar id, repo, path from files union all select 'Symbol', symbol_id, repo, path from syms
    union all select 'ImportEdge', import_id, repo, path from imps union all select 'GraphEdge', edge_id, repo, from_path from edges union all select 'RiskSignal', finding_id::varchar, repo, path from risks"""


def u4_symbol_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols (file, kind, name) that the files of a task gained or lost against its baseline."""
    raw = table(spark, folder, "task_snapshots").where("task_id is not null").select("task_id", "repo", F.explode("symbol_baseline").alias("s"))
    before = raw.select("task_id", "repo", F.col("s.file_path").alias("path"), F.col("s.sym_kind").alias("kind"), F.col("s.sym_name").alias("name"))
    now = before.select("task_id", "repo", "path").distinct().join(facts.symbols(spark, folder).select("repo", "path", "kind", "name"), KEY)
    return changes.delta(before, now, ["task_id", "repo", "path", "kind", "name"])


SQL["u4_symbol_delta"] = S.facts("syms") + """, b as (select distinct task_id, repo, s.file_path path, s.sym_kind kind, s.sym_name name from (select task_id, repo, unnest(symbol_baseline) s from task_snapshots where task_id is not null)),
    n as (select distinct b.task_id, b.repo, b.path, s.kind, s.name from (select distinct task_id, repo, path from b) b join syms s on s.repo = b.repo and s.path = b.path)
    (select *, 'new' "change" from n except select *, 'new' from b) union all (select *, 'removed' from b except select *, 'removed' from n)"""


def u5_risk_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by signal that the later half of the year has more often than the earlier one, per file."""
    r = table(spark, folder, "placeholder_findings").where("repo is not null and file_path is not null and indexed_at is not null")
    cols = ["repo", "file_path", "signal_id"]
    early, late = r.where(F.month("indexed_at") <= 6).select(*cols), r.where(F.month("indexed_at") > 6).select(*cols)
    return changes.multiset_delta(early, late)


SQL["u5_risk_delta"] = """select repo, file_path, signal_id, count(*) more from (select repo, file_path, signal_id from placeholder_findings where repo is not null and file_path is not null and month(indexed_at) > 6
    except all select repo, file_path, signal_id from placeholder_findings where repo is not null and file_path is not null and month(indexed_at) <= 6) group by all"""


def u3_existing_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols, and those baseline entries of tasks whose name isn't among the file's symbols yet."""
    own = facts.symbols(spark, folder).select("repo", "path", "name", F.lit("index").alias("origin"))
    raw = table(spark, folder, "task_snapshots").select("repo", F.explode("symbol_baseline").alias("s"))
    other = raw.select("repo", F.col("s.file_path").alias("path"), F.col("s.sym_name").alias("name"), F.lit("task").alias("origin")).distinct()
    return changes.existing_wins(own.distinct(), other, [*KEY, "name"])


SQL["u3_existing_wins"] = S.facts("syms") + """, o as (select distinct repo, path, name from syms), t as (select distinct repo, s.file_path path, s.sym_name name from (select repo, unnest(symbol_baseline) s from task_snapshots))
    select *, 'index' origin from o union all select *, 'task' from t where not exists (select 1 from o where o.repo = t.repo and o.path = t.path and o.name = t.name)"""


def q19_plan_against_actual(spark: SparkSession, folder: str) -> DataFrame:
    """Planned targets of every task against the files that are dirty in its repository now."""
    t = facts.tasks(spark, folder)
    planned = t.select("task_id", F.explode(F.coalesce("planned", F.array().cast("array<string>"))).alias("path"))
    dirty = t.select("task_id", "repo").join(facts.files(spark, folder).where("dirty").select("repo", "path"), "repo").select("task_id", "path")
    return changes.plan_against_actual(planned, dirty, ["task_id", "path"])


SQL["q19_plan_against_actual"] = S.facts("tasks", "files") + """, p as (select distinct task_id, path from (select task_id, unnest(planned) path from tasks)), d as (select distinct t.task_id, f.path from tasks t join files f on f.repo = t.repo and f.dirty)
    select coalesce(p.task_id, d.task_id) task_id, coalesce(p.path, d.path) path, case when p.path is null then 'unplanned' when d.path is null then 'untouched' else 'planned' end state from p full join d on p.task_id = d.task_id and p.path = d.path"""


# ------------------------------------------------------------ joins
def j1_first_hit(spark: SparkSession, folder: str) -> DataFrame:
    """Where each import leads by its specifier: the first of its candidates that is a file of the repository."""
    i = facts.imports(spark, folder).select(F.col("import_id").alias("row_id"), "repo", "path", "specifier").where("specifier is not null")
    hits = relations.first_hit(i, relations.import_candidates(F.col("path"), F.col("specifier")), facts.files(spark, folder).select("repo", F.col("path").alias("target")), "repo", "target")
    return hits.select(F.col("row_id").alias("import_id"), "hit")


def j5_unique_name(spark: SparkSession, folder: str) -> DataFrame:
    """The symbol that each imported name means: in the resolved file, else the only one of the repository."""
    s = facts.symbols(spark, folder).where("name is not null")
    i = facts.imports(spark, folder).where("imported_name is not null").select("import_id", "repo", "resolved", F.col("imported_name").alias("name"))
    near = relations.unique_or_none(s.select("repo", F.col("path").alias("resolved"), "name", "symbol_id"), ["repo", "resolved", "name"], "symbol_id").withColumnRenamed("symbol_id", "hit")
    wide = relations.unique_or_none(s.select("repo", "name", "symbol_id"), ["repo", "name"], "symbol_id").withColumnRenamed("symbol_id", "hit")
    return relations.tiered(i, [near, wide], [["repo", "resolved", "name"], ["repo", "name"]]).select("import_id", "hit", "tier")


SQL["j5_unique_name"] = S.facts("syms", "imps") + """, n as (select repo, path, name, min(symbol_id) hit from syms where name is not null group by all having min(symbol_id) = max(symbol_id)), w as (select repo, name, min(symbol_id) hit from syms where name is not null group by all having min(symbol_id) = max(symbol_id))
    select import_id, coalesce(n.hit, w.hit) hit, case when n.hit is not null then 0 when w.hit is not null then 1 end tier from imps i left join n on n.repo = i.repo and n.path = i.resolved and n.name = i.imported_name left join w on w.repo = i.repo and w.name = i.imported_name where imported_name is not null"""


def j8_test_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The file that each test is for by its name: of the same stem, if the repository has just one such source."""
    f = facts.files(spark, folder)
    plain = F.regexp_replace(F.lower(P.stem(F.col("path"))), r"^test_|_test$|\.(test|spec)$", "")
    sources = relations.unique_or_none(f.where("not is_test").select("repo", F.lower(P.stem(F.col("path"))).alias("name"), "path"), ["repo", "name"], "path").withColumnRenamed("path", "target")
    return f.where("is_test").select("repo", "path", plain.alias("name")).join(sources, ["repo", "name"], "left").select("repo", "path", "target")


SQL["j8_test_targets"] = S.facts("files") + f""", s as (select repo, lower({S.stem("path")}) name, min(path) target from files where not is_test group by all having count(distinct path) = 1)
    select f.repo, f.path, s.target from files f left join s on s.repo = f.repo and s.name = regexp_replace(lower({S.stem("path")}), '^test_|_test$|\\.(test|spec)$', '', 'g') where f.is_test"""


def j14_findings_in_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The narrowest symbol around the line of each finding."""
    r = facts.risks(spark, folder).where("line_no is not null").select("repo", "path", "finding_id", F.col("line_no").alias("a_from"), F.col("line_no").alias("a_to"))
    s = facts.symbols(spark, folder).select("repo", "path", "symbol_id", F.col("start_line").alias("b_from"), F.col("end_line").alias("b_to"))
    return relations.narrowest(relations.overlapping(r, s, KEY), "finding_id", "b_from", "b_to", "symbol_id")


SQL["j14_findings_in_symbols"] = S.facts("risks", "syms") + """ select finding_id, symbol_id enclosing from (select finding_id, symbol_id, row_number() over (partition by finding_id order by end_line - start_line, start_line, symbol_id) rn
    from risks r join syms s on s.repo = r.repo and s.path = r.path and r.line_no between s.start_line and s.end_line and s.start_line <= s.end_line where r.line_no is not null) where rn = 1"""


def j15_overlapping_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of symbols of a file whose ranges overlap."""
    s = facts.symbols(spark, folder)
    a = s.select("repo", "path", F.col("symbol_id").alias("a"), F.col("start_line").alias("a_from"), F.col("end_line").alias("a_to"))
    b = s.select("repo", "path", F.col("symbol_id").alias("b"), F.col("start_line").alias("b_from"), F.col("end_line").alias("b_to"))
    return relations.overlapping(a, b, KEY).where("a < b").select("repo", "path", "a", "b")


SQL["j15_overlapping_symbols"] = S.facts("syms") + " select x.repo, x.path, x.symbol_id a, y.symbol_id b from syms x join syms y on x.repo = y.repo and x.path = y.path and x.symbol_id < y.symbol_id and x.start_line <= y.end_line and y.start_line <= x.end_line and x.start_line <= x.end_line and y.start_line <= y.end_line"


def j16_nearest_readme(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest folder above each code file that holds a document."""
    f = facts.files(spark, folder)
    parent = F.regexp_replace(F.col("path"), r"/?[^/]*$", "")
    docs = f.where("language = 'markdown'").select("repo", parent.alias("folder"))
    code = f.where("language <> 'markdown'").select(F.concat_ws(":", "repo", "path").alias("row_id"), "repo", "path")
    return relations.nearest_scope(code, P.ancestors(F.col("path")), docs, ["repo"]).select("repo", "path", "scope")


SQL["j16_nearest_readme"] = S.facts("files") + r""", d as (select distinct repo, regexp_replace(path, '/?[^/]*$', '') folder from files where lang = 'markdown'),
    m as (select f.repo, f.path, d.folder, row_number() over (partition by f.repo, f.path order by length(d.folder) desc) rn from files f join d on d.repo = f.repo and (d.folder = '' or starts_with(f.path, d.folder || '/')) where f.lang <> 'markdown')
    select f.repo, f.path, m.folder "scope" from files f left join m on m.repo = f.repo and m.path = f.path and rn = 1 where f.lang <> 'markdown'"""


def j17_unindexed(spark: SparkSession, folder: str) -> DataFrame:
    """Planned targets that are no file of the task's repository."""
    t = facts.tasks(spark, folder).select("task_id", "repo", F.explode(F.coalesce("planned", F.array().cast("array<string>"))).alias("path")).distinct()
    return t.join(facts.files(spark, folder).select(*KEY), KEY, "left_anti")


SQL["j17_unindexed"] = S.facts("tasks", "files") + " select distinct task_id, repo, path from (select task_id, repo, unnest(planned) path from tasks) t where not exists (select 1 from files f where f.repo = t.repo and f.path = t.path)"


def j25_longest_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """The longest module path that each file's path begins with."""
    f = facts.files(spark, folder)
    two = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    prefixes = f.select(F.concat(two, F.lit("/")).alias("prefix"), two.alias("replacement")).distinct()
    rows = f.select(F.col("path").alias("row_id"), "path").distinct()
    return relations.longest_prefix(rows, "path", prefixes).select("path", "replacement")


SQL["j25_longest_prefix"] = S.facts("files") + """, p as (select distinct array_to_string(string_split(path, '/')[1:2], '/') r from files), d as (select distinct path from files)
    select path, replacement from (select d.path, p.r replacement, row_number() over (partition by d.path order by length(p.r) desc nulls last) rn from d left join p on starts_with(d.path, p.r || '/')) where rn = 1"""


# ------------------------------------------------------------ graph
def g1_typed_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges built from the facts, with usages and jobs from the texts (only the Python extractor gives usages)."""
    s, i = facts.symbols(spark, folder), facts.imports(spark, folder)
    met = cut(extract_facts(texts(spark, folder).where(P.language_of(F.col("path")) == "python")).where("fact = 'usage' or fact = 'symbol' and kind in ('class', 'function', 'method', 'test')").distinct())
    name = F.when(F.col("kind") == "decorator", F.col("name")).otherwise(F.col("qualified_name"))
    u = met.where("fact = 'usage'").select("repo", "path", name.alias("name"), "kind", F.col("start_line").alias("line")).distinct()
    u = u.withColumn("usage_id", X.stable_id(F.lit("usage"), "repo", "path", "name", "kind", "line"))
    e = graph.typed_edges(s, i, facts.files(spark, folder), tested(spark, folder), facts.risks(spark, folder), resolve.usage_targets(u, i, s), resolve.job_symbols(met, s))
    return e.withColumn("weight", F.round("weight", 6))


def g1_fact_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of g1_typed_edges that follow from the tables, without usages and jobs of texts."""
    e = graph.typed_edges(facts.symbols(spark, folder), facts.imports(spark, folder), facts.files(spark, folder), tested(spark, folder), facts.risks(spark, folder))
    return e.withColumn("weight", F.round("weight", 6))


SQL["g1_fact_edges"] = S.facts("files", "syms", "imps", "risks") + f""", {S.TESTED},
    named as (select distinct repo, path, symbol_id, coalesce(start_line, 0) l, unnest([name, case when qualified_name <> 'default' then qualified_name end]) n from syms where exported),
    firsts as (select * from (select *, row_number() over (partition by repo, path, n order by l, symbol_id) rn from named where n is not null) where rn = 1),
    known as (select i.* from imps i join files f on f.repo = i.repo and f.path = i.resolved),
    bound as (select k.repo, k.path, k.resolved, k.type_only, x.symbol_id from known k join firsts x on x.repo = k.repo and x.path = k.resolved and x.n = k.imported_name where k.imported_name <> '*'), e as (
    select repo, 'DEFINES' edge_kind, path from_path, path to_path, null::varchar from_symbol, symbol_id to_symbol, 0 c, 3.0 weight from syms
    union all select repo, case when kind in ('interface', 'type', 'enum') then 'TYPE_EXPORTS' else 'EXPORTS' end, path, path, null, symbol_id, 0, 2.8 from syms where exported
    union all select repo, 'ROUTE', path, path, null, symbol_id, 0, 4.0 from syms where kind = 'route'
    union all select repo, 'IMPORTS', path, resolved, null, null, 0, 3.0 from known where not type_only
    union all select repo, 'IMPORTS', path, resolved, null, symbol_id, 0, 3.2 from bound where not type_only
    union all select repo, 'REFERENCES', path, resolved, null, symbol_id, 0, 2.0 from bound
    union all select repo, 'TESTS', path, target, null, null, 0, 3.0 from tested
    union all select repo, 'TEST_COVERS_WORKFLOW', path, target, null, null, 0, 2.8 from tested
    union all select repo, 'RISK', path, path, null, signal_id, {S.ordinal("coalesce(confidence, 'heuristic')")}, greatest(0.5, coalesce(score, 0.0)) from risks)
    select substr(sha1(concat_ws(chr(0), 'edge', repo, edge_kind, from_path, to_path, from_symbol, to_symbol)), 1, 16) edge_id, repo, edge_kind, from_path, to_path, from_symbol, to_symbol,
    ['authoritative', 'derived', 'heuristic'][min(c) + 1] confidence, round(max(weight::double), 6) weight from e group by repo, edge_kind, from_path, to_path, from_symbol, to_symbol"""

_ORDER = "case edge_kind " + " ".join(f"when '{k}' then {n}" for k, n in EDGE_ORDER.items()) + f" else 11 end, {S.ordinal('confidence')}, weight desc, coalesce(from_path, ''), coalesce(to_path, ''), edge_id"


def _list(kinds: list[str]) -> str:
    return ",".join(map(S.quoted, kinds))


def q7_callers(spark: SparkSession, folder: str) -> DataFrame:
    """The first 20 edges into every file."""
    return graph.neighbours(facts.edges(spark, folder), CALLER_KINDS, "to_path", 20).select("repo", "to_path", "edge_id", "place")


SQL["q7_callers"] = S.facts("edges") + f" select * from (select repo, to_path, edge_id, row_number() over (partition by repo, to_path order by {_ORDER})::int place from edges where to_path is not null and edge_kind in ({_list(CALLER_KINDS)})) where place <= 20"


def q7_callees(spark: SparkSession, folder: str) -> DataFrame:
    """The first 20 edges out of every file."""
    return graph.neighbours(facts.edges(spark, folder), CALLEE_KINDS, "from_path", 20).select("repo", "from_path", "edge_id", "place")


SQL["q7_callees"] = S.facts("edges") + f" select * from (select repo, from_path, edge_id, row_number() over (partition by repo, from_path order by {_ORDER})::int place from edges where from_path is not null and edge_kind in ({_list(CALLEE_KINDS)})) where place <= 20"


def q10_impact(spark: SparkSession, folder: str) -> DataFrame:
    """Files that a change of each task's planned targets reaches: within 2 steps for interface changes, else 1."""
    t = facts.tasks(spark, folder)
    e = facts.edges(spark, folder).where(F.col("edge_kind").isin(IMPACT_KINDS)).where("from_path is not null and to_path is not null")
    i = facts.imports(spark, folder, ("repo", "path", "resolved")).where("resolved is not null")
    known = facts.files(spark, folder).select(F.col("repo").alias("scope"), F.col("path").alias("source"))
    links = e.select(F.col("repo").alias("scope"), F.col("from_path").alias("source"), F.col("to_path").alias("target"), "confidence")
    links = links.unionByName(i.select(F.col("repo").alias("scope"), F.col("path").alias("source"), F.col("resolved").alias("target"), F.lit("authoritative").alias("confidence")))
    links = links.join(known, ["scope", "source"], "left_semi")
    most = F.when(F.col("change_type").isin("api", "rename", "delete"), 2).otherwise(1)
    seeds = t.select(F.col("repo").alias("scope"), F.col("task_id").alias("seed"), most.alias("most"), F.explode(F.coalesce("planned", F.array().cast("array<string>"))).alias("node"))
    reach = graph.closure(seeds, links, 2)
    return reach.select(F.col("seed").alias("task_id"), F.col("node").alias("path"), "depth", "confidence")


SQL["q10_impact"] = S.facts("tasks", "edges", "imps", "files") + f""", l as (select l.repo, l.src, l.dst, min(c) c from (select repo, from_path src, to_path dst, {S.ordinal("confidence")} c from edges where edge_kind in ({_list(IMPACT_KINDS)}) and from_path is not null and to_path is not null
    union all select repo, path, resolved, 0 from imps where resolved is not null) l join files f on f.repo = l.repo and f.path = l.src group by all),
    s as (select distinct repo, task_id, change_type, path from (select repo, task_id, change_type, unnest(planned) path from tasks)),
    h1 as (select s.repo, s.task_id, s.change_type, l.src path, min(l.c) c from s join l on l.repo = s.repo and l.dst = s.path group by all),
    n1 as (select * from h1 where not exists (select 1 from s where s.task_id = h1.task_id and s.path = h1.path)),
    h2 as (select n1.repo, n1.task_id, n1.change_type, l.src path, min(l.c) c from n1 join l on l.repo = n1.repo and l.dst = n1.path where change_type in ('api', 'rename', 'delete') group by all),
    a as (select task_id, path, 0 depth, 0 c from s union all select task_id, path, 1, c from h1 union all select task_id, path, 2, c from h2)
    select task_id, path, min(depth) depth, ['authoritative', 'derived', 'heuristic'][case when min(depth) = 0 then 0 else min(c) end + 1] confidence from a group by task_id, path"""


def q8_dependency_path(spark: SparkSession, folder: str) -> DataFrame:
    """The first shortest dependency path from the first to the last focus file of every task."""
    t = facts.tasks(spark, folder).where(F.size("focus") >= 2)
    pairs = t.select(F.col("repo").alias("scope"), F.element_at("focus", 1).alias("start"), F.element_at("focus", -1).alias("goal")).where("start is not null and goal is not null").distinct()
    e = facts.edges(spark, folder).withColumnsRenamed({"repo": "scope"}).withColumns({"source": F.col("from_path"), "target": F.col("to_path")})
    return graph.dependency_paths(pairs, e).select("scope", "start", "goal", "length", F.array_join("path", " > ").alias("path"))


def q5_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    """Edges within two steps of each task's first planned target, the first 120."""
    t = facts.tasks(spark, folder).where(F.size("planned") > 0)
    seeds = t.select(F.col("repo").alias("scope"), F.col("task_id").alias("seed"), F.element_at("planned", 1).alias("node"))
    e = facts.edges(spark, folder).withColumnsRenamed({"repo": "scope"}).withColumns({"from_node": F.col("from_path"), "to_node": F.col("to_path")})
    return graph.undirected_hops(seeds, e, 2, 120).select(F.col("seed").alias("task_id"), "edge_id", "step", "place")


SQL["q5_neighbourhood"] = S.facts("tasks", "edges") + f""", ed as (select * from edges where from_path is not null and to_path is not null and from_path <> to_path), b as (select repo, edge_id, from_path x, to_path y from ed union all select repo, edge_id, to_path, from_path from ed),
    s as (select repo, task_id, planned[1] node from tasks where len(planned) > 0),
    h1 as (select s.repo, s.task_id, b.edge_id, b.y from s join b on b.repo = s.repo and b.x = s.node),
    f1 as (select distinct h1.repo, h1.task_id, h1.y node from h1 where not exists (select 1 from s where s.task_id = h1.task_id and s.node = h1.y)),
    h2 as (select f1.repo, f1.task_id, b.edge_id from f1 join b on b.repo = f1.repo and b.x = f1.node),
    m as (select repo, task_id, edge_id, min(step)::int step from (select repo, task_id, edge_id, 1 step from h1 union all select repo, task_id, edge_id, 2 from h2) group by all)
    select task_id, edge_id, step, place from (select m.task_id, m.edge_id, m.step, row_number() over (partition by m.repo, m.task_id order by {_ORDER.replace("edge_id", "m.edge_id")})::int place from m join edges using (repo, edge_id)) where place <= 120"""


def g6_neighbourhoods(spark: SparkSession, folder: str) -> DataFrame:
    """Functional neighbourhoods of files across modules."""
    r = ranked(spark, folder).withColumn("rank", F.round("rank", 6))
    return graph.functional_neighbourhoods(facts.edges(spark, folder), r).withColumn("score", F.round("score", 4))


_FW = "(case edge_kind " + " ".join(f"when '{k}' then {n}" for k, n in FUNCTIONAL_WEIGHT.items()) + " else 1 end)"
SQL["g6_neighbourhoods"] = _RANKED + f""", r as (select repo, path, module, is_test, round(rank, 6) rank from ranked),
    o as (select repo, from_path a, to_path b, {_FW} * (case confidence when 'authoritative' then 1.5 when 'derived' then 1.2 else 1.0 end) * greatest(1.0, weight) w from edges where from_path is not null and to_path is not null and from_path <> to_path),
    n as (select repo, a, b, sum(w) w from (select * from o union all select repo, b, a, w from o) group by all),
    m as (select n.*, x.module am, x.rank ar, y.module bm, y.is_test bt, y.rank br from n join r x on x.repo = n.repo and x.path = a and not x.is_test join r y on y.repo = n.repo and y.path = b),
    k as (select * from (select *, row_number() over (partition by repo, a order by w desc, br desc, b) pl from m where not bt) where pl <= 15),
    g as (select k.repo, k.a, any_value(am) am, any_value(ar) ar, list_sort(list_append(list(b), k.a)) mem, sum(br) br, count(distinct bm) + case when bool_or(bm = am) then 0 else 1 end mods from k group by k.repo, k.a),
    q as (select g.repo, a seed, array_to_string(mem, ',') members, len(mem)::int size, ar + br + (select sum(w) from m where m.repo = g.repo and m.a = g.a) score from g where mods >= 2),
    u as (select * from (select *, row_number() over (partition by repo, members order by round(score, 6) desc, seed desc) rn from q) where rn = 1)
    select repo, members, seed, size, round(score, 4) score from (select *, row_number() over (partition by repo order by round(score, 6) desc, members) pl from u) where pl <= 24"""


def g8_centrality(spark: SparkSession, folder: str) -> DataFrame:
    """Importance of files passed along imports, within each repository."""
    nodes = facts.files(spark, folder).select(F.col("repo").alias("scope"), F.col("path").alias("node"))
    links = facts.imports(spark, folder, ("repo", "path", "resolved")).where("resolved is not null").select(F.col("repo").alias("scope"), F.col("path").alias("source"), F.col("resolved").alias("target"))
    c = ranking.centrality(nodes, links)
    return c.select("scope", "node", F.round("score", 9).alias("score"), F.round("part", 6).alias("part"))


_ITER = "".join(
    f", s{k} as (select f.repo, f.path, 0.15 / f.n + coalesce(sum(0.85 * s.v / d.d), 0) v from nn f left join ll l on l.repo = f.repo and l.dst = f.path left join s{k - 1} s on s.repo = l.repo and s.path = l.src left join dd d on d.repo = l.repo and d.src = l.src group by f.repo, f.path, f.n)"
    for k in range(1, 5)
)
SQL["g8_centrality"] = S.facts("files", "imps") + f""", nn as (select repo, path, count(*) over (partition by repo) n from files), ll as (select i.repo, i.path src, i.resolved dst from imps i join files a on a.repo = i.repo and a.path = i.path join files b on b.repo = i.repo and b.path = i.resolved),
    dd as (select repo, src, count(*) d from ll group by all), s0 as (select repo, path, 1.0::double / n v from nn){_ITER}
    select s.repo "scope", s.path node, round(v, 9) score, round(least(2.0, greatest(0.0, log2(v * n + 1) - 1)), 6) part from s4 s join nn on nn.repo = s.repo and nn.path = s.path"""


def g10_diffusion(spark: SparkSession, folder: str) -> DataFrame:
    """Weight spread along all edges of each repository in eight rounds."""
    e = facts.edges(spark, folder).where("from_path is not null and to_path is not null and from_path <> to_path")
    nodes = facts.files(spark, folder).select(F.col("repo").alias("scope"), F.col("path").alias("node"))
    links = e.select(F.col("repo").alias("scope"), F.col("from_path").alias("source"), F.col("to_path").alias("target"), "weight", F.col("edge_kind").isin("IMPORTS", "CALLS", "REFERENCES").alias("reflects"))
    return ranking.diffusion(nodes, links).withColumn("score", F.round("score", 6))


def g11_notable_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The 80 most notable symbols of each repository: rank of the file, uses, exported, kind."""
    uses = facts.edges(spark, folder, ("to_symbol",)).where("to_symbol is not null").groupBy(F.col("to_symbol").alias("symbol_id")).agg(F.count("*").alias("uses"))
    s = facts.symbols(spark, folder).join(ranked(spark, folder).select(*KEY, F.round("rank", 6).alias("rank")), KEY).join(uses, "symbol_id", "left")
    score = F.col("rank") + F.log2(F.coalesce("uses", F.lit(0)) + 1) + F.when(F.col("exported"), 2.0).otherwise(0.0) + F.when(F.col("kind").isin("class", "function", "method", "route"), 1.0).otherwise(0.0)
    s = s.withColumn("score", F.round(score, 6))
    return ranking.top_k(s, ["repo"], [F.col("score").desc(), F.col("symbol_id").asc()], 80).select("repo", "symbol_id", "score", "place")


SQL["g11_notable_symbols"] = _RANKED + f""", u as (select to_symbol, count(*) n from edges where to_symbol is not null group by all),
    s as (select y.repo, y.symbol_id, round(round(r.rank, 6) + log2(coalesce(u.n, 0) + 1) + case when exported then 2.0 else 0.0 end + case when kind in ('class', 'function', 'method', 'route') then 1.0 else 0.0 end, 6) score
        from syms y join ranked r on r.repo = y.repo and r.path = y.path left join u on u.to_symbol = y.symbol_id)
    select * from (select repo, symbol_id, score, row_number() over (partition by repo order by score desc, symbol_id)::int place from s) where place <= 80"""


# ------------------------------------------------------------ retrieval
def _queries(spark: SparkSession, folder: str) -> DataFrame:
    t = facts.tasks(spark, folder).where("repo is not null").withColumn("terms", X.expanded_terms(F.col("task_text")))
    return t.select(F.col("task_id").alias("query"), F.col("repo").alias("scope"), F.col("task_text").alias("text"), "terms", X.intents(F.col("task_text"), F.col("terms")).alias("intents"))


def _bm25_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    f = facts.files(spark, folder)
    terms = retrieve.file_terms(
        f, facts.symbols(spark, folder, ("repo", "path", "name", "qualified_name", "kind", "exported")),
        facts.imports(spark, folder, ("repo", "path", "specifier", "imported_name", "local_name", "resolved")), facts.risks(spark, folder, ("repo", "path", "signal_id")),
    )
    return terms, f.select(F.col("repo").alias("scope"), F.col("path").alias("doc"))


def _bm25(spark: SparkSession, folder: str, top: int | None = None, digits: int | None = None) -> DataFrame:
    return retrieve.bm25(*_bm25_parts(spark, folder), _queries(spark, folder), top, digits)


def q1a_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 of every file of its repository that shares a term with the task."""
    return _bm25(spark, folder, digits=6).select("query", "doc", "score", "matched")


_PARTS = [("files", "path", 3, ""), ("files", S.module("path"), 2, ""), ("files", S.stem("path"), 3, ""), ("files", "lang", 1, ""), ("files", "'test spec verification'", 2, "where is_test"), ("files", "'dirty changed worktree'", 2, "where dirty"),
          ("syms", "name", 3, "where exported"), ("syms", "name", 2, "where not exported"), ("syms", "qualified_name", 3, "where exported"), ("syms", "qualified_name", 2, "where not exported"), ("syms", "kind", 2, ""),
          ("imps", "specifier", 2, ""), ("imps", "imported_name", 1, ""), ("imps", "local_name", 1, ""), ("imps", "resolved", 1, ""), ("risks", "signal_id", 2, "")]
_TERMS = " union all ".join(f"select repo, path, unnest({S.tokens(v)}) term, {w} w from {t} {c}" for t, v, w, c in _PARTS)
SQL["q1a_bm25"] = S.facts("files", "syms", "imps", "risks", "tasks") + f""", tt as (select t.repo, t.path, term, sum(w) tf from ({_TERMS}) t join files f on f.repo = t.repo and f.path = t.path group by all),
    ln as (select repo, path, sum(tf) l from tt group by all), st as (select f.repo, count(*) n, avg(greatest(1, coalesce(l, 0))) al from files f left join ln on ln.repo = f.repo and ln.path = f.path group by f.repo),
    df as (select repo, term, count(*) d from tt group by all), q as (select task_id, repo, unnest({S.expanded("task_text")}) term from tasks where repo is not null)
    select task_id query, tt.path doc, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.72 + 0.72 * l / al))), 6) score, count(*) matched
    from q join tt on tt.repo = q.repo and tt.term = q.term join df on df.repo = q.repo and df.term = q.term join ln on ln.repo = tt.repo and ln.path = tt.path join st on st.repo = q.repo group by task_id, tt.path"""


def q1b_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose path or name matches the task."""
    return retrieve.exact_lane(_queries(spark, folder), facts.files(spark, folder), scoped=False)


SQL["q1b_exact"] = S.facts("files", "tasks") + f""", q as (select task_id, repo, task_text, {S.expanded("task_text")} terms from tasks where repo is not null),
    p as (select distinct path, repo, {S.base_name("path")} b, {S.stem("path")} s from files),
    m as (select task_id, path, greatest({S.match_score("task_text", "terms", "path")}, {S.match_score("task_text", "terms", "b")}, {S.match_score("task_text", "terms", "s")}) x from q join p using (repo))
    select task_id query, path doc, (x + 8)::double score from m where x >= 6"""


def used_names(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, path, name, text, n): on how many lines a file uses a name, from the texts (only the Python extractor gives
    usages), and how many imports bind it."""
    met = extract_facts(texts(spark, folder).where(P.language_of(F.col("path")) == "python")).where("fact = 'usage'")
    text = F.when(F.col("specifier") == "", F.col("qualified_name")).otherwise(F.col("specifier"))
    own = met.select("repo", "path", "name", text.alias("text"), "kind", "start_line").distinct().select("repo", "path", "name", "text")
    i = facts.imports(spark, folder).select("repo", "path", F.coalesce("local_name", "imported_name", "specifier").alias("name"))
    return own.unionByName(i.where("name is not null").withColumn("text", F.col("name"))).groupBy("repo", "path", "name", "text").agg(F.count("*").alias("n"))


def _named(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return facts.symbols(spark, folder, ("repo", "path", "name", "qualified_name", "exported")), facts.imports(spark, folder, ("repo", "path", "specifier", "imported_name", "local_name", "resolved"))


def _symbol_lane(spark: SparkSession, folder: str, scoped: bool = True) -> DataFrame:
    return retrieve.symbol_lane(_queries(spark, folder), *_named(spark, folder), used_names(spark, folder), scoped)


def q1c_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose symbols, imports or usages match the task, with the sum of their scores (whole halves)."""
    return _symbol_lane(spark, folder, scoped=False)


def q1c_bound_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """As q1c_symbols, with the names that imports bind as the only usages: no texts are read."""
    bound = F.coalesce("local_name", "imported_name", "specifier")
    return retrieve.symbol_lane(_queries(spark, folder), *_named(spark, folder), scoped=False, bound=bound)


def _values(*columns: str) -> str:
    return f"unnest(list_distinct(list_filter([{', '.join(columns)}], lambda x: x is not null)))"


SQL["q1c_bound_symbols"] = S.facts("syms", "imps", "tasks") + f""", q as (select task_id, repo, task_text, {S.expanded("task_text")} terms from tasks where repo is not null),
    it as (select repo, path, 's' || symbol_id item, case when exported then 4.0 else 1.0 end a, 1 n, {_values("name", "qualified_name", "path")} v from syms
    union all select repo, path, 'i' || import_id, 1.0, 1, {_values("specifier", "imported_name", "local_name", "resolved")} from imps
    union all select repo, path, 'u' || name, -1.0, n, {_values("name", "path")} from (select repo, path, coalesce(local_name, imported_name, specifier) name, count(*) n from imps group by all) where name is not null),
    v as (select distinct repo, v from it), m as (select task_id, repo, v, {S.match_score("task_text", "terms", "v")} x from q join v using (repo)),
    b as (select m.task_id, it.path, it.item, it.a, it.n, max(x) x from m join it on it.repo = m.repo and it.v = m.v where x > 0 group by all)
    select task_id query, path doc, round(sum(n * greatest(0.0, x + a)), 6)::double score from b group by all having sum(n * greatest(0.0, x + a)) > 0"""


def _fused(spark: SparkSession, folder: str, raw: int | None = None) -> DataFrame:
    r = cut(ranked(spark, folder).select("repo", "path", "rank", "dirty"))
    items = retrieve.symbol_items(*_named(spark, folder), used_names(spark, folder))
    links = facts.imports(spark, folder, ("repo", "path", "resolved")), facts.edges(spark, folder, ("repo", "from_path", "to_path"))
    return retrieve.fused(_queries(spark, folder), r, items, _bm25_parts(spark, folder)[0], *links, raw=raw)


def q1i_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best files for every task: exact, symbol, term, dirty and graph lanes fused."""
    return _fused(spark, folder).select("query", "doc", "score", "lanes", "place")


def q1d_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 80 nearest vectors above 0.12 of each vector whose id is divisible by 100, among all."""
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.vector_search(v, q, 80, 0.12).select("query_id", "vec_id", F.round(F.col("score") * 24, 5).alias("score"))


SQL["q1d_vectors"] = """with p as (select q.vec_id query_id, v.vec_id vec_id, list_dot_product(q.embedding::double[], v.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) / sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) s
    from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0)
    select query_id, vec_id, round(s * 24, 5) score from (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) pl from p where s > 0.12) where pl <= 80"""


def a10_maxpool(spark: SparkSession, folder: str) -> DataFrame:
    """The greatest similarity of each label to every query vector."""
    near = q1d_vectors(spark, folder).join(table(spark, folder, "embeddings").select("vec_id", "label"), "vec_id")
    return near.groupBy("query_id", "label").agg(F.max("score").alias("best"))


SQL["a10_maxpool"] = f"select query_id, label, max(score) best from ({SQL['q1d_vectors']}) join embeddings using (vec_id) group by all"


# ------------------------------------------------------------ recommendation and reports
def q13_recommend_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Tests for the planned targets of every task: direct (5), planned tests (4), tests that import a target within two
    steps (4), tests of files so reached (4), imports of a Python target's package (3), same name (2), and the outcome
    boost of each (at most 3). A source counts once per task and test."""
    t = facts.tasks(spark, folder)
    targets = t.select("task_id", "repo", F.explode(F.coalesce("planned", F.array().cast("array<string>"))).alias("target")).distinct()
    edges = tested(spark, folder)
    f = facts.files(spark, folder).where("is_test").select("repo", F.col("path").alias("test"))
    direct = targets.join(edges, ["repo", "target"]).select("task_id", "repo", F.col("path").alias("test"), F.lit(5.0).alias("score"), "confidence")
    own = targets.join(f.withColumnRenamed("test", "target"), ["repo", "target"], "left_semi").select("task_id", "repo", F.col("target").alias("test"), F.lit(4.0).alias("score"), F.lit("authoritative").alias("confidence"))
    i = facts.imports(spark, folder, ("repo", "path", "specifier", "resolved"))
    links = i.where("resolved is not null").select(F.col("repo").alias("scope"), F.col("path").alias("source"), F.col("resolved").alias("target"), F.lit("authoritative").alias("confidence"))
    seeds = targets.select(F.col("repo").alias("scope"), F.col("task_id").alias("seed"), F.col("target").alias("node"))
    reached = graph.closure(seeds, links, 2).select(F.col("seed").alias("task_id"), F.col("scope").alias("repo"), F.col("node").alias("target"))
    above = reached.join(f.withColumnRenamed("test", "target"), ["repo", "target"], "left_semi").select("task_id", "repo", F.col("target").alias("test"), F.lit(4.0).alias("score"), F.lit("authoritative").alias("confidence"))
    far = reached.join(edges, ["repo", "target"]).select("task_id", "repo", F.col("path").alias("test"), F.lit(4.0).alias("score"), F.lit("derived").alias("confidence"))
    named = j8_test_targets(spark, folder).where("target is not null").join(targets, ["repo", "target"])
    named = named.select("task_id", "repo", F.col("path").alias("test"), F.lit(2.0).alias("score"), F.lit("heuristic").alias("confidence"))
    root = F.split("target", "/")[0]
    roots = targets.where(F.col("target").endswith(".py") & (root != "") & ~root.isin(*BROAD_ROOTS)).select("task_id", "repo", root.alias("root")).distinct()
    used = i.where(P.is_test(F.col("path"))).select("repo", F.col("path").alias("test"), F.regexp_replace("specifier", r"^\.+", "").alias("package")).distinct()
    met = roots.select("repo", "root").distinct().join(used, "repo").where(F.col("package").startswith(F.col("root"))).select("repo", "root", "test").distinct()
    packaged = roots.join(met, ["repo", "root"]).select("task_id", "repo", "test", F.lit(3.0).alias("score"), F.lit("derived").alias("confidence"))
    every = reduce(DataFrame.unionByName, [x.distinct() for x in (direct, own, above, far, named, packaged)])
    sums = every.groupBy("task_id", "repo", "test").agg(F.sum("score").alias("score"), F.min(ordinal(F.col("confidence"))).alias("tier"))
    boosts = planned_boosts(spark, folder).select("repo", F.col("path").alias("test"), "boost")
    return sums.join(boosts, ["repo", "test"], "left").select("task_id", "test", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"), "tier")


SQL["q13_recommend_tests"] = S.facts("files", "imps", "tasks") + f""", {S.TESTED}, tg as (select distinct task_id, repo, target from (select task_id, repo, unnest(planned) target from tasks)),
    so as (select repo, lower({S.stem("path")}) name, min(path) target from files where not is_test group by all having count(distinct path) = 1),
    ln as (select distinct repo, path src, resolved dst from imps where resolved is not null and path is not null),
    one as (select distinct tg.task_id, tg.repo, ln.src target from tg join ln on ln.repo = tg.repo and ln.dst = tg.target),
    two as (select distinct one.task_id, one.repo, ln.src target from one join ln on ln.repo = one.repo and ln.dst = one.target),
    near as (select * from tg union select * from one union select * from two),
    roots as (select distinct task_id, repo, string_split(target, '/')[1] root from tg where ends_with(target, '.py') and string_split(target, '/')[1] not in ('', 'api', 'backend', 'server', 'service', 'src', 'web', 'tests', 'scripts')),
    ps as (select distinct repo, path test, regexp_replace(specifier, '^\\.+', '') pkg from imps where regexp_matches(lower(path), {S.quoted(P.TEST)})),
    bo as (select repo, path, least(3.0, count(*) * 0.5) b from (select distinct task_id, repo, unnest(planned) path from tasks) group by all),
    c as (select distinct tg.task_id, tg.repo, e.path test, 5.0 score, 0 tier, 1 src from tg join tested e on e.repo = tg.repo and e.target = tg.target
    union all select distinct tg.task_id, tg.repo, tg.target, 4.0, 0, 2 from tg join files f on f.repo = tg.repo and f.path = tg.target and f.is_test
    union all select distinct n.task_id, n.repo, n.target, 4.0, 0, 3 from near n join files f on f.repo = n.repo and f.path = n.target and f.is_test
    union all select distinct n.task_id, n.repo, e.path, 4.0, 1, 4 from near n join tested e on e.repo = n.repo and e.target = n.target
    union all select distinct tg.task_id, tg.repo, f.path, 2.0, 2, 5 from files f join so on so.repo = f.repo and so.name = regexp_replace(lower({S.stem("path")}), '^test_|_test$|\\.(test|spec)$', '', 'g') join tg on tg.repo = f.repo and tg.target = so.target where f.is_test
    union all select distinct r.task_id, r.repo, ps.test, 3.0, 1, 6 from roots r join ps on ps.repo = r.repo and starts_with(ps.pkg, r.root))
    select task_id, test, (sum(score) + coalesce(any_value(b), 0.0))::double score, min(tier) tier from c left join bo on bo.repo = c.repo and bo.path = c.test group by task_id, c.repo, test"""


def q18_required_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The ten heaviest edges that touch the planned targets of each task, with how many there are."""
    t = facts.tasks(spark, folder)
    targets = t.select("task_id", "repo", F.explode(F.coalesce("planned", F.array().cast("array<string>"))).alias("path")).distinct()
    e = facts.edges(spark, folder)
    met = targets.join(e.withColumn("path", F.explode(F.array_distinct(F.array_compact(F.array("from_path", "to_path"))))), KEY).select("task_id", "edge_id", "weight").distinct()
    return ranking.with_total(met, ["task_id"], [F.col("weight").desc(), F.col("edge_id").asc()], 10).select("task_id", "edge_id", "weight", "place", "total")


SQL["q18_required_edges"] = S.facts("tasks", "edges") + """, tg as (select distinct task_id, repo, path from (select task_id, repo, unnest(planned) path from tasks)), m as (select distinct task_id, edge_id, weight from tg join edges e on e.repo = tg.repo and (e.from_path = tg.path or e.to_path = tg.path))
    select * from (select task_id, edge_id, weight, row_number() over (partition by task_id order by weight desc, edge_id)::int place, count(*) over (partition by task_id) total from m) where place <= 10"""


def q23_placeholder_report(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest production findings of each repository, with how many there are."""
    r = facts.risks(spark, folder).where("context = 'production' and score is not null")
    return ranking.with_total(r, ["repo"], [F.col("score").desc(), F.col("path").asc(), F.col("finding_id").asc()], 20).select("repo", "finding_id", "score", "place", "total")


SQL["q23_placeholder_report"] = S.facts("risks") + " select * from (select repo, finding_id, score, row_number() over (partition by repo order by score desc, path, finding_id)::int place, count(*) over (partition by repo) total from risks where context = 'production' and score is not null) where place <= 20"


def q24_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Of every workspace its latest snapshot: whether it is stale, the first reason, and dirty entries whose indexed
    hash differs."""
    f = table(spark, folder, "freshness").where("repo_root is not null and snapshot_id is not null")
    last = f.groupBy("repo_root").agg(F.max(F.struct("snap_seq", "received_at", "snapshot_id", "is_stale", "stale_reason")).alias("s")).select("repo_root", "s.*")
    d = table(spark, folder, "dirty_files").select("snapshot_id", P.normal_path(F.col("file_path")).alias("path"), F.lower("dirty_hash").alias("now"), F.lower("indexed_hash").alias("then")).distinct()
    off = d.where("not (now <=> then)").groupBy("snapshot_id").agg(F.countDistinct("path").alias("unindexed"))
    return last.join(off, "snapshot_id", "left").select("repo_root", "snapshot_id", "is_stale", "stale_reason", F.coalesce("unindexed", F.lit(0)).alias("unindexed"))


SQL["q24_freshness"] = f"""with l as (select * from (select *, row_number() over (partition by repo_root order by snap_seq desc nulls last, received_at desc nulls last, snapshot_id desc) rn from freshness where repo_root is not null and snapshot_id is not null) where rn = 1),
    o as (select snapshot_id, count(distinct {S.normal("file_path")}) n from dirty_files where lower(dirty_hash) is distinct from lower(indexed_hash) group by all)
    select repo_root, l.snapshot_id, is_stale, stale_reason, coalesce(n, 0) unindexed from l left join o on o.snapshot_id = l.snapshot_id"""


def q3_repo_map(spark: SparkSession, folder: str) -> DataFrame:
    """The ten files of highest rank of every repository with their first symbols."""
    r = ranked(spark, folder).withColumn("rank", F.round("rank", 6))
    best = ranking.top_k(r.select(*KEY, "rank"), ["repo"], [F.col("rank").desc(), F.col("path").asc()], 10)
    s = w2_top_symbols(spark, folder).join(facts.symbols(spark, folder).select("symbol_id", "name"), "symbol_id")
    names = s.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ",").alias("symbols"))
    return best.join(names, KEY, "left").select(*KEY, "rank", "place", F.coalesce("symbols", F.lit("")).alias("symbols"))


SQL["q3_repo_map"] = _RANKED + """, t as (select *, row_number() over (partition by repo, path order by exported desc, start_line nulls last, symbol_id) pl from syms), n as (select repo, path, string_agg(name, ',' order by pl) symbols from t where pl <= 3 group by all),
    b as (select repo, path, round(rank, 6) rank, row_number() over (partition by repo order by round(rank, 6) desc, path)::int place from ranked)
    select b.*, coalesce(symbols, '') symbols from b left join n on n.repo = b.repo and n.path = b.path where place <= 10"""


# ------------------------------------------------------------ text of files
def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, path, text) of files with text, as delivered: texts are not shuffled to drop the repeated ones, but what
    is found in them is made distinct."""
    raw = table(spark, folder, "source_files").where("repo is not null and file_path is not null and source_text is not null")
    return raw.select("repo", F.col("file_path").alias("path"), F.col("source_text").alias("text"))


_TEXTS = "with x as (select repo, file_path path, max(source_text) text from source_files where repo is not null and file_path is not null and source_text is not null group by all)"


def x6_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of the documents."""
    return scan.markdown_headings(texts(spark, folder)).distinct()


SQL["x6_headings"] = _TEXTS + r""", l as (select repo, path, unnest(string_split_regex(text, '\r?\n')) line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) line_no from x where regexp_matches(lower(path), '\.(md|mdx|rst|txt)$'))
    select repo, path, line_no::int line_no, length(regexp_extract(line, '^(#{1,6})\s+(.+?)\s*#*\s*$', 1))::int as "level", regexp_extract(line, '^(#{1,6})\s+(.+?)\s*#*\s*$', 2) title, length(regexp_extract(line, '^(#{1,6})\s+(.+?)\s*#*\s*$', 1)) <= 2 exported
    from l where regexp_matches(line, '^(#{1,6})\s+(.+?)\s*#*\s*$')"""


def x11_path_risks(spark: SparkSession, folder: str) -> DataFrame:
    """Risks that paths tell of."""
    return scan.path_risks(facts.files(spark, folder).select("repo", "path"))


_CONTROL = "(regexp_matches(path, '^scripts/(service|release|preview)-control\\.sh$') or ends_with(path, '.service'))"
SQL["x11_path_risks"] = S.facts("files") + f""" select repo, path, 'public-surface' signal, 2.0::double score from files where regexp_matches(path, {S.quoted(P.PUBLIC)})
    union all select repo, path, 'adapter-runtime', 2.0 from files where contains(path, '/adapters/') union all select repo, path, 'package-manifest', 1.5 from files where contains(path, '/packages/')
    union all select repo, path, 'operator-runtime', 2.0 from files where {_CONTROL} union all select repo, path, 'config-or-migration', 1.5 from files where contains(path, 'migration') or contains(path, 'config') or ends_with(path, '.service')
    union all select repo, path, 'test-file', 0.5 from files where is_test"""


def x12_pattern_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Matches of the rules on code, the first five of each file and rule."""
    return scan.pattern_hits(texts(spark, folder)).distinct()


def _rule_sql(rule: str, score: float, pattern: str, languages: str, where: str) -> str:
    found = f"regexp_extract_all(text, {S.quoted('(' + pattern + ')')}, 1)"
    fits = f"{S.language('path')} in ({','.join(map(S.quoted, languages.split()))})" + (f" and regexp_matches(path, {S.quoted(where)})" if where else "")
    return f"select repo, path, {S.quoted(rule)} as rule, {score}::double score, len({found})::int hits, array_to_string({found}[1:5], '|') matches from x where {fits} and len({found}) > 0"


SQL["x12_pattern_rules"] = _TEXTS + " " + " union all ".join(_rule_sql(*r) for r in scan.RULES)


def x13_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    """Placeholders in the text of files, the twelve highest of each."""
    return scan.placeholders(texts(spark, folder))


def x2_extracted(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols, imports and usages of all files of languages with an extractor, by kind and file."""
    return extract_facts(texts(spark, folder)).distinct().groupBy("repo", "path", "fact", "kind").agg(F.count("*").alias("n"))


def s24_raw_search(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with a literal, the first 25 of each file."""
    return scan.raw_search(texts(spark, folder), ["<<<<<<<", "TODO", "import "])


SQL["s24_raw_search"] = _TEXTS + r""", l as (select repo, path, unnest(string_split_regex(text, '\r?\n')) line, generate_subscripts(string_split_regex(text, '\r?\n'), 1)::int line_no from x),
    h as (select repo, path, line_no, substr(trim(line), 1, 220) line, pattern from l, (values ('<<<<<<<'), ('TODO'), ('import ')) p(pattern) where contains(l.line, pattern))
    select * from (select repo, path, line_no, line, pattern, row_number() over (partition by repo, path, pattern order by line_no)::int place from h) where place <= 25"""


# ------------------------------------------------------------ memory, ledger, streams in batch
def t3_memory(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of a memory folded from the findings of each file: one entry a file, one event a finding."""
    r = table(spark, folder, "placeholder_findings").where("repo is not null and file_path is not null")
    events = r.select(
        F.concat_ws(":", "repo", "file_path").alias("entry_id"), F.col("indexed_at").cast("timestamp").alias("at"), F.lit("risk").alias("kind"), F.col("signal_id").alias("summary"),
        F.when(F.col("category") == "no-op-body", "resolved").otherwise("active").alias("status"), F.col("confidence").alias("tier"), F.col("finding_id").cast("string").alias("evidence_id"), F.array("file_path").alias("files"),
    )
    out = memory.fold_events(events.distinct())
    return out.select("entry_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "status", "tier", F.size("evidence").alias("evidence"), "revisions")


SQL["t3_memory"] = """with e as (select distinct repo || ':' || file_path entry_id, indexed_at at_, signal_id, case when category = 'no-op-body' then 'resolved' else 'active' end status, confidence, finding_id::varchar ev from placeholder_findings where repo is not null and file_path is not null and indexed_at is not null)
    select entry_id, max(at_) updated_at, case when bool_or(status = 'resolved') then 'resolved' else 'active' end status, ['authoritative', 'derived', 'heuristic', 'fallback'][min(case confidence when 'authoritative' then 1 when 'derived' then 2 when 'heuristic' then 3 else 4 end)] tier,
    least(24, count(distinct ev))::int evidence, count(*) revisions from e group by entry_id"""


def t6_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """How many memory entries there are of each status."""
    return t3_memory(spark, folder).groupBy("status", "tier").agg(F.count("*").alias("n"))


SQL["t6_buckets"] = f"select status, tier, count(*) n from ({SQL['t3_memory']}) group by all"


def t8_outcome_boost(spark: SparkSession, folder: str) -> DataFrame:
    """Boosts of focus files by how often tasks planned them, at most 3."""
    t = facts.tasks(spark, folder)
    o = t.select(F.col("task_id").alias("outcome_id"), F.explode(F.coalesce("planned", F.array().cast("array<string>"))).alias("path"), F.lit(0.5).alias("amount"))
    return memory.outcome_boosts(o)


SQL["t8_outcome_boost"] = S.facts("tasks") + " select path, least(3.0, count(*) * 0.5)::double boost, count(*) outcomes from (select distinct task_id, unnest(planned) path from tasks) group by path"


def t2_signature(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_root, snapshot_id, head_commit, signature, entries): the signature of the dirty entries of each snapshot's
    workspace together with its head commit. Snapshots without dirty entries have one too; the latest delivery counts."""
    keys = ["repo_root", "snapshot_id"]
    d = table(spark, folder, "dirty_files").select(*keys, F.col("file_path").alias("path"), F.col("dirty_hash").alias("hash"))
    sums = live.signature(d, keys)
    f = table(spark, folder, "freshness").where("snapshot_id is not null").groupBy(*keys).agg(F.max(F.struct("received_at", "head_commit"))["head_commit"].alias("head_commit"))
    a, b = sums.alias("a"), f.alias("b")
    met = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    head, dirty = F.col("head_commit"), F.coalesce("signature", F.lit("0"))
    each = F.sha1(F.concat_ws("\0", F.coalesce(head, F.lit("none")), dirty)).alias("signature")
    return met.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), head, each, F.coalesce("entries", F.lit(0)).alias("entries"))


def v_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Required checks of all test files, covered by two commands of which one hides its exit."""
    checks = facts.files(spark, folder).where("is_test").select(F.concat_ws(":", "repo", "path").alias("check_id"), F.lit("test").alias("kind"), "path")
    reports = spark.createDataFrame([("a", "pytest tests/ -q", 0, "/w"), ("b", "pytest src/ || true", 0, "/w")], "row_id string, command string, exit_code int, cwd string")
    waivers = checks.where(F.col("path").endswith(".go")).select("check_id")
    return ledger.ledger(checks, ledger.coverage(reports), waivers)


SQL["v_ledger"] = S.facts("files") + " select repo || ':' || path check_id, 'test' kind, path, case when starts_with(path, 'tests/') then 'covered' when ends_with(path, '.go') then 'waived' else 'missing' end state from files where is_test"


def e1_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval scored for every task with planned targets: fused ranks against raw term ranks as the baseline."""
    t = facts.tasks(spark, folder).where(F.size("planned") > 0).select(F.col("task_id").alias("scenario"), F.array_distinct("planned").alias("expected"))
    def listed(only: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.expr(only), F.struct("place", "doc")))), lambda x: x["doc"])
    none = F.array().cast("array<string>")
    lists = _fused(spark, folder, 20).groupBy(F.col("query").alias("scenario")).agg(listed("lanes <> ''").alias("found"), listed("lanes = ''").alias("baseline"))
    s = t.join(lists, "scenario", "left")
    s = s.select("scenario", "expected", F.coalesce("found", none).alias("found"), F.coalesce("baseline", none).alias("baseline"), none.alias("tests_found"), none.alias("tests_expected"), none.alias("forbidden"), F.lit(0.0).alias("min_recall"))
    return evaluate.score_scenarios(s)


# ------------------------------------------------------------ linking by text, packets
def x9_endpoint_references(spark: SparkSession, folder: str) -> DataFrame:
    """Strings in code that look like routes."""
    return resolve.endpoint_references(texts(spark, folder)).distinct()


def x10_dotted_references(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted dotted names in code."""
    return resolve.dotted_references(texts(spark, folder)).distinct()


def x19_exported_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names that Python files list as exported."""
    return resolve.exported_names(texts(spark, folder)).distinct()


def j3_package_files(spark: SparkSession, folder: str) -> DataFrame:
    """For each import the shallowest source file of the folder in which its target lies."""
    i = facts.imports(spark, folder).where("resolved is not null").select("import_id", "repo", F.regexp_replace("resolved", r"/?[^/]*$", "").alias("folder"))
    return resolve.package_files(i, facts.files(spark, folder))


SQL["j3_package_files"] = S.facts("files", "imps") + r""", i as (select import_id, repo, regexp_replace(resolved, '/?[^/]*$', '') f from imps where resolved is not null),
    b as (select d.repo, d.f, x.path, row_number() over (partition by d.repo, d.f order by len(string_split(x.path, '/')), x.path) rn from (select distinct repo, f from i where f <> '') d join files x on x.repo = d.repo and not x.is_test and starts_with(x.path, d.f || '/'))
    select import_id, b.path target from i join b on b.repo = i.repo and b.f = i.f and rn = 1"""


def _context(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Evidence (query, path, confidence, score) of every task: what it plans, focuses on, and what reaches these."""
    t = facts.tasks(spark, folder)
    def listed(c: str, confidence: str, score: float) -> DataFrame:
        return t.select(F.col("task_id").alias("query"), F.explode(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))).alias("path"), F.lit(confidence).alias("confidence"), F.lit(score).alias("score"))
    reach = cut(q10_impact(spark, folder)).where("depth > 0")
    impact = reach.select(F.col("task_id").alias("query"), "path", "confidence", (F.lit(4.0) - F.col("depth")).alias("score"))
    return {"planned": listed("planned", "authoritative", 10.0), "focus": listed("focus", "derived", 5.0), "impact": impact}


def q15_context_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence on the files of every task merged per file."""
    return packets.merge_evidence(_context(spark, folder))


_EVIDENCE = f"""select task_id, unnest(list_distinct(planned)) path, 'authoritative' confidence, 10.0 score, 'planned' src from (select task_id, planned_edit_targets planned, row_number() over (partition by task_id order by received_at desc) rn from task_snapshots where task_id is not null) where rn = 1
    union all select task_id, unnest(list_distinct(focus)), 'derived', 5.0, 'focus' from (select task_id, list_transform(coalesce(focus_files, []), lambda f: f.file_path) focus, row_number() over (partition by task_id order by received_at desc) rn from task_snapshots where task_id is not null) where rn = 1
    union all select task_id, path, confidence, 4.0 - depth, 'impact' from ({SQL["q10_impact"]}) where depth > 0"""
SQL["q15_context_pack"] = f"""with e as ({_EVIDENCE}) select task_id query, path, ['authoritative', 'derived', 'heuristic'][min({S.ordinal("confidence")}) + 1] tier, sum(score)::double score, string_agg(distinct src, ',' order by src) sources from e group by task_id, path"""


def a14_source_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many files each source of evidence gave, by their best tier."""
    each = [df.select("path", "confidence", F.lit(name).alias("source")) for name, df in _context(spark, folder).items()]
    return packets.source_summary(each[0].unionByName(each[1]).unionByName(each[2]))


SQL["a14_source_summary"] = f"""with e as ({_EVIDENCE}), b as (select src, path, min({S.ordinal("confidence")}) t from e group by all)
    select src as source, count(*) filter (where t = 0) authoritative, count(*) filter (where t = 1) derived, count(*) filter (where t = 2) heuristic from b group by src"""


def q25_quality(spark: SparkSession, folder: str) -> DataFrame:
    """How good the evidence of every task is."""
    each = [df.select("query", "confidence") for df in _context(spark, folder).values()]
    return packets.quality(each[0].unionByName(each[1]).unionByName(each[2]))


SQL["q25_quality"] = f"""with e as ({_EVIDENCE}), c as (select task_id query, count(*) filter (where confidence = 'authoritative') authoritative, count(*) filter (where confidence = 'derived') derived, count(*) filter (where confidence = 'heuristic') heuristic from e group by all)
    select *, case when heuristic > authoritative + derived then 'low' when authoritative > 0 then 'high' else 'medium' end as "level" from c"""


def q11_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """What to read first of the files that a change of each task reaches."""
    r = ranked(spark, folder).select("repo", "path", "is_test", "risk", F.round("rank", 6).alias("rank"))
    reach = cut(q10_impact(spark, folder)).join(facts.tasks(spark, folder).select("task_id", "repo", "change_type"), "task_id").join(r, KEY)
    rows = reach.select(F.col("task_id").alias("query"), "path", "change_type", (F.col("depth") == 0).alias("is_target"), "is_test", F.col("confidence").alias("tier"), F.round("risk", 6).alias("risk"), "rank")
    return packets.split_fanout(rows).select("query", "path", "read_first", "place")


SQL["q11_fanout"] = f"""with im as ({SQL["q10_impact"]}), rk as ({_RANKED} select repo, path, is_test, round(risk, 6) risk, round(rank, 6) rank from ranked), tk as ({S.facts("tasks")} select task_id, repo, change_type from tasks),
    a as (select im.task_id query, im.path, tk.change_type, {S.ordinal("im.confidence")} tier, rk.risk, rk.rank, case when im.depth = 0 then 0 when rk.is_test then 1 else 2 end g from im join tk using (task_id) join rk on rk.repo = tk.repo and rk.path = im.path),
    w as (select *, row_number() over (partition by query, g order by tier, risk desc, rank desc, path) n from a),
    l as (select *, g = 1 and n > case when change_type = 'style' then 3 else 6 end late from w),
    p as (select *, row_number() over (partition by query order by late, g, tier, risk desc, rank desc, path)::int place from l)
    select query, path, not late and place <= case when change_type = 'style' then 8 when change_type in ('api', 'rename', 'delete') then 24 else 14 end read_first, place from p"""


def q2_search(spark: SparkSession, folder: str) -> DataFrame:
    """Files for every task: those that hold one of its text's search terms literally, then those of best term rank."""
    t = facts.tasks(spark, folder).where("repo is not null")
    asked = t.select(F.col("task_id").alias("query"), "repo", F.explode(X.raw_search_terms(F.col("task_text"))).alias("term"))
    raw = cut(scan.literal_hits(texts(spark, folder), asked, top=20))
    return packets.combined_search(raw, _bm25(spark, folder, 20, 9).select("query", F.col("doc").alias("path"), "score"))


def q6_explain(spark: SparkSession, folder: str) -> DataFrame:
    """Of every file how many symbols, imports, importers, edges, findings and tests it has."""
    def count(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).groupBy("repo", F.col(column).alias("path")).agg(F.count("*").alias(name))
    i, e = facts.imports(spark, folder), facts.edges(spark, folder)
    out = facts.files(spark, folder).select(*KEY, "language")
    sides = [count(facts.symbols(spark, folder), "path", "symbols"), count(i, "path", "imports"), count(i, "resolved", "importers"), count(e, "from_path", "edges_out"), count(e, "to_path", "edges_in"), count(facts.risks(spark, folder), "path", "findings"), count(tested(spark, folder), "target", "tests")]
    for side in sides:
        out = out.join(side, KEY, "left")
    return out.fillna(0)


def _n(source: str, column: str) -> str:
    return f"coalesce((select count(*) from {source} x where x.repo = f.repo and x.{column} = f.path), 0)"


SQL["q6_explain"] = S.facts("files", "syms", "imps", "edges", "risks") + f""", {S.TESTED} select repo, path, lang as "language", {_n("syms", "path")} symbols, {_n("imps", "path")} imports, {_n("imps", "resolved")} importers, {_n("edges", "from_path")} edges_out, {_n("edges", "to_path")} edges_in, {_n("risks", "path")} findings, {_n("tested", "target")} tests from files f"""


def q12_diff_impact(spark: SparkSession, folder: str) -> DataFrame:
    """Files that import, or have an impact edge to, each dirty file of a repository, with the best confidence."""
    known = facts.files(spark, folder)
    e = facts.edges(spark, folder).where(F.col("edge_kind").isin(IMPACT_KINDS)).where("from_path is not null and to_path is not null")
    i = facts.imports(spark, folder, ("repo", "path", "resolved")).where("resolved is not null")
    links = e.select(F.col("repo").alias("scope"), F.col("from_path").alias("source"), F.col("to_path").alias("target"), "confidence").unionByName(
        i.select(F.col("repo").alias("scope"), F.col("path").alias("source"), F.col("resolved").alias("target"), F.lit("authoritative").alias("confidence"))
    ).join(known.select(F.col("repo").alias("scope"), F.col("path").alias("source")), ["scope", "source"], "left_semi")
    seeds = known.where("dirty").select(F.col("repo").alias("scope"), F.col("path").alias("seed"), F.col("path").alias("node"))
    return graph.closure(seeds, links, 1).where("depth = 1").select("scope", "seed", "node", "confidence")


SQL["q12_diff_impact"] = S.facts("edges", "imps", "files") + f""", l as (select l.repo, l.src, l.dst, min(c) c from (select repo, from_path src, to_path dst, {S.ordinal("confidence")} c from edges where edge_kind in ({_list(IMPACT_KINDS)}) and from_path is not null and to_path is not null
    union all select repo, path, resolved, 0 from imps where resolved is not null) l join files f on f.repo = l.repo and f.path = l.src group by all)
    select l.repo "scope", f.path seed, l.src node, ['authoritative', 'derived', 'heuristic'][c + 1] confidence from files f join l on l.repo = f.repo and l.dst = f.path where f.dirty and l.src <> f.path"""


def x7_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Names, versions, scripts and dependencies of JSON manifests."""
    return scan.manifests(texts(spark, folder)).distinct()


def x18_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The text under which each file would be embedded."""
    return retrieve.chunks(facts.files(spark, folder), facts.symbols(spark, folder), facts.imports(spark, folder))


SQL["x18_chunks"] = S.facts("files", "syms", "imps") + """, a as (select repo, path, string_agg(name, ' ' order by p) n from (select *, row_number() over (partition by repo, path order by start_line nulls last, symbol_id) p from syms where name is not null) where p <= 80 group by all),
    b as (select repo, path, string_agg(specifier, ' ' order by p) n from (select *, row_number() over (partition by repo, path order by specifier, import_id) p from imps where specifier is not null) where p <= 80 group by all)
    select f.repo, f.path, concat_ws(chr(10), f.path, a.n, b.n) chunk from files f left join a on a.repo = f.repo and a.path = f.path left join b on b.repo = f.repo and b.path = f.path"""


def _workflow_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Workflows from the files of routes."""
    s = facts.symbols(spark, folder).where("kind = 'route' and repo is not null and path is not null")
    entries = s.select(F.col("symbol_id").alias("workflow"), F.col("repo").alias("scope"), "path")
    e = facts.edges(spark, folder).withColumnRenamed("repo", "scope")
    t = tested(spark, folder).select(F.col("repo").alias("scope"), "path", "target")
    return graph.workflow_traces(entries, e, t)


def g3_workflow_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of the workflows that begin at routes."""
    return _workflow_steps(spark, folder)


def g4_workflow_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Size, rank and ends of these workflows."""
    r = ranked(spark, folder).select(F.col("repo").alias("scope"), "path", "rank", "module")
    return graph.workflow_summary(cut(_workflow_steps(spark, folder)), r).withColumn("rank", F.round("rank", 5))


def q1f_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Tests that cover the files of a task's exact lane or match it by name."""
    q, f, edges = _queries(spark, folder), facts.files(spark, folder), cut(tested(spark, folder))
    # only what a test covers is asked for as a seed: nothing else would meet an edge
    covered = edges.select(F.col("repo").alias("scope"), F.col("target").alias("doc")).distinct()
    items = retrieve.symbol_items(*_named(spark, folder), used_names(spark, folder)).join(covered, ["scope", "doc"], "left_semi")
    return retrieve.covering_lane(q, f, edges, retrieve.matched(items, q)).select("query", "doc", F.round("score", 6).alias("score"))


def g9_graph_export(spark: SparkSession, folder: str) -> DataFrame:
    """The heaviest edges between the files of highest rank of every repository."""
    _, edges = exports.graph_export(ranked(spark, folder), facts.edges(spark, folder))
    return edges


SQL["g9_graph_export"] = _RANKED + f""", n as (select * from (select repo, path, module, row_number() over (partition by repo order by round(rank, 6) desc, path) pl from ranked) where pl <= 180),
    b as (select e.repo, edge_id, edge_kind, from_path, to_path, weight, row_number() over (partition by e.repo order by weight desc, edge_id) pl from edges e join n x on x.repo = e.repo and x.path = e.from_path join n y on y.repo = e.repo and y.path = e.to_path)
    select repo, edge_id, edge_kind, from_path, to_path, weight from b where pl <= 600 union all select repo, module || ':' || path, 'CONTAINS', module, path, 1.0 from n"""


def q30_edge_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The first 60 edges out of every file, with what makes them weak."""
    e = facts.edges(spark, folder).where("from_path is not null")
    return exports.edge_evidence(e, ["repo", "from_path"]).select("repo", "from_path", "edge_id", "degraded", "place")


SQL["q30_edge_evidence"] = S.facts("edges") + f" select repo, from_path, edge_id, coalesce(confidence = 'heuristic' or fact_source = 'heuristic', true) degraded, place from (select *, row_number() over (partition by repo, from_path order by {_ORDER})::int place from edges where from_path is not null) where place <= 60"


def j13_key_match(spark: SparkSession, folder: str) -> DataFrame:
    """For each imported name the symbol of its repository that is most like it by its parts."""
    i = facts.imports(spark, folder, ("repo", "imported_name")).where("imported_name is not null")
    keys = i.select(F.concat_ws(":", "repo", "imported_name").alias("key_id"), F.col("repo").alias("scope"), F.col("imported_name").alias("key"), F.lit("").alias("folder")).distinct()
    s = facts.symbols(spark, folder, ("repo", "path", "name")).where("name is not null")
    names = s.groupBy(F.col("repo").alias("scope"), "name").agg(F.min("symbol_id").alias("candidate_id")).withColumn("folder", F.lit("x"))
    return exports.best_key_match(keys, names)


def s23_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Import aliases that configuration files define."""
    return config.import_aliases(texts(spark, folder))


def q22_reconciled_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Recommended tests of every task against those that it planned to edit."""
    t = facts.tasks(spark, folder)
    ran = t.select("task_id", F.explode(F.coalesce("planned", F.array().cast("array<string>"))).alias("path"))
    planned = q13_recommend_tests(spark, folder).select("task_id", F.col("test").alias("path"), F.when(F.col("tier") < 2, "derived").otherwise("heuristic").alias("confidence"))
    return exports.reconciled_tests(planned, ran).select("task_id", "path", "state")


SQL["q22_reconciled_tests"] = f"""with r as (select distinct task_id, unnest(planned_edit_targets) path from task_snapshots where task_id is not null), p as ({SQL["q13_recommend_tests"]})
    select p.task_id, p.test path, case when r.path is null then 'missing' when tier >= 2 then 'degraded' else 'trusted' end state from p left join r on r.task_id = p.task_id and r.path = p.test"""


# ------------------------------------------------------------ events
def t_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour and type."""
    w = live.windowed(table(spark, folder, "events"), width="1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


SQL["t_windows"] = "select date_trunc('hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by all"


def t_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users: events less than half an hour apart."""
    s = live.sessions(table(spark, folder, "events").where("user_id is not null"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


SQL["t_sessions"] = """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end fresh from events where user_id is not null), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from g)
    select user_id, min(ts) as start, count(*) n from s group by user_id, k"""


# ------------------------------------------------------------ search functions and targets
def _task_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(task_id, repo, task_text, path): every task with each of its focus and planned paths, once."""
    t = facts.tasks(spark, folder)
    both = F.concat(F.coalesce("planned", F.array().cast("array<string>")), "focus")
    return t.select("task_id", "repo", "task_text", F.explode(F.array_distinct(both)).alias("path")).where("path is not null")


_TASK_PATHS = S.facts("tasks", "files") + ", tp as (select distinct task_id, repo, task_text, path from (select task_id, repo, task_text, unnest(list_concat(coalesce(planned, []), focus)) path from tasks) where path is not null)"


def f11_search_score(spark: SparkSession, folder: str) -> DataFrame:
    """How well each focus or planned path matches its task, with the reason."""
    rows = _task_paths(spark, folder).withColumn("score", Z.search_score(F.col("task_text"), F.col("path")))
    return rows.select("task_id", "path", "score", Z.search_reason(F.col("score")).alias("reason"))


_DECOY = r"(?:^|\b|[._/-])(decoy|mock|old|backup|copy|fixture)(?:$|\b|[._/-])"
_COPY = "(regexp_matches(regexp_replace({0}, '[_-]', ' ', 'g'), '" + _DECOY + "') or regexp_matches(regexp_replace({0}, '[^a-z0-9]+', '', 'g'), '(decoy|mock|backup|fixture)'))"
SQL["f11_search_score"] = _TASK_PATHS + r""", n as (select *, lower(trim(coalesce(task_text, ''), ' ')) q, lower(trim(path, ' ')) v, list_filter(list_transform(string_split_regex(coalesce(task_text, ''), '[^A-Za-z0-9_./@-]+'), lambda t: lower(trim(t, ' '))), lambda t: length(t) >= 2) w from tp),
    m as (select *, list_filter(list_distinct(list_concat([q], w, flatten(list_transform(list_filter(w, lambda t: regexp_matches(t, '[/.@]')), lambda t: list_filter(string_split_regex(t, '[./@-]+'), lambda p: length(p) >= 2))))), lambda t: t <> '') terms,
        regexp_replace(string_split(rtrim(v, '/'), '/')[-1], '\.[^.]+$', '') stem, string_split_regex(v, '[^a-z0-9]+') words from n),
    b as (select *, coalesce(list_max(list_transform(terms, lambda t: case when v = t then 10 when stem = t then 9 when list_contains(words, t) then 6 when contains(v, t) then 2 else 0 end)), 0) best from m),
    s as (select task_id, path, case when q = '' or v = '' then 0 when """ + _COPY.format("v") + " and not " + _COPY.format("q") + """ and best < 9 then 0 else best end::int score from b)
    select task_id, path, score, case when score >= 10 then 'exact' when score >= 9 then 'stem' when score >= 6 then 'token' when score > 0 then 'substring' else 'miss' end reason from s"""


def f13_code_query(spark: SparkSession, folder: str) -> DataFrame:
    """The terms of every task that look like code."""
    return facts.tasks(spark, folder).select("task_id", Z.code_query(F.col("task_text")).alias("code"))


SQL["f13_code_query"] = S.facts("tasks") + r""", w as (select task_id, lower(coalesce(task_text, '')) low, list_transform(string_split_regex(coalesce(task_text, ''), '[^A-Za-z0-9_./@:-]+'), lambda t: regexp_replace(t, '^[./@:-]+|[./@:-]+$', '', 'g')) ts from tasks)
    select task_id, array_to_string(list_sort(list_distinct(list_filter(ts, lambda t: length(t) >= 3
        and not list_contains(['add', 'and', 'project', 'change', 'choose', 'codex', 'current', 'debug', 'diff', 'dirty', 'edit', 'fix', 'focused', 'make', 'safe', 'safely', 'test', 'the', 'this', 'update', 'verify', 'verification'], lower(t))
        and (regexp_matches(t, '[._/@:]') or contains(t, '-') and regexp_matches(low, '\b(package|dependency|dependencies|import|module|npm|pnpm|yarn|bun|plugin|config|library|lib|cli|command)\b') or regexp_matches(t, '[a-z][A-Z]') or regexp_matches(t, '[A-Z].*[0-9]|[0-9].*[A-Z]') or regexp_matches(t, '^[A-Z0-9]{3,}$')))))[1:4], ' ') code from w"""


def f15_intent_boost(spark: SparkSession, folder: str) -> DataFrame:
    """What each focus or planned file gains by the intents of its task."""
    t = facts.tasks(spark, folder)
    shown = t.select("task_id", X.intents(F.col("task_text"), X.expanded_terms(F.col("task_text"))).alias("intents"))
    risk = facts.risks(spark, folder, ("repo", "path")).groupBy(*KEY).agg(F.sum("score").alias("risk"))
    rows = _task_paths(spark, folder).join(shown, "task_id").join(facts.files(spark, folder).select(*KEY, "is_test", "dirty"), KEY).join(risk, KEY, "left")
    boost = Z.intent_boost(F.col("intents"), F.col("path"), F.col("is_test"), F.col("dirty"), F.coalesce("risk", F.lit(0.0)))
    return rows.select("task_id", "path", F.round(boost, 6).alias("boost"))


SQL["f15_intent_boost"] = S.facts("tasks", "files", "risks") + f""", tp as (select distinct task_id, repo, task_text, path from (select task_id, repo, task_text, unnest(list_concat(coalesce(planned, []), focus)) path from tasks) where path is not null),
    i as (select task_id, lower(coalesce(task_text, '')) || ' ' || array_to_string({S.expanded("task_text")}, ' ') j from tasks),
    k as (select tp.task_id, tp.path, f.is_test, f.dirty, coalesce(r.s, 0.0) risk, i.j from tp join i using (task_id) join files f on f.repo = tp.repo and f.path = tp.path left join (select repo, path, sum(score) s from risks group by all) r on r.repo = tp.repo and r.path = tp.path)
    select task_id, path, round((case when regexp_matches(j, '\\b(frontend|react|tsx|component|hook|ui|canvas|web)\\b') and (starts_with(path, 'web/') or regexp_matches(path, '\\.(tsx|jsx)$')) then 2.5 else 0 end
        + case when regexp_matches(j, '\\b(backend|api|python|server|adapter|store|database|route)\\b') and (ends_with(path, '.py') or contains(path, '_api/') or contains(path, '/adapters/')) then 2.5 else 0 end
        + case when regexp_matches(j, '\\b(test|verify|validation|pytest|vitest|coverage|regression)\\b') and is_test then 3 else 0 end
        + case when regexp_matches(j, '\\b(config|env|service|script|deploy|package|manifest|init|hook|session)\\b') and regexp_matches(path, '\\.(json|toml|ya?ml|service|sh)$') then 2 else 0 end
        + case when regexp_matches(j, '\\b(architecture|understand|overview|map|module|subsystem|competitor|sourcegraph|aider|deepwiki)\\b') and regexp_matches(path, 'src/(indexer|parser|resolver|queries|mcp|artifacts|eval|init)\\.ts$') then 4 else 0 end
        + case when regexp_matches(j, '\\b(workflow|flow|execution|route|endpoint|job|process|queue|polling)\\b|\\b(?:workflow|dependency|call|execution)\\s+path\\b') and regexp_matches(path, '(?i)(app|route|adapter|store|execution|queue|polling|workflow|run)') then 3 else 0 end
        + case when regexp_matches(j, '\\b(risk|security|shell|filesystem|sql|danger|unsafe|blast)\\b') and risk > 0 then least(4.0, risk / 4) else 0 end
        + case when dirty and (regexp_matches(j, '\\b(debug|bug|fix|error|failure|broken|trace|root cause)\\b') or regexp_matches(j, '\\b(add|implement|change|update|refactor|rename|delete|modify)\\b')) then 1.5 else 0 end)::double, 6) boost from k"""


def f18_impact_kind(spark: SparkSession, folder: str) -> DataFrame:
    """The kind of every focus or planned path, and of which boundary it is by its name; whether its task asks for copies."""
    known = facts.files(spark, folder).select(*KEY, F.lit(True).alias("known"))
    rows = _task_paths(spark, folder).join(known, KEY, "left")
    p = F.col("path")
    return rows.select(
        "task_id", "path", Z.impact_kind(p, F.coalesce("known", F.lit(False))).alias("kind"), Z.is_store_path(p).alias("store"), Z.is_adapter_path(p).alias("adapter"),
        Z.is_manifest_path(p).alias("manifest"), Z.asks_for_copies(F.col("task_text")).alias("copies"),
    )


SQL["f18_impact_kind"] = _TASK_PATHS + f""" select t.task_id, t.path, case when starts_with(t.path, '.codex/') or regexp_matches(lower(t.path), {S.quoted(P.GENERATED)}) then 'generated' when regexp_matches(lower(t.path), {S.quoted(P.TEST)}) then 'test'
        when regexp_matches(t.path, '\\.(md|mdx|rst|txt)$') or starts_with(t.path, 'docs/') then 'docs'
        when regexp_matches(t.path, '\\.(json|toml|ya?ml|ini|service|env|cfg)$') or regexp_matches(t.path, '(^|/)(Dockerfile|docker-compose|package|tsconfig|vite\\.config|vitest\\.config|pyproject|requirements)') or regexp_matches(t.path, '^scripts/[^/]+\\.sh$') then 'config'
        when f.path is not null then 'source' else 'unknown' end kind, regexp_matches(t.path, '(?i)(^|/)(store|stores|repository|repositories|db|database|models|execution|queue|run-store)(/|\\.|$)') store,
        regexp_matches(t.path, '(?i)(^|/)adapters?/|(^|/).*adapter.*\\.(py|[cm]?[jt]sx?)$') adapter, regexp_matches(t.path, '(?i)(^|/)(packages?|manifests?)/') and ends_with(lower(t.path), '.json') manifest,
        regexp_matches(coalesce(t.task_text, ''), '(?i)\\b(decoy|mock|fixture|backup|old|copy)\\b') copies
    from tp t left join files f on f.repo = t.repo and f.path = t.path"""


def j19_symbol_targets(spark: SparkSession, folder: str) -> DataFrame:
    """What every symbol id and name that tasks list means in their repository."""
    s = facts.symbols(spark, folder, ("repo", "name", "qualified_name")).withColumnRenamed("repo", "scope")
    t = table(spark, folder, "task_snapshots").where("task_id is not null").select(F.col("repo").alias("scope"), F.explode("symbol_baseline").alias("b"))
    asked = t.select("scope", F.explode(F.array("b.symbol_id", "b.sym_name")).alias("name"))
    got = relations.resolved_targets(asked, s)
    return got.select(F.col("scope").alias("repo"), "name", "tier", "symbol_id", F.array_join("ambiguous", ",").alias("ambiguous"))


SQL["j19_symbol_targets"] = S.facts("syms") + """, a as (select distinct repo, unnest([b.symbol_id, b.sym_name]) n from (select repo, unnest(symbol_baseline) b from task_snapshots where task_id is not null)),
    c as (select repo, symbol_id n, 0 k, 'id' tier, symbol_id from syms union all select repo, qualified_name, 1, 'qualified', symbol_id from syms union all select repo, name, 2, 'name', symbol_id from syms),
    p as (select *, row_number() over (partition by repo, n, k order by symbol_id) p from (select distinct * from c)),
    g as (select repo, n, k, tier, list(symbol_id order by symbol_id) ids from p where p <= 20 group by all), f as (select repo, n, min_by(tier, k) tier, min_by(ids, k) ids from g group by all)
    select a.repo, a.n as name, f.tier, case when len(f.ids) = 1 then f.ids[1] end symbol_id, case when len(f.ids) > 1 then array_to_string(f.ids, ',') end ambiguous
    from a left join f on f.repo = a.repo and f.n = a.n where a.repo is not null and a.n is not null"""


def _store_edges(spark: SparkSession, folder: str) -> DataFrame:
    f, s = facts.files(spark, folder), facts.symbols(spark, folder)
    i = facts.imports(spark, folder, ("repo", "path", "resolved")).where("resolved is not null")
    e = facts.edges(spark, folder).where("edge_kind in ('CALLS', 'REFERENCES') and from_path is not null")
    u = e.select("repo", F.col("from_path").alias("path"), F.lit("").alias("name"), "from_symbol", "to_symbol", "confidence")
    stores, adapters = cut(workflows.store_files(f, s)), workflows.adapter_files(f)
    return workflows.workflow_edges([workflows.route_store_calls(u, s, stores, i), workflows.store_adapter_calls(u, s, stores, adapters, i)])


def g2_store_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Routes that call stores and stores that dispatch to adapters, by the calls and references of the graph."""
    return _store_edges(spark, folder).drop("endpoint")


_STORES = r"""rf as (select distinct repo, path from syms where kind = 'route'),
    sn as (select distinct repo, path from syms where kind in ('class', 'function', 'method') and (regexp_matches(coalesce(name, ''), '\b(RunStore|Store|Repository|Coordinator|Database)\b|(Store|Repository|Coordinator)$') or regexp_matches(coalesce(qualified_name, ''), '\b(RunStore|Store|Repository|Coordinator|Database)\b|(Store|Repository|Coordinator)$'))),
    st as (select repo, path from files f where (regexp_matches(path, '(?i)(^|/)(store|stores|repository|repositories|db|database|models|execution|queue|run-store)(/|\.|$)') or exists (select 1 from sn where sn.repo = f.repo and sn.path = f.path)) and not exists (select 1 from rf where rf.repo = f.repo and rf.path = f.path)),
    ad as (select repo, path from files where regexp_matches(path, '(?i)(^|/)adapters?/|(^|/).*adapter.*\.(py|[cm]?[jt]sx?)$')),
    u as (select repo, from_path path, from_symbol, to_symbol, confidence from edges where edge_kind in ('CALLS', 'REFERENCES') and from_path is not null)"""
SQL["g2_store_edges"] = S.facts("files", "syms", "imps", "edges") + f""", {_STORES},
    ds as (select u.repo, u.path, t.path to_path, t.symbol_id, u.confidence from u join syms t on t.symbol_id = u.to_symbol and t.repo = u.repo join ad on ad.repo = t.repo and ad.path = t.path join st on st.repo = u.repo and st.path = u.path),
    e as (select u.repo, 'ROUTE_CALLS_STORE' edge_kind, r.path from_path, r.symbol_id from_symbol, t.path to_path, t.symbol_id to_symbol, {S.ordinal("u.confidence")} c, 3.0 weight
        from u join syms r on r.symbol_id = u.from_symbol and r.kind = 'route' join syms t on t.symbol_id = u.to_symbol and t.repo = u.repo join st on st.repo = t.repo and st.path = t.path
    union all select repo, 'STORE_DISPATCHES_ADAPTER', path, null, to_path, symbol_id, {S.ordinal("confidence")}, 3.2 from ds
    union all select distinct i.repo, 'STORE_DISPATCHES_ADAPTER', i.path, null, i.resolved, null, 1, 2.4 from imps i join st on st.repo = i.repo and st.path = i.path join ad on ad.repo = i.repo and ad.path = i.resolved
        where not exists (select 1 from ds where ds.repo = i.repo and ds.path = i.path and ds.to_path = i.resolved))
    select repo, edge_kind, from_path, from_symbol, to_path, to_symbol, ['authoritative', 'derived', 'heuristic'][min(c) + 1] confidence, max(weight)::double weight from e group by repo, edge_kind, from_path, from_symbol, to_path, to_symbol"""


def q9_workflow_files(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 files of every repository that take most part in workflows, with the kinds of their edges."""
    rows = workflows.workflow_paths(_store_edges(spark, folder)).withColumn("weight", F.round("weight", 6))
    best = ranking.top_k(rows, ["repo"], [F.col("weight").desc(), F.col("edges").desc(), F.col("path").asc()], 20)
    return best.select("repo", "path", F.array_join("kinds", ",").alias("kinds"), "edges", "weight", "place")


SQL["q9_workflow_files"] = f"""with w as ({SQL["g2_store_edges"]}), x as (select repo, edge_kind, weight, unnest(list_distinct([from_path, to_path])) path from w),
    s as (select repo, path, string_agg(distinct edge_kind, ',' order by edge_kind) kinds, count(*)::bigint edges, round(sum(weight), 6)::double weight from x where path is not null group by all)
    select * from (select *, row_number() over (partition by repo order by weight desc, edges desc, path)::int place from s) where place <= 20"""


QUERIES = {n: f for n, f in globals().items() if callable(f) and n[0] in "fauwqjgxstve" and (n[1:2].isdigit() or n in ("v_ledger", "t_windows", "t_sessions"))}
