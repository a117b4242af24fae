"""Queries p1 and p5 to p9: source files, findings and documents as training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import syntax
from quarryline.llm.mixing import mix_sources, shares
from quarryline.llm.origin import origins
from quarryline.llm.subjects import assign_subjects, composition, fit_subjects
from quarryline.llm.tokens import count_tokens, decode_texts, encode_texts
from quarryline.llm.topn import code_of_double, top_n
from quarryline.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are invalid in the language of their extension."""
    return syntax.invalid_files(table(spark, folder, "source_files"))


def p1_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Where and why each of them fails."""
    return syntax.failures(table(spark, folder, "source_files")).withColumn("expected", F.array_join("expected", " "))


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates per repository and language, next to what older runs claim."""
    return syntax.rates(table(spark, folder, "source_files"), table(spark, folder, "freshness"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three highest findings of each file and focus files of each task."""
    raw = table(spark, folder, "placeholder_findings").where("finding_id is not null")
    # of one finding the latest row counts, of several at that time the one with the greatest score
    score = F.when(~F.isnan("score"), F.col("score"))
    latest = raw.groupBy("finding_id").agg(
        F.max(F.struct("indexed_at", score.alias("score"), "line_no", "signal_id", "repo", "file_path")).alias("r")
    ).select("finding_id", "r.*").where("score is not null")
    findings = latest.withColumn("grp", F.concat(F.coalesce("repo", F.lit("")), F.lit(":"), F.coalesce("file_path", F.lit(""))))
    line = F.coalesce(-F.col("line_no").cast("long"), F.lit(-(2**40)))
    best = top_n(findings.select("grp", "finding_id", "score", "line_no", "signal_id"), 3, [code_of_double(F.col("score")), line], F.col("signal_id"), [-F.col("finding_id")])
    by_file = best.select(F.lit("placeholder_findings").alias("src_table"), F.col("grp").alias("group_key"), F.col("finding_id").cast("string").alias("item_key"))

    focus = table(spark, folder, "task_snapshots").select("task_id", F.explode("focus_files").alias("f"))
    focus = focus.select("task_id", "f.file_path", "f.risk_score").where("risk_score is not null and not isnan(risk_score)")
    focus = focus.where("task_id is not null and file_path is not null").groupBy(F.col("task_id").alias("grp"), "file_path")
    focus = focus.agg(F.max("risk_score").alias("risk_score"))
    best = top_n(focus, 3, [code_of_double(F.col("risk_score"))], F.col("file_path"), [])
    by_task = best.select(F.lit("task_snapshots").alias("src_table"), F.col("grp").alias("group_key"), F.col("file_path").alias("item_key"))
    return by_file.unionByName(by_task)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are not handwritten."""
    return origins(table(spark, folder, "source_files")).where("label <> 'handwritten'").select("file_id")


def p6_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The origin of every file with text."""
    return origins(table(spark, folder, "source_files"))


def p6_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Placeholder findings in handwritten files only, per repository, next to all of them."""
    files = table(spark, folder, "source_files").select("file_id", "repo", "file_path").distinct()
    made = files.join(p6_found(spark, folder), "file_id").select("repo", "file_path", F.lit(True).alias("made")).distinct()
    findings = table(spark, folder, "placeholder_findings").select("repo", "file_path")
    # counts per file meet the labels, so a file with a tenth of all findings is one row
    counts = findings.groupBy("repo", "file_path").agg(F.count("*").alias("n")).join(made, ["repo", "file_path"], "left")
    return counts.groupBy("repo").agg(F.sum("n").alias("findings"), F.sum(F.when(F.col("made").isNull(), F.col("n")).otherwise(0)).alias("in_handwritten"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(table(spark, folder, "documents").select("doc_id", "text"))


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every document from its token ids: the round trip."""
    return decode_texts(p7_ids(spark, folder))


def _mix(spark: SparkSession, folder: str) -> DataFrame:
    sized = count_tokens(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mix_sources(sized, table(spark, folder, "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix and how often each occurs."""
    return _mix(spark, folder)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that each source reached."""
    return shares(_mix(spark, folder), table(spark, folder, "mix_targets"))


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = fit_subjects(documents, table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas"))
    return assign_subjects(documents, model)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The one or two subjects of every document."""
    return _subjects(spark, folder).select("doc_id", "subject")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The make-up of the corpus by subject."""
    return composition(_subjects(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_failures": p1_failures, "p1_rates": p1_rates, "p5_found": p5_found, "p6_found": p6_found, "p6_labels": p6_labels, "p6_findings": p6_findings, "p7_ids": p7_ids, "p7_texts": p7_texts, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_composition": p9_composition}

SQL: dict[str, str] = {
    "p5_found": """
        with latest as (select *, row_number() over (partition by finding_id order by indexed_at desc nulls last, case when isnan(score) then null else score end desc nulls last, line_no desc nulls last, signal_id desc nulls last) rn from placeholder_findings),
        ranked as (select *, row_number() over (partition by repo, file_path order by score desc, line_no nulls last, signal_id, finding_id) place
            from latest where rn = 1 and score is not null and not isnan(score)),
        focus as (select task_id, f.file_path, max(f.risk_score) risk_score from (select task_id, unnest(focus_files) f from task_snapshots)
            where f.risk_score is not null and not isnan(f.risk_score) group by all),
        placed as (select *, row_number() over (partition by task_id order by risk_score desc, file_path) place from focus)
        select 'placeholder_findings' src_table, repo || ':' || file_path group_key, finding_id::varchar item_key from ranked where place <= 3
        union all
        select 'task_snapshots', task_id, file_path from placed where place <= 3
    """,
    "p7_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
