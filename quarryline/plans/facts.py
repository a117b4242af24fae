"""The fact tables that the operators read, bound to the tables of a folder. Each fact occurs once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import paths as P
from quarryline.functions.paths import normal_path, strip_text
from quarryline.session import table


def _once(raw: DataFrame, key: str, order: list[str], fields: dict[str, Column], only: tuple[str, ...] | None) -> DataFrame:
    """The greatest row of each key by ``order`` and then the fields; of these ``only`` some where given, so that the
    scan reads no other columns. Rows delivered repeatedly are equal, so it doesn't matter which fields decide."""
    kept = [c.alias(n) for n, c in fields.items() if only is None or n in only]
    row = F.max(F.struct(*(F.col(o).alias(f"_{o}") for o in order), *kept)).alias("_r")
    return raw.groupBy(key).agg(row).select(key, "_r.*").drop(*(f"_{o}" for o in order))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, path, file_id, language, is_test, generated, dirty, size_bytes), one row per file."""
    raw = table(spark, folder, "source_files").where("repo is not null and file_path is not null")
    once = raw.groupBy("repo", F.col("file_path").alias("path")).agg(
        F.min("file_id").alias("file_id"), F.max(F.coalesce("is_dirty", F.lit(False))).alias("dirty"), F.max("size_bytes").alias("size_bytes")
    )
    p = F.col("path")
    return once.withColumns({"language": P.language_of(p), "is_test": P.is_test(p), "generated": P.is_generated(p), "module": P.module_of(p)})


def symbols(spark: SparkSession, folder: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """(symbol_id, repo, path, name, qualified_name, kind, exported, start_line, end_line): the latest row of each."""
    raw = table(spark, folder, "symbols").where("symbol_id is not null")
    c = F.col
    fields = {
        "repo": c("repo"), "path": c("file_path"), "name": c("sym_name"), "qualified_name": c("qualified_name"), "kind": c("sym_kind"),
        "exported": F.coalesce("is_exported", F.lit(False)), "start_line": c("start_line"), "end_line": c("end_line"),
    }
    return _once(raw, "symbol_id", ["indexed_at"], fields, only)


def edges(spark: SparkSession, folder: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """(edge_id, repo, edge_kind, from_path, to_path, from_symbol, to_symbol, confidence, weight), each edge once."""
    def symbol(c: str) -> Column:
        return F.nullif(F.lower(strip_text(F.col(c))), F.lit(""))
    raw = table(spark, folder, "graph_edges").where("edge_id is not null")
    c = F.col
    fields = {
        "repo": c("repo"), "edge_kind": c("edge_kind"), "from_path": c("from_path"), "to_path": c("to_path"), "from_symbol": symbol("from_symbol_id"), "to_symbol": symbol("to_symbol_id"),
        "confidence": c("confidence"), "weight": F.coalesce("weight", F.lit(0.0)), "fact_source": c("fact_source"),
    }
    return _once(raw, "edge_id", [], fields, only)


def imports(spark: SparkSession, folder: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """(import_id, repo, path, specifier, imported_name, local_name, type_only, re_export, resolved), each import once."""
    raw = table(spark, folder, "import_edges").where("import_id is not null")
    c = F.col
    fields = {
        "repo": c("repo"), "path": normal_path(c("file_path")), "specifier": c("specifier"), "imported_name": c("imported_name"), "local_name": c("local_name"),
        "type_only": F.coalesce("is_type_only", F.lit(False)), "re_export": F.coalesce("is_re_export", F.lit(False)), "resolved": F.nullif(normal_path(strip_text(c("resolved_path"))), F.lit("")),
    }
    return _once(raw, "import_id", [], fields, only)


def risks(spark: SparkSession, folder: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """(finding_id, score, repo, path, line_no, signal_id, category, confidence, fact_source, context): the latest row
    of each, of several at that time the one with the greatest score."""
    raw = table(spark, folder, "placeholder_findings").where("finding_id is not null and repo is not null and file_path is not null")
    c = F.col
    fields = {
        "score": F.when(~F.isnan("score"), c("score")), "repo": c("repo"), "path": c("file_path"), "line_no": c("line_no"), "signal_id": c("signal_id"), "category": c("category"),
        "confidence": c("confidence"), "fact_source": c("fact_source"), "context": c("finding_ctx"),
    }
    return _once(raw, "finding_id", ["indexed_at"], fields, None if only is None else ("score", *only))


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """(task_id, repo, task_text, change_type, created_at, planned, focus), each task once: its latest delivery."""
    raw = table(spark, folder, "task_snapshots").where("task_id is not null")
    row = F.struct(
        "received_at", "repo", "task_text", "change_type", "created_at", F.col("planned_edit_targets").alias("planned"),
        F.transform(F.coalesce("focus_files", F.array().cast("array<struct<file_path:string,tier:string,file_rank:int,risk_score:double>>")), lambda f: f["file_path"]).alias("focus"),
    )
    return raw.groupBy("task_id").agg(F.max(row).alias("t")).select("task_id", "t.*")
