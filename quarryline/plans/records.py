"""Queries p2 to p4: references, schemas and snapshots over the code-intelligence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.paths import normal_path, strip_text
from quarryline.operators.orphans import month, orphan_references
from quarryline.operators.schema_drift import schema_changes, unified_records
from quarryline.operators.snapshot_diff import snapshot_changes
from quarryline.session import table


def references(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference of the three tables: (src_table, record_id, ref_field, ref_key, ref, t)."""

    def symbol(value: str) -> F.Column:
        return F.lower(strip_text(F.col(value)))

    edges = table(spark, folder, "graph_edges").select(
        F.lit("graph_edges").alias("src_table"), F.col("edge_id").alias("record_id"), F.col("indexed_at").alias("t"),
        F.explode(
            F.array(*(F.struct(F.lit(c).alias("ref_field"), symbol(c).alias("ref_key")) for c in ("from_symbol_id", "to_symbol_id")))
        ).alias("r"),
    ).select("src_table", "record_id", "t", "r.*")
    tasks = table(spark, folder, "task_snapshots").select(
        F.lit("task_snapshots").alias("src_table"), F.col("task_id").alias("record_id"), F.col("created_at").alias("t"),
        F.explode("symbol_baseline").alias("s"),
    ).select("src_table", "record_id", "t", F.lit("symbol_baseline").alias("ref_field"), symbol("s.symbol_id").alias("ref_key"))
    by_symbol = edges.unionByName(tasks).withColumn("ref", F.concat(F.lit("s\0"), "ref_key"))
    imports = table(spark, folder, "import_edges").select(
        F.lit("import_edges").alias("src_table"), F.col("import_id").alias("record_id"), F.col("indexed_at").alias("t"),
        F.lit("resolved_path").alias("ref_field"), normal_path(strip_text(F.col("resolved_path"))).alias("ref_key"), "repo",
    )
    by_file = imports.withColumn("ref", F.concat(F.lit("f\0"), F.coalesce("repo", F.lit("\1")), F.lit("\0"), "ref_key")).drop("repo")
    return by_symbol.unionByName(by_file).where("ref_key <> ''")


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that can be referred to: (ref, since, until)."""
    symbols = table(spark, folder, "symbols").select(
        F.concat(F.lit("s\0"), "symbol_id").alias("ref"), F.col("indexed_at").alias("since"), F.col("deleted_at").alias("until")
    )
    files = table(spark, folder, "source_files").select(
        F.concat(F.lit("f\0"), "repo", F.lit("\0"), "file_path").alias("ref"), F.col("indexed_at").alias("since"), F.col("deleted_at").alias("until")
    )
    return symbols.unionByName(files)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """References without a target at their time, each once."""
    found = orphan_references(references(spark, folder), targets(spark, folder))
    return found.select("src_table", "record_id", "ref_field", "ref_key").distinct()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, field and month, with the number of distinct missing keys."""
    found = orphan_references(references(spark, folder), targets(spark, folder)).distinct()
    return found.groupBy("src_table", "ref_field", month(F.col("t")).alias("period")).agg(
        F.count("*").alias("orphans"), F.countDistinct("ref_key").alias("missing_keys")
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of each file's fields against the file of the producer before it."""
    changes = schema_changes(table(spark, folder, "eval_records_raw"))
    return changes.select("file_name", "change_kind", "old_field", "new_field").distinct()


def p3_table(spark: SparkSession, folder: str) -> DataFrame:
    """All records in one schema."""
    return unified_records(table(spark, folder, "eval_records_raw"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty paths added, removed or changed against the snapshot before."""
    fresh = table(spark, folder, "freshness").where("not coalesce(index_missing, false)")
    snapshots = fresh.select(F.col("repo_root").alias("series"), F.col("snapshot_id").alias("snap_id"), F.col("snap_seq").alias("seq"))
    dirty = table(spark, folder, "dirty_files").select(
        F.col("snapshot_id").alias("snap_id"), normal_path(F.col("file_path")).alias("key"), "received_at",
        F.lower("dirty_hash").alias("dirty_hash"), "entry_kind",
    )
    # the latest delivery counts; of two at the same time the one with the greater hash, then kind
    latest = dirty.groupBy("snap_id", "key").agg(F.max(F.struct("received_at", "dirty_hash", "entry_kind")).alias("last"))
    rows = latest.select("snap_id", "key", "last.dirty_hash", "last.entry_kind")
    found = snapshot_changes(snapshots, rows, ["dirty_hash", "entry_kind"])
    return found.select(
        F.col("series").alias("repo_root"), F.col("snap_id").alias("snapshot_id"), F.col("key").alias("file_path"), "change_kind"
    )


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_table": p3_table, "p4_found": p4_found}

SQL = {
    "p2_found": r"""
        with refs as (
            select 'graph_edges' src_table, edge_id record_id, 'from_symbol_id' ref_field, lower(regexp_replace(from_symbol_id, '^\s+|\s+$', '', 'g')) ref_key, indexed_at t from graph_edges
            union all
            select 'graph_edges', edge_id, 'to_symbol_id', lower(regexp_replace(to_symbol_id, '^\s+|\s+$', '', 'g')), indexed_at from graph_edges
            union all
            select 'task_snapshots', task_id, 'symbol_baseline', lower(regexp_replace(s.symbol_id, '^\s+|\s+$', '', 'g')), created_at
            from (select task_id, created_at, unnest(symbol_baseline) s from task_snapshots)),
        files as (
            select import_id record_id, repo, regexp_replace(replace(regexp_replace(resolved_path, '^\s+|\s+$', '', 'g'), '\', '/'), '^(\./+)+', '') ref_key, indexed_at t from import_edges)
        select distinct src_table, record_id, ref_field, ref_key from refs
        where ref_key <> '' and not exists (select 1 from symbols s where s.symbol_id = ref_key and s.indexed_at <= t and (s.deleted_at is null or s.deleted_at > t))
        union
        select distinct 'import_edges', record_id, 'resolved_path', ref_key from files
        where ref_key <> '' and not exists (select 1 from source_files s where s.repo = files.repo and s.file_path = ref_key and s.indexed_at <= t and (s.deleted_at is null or s.deleted_at > t))
    """,
    "p2_report": r"""
        with refs as (
            select 'graph_edges' src_table, edge_id record_id, 'from_symbol_id' ref_field, lower(regexp_replace(from_symbol_id, '^\s+|\s+$', '', 'g')) ref_key, indexed_at t from graph_edges
            union
            select 'graph_edges', edge_id, 'to_symbol_id', lower(regexp_replace(to_symbol_id, '^\s+|\s+$', '', 'g')), indexed_at from graph_edges
            union
            select 'task_snapshots', task_id, 'symbol_baseline', lower(regexp_replace(s.symbol_id, '^\s+|\s+$', '', 'g')), created_at
            from (select task_id, created_at, unnest(symbol_baseline) s from task_snapshots)),
        files as (
            select distinct import_id record_id, repo, regexp_replace(replace(regexp_replace(resolved_path, '^\s+|\s+$', '', 'g'), '\', '/'), '^(\./+)+', '') ref_key, indexed_at t from import_edges),
        lost as (
            select src_table, record_id, ref_field, ref_key, t from refs
            where ref_key <> '' and not exists (select 1 from symbols s where s.symbol_id = ref_key and s.indexed_at <= t and (s.deleted_at is null or s.deleted_at > t))
            union all
            select 'import_edges', record_id, 'resolved_path', ref_key, t from files
            where ref_key <> '' and not exists (select 1 from source_files s where s.repo = files.repo and s.file_path = ref_key and s.indexed_at <= t and (s.deleted_at is null or s.deleted_at > t)))
        select src_table, ref_field, (year(t) * 12 + month(t) - 1)::int period, count(*) orphans, count(distinct ref_key) missing_keys from lost group by all
    """,
    "p4_found": r"""
        with snaps as (select distinct repo_root, snapshot_id, snap_seq from freshness where not coalesce(index_missing, false)),
        linked as (select *, lag(snapshot_id) over (partition by repo_root order by snap_seq, snapshot_id) prev from snaps),
        entries as (select snapshot_id, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') file_path, lower(dirty_hash) h, entry_kind k,
                row_number() over (partition by snapshot_id, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') order by received_at desc nulls last, lower(dirty_hash) desc nulls last, entry_kind desc nulls last) rn
            from dirty_files where file_path is not null),
        last as (select * from entries where rn = 1),
        now as (select l.repo_root, l.snapshot_id, e.file_path, h, k from linked l join last e using (snapshot_id) where prev is not null),
        past as (select l.repo_root, l.snapshot_id, e.file_path, h, k from linked l join last e on e.snapshot_id = l.prev)
        select coalesce(n.repo_root, p.repo_root) repo_root, coalesce(n.snapshot_id, p.snapshot_id) snapshot_id, coalesce(n.file_path, p.file_path) file_path,
            case when p.file_path is null then 'added' when n.file_path is null then 'removed' else 'changed' end change_kind
        from now n full join past p on n.snapshot_id = p.snapshot_id and n.file_path = p.file_path
        where p.file_path is null or n.file_path is null or n.h is distinct from p.h or n.k is distinct from p.k
    """,
}
