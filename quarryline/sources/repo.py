"""A repository on disk as facts: files with hashes, the dirty set, churn, and a parse that reuses what is unchanged."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.paths import is_skipped, language_of

#: Larger files are facts without a parse.
MOST_BYTES = 2 * 1024 * 1024
#: Languages that are indexed.
INDEXED = "typescript javascript python rust go java json markdown".split()


def read_files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, path, size_bytes, content_hash, text, skip_reason) of the source files below ``root``.

    The text of a file that is too large, or no UTF-8, is null, with the reason.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + root.rstrip("/") + "/", "")
    files = raw.select(F.lit(repo).alias("repo"), path.alias("path"), F.col("length").alias("size_bytes"), "content")
    files = files.where(language_of(F.col("path")).isin(INDEXED) & ~is_skipped(F.col("path")) | F.col("path").rlike(r"^scripts/[^/]+\.sh$") | F.col("path").endswith(".service"))
    text = F.when(F.col("size_bytes") <= MOST_BYTES, F.expr("try_validate_utf8(cast(content as string))"))
    reason = F.when(F.col("size_bytes") > MOST_BYTES, "source-file-too-large").when(text.isNull(), "unreadable")
    return files.select("repo", "path", "size_bytes", F.sha1("content").alias("content_hash"), text.alias("text"), reason.alias("skip_reason"))


def porcelain(output: str) -> list[tuple[str, str, str | None]]:
    """(status, path, old path) from ``git status --porcelain=v1 -z``; renames and copies take two fields."""
    fields, out, k = output.split("\0"), [], 0
    while k < len(fields):
        entry = fields[k]
        k += 1
        if len(entry) < 4:
            continue
        status, path, old = entry[:2], entry[3:], None
        if "R" in status or "C" in status:
            old = fields[k] if k < len(fields) else None
            k += 1
        out.append((status, path, old))
    return out


def changed_kind(status: str) -> str:
    """What an XY status says: added, deleted, renamed, copied, untracked or modified."""
    for letter, kind in (("?", "untracked"), ("R", "renamed"), ("C", "copied"), ("D", "deleted"), ("A", "added")):
        if letter in status:
            return kind
    return "modified"


def dirty_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, old_path, kind) of the working tree; an empty table where git fails, which means unknown, not clean."""
    run = subprocess.run(["git", "-C", root, "status", "--porcelain=v1", "-z"], capture_output=True, text=True, timeout=30)
    rows = [(p, o, changed_kind(s)) for s, p, o in porcelain(run.stdout)] if run.returncode == 0 else []
    return spark.createDataFrame(rows, "path string, old_path string, kind string")


def churn(log_lines: DataFrame) -> DataFrame:
    """(path, commits) from lines (value) of ``git log --name-only --format=``."""
    return log_lines.where("trim(value) <> ''").groupBy(F.col("value").alias("path")).agg(F.count("*").alias("commits"))


def parse_incrementally(files: DataFrame, cached: DataFrame, parse: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Facts of files: those of (path, content_hash) pairs that ``cached`` has are taken over, others are parsed.

    ``parse`` maps batches of (path, content_hash, text) to facts that begin with path and content_hash.
    """
    key = ["path", "content_hash"]
    hits = cached.join(files.select(*key).distinct(), key, "left_semi")
    missed = files.where("text is not null").join(cached.select(*key).distinct(), key, "left_anti")
    return hits.unionByName(missed.select(*key, "text").mapInPandas(parse, schema))
