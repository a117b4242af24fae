"""Source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.grammars import check

CHECKED = list(check.CHECKED)


def checkable(files: DataFrame) -> DataFrame:
    """The rows that a grammar can judge: whole text, no skip reason, an extension with a grammar."""
    ext = F.lower(F.regexp_extract("file_path", r"(\.[^./\\]+)$", 1))
    return files.withColumn("_ext", ext).where("source_text is not null and skip_reason is null").where(F.col("_ext").isin(CHECKED))


def invalid_files(files: DataFrame) -> DataFrame:
    """The ``file_id`` of each file whose text its language's grammar doesn't consume as a whole, each once.

    ``files`` has (file_id, file_path, skip_reason, source_text); the language is told by the extension. Rows with
    a null text, a skip reason, or an extension without grammar are not judged; an empty text is judged as such.
    Rows delivered twice give one id; other columns are not read. Texts are judged where they are read, whole and
    each on its own; only the ids of invalid files are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [i.as_py() for i, e, t in zip(*batch.columns, strict=True) if check.invalid(t.as_py(), e.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["file_id"])

    texts = checkable(files).select(F.col("file_id").cast("long"), "_ext", "source_text")
    return texts.mapInArrow(run, "file_id long").distinct()


FAILURES = "file_id long, line int, found string, expected array<string>, cause string"


def failures(files: DataFrame) -> DataFrame:
    """(file_id, line, found, expected, cause) of each invalid file: the furthest place where a token was refused,
    what stands there, what would have been accepted, and conflict, extension, truncated or token as the cause.
    Rows as in invalid_files; of a file delivered repeatedly one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, e, t in zip(*batch.columns, strict=True):
                if f := check.failure(t.as_py(), e.as_py()):
                    rows.append((i.as_py(), f.line, f.found, f.expected, f.cause))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file_id", "line", "found", "expected", "cause"])

    texts = checkable(files).select(F.col("file_id").cast("long"), "_ext", "source_text")
    return texts.mapInArrow(run, FAILURES).dropDuplicates(["file_id"])


def rates(files: DataFrame, freshness: DataFrame) -> DataFrame:
    """Per repository and language (extension): files, invalid files and their rate, files of which parser_errors
    claims an error, those where claim and grammar differ, and the parser_error_count of the repository's latest
    snapshot (over all its languages). A null repository is a group of its own."""
    once = checkable(files).groupBy("file_id").agg(
        F.min("repo").alias("repo"), F.min("_ext").alias("language"), F.max(F.coalesce(F.size("parser_errors"), F.lit(0)) > 0).alias("claimed")
    )
    bad = invalid_files(files).withColumn("bad", F.lit(True))
    judged = once.join(bad, "file_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    latest = freshness.groupBy("repo").agg(F.max_by("parser_error_count", "taken_at").alias("freshness_count"))
    grouped = judged.groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.count_if("bad").alias("invalid"), F.count_if("claimed").alias("claimed"),
        F.count_if(F.col("bad") != F.col("claimed")).alias("differing"),
    )
    out = grouped.join(latest, grouped["repo"].eqNullSafe(latest["repo"]), "left").drop(latest["repo"])
    return out.withColumn("rate", F.col("invalid") / F.col("files"))
