"""Session helpers: reading tables, cutting lineage, joining with hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; columns and filters are pushed into its scan.

    Python workers get the place of this package, for sessions that were started elsewhere; on a cluster the
    package is installed or given with --py-files as usual.
    """
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment
    if root not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [paths.get("PYTHONPATH", ""), root]))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a local one only where it is unset and the master is local
    (tests). A cluster without it is refused, as its executors would write parts that no other can read."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), f"quarryline-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table into the shared checkpoint folder and go on from there.

    Lost executors cost no replay of what came before, and later reads take only the columns that they need. The
    table is deleted when the driver ends.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    place = f"{sc.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def skew_join(
    rows: DataFrame, state: DataFrame, keys: list[str], hot: DataFrame, spread: Column, how: str = "inner", salts: int = 32
) -> DataFrame:
    """Join many ``rows`` to one ``state`` row per key; rows of hot keys are spread over ``salts`` parts.

    ``hot`` holds the keys whose share of the rows exceeds a fixed fraction, so it has at most one over that
    fraction rows whatever the data's size, and is broadcast. ``state`` is repeated per salt for those keys only.
    Keys compare null-safe nowhere: callers replace nulls first. ``how`` is inner or left.
    """
    mark = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    left = rows.join(mark, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(salts)).cast("int")).otherwise(F.lit(0))
    )
    right = state.join(mark, keys, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return left.drop("_hot").join(right.drop("_hot"), [*keys, "_salt"], how).drop("_salt")
