"""Small inputs beside the source: import aliases, policy packs, stored bundles, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.operators.memory import EVENT

#: Larger policy packs and event logs are refused.
MOST_POLICY_BYTES, MOST_LOG_BYTES = 64 * 1024, 1024 * 1024


def import_aliases(files: DataFrame) -> DataFrame:
    """(repo, folder, prefix, replacement, origin): path aliases of ``tsconfig.json`` files, package names of
    ``package.json`` files and modules of ``go.mod`` files (repo, path, text), each valid below its folder.

    A text that is no JSON, or has no such field, gives none. Stars at the end are left out of both sides.
    """
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where("text is not null").select("repo", folder.alias("folder"), name.alias("file"), "text", F.expr("try_parse_json(text)").alias("v"))

    def below(target: F.Column) -> F.Column:
        return F.regexp_replace(F.concat_ws("/", F.nullif("folder", F.lit("")), F.nullif(F.regexp_replace(target, r"^\./", ""), F.lit(""))), "/+", "/")

    ts = rows.where("file rlike '^tsconfig.*[.]json$'").select("repo", "folder", F.expr("coalesce(try_variant_get(v, '$.compilerOptions.baseUrl', 'string'), '.')").alias("base"), F.explode(F.expr("try_variant_get(v, '$.compilerOptions.paths', 'map<string, array<string>>')")))
    target = F.regexp_replace(F.concat_ws("/", F.nullif(F.regexp_replace("base", r"^\.?/?", ""), F.lit("")), F.try_element_at("value", F.lit(1))), r"\*$", "")
    out = ts.select("repo", "folder", F.regexp_replace("key", r"\*$", "").alias("prefix"), below(target).alias("replacement"), F.lit("tsconfig").alias("origin"))
    package = rows.where("file = 'package.json'").select("repo", "folder", F.expr("try_variant_get(v, '$.name', 'string')").alias("prefix"), F.col("folder").alias("replacement"), F.lit("package").alias("origin"))
    module = rows.where("file = 'go.mod'").select("repo", "folder", F.nullif(F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1), F.lit("")).alias("prefix"), F.col("folder").alias("replacement"), F.lit("go.mod").alias("origin"))
    return out.unionByName(package).unionByName(module).where("prefix is not null and prefix <> ''").distinct()


def policy_packs(spark: SparkSession, folder: str, names: list[str], version: int = 1) -> DataFrame:
    """(name, status, reason) of the wanted JSON files of a folder: ``ok``, ``missing`` or ``warning``."""
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    raw = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.expr("try_parse_json(cast(content as string))").alias("v"))
    got = raw.select("name", "length", F.col("v").isNotNull().alias("valid"), F.expr("try_variant_get(v, '$.schemaVersion', 'int')").alias("version"))
    reason = (
        F.when(F.col("length").isNull(), "no such file").when(F.col("length") > MOST_POLICY_BYTES, "too large").when(~F.col("valid"), "no JSON")
        .when(~F.col("version").eqNullSafe(F.lit(version)), "another version")
    )
    status = F.when(F.col("length").isNull(), "missing").when(reason.isNotNull(), "warning").otherwise("ok")
    return wanted.join(got, "name", "left").select("name", status.alias("status"), F.coalesce(reason, F.lit("")).alias("reason"))


def conformed(df: DataFrame, schema: T.StructType, required: list[str]) -> DataFrame:
    """A stored table in the wanted schema: missing columns are null (arrays empty), others are cast or left out.

    Raises ValueError if a required column isn't there.
    """
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"stored table lacks {', '.join(lacking)}")
    columns = []
    for f in schema.fields:
        empty = F.array() if isinstance(f.dataType, T.ArrayType) else F.lit(None)
        value = F.col(f.name) if f.name in df.columns else empty
        value = F.coalesce(value, F.array().cast(f.dataType)) if isinstance(f.dataType, T.ArrayType) else value
        columns.append(value.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of a log of JSON lines, and the lines (line) that are none: those are warnings, not failures."""
    raw = spark.read.text(path).where("trim(value) <> ''").withColumn("e", F.from_json("value", EVENT))
    good = F.col("e").isNotNull() & F.col("e.entry_id").isNotNull() & F.col("e.at").isNotNull()
    return raw.where(good).select("e.*"), raw.where(~good | good.isNull()).select(F.col("value").alias("line"))


def trimmed(log: DataFrame, most: int = 200) -> DataFrame:
    """The newest ``most`` rows of a log (at, ...), which is written again when it grows too long."""
    return log.orderBy(F.col("at").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in log.columns if c != "at")).limit(most)
