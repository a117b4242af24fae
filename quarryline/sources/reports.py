"""Scanner reports as risks, symbol reports and SCIP indexes as facts. Reports are read whole, one per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.ranking import top_k
from quarryline.operators.relations import narrowest

SEMGREP = "results array<struct<check_id:string, path:string, start:struct<line:int>, extra:struct<severity:string, message:string>>>"
SARIF = (
    "runs array<struct<tool:struct<driver:struct<name:string, rules:array<struct<id:string, shortDescription:struct<text:string>, properties:struct<`security-severity`:string>>>>>,"
    " results:array<struct<ruleId:string, level:string, message:struct<text:string>, locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>, region:struct<startLine:int>>>>>>>>"
)
SYMBOL_REPORT = (
    "schemaVersion int, tool string, language string,"
    " symbols array<struct<id:string, name:string, qualifiedName:string, kind:string, path:string, line:int, endLine:int, exported:boolean, parentId:string, confidence:string>>,"
    " relationships array<struct<kind:string, fromSymbol:string, fromPath:string, toSymbol:string, toPath:string, line:int, confidence:string>>"
)
SCIP = (
    "documents array<struct<relativePath:string, language:string, occurrences:array<struct<symbol:string, symbolRoles:int, range:array<int>, enclosingRange:array<int>>>,"
    " symbols:array<struct<symbol:string, displayName:string, kind:string>>>>"
)
RISK = ["path", "signal", "line", "score", "reason", "source"]
#: Rows that one report gives at most, and all reports together, after equal ones are merged.
PER_REPORT, IN_ALL = 5_000, 20_000


def severity_score(severity: Column) -> Column:
    """3 for errors, 2 for warnings, 1 for notes, 1.5 for anything else."""
    s = F.upper(F.coalesce(severity, F.lit("")))
    return F.when(s.rlike("ERROR|CRITICAL|HIGH"), 3.0).when(s.rlike("WARN|MEDIUM"), 2.0).when(s.rlike("LOW|INFO|NOTE"), 1.0).otherwise(1.5)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports of one format, one row per file with ``report``; what is no JSON gives a row of nulls."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), "value")
    return raw.select("report", F.from_json("value", schema).alias("r")).select("report", "r.*")


def sarif_risks(reports: DataFrame) -> DataFrame:
    """Risks (report and RISK) of SARIF reports: one for each location; the score follows the rule's security severity
    (3 from 7, 2 from 4, else 1.5), and the level where it has none."""
    runs = reports.select("report", F.explode("runs").alias("run"))
    rules = F.map_from_entries(F.transform(F.filter(F.coalesce("run.tool.driver.rules", F.array()), lambda r: r["id"].isNotNull()), lambda r: F.struct(r["id"], r)))
    results = runs.select("report", F.col("run.tool.driver.name").alias("source"), rules.alias("rules"), F.explode("run.results").alias("x"))
    located = results.select("report", "source", F.try_element_at("rules", F.col("x.ruleId")).alias("rule"), "x", F.explode("x.locations").alias("at"))
    severity = F.expr("try_cast(rule.properties.`security-severity` as double)")
    score = F.when(severity.isNull(), severity_score(F.col("x.level"))).when(severity >= 7, 3.0).when(severity >= 4, 2.0).otherwise(1.5)
    uri = F.regexp_replace(F.url_decode("at.physicalLocation.artifactLocation.uri"), r"^(file://)?(\./)?", "")
    return located.select(
        "report", uri.alias("path"), F.col("x.ruleId").alias("signal"), F.col("at.physicalLocation.region.startLine").alias("line"), score.alias("score"),
        F.coalesce("x.message.text", "rule.shortDescription.text").alias("reason"), F.coalesce("source", F.lit("sarif")).alias("source"),
    )


def semgrep_risks(reports: DataFrame) -> DataFrame:
    x = reports.select("report", F.explode("results").alias("x"))
    return x.select("report", "x.path", F.col("x.check_id").alias("signal"), F.col("x.start.line").alias("line"), severity_score(F.col("x.extra.severity")).alias("score"), F.col("x.extra.message").alias("reason"), F.lit("semgrep").alias("source"))


def generic_risks(spark: SparkSession, path: str) -> DataFrame:
    """Risks of JSON reports with ``risks`` or ``findings`` whose fields go by several names."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), F.expr("try_parse_json(value)").alias("v"))
    items = F.coalesce(F.expr("try_variant_get(v, '$.risks', 'array<variant>')"), F.expr("try_variant_get(v, '$.findings', 'array<variant>')"))
    x = raw.select("report", F.explode(items).alias("x"))

    def first(*names: str, kind: str = "string") -> Column:
        return F.coalesce(*(F.expr(f"try_variant_get(x, '$.{n}', '{kind}')") for n in names))

    score = F.coalesce(first("score", kind="double"), severity_score(first("severity")))
    return x.select("report", first("path", "file").alias("path"), first("signal", "rule", "id").alias("signal"), first("line", "startLine", kind="int").alias("line"), score.alias("score"), first("reason", "message").alias("reason"), F.lit("report").alias("source"))


def admitted(risks: DataFrame, files: DataFrame, per_report: int = PER_REPORT, in_all: int = IN_ALL) -> DataFrame:
    """Risks of known files (path): equal ones (path, signal, line, reason) once, then the first of each report and of
    all, in the order of report, path, line and signal."""
    known = risks.join(files.select("path").distinct(), "path", "left_semi")
    key = ["path", "signal", "line", "reason"]
    once = known.groupBy(*key).agg(F.min(F.struct("report", "score", "source")).alias("r")).select(*key, "r.*")
    order = [F.col("path").asc(), F.col("line").asc_nulls_last(), F.col("signal").asc_nulls_last(), F.col("reason").asc_nulls_last()]
    return top_k(once, ["report"], order, per_report).drop("place").orderBy("report", *order).limit(in_all)


def symbol_report(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of symbol reports of version 1; a report of another version gives none."""
    good = reports.where("schemaVersion = 1")
    s = good.select("tool", "language", F.explode("symbols").alias("s")).select("tool", "language", "s.*").where("name is not null and path is not null")
    symbols = s.select(
        F.coalesce("id", F.concat_ws("#", "path", "name", "line")).alias("symbol_id"), "path", "name", F.coalesce("qualifiedName", "name").alias("qualified_name"), F.coalesce("kind", F.lit("unknown")).alias("kind"),
        "language", F.coalesce("exported", F.lit(False)).alias("exported"), F.col("line").alias("start_line"), F.coalesce("endLine", "line").alias("end_line"), F.col("parentId").alias("parent_id"), _capped(F.col("confidence")).alias("confidence"),
    )
    r = good.select(F.explode("relationships").alias("r")).select("r.*")
    a = symbols.select(F.col("symbol_id").alias("fromSymbol"), F.col("path").alias("_a"))
    b = symbols.select(F.col("symbol_id").alias("toSymbol"), F.col("path").alias("_b"))
    edges = r.join(a, "fromSymbol", "left").join(b, "toSymbol", "left").select(
        F.upper("kind").alias("edge_kind"), F.coalesce("fromPath", "_a").alias("from_path"), F.coalesce("toPath", "_b").alias("to_path"),
        F.col("fromSymbol").alias("from_symbol"), F.col("toSymbol").alias("to_symbol"), _capped(F.col("confidence")).alias("confidence"), "line",
    )
    return symbols, edges.where("from_path is not null and to_path is not null")


def _capped(confidence: Column) -> Column:
    """Tools from outside are never more than derived."""
    return F.when(confidence == "heuristic", "heuristic").otherwise("derived")


def scip_facts(indexes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and reference edges of SCIP documents in JSON.

    Occurrences with the definition role are symbols. Any other is an edge to its symbol from the narrowest
    definition around it, or from the file where there is none; role 2 is an import.
    """
    d = indexes.select(F.explode("documents").alias("d")).select(F.col("d.relativePath").alias("path"), "d.language", "d.occurrences", "d.symbols")
    o = d.select("path", "language", F.posexplode("occurrences").alias("n", "o")).select("path", "language", "n", "o.*").where("size(range) >= 3")
    role = F.coalesce("symbolRoles", F.lit(0))
    start, body = F.col("range")[0], F.coalesce("enclosingRange", "range")
    end = F.when(F.size(body) >= 4, F.try_element_at(body, F.lit(3))).otherwise(body[0])
    o = o.withColumns({"start_line": start + 1, "body_start": body[0] + 1, "body_end": end + 1, "defines": role.bitwiseAND(1) == 1, "imports": role.bitwiseAND(2) == 2})
    names = d.select("path", F.explode("symbols").alias("s")).select("path", "s.symbol", F.coalesce("s.displayName", "s.symbol").alias("name"), F.coalesce("s.kind", F.lit("unknown")).alias("kind"))
    symbols = o.where("defines").join(names, ["path", "symbol"], "left").select("path", F.col("symbol").alias("symbol_id"), F.coalesce("name", "symbol").alias("name"), F.coalesce("kind", F.lit("unknown")).alias("kind"), "language", F.col("body_start").alias("start_line"), F.col("body_end").alias("end_line")).distinct()
    uses = o.where("not defines").select(F.concat_ws(":", "path", "n").alias("row_id"), "path", "symbol", "start_line", "imports")
    inside = uses.join(symbols.select("path", F.col("symbol_id").alias("outer"), F.col("start_line").alias("low"), F.col("end_line").alias("high")), "path").where("start_line between low and high")
    inner = narrowest(inside, "row_id", "low", "high", "outer")
    homes = symbols.groupBy(F.col("symbol_id").alias("symbol")).agg(F.min("path").alias("to_path"))
    edges = uses.join(inner, "row_id", "left").join(homes, "symbol").select(
        F.when(F.col("imports"), "IMPORTS").otherwise("REFERENCES").alias("edge_kind"), F.col("path").alias("from_path"), "to_path",
        F.col("enclosing").alias("from_symbol"), F.col("symbol").alias("to_symbol"), F.lit("derived").alias("confidence"),
    )
    return symbols, edges.distinct()
