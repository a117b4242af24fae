"""Exports of the graph and small projections for readers, each bounded and in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.ranking import top_k
from quarryline.schema import edge_order

#: How many files and edges of a repository are exported.
FILES, EDGES = 180, 600


def graph_export(ranked: DataFrame, edges: DataFrame, files: int = FILES, most: int = EDGES) -> tuple[DataFrame, DataFrame]:
    """The files (repo, path, rank) of highest rank of each repository, and the heaviest edges between them, with the
    membership of files in modules as edges of the kind CONTAINS."""
    nodes = top_k(ranked.select("repo", "path", "module", "rank"), ["repo"], [F.round("rank", 6).desc(), F.col("path").asc()], files)
    kept = nodes.select("repo", F.col("path").alias("from_path"))
    inner = edges.join(kept, ["repo", "from_path"], "left_semi").join(kept.withColumnRenamed("from_path", "to_path"), ["repo", "to_path"], "left_semi")
    best = top_k(inner.select("repo", "edge_id", "edge_kind", "from_path", "to_path", "weight"), ["repo"], [F.col("weight").desc(), F.col("edge_id").asc()], most).drop("place")
    contains = nodes.select("repo", F.concat_ws(":", "module", "path").alias("edge_id"), F.lit("CONTAINS").alias("edge_kind"), F.col("module").alias("from_path"), F.col("path").alias("to_path"), F.lit(1.0).alias("weight"))
    return nodes.drop("place"), best.unionByName(contains)


def edge_evidence(edges: DataFrame, keys: list[str], most: int = 60) -> DataFrame:
    """The first edges of each key in the order in which they are shown, with what makes each weak."""
    rows = top_k(edges, keys, edge_order(), most)
    weak = (F.col("confidence") == "heuristic") | (F.col("fact_source") == "heuristic")
    return rows.select(*keys, "edge_id", "edge_kind", "from_path", "to_path", "confidence", F.coalesce(weak, F.lit(True)).alias("degraded"), "place")


def find_context(rows: DataFrame, text: Column, wanted: str, order: list[Column], most: int = 20) -> DataFrame:
    """Rows whose text contains what is wanted, in any case, the first of all in the given order."""
    return rows.where(F.contains(F.lower(text), F.lit(wanted.lower()))).orderBy(*order).limit(most)


def best_key_match(keys: DataFrame, candidates: DataFrame) -> DataFrame:
    """(key_id, candidate_id, score): for each dotted key the candidate that is most like it.

    100 for the same name, 12 for the same last part, 1 for each other shared part, 20 more in the same folder; ties
    go to the lesser candidate. ``keys`` (key_id, scope, key, folder), ``candidates`` (candidate_id, scope, name,
    folder). Both sides meet by shared parts, so nothing without one is compared.
    """
    def parts(c: str) -> Column:
        return F.filter(F.split(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1.$2")), r"[^a-z0-9]+"), lambda p: p != "")
    k = keys.withColumn("kp", parts("key"))
    c = candidates.withColumn("cp", parts("name")).withColumnRenamed("folder", "c_folder")
    met = k.select("key_id", "scope", F.explode(F.array_distinct("kp")).alias("part")).join(c.select("candidate_id", "scope", F.explode(F.array_distinct("cp")).alias("part")), ["scope", "part"])
    pairs = met.groupBy("scope", "key_id", "candidate_id").agg(F.count("*").alias("shared")).join(k, ["scope", "key_id"]).join(c, ["scope", "candidate_id"])
    last = F.element_at("kp", -1) == F.element_at("cp", -1)
    score = F.when(F.col("kp") == F.col("cp"), 100).otherwise(F.when(last, 12).otherwise(0) + F.col("shared")) + F.when(F.col("folder").eqNullSafe(F.col("c_folder")), 20).otherwise(0)
    place = F.row_number().over(Window.partitionBy("key_id").orderBy(F.col("score").desc(), F.col("candidate_id").asc()))
    return pairs.withColumn("score", score).withColumn("place", place).where("place = 1").select("key_id", "candidate_id", "score")


def star_imports(imports: DataFrame, exported: DataFrame) -> DataFrame:
    """(import_id, name): the names that ``from x import *`` binds: those that its target lists as exported."""
    star = imports.where("imported_name = '*' and resolved is not null").select("import_id", "repo", F.col("resolved").alias("path"))
    return star.join(exported.select("repo", "path", "name").distinct(), ["repo", "path"]).select("import_id", "name")


def files_of_hits(hits: DataFrame) -> DataFrame:
    """(query, files): files of raw hits (query, path, line_no) in the order of their first hit, as a baseline."""
    first = hits.groupBy("query", "path").agg(F.min("line_no").alias("line_no"), F.count("*").alias("hits"))
    return first.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("h"), "path"))), lambda x: x["path"]).alias("files"))


def reconciled_tests(planned: DataFrame, ran: DataFrame) -> DataFrame:
    """Planned tests (task_id, path, confidence) as ``trusted`` (ran and not guessed), ``degraded`` (ran, guessed) or
    ``missing``; ``ran`` has (task_id, path)."""
    done = ran.select("task_id", "path").distinct().withColumn("_ran", F.lit(True))
    state = F.when(F.col("_ran").isNull(), "missing").when(F.coalesce("confidence", F.lit("heuristic")) == "heuristic", "degraded").otherwise("trusted")
    return planned.join(done, ["task_id", "path"], "left").withColumn("state", state).drop("_ran")


def guidance_lines(lines: DataFrame, terms: list[str], most: int = 12) -> DataFrame:
    """Lines (path, line_no, line) of guidance files that speak of the terms or give rules, the best of each file."""
    text = F.lower("line")
    hits = sum((F.contains(text, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    rule = text.rlike(r"\b(must|never|always|do not|don't|required|only)\b").cast("int")
    command = F.col("line").rlike(r"`[^`]+`").cast("int")
    scored = lines.withColumn("score", hits * 3 + rule * 2 + command).where("score > 0")
    return top_k(scored, ["path"], [F.col("score").desc(), F.col("line_no").asc()], most)
