"""Facts from source text: rule tables, placeholders, raw search, documents, routes. Line oriented and JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.paths import is_generated, is_public, is_test, language_of
from quarryline.operators import pairs
from quarryline.operators.ranking import top_k
from quarryline.session import cut

#: Id, score, pattern, languages ("" for all) and path pattern ("" for all) of the rules on code.
RULES = [
    ("shell-execution-boundary", 2.5, r"\b(execFileSync|execFile|spawn|spawnSync|execSync|subprocess\.(run|Popen|call|check_call|check_output))\s*\(", "typescript javascript python", ""),
    ("filesystem-write-boundary", 2.0, r"\b(writeFile|appendFile|rename|rm|unlink|mkdir|open)\s*\(|\bfs\.(writeFile|appendFile|rename|rm|unlink|mkdir)\b", "typescript javascript python", ""),
    ("mcp-tool-surface", 2.0, r"\bregisterTool\s*\(", "typescript javascript", r"(^|/)mcp\.[cm]?[jt]s$"),
    ("dangerous-html-sink", 2.0, r"\bdangerouslySetInnerHTML\b", "typescript javascript", ""),
    ("sql-execution-boundary", 2.0, r"\.(execute|executemany|executescript|raw)\s*\(", "typescript javascript python", ""),
    ("fastapi-dependency-boundary", 1.5, r"\b(APIRouter|FastAPI|Depends|include_router)\b", "python", ""),
    ("pydantic-model-boundary", 1.5, r"\b(BaseModel|Field|model_validate|model_dump)\b", "python", ""),
    ("sqlalchemy-model-boundary", 1.5, r"\b(SQLAlchemy|declarative_base|relationship|mapped_column|Session|select)\b", "python", ""),
    ("celery-job-boundary", 1.5, r"\b(celery|Celery|shared_task|@task|@job|rq\.|enqueue)\b", "python", ""),
    ("queue-lifecycle-boundary", 2.0, r"(?i)\b(run_id|queue|polling|queued|running|completed|failed|cancelled|recover|terminal)\b", "typescript javascript python", r"(^|/)(api|backend|server|service|src|web/src|tests)/"),
    ("generator-node-invariant", 2.0, r"(?i)\b(generator|runtime_identity|managed_output|prompt_builder|run_status|generator-node-template)\b", "typescript javascript json", r"(^|/)(src|web/src|packages?|manifests?)/"),
    ("manifest-adapter-contract", 2.0, r"(?i)\b(type_id|adapter_key|inputs|outputs|managed_output|node_type)\b", "json python typescript javascript", r"(^|/)(packages?|manifests?|adapters?|src|web/src)/"),
    ("frontend-polling-boundary", 1.8, r"\b(useRunPolling|pollInterval|setInterval|refetch|queue|runStatus|last_error|silent)\b", "typescript javascript", r"(^|/)web/src/"),
    ("release-service-boundary", 2.0, r"\b(release|promote|rollback|systemctl|app\.service|RUN_COORDINATOR_ENABLED|BACKGROUND_INGEST_ENABLED)\b", "typescript javascript python", r"(^|/)(scripts|api|backend|server|service|src|web/src)/"),
]
#: Signal, score, test of a path (see path_risks).
PATH_SCORES = {"public-surface": 2.0, "adapter-runtime": 2.0, "package-manifest": 1.5, "operator-runtime": 2.0, "config-or-migration": 1.5, "test-file": 0.5}
#: How much a placeholder counts in a context.
CONTEXT_FACTOR = {"production": 1.0, "test": 0.35, "docs": 0.25, "generated": 0.2}
MOST_HITS, MOST_PLACEHOLDERS = 5, 12


def lines_of(files: DataFrame) -> DataFrame:
    """Files (repo, path, text) as lines (repo, path, line_no, line)."""
    return files.where("text is not null").select("repo", "path", F.posexplode(F.split("text", r"\r?\n")).alias("_n", "line")).select(
        "repo", "path", (F.col("_n") + 1).alias("line_no"), "line"
    )


def pattern_hits(files: DataFrame, rules: list[tuple[str, float, str, str, str]] | None = None, most: int = MOST_HITS) -> DataFrame:
    """(repo, path, rule, score, hits, matches): per file and rule the matches, at most ``most`` of them in order.

    ``hits`` is how many there are. The rule table is part of the expression, so a file is read once for all rules
    and no join takes place; only rules that match give a row.
    """
    text, path, lang = F.col("text"), F.col("path"), F.col("_lang")
    entries = []
    for rule, score, pattern, languages, where in rules or RULES:
        fits = F.lit(True)
        if languages:
            fits = fits & lang.isin(*languages.split())
        if where:
            fits = fits & path.rlike(where)
        found = F.when(fits, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
        entries.append(F.struct(F.lit(rule).alias("rule"), F.lit(score).alias("score"), found.alias("found")))
    tagged = files.where("text is not null").withColumn("_lang", language_of(path))
    each = tagged.select("repo", "path", F.explode(F.array(*entries)).alias("h")).where("size(h.found) > 0")
    return each.select("repo", "path", "h.rule", "h.score", F.size("h.found").alias("hits"), F.array_join(F.slice("h.found", 1, most), "|").alias("matches"))


def path_risks(files: DataFrame) -> DataFrame:
    """(repo, path, signal, score): what a path alone tells of risk."""
    p = F.col("path")
    control = p.rlike(r"^scripts/(service|release|preview)-control\.sh$") | p.endswith(".service")
    tests = {
        "public-surface": is_public(p), "adapter-runtime": p.contains("/adapters/"), "package-manifest": p.contains("/packages/"), "operator-runtime": control,
        "config-or-migration": p.contains("migration") | p.contains("config") | p.endswith(".service"), "test-file": is_test(p),
    }
    found = F.array_compact(F.array(*(F.when(t, F.struct(F.lit(s).alias("signal"), F.lit(PATH_SCORES[s]).alias("score"))) for s, t in tests.items())))
    return files.select("repo", "path", F.explode(found).alias("r")).select("repo", "path", "r.*")


def context_of(path: Column) -> Column:
    return F.when(is_generated(path), "generated").when(is_test(path), "test").when((language_of(path) == "markdown") | path.rlike("(^|/)docs?/"), "docs").otherwise("production")


def placeholders(files: DataFrame, most: int = MOST_PLACEHOLDERS) -> DataFrame:
    """(repo, path, line_no, signal, score, place): stubs, dummy data and notes to come back, the highest of a file.

    Bodies that do nothing or raise "not implemented" (3.5, 1.8, 2.2), variables named as dummies (1.7), comments with
    TODO and the like (.9) or about placeholders (.8), times what the context counts.
    """
    lang = language_of(F.col("path"))
    script = lang.isin("typescript", "javascript")
    line = F.col("line")
    code = F.regexp_replace(line, r"(^|\s)(#|//).*$", "")
    comment = F.regexp_extract(line, r"(?:^|\s)(?:#|//|/\*|\*)\s?(.*)$", 1)
    marker = r"(?i)\b(TODO|FIXME|HACK|XXX|TBD)\b"
    tests = [
        ("placeholder.not-implemented", 3.5, (lang == "python") & F.trim(code).rlike(r"^raise\s+NotImplementedError\b")),
        ("placeholder.not-implemented", 3.5, script & code.rlike(r"(?i)\bthrow\s+new\s+Error\s*\(\s*['\"`][^'\"`]*(todo|tbd|not implemented|unimplemented|placeholder|stub)")),
        ("placeholder.no-op-body", 1.8, (lang == "python") & F.trim(code).rlike(r"^(pass|\.\.\.)\s*$")),
        ("placeholder.no-op-body", 2.2, script & code.rlike(r"\bfunction\s+[A-Za-z_$][\w$]*\s*\([^)]*\)\s*\{\s*\}")),
        ("placeholder.dummy-data", 1.7, script & code.rlike(r"\b(const|let|var)\s+(dummy|fake|mock|sample)[A-Za-z0-9_$]*\s*=")),
        ("placeholder.dummy-data", 1.7, (lang == "python") & code.rlike(r"^\s*(dummy|fake|mock|sample)[A-Za-z0-9_]*\s*=")),
        ("placeholder.todo-comment", 0.9, comment.rlike(marker)),
        ("placeholder.placeholder-comment", 0.8, ~comment.rlike(marker) & comment.rlike(r"(?i)\b(placeholder|stub|dummy|fake|not implemented|unimplemented|replace me)\b")),
    ]
    found = F.array_compact(F.array(*(F.when(t, F.struct(F.lit(s).alias("signal"), F.lit(x).alias("base"))) for s, x, t in tests)))
    rows = lines_of(files).select("repo", "path", "line_no", F.explode(found).alias("p")).select("repo", "path", "line_no", "p.*").distinct()
    factor = reduce(lambda acc, kv: acc.when(context_of(F.col("path")) == kv[0], kv[1]), list(CONTEXT_FACTOR.items())[1:], F.when(context_of(F.col("path")) == "production", 1.0))
    rows = rows.withColumn("score", F.round(F.col("base") * factor, 2)).drop("base")
    return top_k(rows, ["repo", "path"], [F.col("score").desc(), F.col("line_no").asc(), F.col("signal").asc()], most)


def raw_search(files: DataFrame, patterns: list[str], per_file: int = 25, width: int = 220) -> DataFrame:
    """(repo, path, pattern, line_no, line, place): lines that contain a literal pattern, at most ``per_file`` of a
    file and pattern, cut to ``width`` characters; at most eight patterns."""
    if len(patterns) > 8:
        raise ValueError("at most eight patterns")
    hits = F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.col("line"), p))
    found = lines_of(files).withColumn("pattern", F.explode(hits)).withColumn("line", F.substring(F.trim("line"), 1, width))
    return top_k(found.distinct(), ["repo", "path", "pattern"], [F.col("line_no").asc()], per_file)


def literal_hits(files: DataFrame, asked: DataFrame, per_file: int = 25, top: int | None = None) -> DataFrame:
    """(query, path, hits): on how many lines a file (repo, path, text) holds a term of a query (query, repo, term)
    literally, also inside words, at most ``per_file``. With ``top`` only the files that can be among the first so many
    of a query by hits and then by path, and a few others, with ``files`` and ``all_hits``, whose sums over a query's
    rows are the number of its files and of their hits.

    Terms consist of letters, digits and ``_.@/-``, so they lie within one run of these. Each distinct run of a block of
    texts is looked up once.
    """
    docs = files.where("text is not null").groupBy(F.col("repo").alias("scope"), F.col("path").alias("doc")).agg(F.collect_set("text").alias("texts"), F.sum(F.length("text")).alias("n"))
    queries = asked.groupBy("query", F.col("repo").alias("scope")).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    grid = pairs.cells(cut(docs), queries, 2_000_000)
    found = pairs.scored(grid, pairs.literal_rows(per_file, top), "hits long" + ", files long, all_hits long" * bool(top))
    return found.drop("scope").withColumnRenamed("doc", "path")


def markdown_headings(files: DataFrame) -> DataFrame:
    """(repo, path, line_no, level, title, exported) of the headings of documents."""
    rows = lines_of(files.where(language_of(F.col("path")) == "markdown"))
    pattern = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
    found = rows.where(F.col("line").rlike(pattern)).withColumn("level", F.length(F.regexp_extract("line", pattern, 1)))
    return found.select("repo", "path", "line_no", "level", F.regexp_extract("line", pattern, 2).alias("title"), (F.col("level") <= 2).alias("exported"))


def markdown_links(files: DataFrame) -> DataFrame:
    """(repo, path, line_no, label, target) of the links of documents, images left out."""
    rows = lines_of(files.where(language_of(F.col("path")) == "markdown"))
    links = F.regexp_extract_all(F.concat(F.lit(" "), "line"), F.lit(r"[^!](\[[^\]]*\]\([^)\s]+\))"), F.lit(1))
    each = rows.select("repo", "path", "line_no", F.explode(links).alias("link"))
    return each.select("repo", "path", "line_no", F.regexp_extract("link", r"\[([^\]]*)\]", 1).alias("label"), F.regexp_extract("link", r"\(([^)\s]+)\)", 1).alias("target"))


def route_endpoints(decorators: DataFrame) -> DataFrame:
    """(row_id, method, endpoint) from decorator texts (row_id, text): one row for each method; ``route`` alone is ANY."""
    text = F.col("text")
    verb = F.upper(F.regexp_extract(text, r"\.(get|post|put|patch|delete|head|options|route|websocket)\s*\(", 1))
    listed = F.regexp_extract_all(F.regexp_extract(text, r"methods\s*=\s*[\[(]([^\])]*)", 1), F.lit(r"['\"](\w+)['\"]"), F.lit(1))
    methods = F.when(F.size(listed) > 0, F.transform(listed, lambda m: F.upper(m))).when(verb == "ROUTE", F.array(F.lit("ANY"))).otherwise(F.array(verb))
    endpoint = F.regexp_extract(text, r"\(\s*f?['\"]([^'\"]*)['\"]", 1)
    return decorators.where(verb != "").select("row_id", F.explode(methods).alias("method"), endpoint.alias("endpoint"))


def manifests(files: DataFrame) -> DataFrame:
    """(repo, path, key, value): name, version, and each script and dependency of JSON manifests.

    The JSON is read as a Variant, so fields of another type, or a text that is no JSON, give nothing.
    """
    rows = files.where((language_of(F.col("path")) == "json") & F.col("text").isNotNull()).select("repo", "path", F.expr("try_parse_json(text)").alias("v"))
    def flat(name: str) -> Column:
        entries = F.map_entries(F.expr(f"try_variant_get(v, '$.{name}', 'map<string, string>')"))
        return F.transform(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.concat(F.lit(f"{name}."), e["key"]).alias("key"), e["value"].alias("value")))
    single = F.array(*(F.struct(F.lit(n).alias("key"), F.expr(f"try_variant_get(v, '$.{n}', 'string')").alias("value")) for n in ("name", "version")))
    every = F.concat(single, *(flat(n) for n in ("scripts", "dependencies", "devDependencies")))
    return rows.select("repo", "path", F.explode(every).alias("e")).select("repo", "path", "e.*").where("value is not null")
