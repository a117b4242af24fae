"""Linking names to what they mean: endpoints, members, package folders, fixtures, exported lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.paths import ancestors, language_of
from quarryline.operators.ranking import top_k
from quarryline.operators.relations import endpoint_key, narrowest, overlapping, unique_or_none
from quarryline.operators.scan import lines_of

#: How many handlers an endpoint reference is linked to at most.
MOST_HANDLERS = 4


def endpoint_references(files: DataFrame) -> DataFrame:
    """(repo, path, line_no, method, endpoint): strings in code that look like routes, with the method that the call
    around them names (GET where it names none)."""
    rows = lines_of(files.where(language_of(F.col("path")).isin("typescript", "javascript", "python")))
    found = F.regexp_extract_all(F.col("line"), F.lit(r"['\"`](/(?:api|v\d+)/[^'\"`\s]*)['\"`]"), F.lit(1))
    method = F.upper(F.regexp_extract("line", r"(?i)(?:method\s*[:=]\s*['\"]|\.)(get|post|put|patch|delete)\b", 1))
    each = rows.select("repo", "path", "line_no", F.when(method == "", "GET").otherwise(method).alias("method"), F.explode(found).alias("endpoint"))
    return each.distinct()


def endpoint_matches(references: DataFrame, handlers: DataFrame, most: int = MOST_HANDLERS) -> DataFrame:
    """(ref_id, handler_id, exact, place): handlers of the same route: those of the reference's method, and where it
    has none those for any method. Dynamic segments of both sides are alike, so routes meet by equality.

    ``references`` has (ref_id, repo, method, endpoint), ``handlers`` (handler_id, repo, method, endpoint).
    """
    r = references.select("ref_id", "repo", "method", endpoint_key(F.col("endpoint")).alias("key"))
    h = handlers.select("handler_id", "repo", "method", endpoint_key(F.col("endpoint")).alias("key")).distinct()
    exact = r.join(h, ["repo", "key", "method"]).select("ref_id", "handler_id", F.lit(True).alias("exact"))
    left = r.join(exact.select("ref_id").distinct(), "ref_id", "left_anti")
    wide = left.drop("method").join(h.where("method = 'ANY'"), ["repo", "key"]).select("ref_id", "handler_id", F.lit(False).alias("exact"))
    return top_k(exact.unionByName(wide), ["ref_id"], [F.col("handler_id").asc()], most)


def member_targets(usages: DataFrame, bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """(usage_id, symbol_id): what ``a.b`` or ``a.b.c`` means in a file that binds ``a`` to another file.

    ``usages`` (usage_id, repo, path, name), ``bindings`` (repo, path, local_name, resolved), ``symbols`` (repo, path,
    name, symbol_id). The name after the first dot is looked up in the bound file; an ambiguous one is none.
    """
    dotted = usages.where(F.contains(F.col("name"), F.lit("."))).withColumns({"local_name": F.split_part("name", F.lit("."), F.lit(1)), "member": F.split_part("name", F.lit("."), F.lit(2))})
    bound = unique_or_none(bindings.where("resolved is not null and local_name is not null"), ["repo", "path", "local_name"], "resolved")
    own = unique_or_none(symbols.select("repo", F.col("path").alias("resolved"), F.col("name").alias("member"), "symbol_id"), ["repo", "resolved", "member"], "symbol_id")
    return dotted.join(bound, ["repo", "path", "local_name"]).join(own, ["repo", "resolved", "member"]).select("usage_id", "symbol_id")


def imported_symbols(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path, resolved, local_name, type_only, to_symbol): imports with the exported symbol of the resolved file
    that they name, by its name or qualified name (``default`` by its name only), the first of it where there are more."""
    own = symbols.where("exported").select("repo", F.col("path").alias("resolved"), "name", "qualified_name", "start_line", "symbol_id")
    names = F.array_distinct(F.array_compact(F.array("name", F.when(F.col("qualified_name") != "default", F.col("qualified_name")))))
    first = own.withColumn("imported_name", F.explode(names)).groupBy("repo", "resolved", "imported_name").agg(F.min_by("symbol_id", F.struct(F.coalesce("start_line", F.lit(0)), F.col("symbol_id"))).alias("to_symbol"))
    some = imports.where("resolved is not null and imported_name <> '*'")
    return some.join(first, ["repo", "resolved", "imported_name"]).select("repo", "path", "resolved", F.coalesce("local_name", "imported_name").alias("local_name"), "type_only", "to_symbol")


def usage_targets(usages: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path, kind, from_symbol, to_path, to_symbol, confidence): usages (usage_id, repo, path, name, kind, line)
    whose name means one symbol.

    A plain name is a symbol of its own file, else what the file imports by that name; ``a.b`` is looked up in the file
    that ``a`` is bound to. A usage comes from the narrowest symbol around its line, and from its file where there is none.
    """
    at = symbols.select("repo", F.col("path").alias("to_path"), F.col("symbol_id").alias("to_symbol"))
    own = unique_or_none(symbols.where("kind <> 'module'").select("repo", "path", "name", "symbol_id"), ["repo", "path", "name"], "symbol_id")
    bound = unique_or_none(imported_symbols(imports, symbols).select("repo", "path", F.col("local_name").alias("name"), "to_symbol"), ["repo", "path", "name"], "to_symbol")
    here = usages.join(own, ["repo", "path", "name"]).select("usage_id", F.col("symbol_id").alias("to_symbol"))
    there = usages.join(bound, ["repo", "path", "name"]).join(here, "usage_id", "left_anti").select("usage_id", "to_symbol")
    member = member_targets(usages.select("usage_id", "repo", "path", "name"), imports.select("repo", "path", "local_name", "resolved"), symbols).select("usage_id", F.col("symbol_id").alias("to_symbol"))
    lines = usages.select("repo", "path", "usage_id", F.col("line").alias("a_from"), F.col("line").alias("a_to"))
    ranges = symbols.where("kind <> 'module'").select("repo", "path", "symbol_id", F.col("start_line").alias("b_from"), F.col("end_line").alias("b_to"))
    around = narrowest(overlapping(lines, ranges, ["repo", "path"]), "usage_id", "b_from", "b_to", "symbol_id")
    found = here.unionByName(there).unionByName(member).join(usages, "usage_id").join(around, "usage_id", "left").join(at, ["repo", "to_symbol"])
    return found.select("repo", "path", "kind", F.col("enclosing").alias("from_symbol"), "to_path", "to_symbol", F.lit("derived").alias("confidence"))


def job_symbols(extracted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path, symbol_id): symbols with a decorator that speaks of tasks, jobs or workers. ``extracted`` are facts of
    texts; a decorator belongs to the definition that follows it."""
    after = Window.partitionBy("repo", "path").orderBy(F.col("start_line"), F.when(F.col("fact") == "usage", 0).otherwise(1)).rowsBetween(1, Window.unboundedFollowing)
    some = extracted.where("fact = 'symbol' and kind in ('class', 'function', 'method', 'test') or kind = 'decorator'").distinct()
    each = some.withColumn("defined", F.first(F.when(F.col("fact") == "symbol", F.col("name")), ignorenulls=True).over(after))
    jobs = each.where("kind = 'decorator'").where(F.lower("specifier").rlike("task|job|worker|celery|rq")).select("repo", "path", F.col("defined").alias("name")).distinct()
    return symbols.select("repo", "path", "name", "symbol_id").join(jobs, ["repo", "path", "name"], "left_semi").select("repo", "path", "symbol_id")


def package_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, target): the shallowest source file of the folder that an import of a package folder names.

    ``imports`` has (import_id, repo, folder), ``files`` (repo, path, is_test). Files know all folders above them, so
    a folder meets its files by equality; of the least depth the first by name counts, tests never.
    """
    inside = files.where("not is_test").select("repo", "path", F.explode(F.filter(ancestors(F.col("path")), lambda f: f != "")).alias("folder"))
    best = inside.groupBy("repo", "folder").agg(F.min_by("path", F.struct(F.size(F.split("path", "/")), F.col("path"))).alias("target"))
    return imports.join(best, ["repo", "folder"]).select("import_id", "target")


def python_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, target, authoritative): Python imports (import_id, repo, module, name) as files.

    The imported name as a module comes first, then the module, as file or package, from the root or below ``src``;
    it is authoritative if every folder from there has an ``__init__.py``.
    """
    base = F.translate("module", ".", "/")
    both = F.array(F.concat_ws("/", base, "name"), base)
    roots = F.array(F.lit(""), F.lit("src/"))
    tries = F.flatten(F.transform(both, lambda b: F.flatten(F.transform(roots, lambda r: F.array(F.concat(r, b, F.lit(".py")), F.concat(r, b, F.lit("/__init__.py")))))))
    tried = imports.where("module is not null and module not like '.%'").select("import_id", "repo", F.posexplode(tries).alias("place", "path"))
    hit = tried.join(files.select("repo", "path").distinct(), ["repo", "path"]).groupBy("import_id", "repo").agg(F.min_by("path", "place").alias("target"))
    folders = F.filter(ancestors(F.regexp_replace("target", "^src/", "")), lambda f: f != "")
    prefix = F.when(F.col("target").startswith("src/"), "src/").otherwise("")
    need = hit.select("import_id", "repo", F.explode(F.transform(folders, lambda f: F.concat(prefix, f, F.lit("/__init__.py")))).alias("path"))
    lacking = need.join(files.select("repo", "path").distinct(), ["repo", "path"], "left_anti").select("import_id").distinct().withColumn("_lacks", F.lit(True))
    return hit.join(lacking, "import_id", "left").select("import_id", "target", F.col("_lacks").isNull().alias("authoritative"))


def visible_fixtures(usages: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(usage_id, fixture_id, how): which fixture a test's parameter means: one of its own file, else of the nearest
    ``conftest.py`` above it, else the only one of that name in the repository (heuristic).

    ``usages`` (usage_id, repo, path, name), ``fixtures`` (fixture_id, repo, path, name).
    """
    same = usages.join(unique_or_none(fixtures, ["repo", "path", "name"], "fixture_id"), ["repo", "path", "name"]).select("usage_id", "fixture_id", F.lit("file").alias("how"), F.lit(0).alias("rank"))
    folder = F.regexp_replace("path", r"/?conftest\.py$", "")
    shared = fixtures.where(F.col("path").rlike(r"(^|/)conftest\.py$")).select("repo", "name", folder.alias("folder"), F.col("fixture_id").alias("f"))
    above = usages.select("usage_id", "repo", "name", F.posexplode(ancestors(F.col("path"))).alias("distance", "folder")).join(shared, ["repo", "name", "folder"])
    near = above.groupBy("usage_id").agg(F.min_by("f", F.struct("distance", "f")).alias("fixture_id")).select("usage_id", "fixture_id", F.lit("conftest").alias("how"), F.lit(1).alias("rank"))
    only = usages.join(unique_or_none(fixtures, ["repo", "name"], "fixture_id"), ["repo", "name"]).select("usage_id", "fixture_id", F.lit("unique").alias("how"), F.lit(2).alias("rank"))
    every = same.unionByName(near).unionByName(only)
    return every.groupBy("usage_id").agg(F.min(F.struct("rank", "fixture_id", "how")).alias("b")).select("usage_id", "b.fixture_id", "b.how")


def exported_names(files: DataFrame) -> DataFrame:
    """(repo, path, name) that Python files list in ``__all__``."""
    listed = F.regexp_extract("text", r"(?m)^__all__\s*(?::[^=\n]+)?\+?=\s*[\[(]([^\])]*)", 1)
    names = F.regexp_extract_all(listed, F.lit(r"['\"]([A-Za-z_]\w*)['\"]"), F.lit(1))
    return files.where((language_of(F.col("path")) == "python") & F.col("text").isNotNull()).select("repo", "path", F.explode(F.array_distinct(names)).alias("name"))


def dotted_references(files: DataFrame) -> DataFrame:
    """(repo, path, line_no, reference): quoted dotted names in code, web domains and file names left out."""
    rows = lines_of(files.where(language_of(F.col("path")).isin("typescript", "javascript", "python", "json")))
    found = F.regexp_extract_all(F.col("line"), F.lit(r"['\"]([a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*){1,5})['\"]"), F.lit(1))
    each = rows.select("repo", "path", "line_no", F.explode(F.array_distinct(found)).alias("reference"))
    ends = r"\.(com|org|net|io|dev|app|js|ts|py|json|md|txt|html|css|yaml|yml|toml|go|rs|java|sh)$"
    return each.where(~F.col("reference").rlike(ends))


def model_attributes(files: DataFrame) -> DataFrame:
    """(repo, path, line_no, name): annotated or mapped attributes of Python files that import a model framework."""
    framework = r"(?m)^\s*(?:from|import)\s+(?:pydantic|sqlalchemy|sqlmodel|django\.db)\b"
    some = files.where((language_of(F.col("path")) == "python") & F.col("text").rlike(framework))
    pattern = r"^\s{4}([a-z_]\w*)\s*(?::\s*[A-Za-z_][\w\[\], .|]*(?:=.*)?|=\s*(?:Column|mapped_column|relationship|models\.\w+)\(.*)$"
    return lines_of(some).where(F.col("line").rlike(pattern)).select("repo", "path", "line_no", F.regexp_extract("line", pattern, 1).alias("name"))


def decided(rows: DataFrame, *rules: tuple[Column, str], default: str) -> DataFrame:
    """Rows with ``verdict``: the name of the first rule that holds."""
    verdict = F.coalesce(*(F.when(c, F.lit(n)) for c, n in rules), F.lit(default))
    return rows.withColumn("verdict", verdict)
