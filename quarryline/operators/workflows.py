"""Typed workflow edges: routes to endpoints, pages and tests to endpoints, routes to stores, stores to adapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.paths import is_test
from quarryline.functions.search import is_adapter_path, is_store_name, is_store_path
from quarryline.operators.resolve import endpoint_matches
from quarryline.schema import confidence_of, ordinal

EDGE = ("repo", "edge_kind", "from_path", "from_symbol", "to_path", "to_symbol", "endpoint", "confidence", "weight")


def _edge(rows: DataFrame, kind: str | Column, weight: float | Column, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    kind_, weight_ = (x if isinstance(x, Column) else F.lit(x) for x in (kind, weight))
    given = columns | {"repo": F.col("repo"), "edge_kind": kind_, "weight": weight_.cast("double")}
    return rows.select(*(given.get(n, none).alias(n) for n in EDGE))


def store_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path): files without routes whose path, or a class, function or method in which, is named as a store."""
    named = symbols.where(F.col("kind").isin("class", "function", "method")).where(is_store_name(F.col("name")) | is_store_name(F.col("qualified_name")))
    held = named.select("repo", "path").distinct().withColumn("_named", F.lit(True))
    routes = symbols.where("kind = 'route'").select("repo", "path").distinct()
    each = files.select("repo", "path").distinct().join(held, ["repo", "path"], "left").where(is_store_path(F.col("path")) | F.col("_named"))
    return each.join(routes, ["repo", "path"], "left_anti").select("repo", "path")


def adapter_files(files: DataFrame) -> DataFrame:
    return files.select("repo", "path").where(is_adapter_path(F.col("path"))).distinct()


def route_store_calls(usages: DataFrame, symbols: DataFrame, stores: DataFrame, imports: DataFrame) -> DataFrame:
    """EDGE rows ROUTE_CALLS_STORE: usages (repo, path, name, from_symbol, to_symbol, confidence) of a route that mean a
    symbol of a store file (3). ``store.method`` that means no symbol is taken for the method of that name in the
    first store file that the route's file imports, or in the repository's only one; where none has it for that file
    itself (2.2, heuristic) — unless the route has a surer edge to that file."""
    routes = symbols.where("kind = 'route'").select(F.col("symbol_id").alias("from_symbol"), F.col("path").alias("from_path"))
    used = usages.join(routes, "from_symbol")
    at = symbols.select(F.col("symbol_id").alias("to_symbol"), F.col("path").alias("to_path"), "repo").join(stores.select("repo", F.col("path").alias("to_path")), ["repo", "to_path"])
    c = F.col
    sure = _edge(used.join(at, ["repo", "to_symbol"]), "ROUTE_CALLS_STORE", 3.0, **{n: c(n) for n in ("from_path", "from_symbol", "to_path", "to_symbol", "confidence")})
    method = F.regexp_extract("name", r"^store\.([A-Za-z_]\w*)$", 1)
    loose = used.where("to_symbol is null").withColumn("method", method).where("method <> ''").select("repo", "from_path", "from_symbol", "method").distinct()
    imported = imports.select("repo", c("path").alias("from_path"), c("resolved").alias("path")).join(stores, ["repo", "path"]).distinct()
    only = stores.groupBy("repo").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("repo", "path")
    near = loose.join(imported, ["repo", "from_path"]).select(*loose.columns, "path")
    far = loose.join(imported.select("repo", "from_path").distinct(), ["repo", "from_path"], "left_anti").join(only, "repo").select(*loose.columns, "path")
    names = F.array_distinct(F.array("name", F.regexp_extract("qualified_name", r"\.([^.]+)$", 1)))
    methods = symbols.select("repo", "path", F.explode(names).alias("method"), "start_line", "symbol_id").where("method <> ''")
    methods = methods.groupBy("repo", "path", "method").agg(F.min_by("symbol_id", F.struct(F.coalesce("start_line", F.lit(0)), "symbol_id")).alias("to_symbol"))
    found = near.unionByName(far).join(methods, ["repo", "path", "method"], "left")
    # a file with the method before one without, then the first by path
    best = found.groupBy("repo", "from_path", "from_symbol", "method").agg(F.min(F.struct(c("to_symbol").isNull().alias("no"), "path", "to_symbol")).alias("b"))
    best = best.select("repo", "from_path", "from_symbol", c("b.path").alias("to_path"), c("b.to_symbol").alias("to_symbol"), F.lit("heuristic").alias("confidence"))
    best = best.join(sure.select("from_symbol", "to_path").distinct(), ["from_symbol", "to_path"], "left_anti")
    return sure.unionByName(_edge(best, "ROUTE_CALLS_STORE", 2.2, **{n: c(n) for n in ("from_path", "from_symbol", "to_path", "to_symbol", "confidence")}))


def store_adapter_calls(usages: DataFrame, symbols: DataFrame, stores: DataFrame, adapters: DataFrame, imports: DataFrame) -> DataFrame:
    """EDGE rows STORE_DISPATCHES_ADAPTER: usages in a store file that mean a symbol of an adapter file (3.2), and
    imports of adapter files of which the store uses no symbol (2.4, derived)."""
    c = F.col
    at = symbols.select("repo", c("symbol_id").alias("to_symbol"), c("path").alias("to_path")).join(adapters.select("repo", c("path").alias("to_path")), ["repo", "to_path"])
    own = usages.join(stores, ["repo", "path"]).join(at, ["repo", "to_symbol"])
    used = _edge(own, "STORE_DISPATCHES_ADAPTER", 3.2, from_path=c("path"), to_path=c("to_path"), to_symbol=c("to_symbol"), confidence=c("confidence"))
    bound = imports.select("repo", "path", c("resolved").alias("to_path")).distinct().join(stores, ["repo", "path"]).join(adapters.select("repo", c("path").alias("to_path")), ["repo", "to_path"])
    bound = bound.join(used.select("repo", c("from_path").alias("path"), "to_path").distinct(), ["repo", "path", "to_path"], "left_anti")
    return used.unionByName(_edge(bound, "STORE_DISPATCHES_ADAPTER", 2.4, from_path=c("path"), to_path=c("to_path"), confidence=F.lit("derived")))


def endpoint_edges(handlers: DataFrame, references: DataFrame) -> DataFrame:
    """EDGE rows of endpoints: ROUTE_HANDLES (4.5) of each handler (handler_id, repo, path, symbol_id, method, endpoint,
    confidence), and UI_CALLS_ENDPOINT (3.8), of tests TEST_COVERS_WORKFLOW (3.2), of each reference (ref_id, repo,
    path, from_symbol, method, endpoint, confidence) to the at most four handlers that it means. Two authoritative
    ends are authoritative, a heuristic one makes heuristic, anything else derived."""
    c = F.col
    key = F.concat_ws(" ", "method", "endpoint")
    own = _edge(handlers, "ROUTE_HANDLES", 4.5, from_path=c("path"), from_symbol=c("symbol_id"), to_path=c("path"), endpoint=key, confidence=c("confidence"))
    h = handlers.select("handler_id", c("path").alias("to_path"), c("symbol_id").alias("to_symbol"), key.alias("endpoint"), c("confidence").alias("_h"))
    met = endpoint_matches(references, handlers).join(references.select("ref_id", "repo", "path", "from_symbol", "confidence"), "ref_id").join(h, "handler_id")
    a, b = ordinal(c("confidence")), ordinal(c("_h"))
    both = F.when((a == 0) & (b == 0), 0).when((a == 2) | (b == 2), 2).otherwise(1)
    test = is_test(c("path"))
    calls = _edge(
        met, F.when(test, "TEST_COVERS_WORKFLOW").otherwise("UI_CALLS_ENDPOINT"), F.when(test, 3.2).otherwise(3.8), from_path=c("path"), from_symbol=c("from_symbol"),
        to_path=c("to_path"), to_symbol=c("to_symbol"), endpoint=c("endpoint"), confidence=confidence_of(both),
    )
    return own.unionByName(calls)


def workflow_edges(parts: list[DataFrame]) -> DataFrame:
    """The edges of all parts, each once with its best confidence and greatest weight."""
    keys = [n for n in EDGE if n not in ("confidence", "weight")]
    once = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.min(ordinal(F.col("confidence"))).alias("_c"), F.max("weight").alias("weight"))
    return once.select(*keys, confidence_of(F.col("_c")).alias("confidence"), "weight")


def workflow_paths(edges: DataFrame) -> DataFrame:
    """(repo, path, kinds, edges, weight): how much each file takes part in workflows: its edges at either end, their
    kinds and summed weight."""
    ends = F.array_distinct(F.array_compact(F.array("from_path", "to_path")))
    each = edges.select("repo", "edge_kind", "weight", F.explode(ends).alias("path"))
    sums = each.groupBy("repo", "path", "edge_kind").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return sums.groupBy("repo", "path").agg(F.array_sort(F.collect_set("edge_kind")).alias("kinds"), F.sum("n").alias("edges"), F.sum("w").alias("weight"))
