"""Graph operators: typed edges, callers and callees, bounded closures, paths, neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import stable_id
from quarryline.operators.ranking import top_k
from quarryline.operators.resolve import imported_symbols
from quarryline.schema import CONFIDENCE_WEIGHT, FUNCTIONAL_WEIGHT, PATH_KINDS, REVERSIBLE_KINDS, confidence_of, edge_order, lookup, ordinal
from quarryline.session import cut


def typed_edges(symbols: DataFrame, imports: DataFrame, files: DataFrame, tests: DataFrame, risks: DataFrame, usages: DataFrame | None = None, jobs: DataFrame | None = None) -> DataFrame:
    """Edges (edge_id, repo, edge_kind, from_path, to_path, from_symbol, to_symbol, confidence, weight) from facts.

    A file defines its symbols (3) and exports the exported (2.8; interfaces, types and enums as types), routes (4) and
    jobs (4, symbols of ``jobs``); imports of known files (3) and of the exported symbol that they name (3.2), type-only
    ones give none; imported symbols are referenced (2). ``usages`` (repo, path, kind, from_symbol, to_path, to_symbol,
    confidence) give calls (2.5), references (1.5), extends and implements (2.5). Test edges (3), also as covered
    workflows (2.8); risks (their score, at least .5). Equal edges occur once.
    """
    none = F.lit(None).cast("string")
    known = files.select("repo", F.col("path").alias("resolved"))
    named = symbols.select("repo", "path", "symbol_id", "kind", "exported")

    def edge(df: DataFrame, kind: str, to_path: Column, symbol: Column, confidence: Column, weight: Column, source: Column = none) -> DataFrame:
        return df.select("repo", F.lit(kind).alias("edge_kind"), F.col("path").alias("from_path"), to_path.alias("to_path"), source.alias("from_symbol"), symbol.alias("to_symbol"), confidence.alias("confidence"), weight.cast("double").alias("weight"))

    sure, own = F.lit("authoritative"), (F.col("path"), F.col("symbol_id"))
    is_type = F.col("kind").isin("interface", "type", "enum")
    bound = imported_symbols(imports.join(known, ["repo", "resolved"], "left_semi"), symbols)
    target = (F.col("resolved"), F.col("to_symbol"))
    parts = [
        edge(named, "DEFINES", *own, sure, F.lit(3.0)),
        edge(named.where("exported").where(~F.coalesce(is_type, F.lit(False))), "EXPORTS", *own, sure, F.lit(2.8)),
        edge(named.where("exported").where(is_type), "TYPE_EXPORTS", *own, sure, F.lit(2.8)),
        edge(named.where("kind = 'route'"), "ROUTE", *own, sure, F.lit(4.0)),
        edge(imports.where("not type_only").join(known, ["repo", "resolved"], "left_semi"), "IMPORTS", F.col("resolved"), none, sure, F.lit(3.0)),
        edge(bound.where("not type_only"), "IMPORTS", *target, sure, F.lit(3.2)),
        edge(bound, "REFERENCES", *target, sure, F.lit(2.0)),
        edge(tests, "TESTS", F.col("target"), none, F.col("confidence"), F.lit(3.0)),
        edge(tests, "TEST_COVERS_WORKFLOW", F.col("target"), none, F.col("confidence"), F.lit(2.8)),
        edge(risks, "RISK", F.col("path"), F.col("signal_id"), F.coalesce("confidence", F.lit("heuristic")), F.greatest(F.lit(0.5), F.coalesce("score", F.lit(0.0)))),
    ]
    if jobs is not None:
        parts.append(edge(jobs, "JOB", *own, F.lit("heuristic"), F.lit(4.0)))
    if usages is not None:
        used = (F.col("to_path"), F.col("to_symbol"), F.col("confidence"))
        parts += [
            edge(usages.where("kind = 'call'"), "CALLS", *used, F.lit(2.5), F.col("from_symbol")),
            edge(usages.where("kind <> 'call'"), "REFERENCES", *used, F.lit(1.5), F.col("from_symbol")),
            edge(usages.where("kind = 'extends'"), "EXTENDS", *used, F.lit(2.5), F.col("from_symbol")),
            edge(usages.where("kind = 'implements'"), "IMPLEMENTS", *used, F.lit(2.5), F.col("from_symbol")),
        ]
    every = reduce(DataFrame.unionByName, parts)
    keys = ["repo", "edge_kind", "from_path", "to_path", "from_symbol", "to_symbol"]
    once = every.groupBy(*keys).agg(F.min(ordinal(F.col("confidence"))).alias("_c"), F.max("weight").alias("weight"))
    return once.select(stable_id(F.lit("edge"), *keys).alias("edge_id"), *keys, confidence_of(F.col("_c")).alias("confidence"), "weight")


def neighbours(edges: DataFrame, kinds: list[str], of: str, limit: int) -> DataFrame:
    """The first ``limit`` edges of these kinds at each node (repo, ``of``) in the order in which edges are shown."""
    some = edges.where(F.col("edge_kind").isin(kinds) & F.col(of).isNotNull())
    return top_k(some, ["repo", of], edge_order(), limit)


def closure(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(seed..., node, depth, confidence): nodes reached from each seed within ``depth`` steps along reversed links.

    ``seeds`` has (scope, seed, node) with the node where a seed begins, and may have ``most``, the steps that this
    seed goes at most; ``links`` (scope, source, target,
    confidence): whoever is a source of a link to a reached node is reached. The least depth and the best confidence
    of any way count. Each step joins the new nodes only; a fixed number of steps keeps it one plan per step.
    """
    back = cut(links.groupBy("scope", "source", "target").agg(F.min(ordinal(F.col("confidence"))).alias("c")))
    limits = seeds.select("scope", "seed", F.col("most") if "most" in seeds.columns else F.lit(depth).alias("most")).distinct()
    limits = cut(limits)
    reached = cut(seeds.select("scope", "seed", "node", F.lit(0).alias("depth"), F.lit(0).alias("c")).distinct())
    front = reached
    for step in range(1, depth + 1):
        front = front.join(limits.where(F.col("most") >= step), ["scope", "seed"], "left_semi")
        hop = front.select("scope", "seed", F.col("node").alias("target")).join(back, ["scope", "target"])
        hop = hop.groupBy("scope", "seed", F.col("source").alias("node")).agg(F.min("c").alias("c")).withColumn("depth", F.lit(step))
        merged = reached.unionByName(hop.select(*reached.columns)).groupBy("scope", "seed", "node").agg(F.min("depth").alias("depth"), F.min(F.when(F.col("depth") > 0, F.col("c"))).alias("best"), F.max(F.when(F.col("depth") == 0, F.lit(1))).alias("own"))
        reached = cut(merged.select("scope", "seed", "node", "depth", F.when(F.col("own") == 1, 0).otherwise(F.col("best")).alias("c")))
        front = reached.where(F.col("depth") == step)
    return reached.select("scope", "seed", "node", "depth", confidence_of(F.col("c")).alias("confidence"))


def undirected_hops(seeds: DataFrame, edges: DataFrame, hops: int, limit: int) -> DataFrame:
    """Edges of the neighbourhood of each seed (scope, seed, node): those within ``hops`` steps in either direction,
    at most ``limit`` in the order in which edges are shown, with the step at which each was first met."""
    ends = edges.where("from_node is not null and to_node is not null and from_node <> to_node")
    both = ends.select("scope", "edge_id", F.col("from_node").alias("a"), F.col("to_node").alias("b")).unionByName(
        ends.select("scope", "edge_id", F.col("to_node").alias("a"), F.col("from_node").alias("b"))
    )
    both = cut(both)
    seen = seeds.select("scope", "seed", "node", F.lit(0).alias("step"))
    met: DataFrame | None = None
    front = seen
    for step in range(1, hops + 1):
        hop = front.select("scope", "seed", F.col("node").alias("a")).join(both, ["scope", "a"])
        hop = cut(hop.select("scope", "seed", "edge_id", F.col("b").alias("node")))
        mine = hop.select("scope", "seed", "edge_id", F.lit(step).alias("step")).distinct()
        met = mine if met is None else met.unionByName(mine)
        front = cut(hop.select("scope", "seed", "node").distinct().join(seen.select("scope", "seed", "node"), ["scope", "seed", "node"], "left_anti"))
        seen = seen.unionByName(front.withColumn("step", F.lit(step)).select(*seen.columns))
    assert met is not None
    first = met.groupBy("scope", "seed", "edge_id").agg(F.min("step").alias("step"))
    return top_k(first.join(edges, ["scope", "edge_id"]), ["scope", "seed"], edge_order(), limit)


def dependency_paths(pairs: DataFrame, edges: DataFrame, depth: int = 6) -> DataFrame:
    """(scope, start, goal, length, path): for each pair the first shortest path along dependency edges.

    ``edges`` has (scope, edge_id, edge_kind, confidence, weight, from_path, to_path, source, target). Definitions,
    imports and handled routes are followed both ways. Among shortest paths the one counts that a breadth-first
    search finds first which expands nodes in the order of their discovery and edges in the order in which they are
    shown: each new node keeps the least (place of its parent, place of the edge). Starts advance together; those
    that reached all their goals stop. Pairs without a path of at most ``depth`` edges are left out.
    """
    some = edges.where(F.col("edge_kind").isin(PATH_KINDS)).where("source is not null and target is not null")
    order = F.row_number().over(Window.partitionBy("scope", "source").orderBy(*edge_order(), F.col("target")))
    ahead = some.select("scope", "source", "target", "edge_id", "edge_kind", "confidence", "weight", "from_path", "to_path")
    back = some.where(F.col("edge_kind").isin(list(REVERSIBLE_KINDS))).select(
        "scope", F.col("target").alias("source"), F.col("source").alias("target"), "edge_id", "edge_kind", "confidence", "weight",
        F.col("to_path").alias("from_path"), F.col("from_path").alias("to_path"),
    )
    step_edges = cut(ahead.unionByName(back).withColumn("edge_place", order).select("scope", "source", "target", "edge_place"))
    goals = cut(pairs.select("scope", "start", "goal").distinct())
    front = goals.select("scope", "start", F.col("start").alias("node"), F.lit(0).alias("place"), F.array("start").alias("path")).distinct()
    seen = front.select("scope", "start", "node")
    found = [goals.where("start = goal").select("scope", "start", "goal", F.lit(0).alias("length"), F.array("start").alias("path"))]
    open_goals = cut(goals.where("start <> goal"))
    for length in range(1, depth + 1):
        hop = front.join(open_goals.select("scope", "start").distinct(), ["scope", "start"], "left_semi")
        hop = hop.withColumnRenamed("node", "source").join(step_edges, ["scope", "source"])
        hop = hop.withColumnRenamed("target", "node").join(seen, ["scope", "start", "node"], "left_anti")
        best = hop.groupBy("scope", "start", "node").agg(F.min(F.struct("place", "edge_place", "path")).alias("b"))
        best = best.select("scope", "start", "node", "b.place", "b.edge_place", F.concat("b.path", F.array("node")).alias("path"))
        place = F.row_number().over(Window.partitionBy("scope", "start").orderBy("place", "edge_place", "node")) - 1
        front = cut(best.withColumn("next", place).select("scope", "start", "node", F.col("next").alias("place"), "path"))
        reached = front.join(open_goals.withColumnRenamed("goal", "node"), ["scope", "start", "node"])
        found.append(reached.select("scope", "start", F.col("node").alias("goal"), F.lit(length).alias("length"), "path"))
        open_goals = cut(open_goals.join(found[-1].select("scope", "start", "goal"), ["scope", "start", "goal"], "left_anti"))
        seen = seen.unionByName(front.select("scope", "start", "node"))
        if open_goals.isEmpty() or front.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def functional_neighbourhoods(edges: DataFrame, files: DataFrame, most_files: int = 16, seeds: int = 24) -> DataFrame:
    """(repo, seed, members, size, score): the heaviest one-hop neighbourhoods that span two modules or more.

    Weights of parallel edges add up in both directions; a seed's heaviest neighbours that are no tests join it, at
    most ``most_files`` with the seed. Equal member sets occur once (their best seed); ``seeds`` per repository.
    ``files`` has (repo, path, module, is_test, rank).
    """
    weight = lookup(F.col("edge_kind"), FUNCTIONAL_WEIGHT, 1) * lookup(F.col("confidence"), CONFIDENCE_WEIGHT, 1.0) * F.greatest(F.lit(1.0), F.coalesce("weight", F.lit(0.0)))
    one = edges.where("from_path is not null and to_path is not null and from_path <> to_path").select("repo", F.col("from_path").alias("a"), F.col("to_path").alias("b"), weight.alias("w"))
    both = one.unionByName(one.select("repo", F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("repo", "a", "b").agg(F.sum("w").alias("w"))
    facts = files.select("repo", "path", "module", "is_test", "rank")
    seed = facts.where("not is_test").select("repo", F.col("path").alias("a"), F.col("module").alias("a_module"), F.col("rank").alias("a_rank"))
    other = facts.select("repo", F.col("path").alias("b"), F.col("module").alias("b_module"), F.col("is_test").alias("b_test"), F.col("rank").alias("b_rank"))
    met = cut(both.join(seed, ["repo", "a"]).join(other, ["repo", "b"]))
    weights = met.groupBy("repo", "a").agg(F.sum("w").alias("all_w"))
    near = top_k(met.where("not b_test"), ["repo", "a"], [F.col("w").desc(), F.col("b_rank").desc(), F.col("b").asc()], most_files - 1)
    groups = near.groupBy("repo", "a", "a_module", "a_rank").agg(
        F.array_sort(F.collect_list("b")).alias("others"), F.sum("b_rank").alias("ranks"), F.collect_set("b_module").alias("modules")
    ).join(weights, ["repo", "a"])
    wide = groups.where(F.size(F.array_union("modules", F.array("a_module"))) >= 2)
    members = F.array_join(F.array_sort(F.concat("others", F.array("a"))), ",")
    scored = wide.select("repo", F.col("a").alias("seed"), members.alias("members"), (F.size("others") + 1).alias("size"), (F.col("a_rank") + F.col("ranks") + F.col("all_w")).alias("score"))
    best = scored.groupBy("repo", "members").agg(F.max_by(F.struct("seed", "size", "score"), F.struct(F.round("score", 6), F.col("seed"))).alias("m"))
    flat = best.select("repo", "members", "m.seed", "m.size", "m.score")
    return top_k(flat, ["repo"], [F.round("score", 6).desc(), F.col("members").asc()], seeds).drop("place")


def reexport_bindings(defined: DataFrame, reexports: DataFrame, rounds: int = 8) -> DataFrame:
    """(scope, path, name, symbol_id): names that a file offers through re-exports; an ambiguous name is none.

    ``defined`` has (scope, path, name, symbol_id); ``reexports`` (scope, path, source, name, alias), name ``*`` for
    all. Definitions travel along re-exports until nothing new arrives, at most ``rounds`` times.
    """
    links = cut(reexports.select("scope", "path", "source", "name", F.coalesce("alias", "name").alias("alias")))
    known = cut(defined.select("scope", "path", "name", "symbol_id").distinct())
    own = known
    for _ in range(rounds):
        given = known.withColumnRenamed("path", "source").withColumnRenamed("name", "given")
        hop = links.join(given, ["scope", "source"]).where("name = '*' or name = given")
        new = hop.select("scope", "path", F.when(F.col("name") == "*", F.col("given")).otherwise(F.col("alias")).alias("name"), "symbol_id").distinct()
        fresh = cut(new.join(known, ["scope", "path", "name", "symbol_id"], "left_anti"))
        if fresh.isEmpty():
            break
        known = cut(known.unionByName(fresh))
    offered = known.join(own.select("scope", "path", "name").distinct(), ["scope", "path", "name"], "left_anti")
    one = offered.groupBy("scope", "path", "name").agg(F.min("symbol_id").alias("symbol_id"), F.max("symbol_id").alias("_o"))
    return one.where("symbol_id = _o").drop("_o")


def workflow_traces(entries: DataFrame, edges: DataFrame, tests: DataFrame, per_entry: int = 30, most_tests: int = 8) -> DataFrame:
    """Steps (workflow, scope, place, kind, path, target) of the workflows that begin at entries.

    ``entries`` has (workflow, scope, path), ``edges`` as dependency_paths takes them, ``tests`` (scope, path, target).
    From the entry the first ``per_entry`` edges in the order in which they are shown are steps, then those out of
    their targets; tests that cover a file of the workflow close it.
    """
    flow = edges.where(F.col("edge_kind").isin(*FUNCTIONAL_WEIGHT)).where("from_path <> to_path").select("scope", "edge_id", "edge_kind", "confidence", "weight", "from_path", "to_path")
    first = entries.select("workflow", "scope", F.col("path").alias("from_path")).join(flow, ["scope", "from_path"])
    first = cut(top_k(first, ["workflow"], edge_order(), per_entry))
    second = first.select("workflow", "scope", F.col("to_path").alias("from_path")).distinct().join(flow, ["scope", "from_path"])
    second = second.join(entries.select("workflow", F.col("path").alias("to_path")), ["workflow", "to_path"], "left_anti")
    second = top_k(second.select(*first.drop("place").columns), ["workflow"], edge_order(), per_entry)

    def steps(df: DataFrame, kind: Column, base: int) -> DataFrame:
        return df.select("workflow", "scope", (F.col("place") + base).alias("place"), kind.alias("kind"), F.col("from_path").alias("path"), F.col("to_path").alias("target"))

    begin = entries.select("workflow", "scope", F.lit(0).alias("place"), F.lit("entry").alias("kind"), "path", F.lit(None).cast("string").alias("target"))
    body = begin.unionByName(steps(first, F.lower("edge_kind"), 0)).unionByName(steps(second, F.lower("edge_kind"), per_entry))
    covered = body.select("workflow", "scope", F.explode(F.array_compact(F.array("path", "target"))).alias("target")).distinct()
    found = covered.join(tests, ["scope", "target"]).select("workflow", "scope", "path").distinct()
    last = top_k(found, ["workflow"], [F.col("path").asc()], most_tests)
    return body.unionByName(last.select("workflow", "scope", (F.col("place") + 2 * per_entry).alias("place"), F.lit("test").alias("kind"), "path", F.lit(None).cast("string").alias("target")))


def workflow_summary(steps: DataFrame, ranks: DataFrame) -> DataFrame:
    """(workflow, scope, steps, files, tests, modules, rank, terminal): of each workflow its size, rank (logs of its
    files' ranks and two per test) and the files from which no step leads on. ``ranks`` has (scope, path, rank, module)."""
    touched = steps.select("workflow", "scope", F.explode(F.array_compact(F.array("path", "target"))).alias("path")).distinct().join(ranks, ["scope", "path"])
    sums = touched.groupBy("workflow", "scope").agg(F.count("*").alias("files"), F.sum(F.log2(F.greatest(F.lit(0.0), F.col("rank")) + 1)).alias("r"), F.countDistinct("module").alias("modules"))
    counts = steps.groupBy("workflow").agg(F.count("*").alias("steps"), F.count_if(F.col("kind") == "test").alias("tests"))
    ends = steps.where("target is not null").select("workflow", F.col("target").alias("path")).distinct().join(steps.where("target is not null").select("workflow", "path").distinct(), ["workflow", "path"], "left_anti")
    terminal = top_k(ends, ["workflow"], [F.col("path").asc()], 8).groupBy("workflow").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("terminal"))
    out = sums.join(counts, "workflow").join(terminal, "workflow", "left")
    return out.select("workflow", "scope", "steps", "files", "tests", "modules", (F.col("r") + 2 * F.col("tests")).alias("rank"), F.coalesce("terminal", F.lit("")).alias("terminal"))
