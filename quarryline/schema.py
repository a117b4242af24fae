"""Ordinal tables of evidence and edges, and expressions on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidences, best first.
CONFIDENCE = ("authoritative", "derived", "heuristic")
TIERS = (*CONFIDENCE, "fallback")
#: Edge kinds in the order in which edges are shown; the same number means the same place.
EDGE_ORDER = {
    "DEFINES": 0, "ROUTE": 1, "JOB": 1, "ROUTE_HANDLES": 1, "UI_CALLS_ENDPOINT": 2, "TEST_COVERS_WORKFLOW": 2, "ROUTE_CALLS_STORE": 3,
    "STORE_DISPATCHES_ADAPTER": 3, "ADAPTER_REFERENCED_BY_MANIFEST": 3, "CALLS": 4, "REFERENCES": 5, "IMPORTS": 6, "TESTS": 7, "EXTENDS": 8,
    "IMPLEMENTS": 8, "EXPORTS": 9, "TYPE_EXPORTS": 9, "RISK": 10,
}
#: Edge kinds that callers, callees, impact and paths follow.
CALLER_KINDS = "CALLS REFERENCES IMPORTS TESTS UI_CALLS_ENDPOINT TEST_COVERS_WORKFLOW IMPLEMENTS EXTENDS ADAPTER_REFERENCED_BY_MANIFEST".split()
CALLEE_KINDS = [k for k in EDGE_ORDER if k != "DEFINES"]
IMPACT_KINDS = (
    "CALLS REFERENCES IMPORTS TESTS ROUTE_HANDLES ROUTE_CALLS_STORE STORE_DISPATCHES_ADAPTER ADAPTER_REFERENCED_BY_MANIFEST UI_CALLS_ENDPOINT"
    " TEST_COVERS_WORKFLOW IMPLEMENTS EXTENDS"
).split()
PATH_KINDS = [k for k in EDGE_ORDER if k != "RISK"]
REVERSIBLE_KINDS = ("DEFINES", "IMPORTS", "ROUTE_HANDLES")
#: Weight of an edge kind in functional neighbourhoods, and of its confidence.
FUNCTIONAL_WEIGHT = {
    "ROUTE_HANDLES": 5, "UI_CALLS_ENDPOINT": 5, "TEST_COVERS_WORKFLOW": 5, "ROUTE_CALLS_STORE": 4, "STORE_DISPATCHES_ADAPTER": 4,
    "ADAPTER_REFERENCED_BY_MANIFEST": 4, "CALLS": 3, "REFERENCES": 3, "IMPLEMENTS": 2, "EXTENDS": 2, "IMPORTS": 2,
}
CONFIDENCE_WEIGHT = {"authoritative": 1.5, "derived": 1.2}
#: Weight of each lane when rankings are fused.
LANE_WEIGHT = {"exact": 4.0, "symbol": 3.2, "bm25": 2.0, "semantic": 2.6, "graph": 0.65, "workflow": 2.8, "test": 2.5, "dirty": 1.7}


def lookup(key: Column, table: dict, default: object) -> Column:
    """The table's value of a key, as an expression."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key], F.lit(default))


def ordinal(confidence: Column) -> Column:
    """0 for the best confidence; unknown and null ones count as heuristic."""
    return lookup(confidence, {c: i for i, c in enumerate(CONFIDENCE)}, 2)


def confidence_of(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), number + 1)


def weakest(a: Column, b: Column) -> Column:
    """The confidence of something that rests on both."""
    x, y = ordinal(a), ordinal(b)
    best = (x == 0) & (y == 0)
    return F.when(best, F.lit("authoritative")).when((x == 2) | (y == 2), F.lit("heuristic")).otherwise(F.lit("derived"))


def edge_order() -> list[Column]:
    """Columns by which edges (edge_kind, confidence, weight, from_path, to_path, edge_id) are shown."""
    return [
        lookup(F.col("edge_kind"), EDGE_ORDER, 11).asc(), ordinal(F.col("confidence")).asc(), F.coalesce("weight", F.lit(0.0)).desc(),
        F.coalesce("from_path", F.lit("")).asc(), F.coalesce("to_path", F.lit("")).asc(), F.col("edge_id").asc(),
    ]
