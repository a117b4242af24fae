"""Durable memory: entries folded from events in order, staleness, buckets, outcome boosts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.ranking import top_k

#: Statuses that an active event doesn't undo; evidence kept for an entry; outcome boost at most.
TERMINAL = ("superseded", "rejected", "resolved")
MOST_EVIDENCE, MOST_BOOST = 24, 3.0
TIER_ORDER = {"authoritative": 0, "derived": 1, "heuristic": 2, "fallback": 3}

EVENT = "entry_id string, at timestamp, kind string, summary string, status string, tier string, evidence_id string, files array<string>"
ENTRY = "entry_id string, created_at timestamp, updated_at timestamp, kind string, summary string, status string, tier string, evidence array<string>, files array<string>, revisions bigint"


def fold(entry: dict | None, events: Iterable[dict]) -> dict | None:
    """An entry after more events, in their order: the last summary (the first of a ``viewed`` entry), the best tier,
    all files, the latest evidence, and a terminal status that ``active`` doesn't undo."""
    for e in events:
        if entry is None:
            entry = {"entry_id": e["entry_id"], "created_at": e["at"], "kind": e["kind"], "summary": e["summary"], "status": "active", "tier": "fallback", "evidence": [], "files": [], "revisions": 0}
        status = e["status"] or "active"
        sticky = entry["status"] in TERMINAL and status == "active"
        evidence = [x for x in entry["evidence"] if x != e["evidence_id"]] + ([e["evidence_id"]] if e["evidence_id"] is not None else [])
        tier = e["tier"] if e["tier"] in TIER_ORDER else "fallback"
        files = e["files"] if e["files"] is not None else []
        entry |= {
            "updated_at": e["at"],
            "summary": entry["summary"] if entry["kind"] == "viewed" else e["summary"] if e["summary"] is not None else entry["summary"],
            "status": entry["status"] if sticky else status,
            "tier": min(entry["tier"], tier, key=TIER_ORDER.__getitem__),
            "evidence": evidence[-MOST_EVIDENCE:],
            "files": sorted({*entry["files"], *files}),
            "revisions": entry["revisions"] + 1,
        }
    return entry


def fold_events(events: DataFrame) -> DataFrame:
    """Entries (ENTRY) from events (EVENT), each folded in the order of time and then evidence.

    Built from aggregations that merge before the shuffle, so an entry that a third of all events concern is added
    up in parts: first and last by time, sets of files, and the newest evidence. It equals ``fold`` over the events
    in order, event for event, as the tests check.
    """
    e = events.where("entry_id is not null and at is not null")
    order = F.struct("at", "evidence_id")
    terminal = F.coalesce("status", F.lit("active")).isin(*TERMINAL)
    told = F.coalesce("status", F.lit("active"))
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in TIER_ORDER.items() for x in kv))[F.col("tier")], F.lit(3))
    base = e.groupBy("entry_id").agg(
        F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.min_by("kind", order).alias("kind"), F.min_by("summary", order).alias("first_summary"),
        F.max_by("summary", F.when(F.col("summary").isNotNull(), order)).alias("last_summary"),
        F.max_by(told, order).alias("last_status"), F.max_by(told, F.when(told != "active", order)).alias("loud"), F.max(F.when(~terminal & (told != "active"), order)).alias("other_at"), F.max(F.when(terminal, order)).alias("final_at"),
        F.min(rank).alias("tier_rank"), F.count("*").alias("revisions"),
    )
    final = F.col("final_at").isNotNull() & (F.col("other_at").isNull() | (F.col("final_at") > F.col("other_at")))
    status = F.when(final, F.col("loud")).otherwise(F.col("last_status"))
    seen = e.where("evidence_id is not null").groupBy("entry_id", "evidence_id").agg(F.max("at").alias("at"))
    newest = top_k(seen, ["entry_id"], [F.col("at").desc(), F.col("evidence_id").desc()], MOST_EVIDENCE)
    proof = newest.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence"))
    files = e.select("entry_id", F.explode("files").alias("f")).distinct().groupBy("entry_id").agg(F.array_sort(F.collect_list("f")).alias("files"))
    none = F.array().cast("array<string>")
    tier = F.element_at(F.array(*map(F.lit, TIER_ORDER)), F.col("tier_rank") + 1)
    summary = F.when(F.col("kind") == "viewed", F.col("first_summary")).otherwise(F.coalesce("last_summary", "first_summary"))
    out = base.join(proof, "entry_id", "left").join(files, "entry_id", "left")
    return out.select("entry_id", "created_at", "updated_at", "kind", summary.alias("summary"), status.alias("status"), tier.alias("tier"), F.coalesce("evidence", none).alias("evidence"), F.coalesce("files", none).alias("files"), "revisions")


def mark_stale(entries: DataFrame, dirty: DataFrame, head: str | None = None) -> DataFrame:
    """Entries (with entry_id, status, files, head) with a status: an active one is stale if its commit isn't
    ``head`` or one of its files is dirty (path); a stale one without such a reason is active again."""
    hit = entries.select("entry_id", F.explode("files").alias("path")).join(dirty.select("path").distinct(), "path", "left_semi").select("entry_id").distinct().withColumn("_dirty", F.lit(True))
    moved = (F.col("head") != F.lit(head)) if head is not None and "head" in entries.columns else F.lit(False)
    reason = F.coalesce("_dirty", F.lit(False)) | F.coalesce(moved, F.lit(False))
    status = F.when(reason & (F.col("status") == "active"), "stale").when(~reason & (F.col("status") == "stale"), "active").otherwise(F.col("status"))
    return entries.join(hit, "entry_id", "left").withColumn("status", status).drop("_dirty")


def buckets(entries: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(kind, status, n, newest): how many entries of each kind and status, and the newest."""
    some = entries.where(F.col("kind").isin(kinds)) if kinds else entries
    return some.groupBy("kind", "status").agg(F.count("*").alias("n"), F.max_by("entry_id", F.struct("updated_at", "entry_id")).alias("newest"))


def outcome_boosts(outcomes: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """(keys, boost, outcomes) from (outcome_id, keys, amount): each outcome once, sums of at most MOST_BOOST."""
    once = outcomes.groupBy("outcome_id", *keys).agg(F.max("amount").alias("amount"))
    return once.groupBy(*keys).agg(F.least(F.lit(MOST_BOOST), F.sum("amount")).alias("boost"), F.count("*").alias("outcomes"))


def fold_frame(state: dict | None, events: pd.DataFrame) -> dict | None:
    """As ``fold`` over a frame of events, ordered by time and evidence."""
    rows = events.sort_values(["at", "evidence_id"], na_position="first").to_dict("records")
    return fold(state, ({k: (None if not isinstance(v, (list,)) and not hasattr(v, "__len__") and pd.isna(v) else v) for k, v in r.items()} for r in rows))


def newest_outcomes(outcomes: DataFrame, head: str | None = None, most: int = 30) -> DataFrame:
    """Of outcomes (outcome_id, at, head, ...) the last row of each id, those of the commit only where one is given,
    the newest ``most`` of them."""
    rest = [c for c in outcomes.columns if c not in ("outcome_id", "at")]
    once = outcomes.where("outcome_id is not null").groupBy("outcome_id").agg(F.max(F.struct("at", *rest)).alias("o")).select("outcome_id", "o.*")
    some = once.where(F.col("head") == head) if head is not None else once
    return some.orderBy(F.col("at").desc_nulls_last(), "outcome_id").limit(most)


def compacted(entries: DataFrame) -> DataFrame:
    """What stays of a log when it is rewritten: entries that are neither resolved nor rejected."""
    return entries.where(~F.coalesce("status", F.lit("active")).isin("resolved", "rejected"))


def needs_compaction(events: DataFrame, most_bytes: int = 512 * 1024, most_lines: int = 200) -> bool:
    """Whether a log (line) is longer than ``most_lines`` or ``most_bytes``: one row comes to the driver."""
    n, size = events.agg(F.count("*"), F.sum(F.length("line") + 1)).first()
    return n > most_lines or (size or 0) > most_bytes
