"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import math
import random
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import cut

#: Documents of a source that one leaf of the tree rounds, and residuals that one inner node does.
LEAF, FAN = 20_000, 64
#: More targets than this are not a mixing plan but a table; they would have to be joined, not planned on the driver.
MOST_TARGETS = 10_000

ROUNDED = "source string, node bigint, doc_id bigint, n_tokens bigint, p double"


def settle(p: float, eps: float = 1e-12) -> float:
    return 0.0 if p < eps else 1.0 if p > 1 - eps else p


def pivotal(sizes: list[int], p: list[float], rng: random.Random) -> list[float]:
    """Round all but at most one of the probabilities to 0 or 1, keeping each one's mean and the expected size.

    Two open items are paired: as much expected size as one can take or give is moved from one to the other, in
    a direction chosen so that both keep their means; one of them becomes integral, the other meets the next. Items
    meet in the order given; with the largest first, large ones trade with large ones, and the one that stays open
    is small.
    """
    out, open_at = list(p), -1
    for j in range(len(out)):
        out[j] = settle(out[j])
        if out[j] in (0.0, 1.0):
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        up = min((1 - out[i]) * sizes[i], out[j] * sizes[j])
        down = min(out[i] * sizes[i], (1 - out[j]) * sizes[j])
        move = up if rng.random() * (up + down) < down else -down
        out[i], out[j] = settle(out[i] + move / sizes[i]), settle(out[j] - move / sizes[j])
        open_at = i if 0 < out[i] < 1 else j if 0 < out[j] < 1 else -1
    return out


def pivotal_chain(sizes: list[int], p: float, rng: random.Random) -> list[float]:
    """Round items of one probability, largest first, each paired with all that follow it as one bundle.

    A bundle is an item of the size of its members, which share its probability; a pairing is as in ``pivotal``. If
    the item becomes integral, the next one meets the rest of the bundle; if the bundle does, all its members are
    settled and the item stays open. At most one is open in the end, the last one unless an item was too large for
    all after it together. Means and the expected size are kept.
    """
    out, rest = [], sum(sizes)
    for at, size in enumerate(sizes):
        p, rest = settle(p), rest - size
        if p in (0.0, 1.0) or rest <= 0:
            return out + [p] * (len(sizes) - at)
        up, down = min((1 - p) * size, p * rest), min(p * size, (1 - p) * rest)
        move = up if rng.random() * (up + down) < down else -down
        out.append(settle(p + move / size))
        p -= move / rest
    return out


def plan_mix(sizes: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Copies per document (a real number up to max_repeats) of each source.

    ``sizes``: (documents, tokens) by source; ``targets``: (share, max_repeats) by source. The total is the largest
    at which no source needs more than its repeats, or ``total`` where that is smaller. Sources without tokens or
    share take no part, and the shares of the others are scaled to sum to 1.
    """
    live = {s: t for s, t in targets.items() if t[0] > 0 and t[1] > 0 and sizes.get(s, (0, 0))[1] > 0}
    scale = sum(t[0] for t in live.values())
    reach = [t[1] * sizes[s][1] * scale / t[0] for s, t in live.items()]
    size = min([*reach, *([total] if total is not None else [])], default=0.0)
    return {s: min(float(t[1]), t[0] / scale * size / sizes[s][1]) for s, t in live.items()}


def mix_sources(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each document occurs in the mix; those with 0 copies left out.

    ``docs`` has (doc_id, source, n_tokens), ``targets`` (source, target_share, max_repeats). A document delivered
    repeatedly counts once (with its greatest size and source). Documents without tokens, of no source or of a
    source without target are not in the mix. Each document gets the whole part of its source's copies; the
    fractional parts are rounded by pairs: in leaves of about LEAF documents, largest first, each with all smaller ones
    as a bundle; at most one residual per leaf, its smallest document unless one outweighs all others, goes up a tree
    of fan-out FAN, and the last one of a source is rounded by chance. Every document keeps its mean, and a source is
    off its target by less than its last open document. The outcome depends on ``seed`` and the documents only, not
    on partitions.
    """
    plan_rows = targets.where("source is not null").groupBy("source").agg(
        F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")
    ).limit(MOST_TARGETS + 1).collect()
    if len(plan_rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} mixing targets")
    wanted = {r["source"]: (float(r["share"] or 0), int(r["repeats"] or 0)) for r in plan_rows}
    once = docs.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("d")).select("doc_id", "d.*")
    once = cut(once.where("doc_id is not null and n_tokens > 0").where(F.col("source").isin(*wanted) if wanted else F.lit(False)))
    sums = {r["source"]: r for r in once.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}
    copies = plan_mix({s: (r["docs"], r["tokens"]) for s, r in sums.items()}, wanted, total)
    shape = [(s, float(math.floor(c + 1e-9)), max(0.0, c - math.floor(c + 1e-9)), math.ceil(sums[s]["docs"] / LEAF)) for s, c in copies.items()]
    schema = "source string, whole double, part double, leaves bigint"
    plan = F.broadcast(docs.sparkSession.createDataFrame(shape, schema))  # at most MOST_TARGETS rows
    placed = once.join(plan, "source").withColumn("n_tokens", F.col("n_tokens").cast("bigint"))
    # a leaf holds documents of all sizes, so that its largest ones trade with many small ones before they are left over
    node = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("leaves"))
    state = placed.select("source", node.alias("node"), "doc_id", "n_tokens", F.col("part").alias("p"))

    def round_at(level: int):  # noqa: ANN202
        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["n_tokens", "doc_id"], ascending=[False, True]).reset_index(drop=True)
            rng = random.Random(f"{seed}/{level}/{key[0]}/{key[1]}")
            sizes, p = part["n_tokens"].tolist(), part["p"].tolist()
            # the documents of a leaf begin with one probability
            part["p"] = pivotal(sizes, p, rng) if level else pivotal_chain(sizes, p[0], rng)
            return part[["source", "node", "doc_id", "n_tokens", "p"]]

        return run

    state = cut(state.groupBy("source", "node").applyInPandas(round_at(0), ROUNDED))
    most = max((math.ceil(r["docs"] / LEAF) for r in sums.values()), default=1)  # nodes of a source at most
    done, width, level = [state.where("p in (0, 1)")], most, 1
    left = state.where("p not in (0, 1)")
    while width > 1:
        width = math.ceil(width / FAN)
        up = left.withColumn("node", F.floor(F.col("node") / FAN))
        state = cut(up.groupBy("source", "node").applyInPandas(round_at(level), ROUNDED))
        done.append(state.where("p in (0, 1)"))
        left, level = state.where("p not in (0, 1)"), level + 1
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2**30)) / 2**30
    done.append(left.withColumn("p", (chance < F.col("p")).cast("double")))
    rounded = reduce(DataFrame.unionByName, done).join(plan.select("source", "whole"), "source")
    out = rounded.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("p")).cast("int").alias("copies"))
    return out.where("copies > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, copies, tokens, actual_share, most_copies) of every target."""
    got = mix.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("copies").alias("copies"),
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"),
    )
    whole = got.agg(F.sum("tokens").alias("_all"))  # one row
    rows = targets.join(got, "source", "left").crossJoin(F.broadcast(whole))
    return rows.select(
        "source", "target_share", "max_repeats",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "copies", "tokens")),
        F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
