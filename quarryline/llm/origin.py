"""Generated, minified or vendored source files: belief propagation over directory trees and groups of copies.

A factor graph has a node per file, per directory (ancestors included) and per body that several files share; each
has one of LABELS. Files have evidence in bins (``origin_features``), directories in their name, bodies in the
number of repositories that hold them. Factors between a file and its directory, a directory and its parent, and a
body and its copies say how much likelier two labels are together than apart.

The tables behind all of it are fitted to the files at hand by expectation-maximisation: START and the like
hold what is known beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.origin_features import DIRECTORY, FEATURES, LABELS, bins, body_key, head_of
from quarryline.session import cut

N = len(LABELS)
#: What the tables known beforehand weigh in a fit: this part of the data and so many rows; the steps of a fit of
#: files by themselves.
KEEP, FEW, STEPS = 0.5, 200, 30
#: How far messages go among directories: so many edges up, down and across. What lies farther is told through so
#: many factors that it changes no belief by much; the number of jobs doesn't depend on how deep trees are.
ROUNDS, FIT_ROUNDS = 4, 2
#: How likely a body and a copy share a label; copies are the same text below their heads, so this isn't fitted.
COPIES = 0.98
#: No ratio of a factor is under this, so that no single neighbour rules a label out.
LEAST = 0.01

#: Known beforehand: how common the labels are, and the chance of each bin of FEATURES in files of each label.
PRIOR = [0.81, 0.07, 0.03, 0.06, 0.03]
START: dict[str, list[list[float]]] = {
    "alike": [[0.80, 0.14, 0.05, 0.007, 0.002, 0.001], [0.05, 0.03, 0.04, 0.08, 0.15, 0.65], [0.80, 0.10, 0.06, 0.02, 0.01, 0.01], [0.80, 0.14, 0.05, 0.007, 0.002, 0.001], [0.60, 0.10, 0.10, 0.10, 0.05, 0.05]],
    "dense": [[0.985, 0.014, 0.001], [0.95, 0.04, 0.01], [0.01, 0.14, 0.85], [0.985, 0.014, 0.001], [0.60, 0.30, 0.10]],
    "literal": [[0.965, 0.034, 0.001], [0.85, 0.09, 0.06], [0.90, 0.08, 0.02], [0.965, 0.034, 0.001], [0.10, 0.20, 0.70]],
    "names": [[0.002, 0.008, 0.09, 0.90], [0.05, 0.10, 0.25, 0.60], [0.02, 0.08, 0.20, 0.70], [0.002, 0.008, 0.09, 0.90], [0.75, 0.20, 0.04, 0.01]],
    "head": [[0.925, 0.005, 0.01, 0.06], [0.40, 0.55, 0.01, 0.04], [0.85, 0.03, 0.10, 0.02], [0.55, 0.01, 0.40, 0.04], [0.94, 0.03, 0.01, 0.02]],
    "name": [[0.996, 0.001, 0.002, 0.001], [0.75, 0.10, 0.149, 0.001], [0.50, 0.001, 0.001, 0.498], [0.996, 0.001, 0.002, 0.001], [0.99, 0.003, 0.004, 0.003]],
    "inside": [[0.998, 0.001, 0.001], [0.889, 0.11, 0.001], [0.70, 0.001, 0.299], [0.997, 0.001, 0.002], [0.998, 0.001, 0.001]],
}
#: The chance that a directory's own name is none of DIRECTORY or speaks for generated, minified or vendored.
MARKS = ["none", "generated", "minified", "vendored"]
NAMED = [[0.9985, 0.0005, 0.0005, 0.0005], [0.60, 0.39, 0.005, 0.005], [0.65, 0.005, 0.34, 0.005], [0.50, 0.005, 0.005, 0.49], [0.985, 0.005, 0.005, 0.005]]
#: The chance that a body with copies is in 1, 2, 3-4, 5-8, 9-16, 17 or more repositories. Bodies of under SHORT
#: characters are shared by chance (empty files, one-line modules), so that their spread says nothing.
SPREAD = [[0.60, 0.33, 0.04, 0.02, 0.007, 0.003], [0.40, 0.35, 0.12, 0.07, 0.04, 0.02], [0.25, 0.25, 0.20, 0.15, 0.10, 0.05], [0.10, 0.15, 0.20, 0.20, 0.20, 0.15], [0.40, 0.35, 0.12, 0.07, 0.04, 0.02]]
SHORT = 200
#: How common the labels are among bodies with copies.
SHARED = [0.55, 0.10, 0.05, 0.28, 0.02]
#: The part of what a directory of each label holds (files, subdirectories) that has its label for that reason; the
#: rest has labels as common as anywhere. Ordinary directories hold anything, the others are nearly pure.
TOGETHER = {"file": [0.2, 0.8, 0.8, 0.85, 0.8], "dir": [0.3, 0.9, 0.9, 0.95, 0.9]}

#: Texts handled at once, so that a batch of long ones stays small in memory.
AT_ONCE = 512
FEATURED = "file_id long, repo string, dir string, body string, size int, bins array<int>"


@dataclass(frozen=True)
class Model:
    """Log-chances of bins (a row of N per bin) and factors (N by N ratios of joint to separate chances)."""

    prior: np.ndarray
    tables: dict[str, np.ndarray]
    named: np.ndarray
    spread: np.ndarray
    file_dir: np.ndarray
    dir_dir: np.ndarray
    of_dirs: np.ndarray
    of_bodies: np.ndarray


def factor(joint: np.ndarray) -> np.ndarray:
    """The ratio of joint to separate chances."""
    return np.maximum(joint / np.outer(joint.sum(1), joint.sum(0)), LEAST)


def start() -> Model:
    prior = np.array(PRIOR)
    # rows: the directory's label
    joint = {k: prior[:, None] * ((1 - np.array(s))[:, None] * prior + np.diag(s)) for k, s in TOGETHER.items()}
    tables = {k: np.array(t) for k, t in START.items()}
    return Model(prior, tables, np.array(NAMED), np.array(SPREAD), joint["file"].T, joint["dir"], prior, np.array(SHARED))


def _mixed(counts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Rows of chances from expected counts and what was known beforehand."""
    mass = counts.sum(-1, keepdims=True)
    weight = KEEP * mass + FEW
    return (counts + weight * known) / (mass + weight)


def fit_files(kinds: list[tuple[tuple[int, ...], float]], model: Model) -> Model:
    """Tables and prior from how often each combination of bins occurs, without the graph."""
    if not kinds:
        return model
    codes, weight = np.array([k for k, _ in kinds]), np.array([w for _, w in kinds], float)
    for _ in range(STEPS):
        logs = np.log(model.prior) + sum(_looked_up(model.tables[f], codes[:, i]) for i, f in enumerate(FEATURES))
        share = np.exp(logs - logs.max(1, keepdims=True))
        model = refit_files(codes, weight[:, None] * share / share.sum(1, keepdims=True), model)
    return model


def _looked_up(table: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.where(code[:, None] >= 0, np.log(table.T)[np.maximum(code, 0)], 0.0)


def refit_files(codes: np.ndarray, share: np.ndarray, model: Model) -> Model:
    """Tables and prior from the expected number of files per combination of bins and label."""
    tables = {}
    for i, f in enumerate(FEATURES):
        counts = np.zeros((N, len(FEATURES[f])))
        known = codes[:, i] >= 0
        np.add.at(counts.T, codes[known, i], share[known])
        tables[f] = _mixed(counts, np.array(START[f]))
    return replace(model, prior=_mixed(share.sum(0), np.array(PRIOR)), tables=tables)


# --- beliefs as N columns, in SQL: whole plans are built from these, and columns made one by one take longer ----


def names(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(N)]


def plus(*beliefs: list[str]) -> list[str]:
    return ["(" + " + ".join(c) + ")" for c in zip(*beliefs, strict=True)]


def minus(a: list[str], b: list[str]) -> list[str]:
    return [f"({x} - {y})" for x, y in zip(a, b, strict=True)]


def or_nothing(belief: list[str]) -> list[str]:
    """A belief in which nulls count as nothing known."""
    return [f"coalesce({b}, 0D)" for b in belief]


def known(values: np.ndarray) -> list[str]:
    return [f"{float(x)!r}D" for x in np.log(values)]


def looked_up(code: str, table: np.ndarray) -> list[str]:
    """The log-chances of a bin; of -1 and null nothing."""
    return [f"coalesce(get(array({', '.join(known(row))}), {code}), 0D)" for row in table]


def named(belief: list[str], prefix: str) -> list[str]:
    return [f"{b} AS {n}" for b, n in zip(belief, names(prefix), strict=True)]


def sums(prefix: str, to: str) -> list[Column]:
    """The aggregates that add up beliefs."""
    return [F.sum(a).alias(b) for a, b in zip(names(prefix), names(to), strict=True)]


def weights(rows: DataFrame, belief: list[str], prefix: str) -> DataFrame:
    """``rows`` with the chances that a log-belief stands for, in proportion, as columns of their own, so that each
    is worked out once whatever refers to it."""
    on = rows.selectExpr("*", *named(belief, "_b")).selectExpr("*", f"greatest({', '.join(names('_b'))}) AS _top")
    return on.selectExpr("*", *named([f"exp({b} - _top)" for b in names("_b")], prefix)).drop(*names("_b"), "_top")


def tell(rows: DataFrame, belief: list[str], ratios: np.ndarray, prefix: str) -> DataFrame:
    """``rows`` with what a node of this log-belief tells a neighbour over a factor (rows: the node's label)."""
    out = [f"ln({' + '.join(f'{w} * {float(ratios[a][b])!r}D' for a, w in enumerate(names('_w')))})" for b in range(N)]
    return weights(rows, belief, "_w").selectExpr("*", *named(out, prefix)).drop(*names("_w"))


def chances(rows: DataFrame, belief: list[str], prefix: str) -> DataFrame:
    """``rows`` with the chance of each label."""
    on = weights(rows, belief, "_w").selectExpr("*", f"{' + '.join(names('_w'))} AS _all")
    return on.selectExpr("*", *named([f"{w} / _all" for w in names("_w")], prefix)).drop(*names("_w"), "_all")


def pair_sums(rows: DataFrame, a: list[str], b: list[str], ratios: np.ndarray) -> DataFrame:
    """The expected number of pairs of labels over a factor whose ends believe ``a`` and ``b`` without each other."""
    on = weights(weights(rows, a, "_x"), b, "_y").select(*names("_x"), *names("_y"))
    cells = {f"x{i}{j}": f"_x{i} * _y{j} * {float(ratios[i][j])!r}D" for i in range(N) for j in range(N)}
    on = on.selectExpr("*", f"{' + '.join(cells.values())} AS _all")
    return on.selectExpr(*(f"sum({c} / _all) AS {n}" for n, c in cells.items()))


def _joint(row: object, start_: np.ndarray) -> np.ndarray:
    got = np.array([[(row[f"x{i}{j}"] or 0.0) for j in range(N)] for i in range(N)])  # type: ignore[index]
    return _mixed(got.reshape(-1), start_.reshape(-1)).reshape(N, N)


# --- the graph ------------------------------------------------------------------------------------------------


def file_features(files: DataFrame) -> DataFrame:
    """FEATURED: each file with text, once; texts are read here only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            rows = []
            for i, repo, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                clean = (path or "").replace("\\", "/").removeprefix("./")
                head = head_of(text)
                rows.append((i, repo or "", "/".join(clean.split("/")[:-1]), *body_key(text, head), bins(clean, text, head)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file_id", "repo", "dir", "body", "size", "bins"])

    texts = files.where("file_id is not null and source_text is not null").select(F.col("file_id").cast("long"), "repo", "file_path", "source_text")
    seen = texts.mapInArrow(run, FEATURED)
    return seen.groupBy("file_id").agg(F.max(F.struct("repo", "dir", "body", "size", "bins")).alias("f")).select("file_id", "f.*")


def bodies_of(files: DataFrame) -> DataFrame:
    """(body, spread): the bodies that several files share, with the bin of SPREAD (-1: too short to tell)."""
    per_repo = files.groupBy("body", "repo").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    shared = per_repo.groupBy("body").agg(F.sum("n").alias("n"), F.count("*").alias("repos"), F.max("size").alias("size")).where("n > 1")
    bin_ = F.least(F.ceil(F.log2("repos")), F.lit(len(SPREAD[0]) - 1)).cast("int")
    return shared.select("body", F.when(F.col("size") < SHORT, -1).otherwise(bin_).alias("spread"))


def directories_of(files: DataFrame) -> DataFrame:
    """(repo, dir, parent, mark): every directory that holds files, and all above it. The root's parent is null."""
    held = files.select("repo", "dir").distinct()
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    every = held.select("repo", F.explode(F.array_union(above, F.array("dir"))).alias("dir")).distinct()
    last = F.lower(F.element_at(F.split("dir", "/"), -1))
    mark = F.lit(0)
    for label in MARKS[1:]:
        mark = F.when(last.isin(*[n for n, of in DIRECTORY.items() if of == label]), MARKS.index(label)).otherwise(mark)
    # the string up to the last slash; a directory at the top is in the root, which has the empty path
    up = F.when(F.col("dir") == "", None).when(F.instr("dir", "/") == 0, "").otherwise(F.regexp_replace("dir", "/[^/]*$", ""))
    return every.select("repo", "dir", up.alias("parent"), mark.alias("mark"))


def _own(model: Model) -> list[str]:
    """What a file's bins say, its prior included."""
    return plus(known(model.prior), *(looked_up(f"get(bins, {i})", model.tables[f]) for i, f in enumerate(FEATURES)))


SAME = COPIES * np.eye(N) + (1 - COPIES) / (N - 1) * (1 - np.eye(N))


def _with_copies(files: DataFrame, model: Model, told: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files with ``c``, what the copies of their body tell them by way of the body (nothing for lone files), and
    (spread, h) of each body. ``told`` is a file's belief without its copies."""
    # a label's chance is part of each file's belief; the body has it once
    ratios = SAME / model.prior
    alone = files.where("spread is null").selectExpr("*", *named(["0D"] * N, "c"))
    said = tell(files.where("spread is not null"), told, ratios.T, "s")
    full = said.groupBy("body").agg(F.first("spread").alias("spread"), *sums("s", "h"))
    full = full.selectExpr("body", "spread", *named(plus(known(model.of_bodies), looked_up("spread", model.spread), names("h")), "h"))
    copies = said.join(full.drop("spread"), "body")
    back = tell(copies, minus(names("h"), names("s")), ratios, "c").select(*files.columns, *names("c"))
    return back.unionByName(alone), full


def _from_below(state: DataFrame) -> DataFrame:
    """(repo, dir, b): the sum of what each directory's subdirectories tell it."""
    return state.where("parent is not null").groupBy("repo", F.col("parent").alias("dir")).agg(*sums("w", "b"))


def _flood(dirs: DataFrame, model: Model, rounds: int) -> DataFrame:
    """(repo, dir, parent, mark, d, f, q) after so many rounds in which all directories speak at once: the belief d
    of each directory, f without its parent, and the belief q of its parent without it."""
    ratios, e, f = factor(model.dir_dir), names("e"), named(plus(names("e"), or_nothing(names("b"))), "f")
    state = dirs.selectExpr("*", *(x for p in "wvq" for x in named(["0D"] * N, p)))
    for _ in range(rounds):
        heard = state.join(_from_below(state), ["repo", "dir"], "left").selectExpr(*dirs.columns, *names("v"), *names("w"), *f)
        above = heard.selectExpr("repo", "dir AS parent", *named(plus(names("f"), names("v")), "p"))
        joined = heard.join(above, ["repo", "parent"], "left").selectExpr(*dirs.columns, *names("f"), *named(minus(names("p"), names("w")), "q"))
        spoken = tell(tell(joined, names("f"), ratios.T, "w"), names("q"), ratios, "v")
        state = cut(spoken.selectExpr(*dirs.columns, *names("q"), *names("w"), *named(or_nothing(names("v")), "v")))
    full = state.join(_from_below(state), ["repo", "dir"], "left").selectExpr("repo", "dir", "parent", "mark", *names("q"), *names("v"), *f)
    return full.selectExpr("repo", "dir", "parent", "mark", *names("q"), *names("f"), *named(plus(names("f"), names("v")), "d"))


def propagate(files: DataFrame, dirs: DataFrame, model: Model, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run of messages: files (u own, z with their copies, y their directory without them, t of the tree, c of
    the copies that know their trees), directories (d, f, q as _flood gives them) and bodies (h)."""
    ratios = factor(model.file_dir)
    first, _ = _with_copies(files.selectExpr("*", *named(_own(model), "u")), model, names("u"))
    said = cut(tell(first.selectExpr(*files.columns, *names("u"), *named(plus(names("u"), names("c")), "z")), names("z"), ratios, "m"))
    there = dirs.join(said.groupBy("repo", "dir").agg(*sums("m", "k")), ["repo", "dir"], "left")
    spoken = plus(known(model.of_dirs), looked_up("mark", model.named), or_nothing(names("k")))
    tree = cut(_flood(cut(there.selectExpr("repo", "dir", "parent", "mark", *named(spoken, "e"))), model, rounds))
    placed = said.join(tree.select("repo", "dir", *names("d")), ["repo", "dir"])
    heard = placed.selectExpr(*files.columns, *names("u"), *names("z"), *named(minus(names("d"), names("m")), "y"))
    told = cut(tell(heard, names("y"), ratios.T, "t"))
    done, hubs = _with_copies(told, model, plus(names("u"), names("t")))
    return done, tree, hubs


def refit(model: Model, files: DataFrame, tree: DataFrame, hubs: DataFrame) -> Model:
    """All tables anew from the beliefs that one run of messages left; only sums over all data reach the driver:
    a row per combination of bins, per bin of SPREAD and of MARKS, and one per factor."""
    begin = start()
    rows = _by(files, "bins", plus(names("u"), names("t"), names("c")))
    if not rows:
        return model
    new = refit_files(np.array([r[0] for r in rows]), np.array([r[1:] for r in rows]), model)
    # the ends of a factor as believed without each other
    pairs = pair_sums(files, names("z"), names("y"), factor(model.file_dir)).first()
    kin = pair_sums(tree.where("parent is not null"), names("q"), names("f"), factor(model.dir_dir)).first()
    by_mark, by_spread = np.zeros((N, len(MARKS))), np.zeros((N, len(SPREAD[0])))
    for r in _by(tree, "mark", names("d")):
        by_mark[:, r[0]] = r[1:]
    for r in _by(hubs.where("spread >= 0"), "spread", names("h")):
        by_spread[:, r[0]] = r[1:]
    return replace(
        new, file_dir=_joint(pairs, begin.file_dir), dir_dir=_joint(kin, begin.dir_dir), named=_mixed(by_mark, begin.named), spread=_mixed(by_spread, begin.spread),
        of_dirs=_mixed(by_mark.sum(1), begin.of_dirs), of_bodies=_mixed(by_spread.sum(1), begin.of_bodies),
    )


def _by(rows: DataFrame, key: str, belief: list[Column]) -> list[tuple]:
    """The expected number of rows per value of ``key`` and label."""
    return [tuple(r) for r in chances(rows, belief, "g").groupBy(key).agg(*sums("g", "g")).collect()]


def origins(files: DataFrame) -> DataFrame:
    """(file_id, label, probability) of every file with text, one row each.

    ``files`` has (file_id, repo, file_path, source_text). Texts are read once, whole, and never shuffled: what
    marks, repetition, density, literal data and names they have becomes a few bins. The tables are fitted to how
    often combinations of bins occur, then once more from the beliefs of a run over the graph; a second run decides.
    A file's label is the most likely one, ties going to the earlier of LABELS. A directory's name is evidence on
    the directory only: a lone plain file below ``vendor`` may stay handwritten, one among files with foreign
    notices doesn't.

    Rows without id or text are left out; rows delivered repeatedly count once; an empty text has only its path.
    A null repository is one of its own (the one of the empty name). A directory or body that holds a third of all
    files is added up before the shuffle, and is one row where its files meet it.
    """
    once = cut(file_features(files))
    model = fit_files([(tuple(r["bins"]), r["count"]) for r in once.groupBy("bins").count().collect()], start())
    shared = once.join(bodies_of(once), "body", "left").select("file_id", "repo", "dir", "bins", "spread", F.when(F.col("spread").isNotNull(), F.col("body")).alias("body"))
    known_, dirs = cut(shared), cut(directories_of(once))
    model = refit(model, *propagate(known_, dirs, model, FIT_ROUNDS))
    done, _, _ = propagate(known_, dirs, model)
    scored = done.selectExpr("file_id", *named(plus(names("u"), names("t"), names("c")), "f"))
    scored = chances(scored.selectExpr("*", f"greatest({', '.join(names('f'))}) AS best"), names("f"), "g")
    label = " ".join(f"WHEN f{i} = best THEN '{name}'" for i, name in enumerate(LABELS))
    return scored.selectExpr("file_id", f"CASE {label} END AS label", f"greatest({', '.join(names('g'))}) AS probability")
