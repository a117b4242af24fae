"""Subject areas of documents: a classifier chain over terms, source and structure, decoded by beam search."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features; labelled documents that a model is fitted on at most (more are sampled by hash of their id).
WIDTH, MOST_LABELLED = 1 << 17, 3_000
#: A chain over more subjects than this is refused.
MOST_SUBJECTS = 1000
#: The subject that holds only for documents without any other.
ALONE = "software"
BEAM = 6
#: Words of so many letters and more may count by their first letters too, which spans endings and typing errors.
STEM = 5

WORD = re.compile(r"[^\W\d_]{2,}")
CAMEL = re.compile(r"(?<=[a-zà-ÿ0-9])(?=[A-ZÀ-Þ])")


#: The place of no term: its row in a table is zero.
NONE = WIDTH
#: What ends a sentence, among the words of a text.
BREAK = -1


class Vocabulary(dict):
    """Token -> number; per number the places of the words that an identifier is made of and of their first letters."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[int] = []
        self.firsts: list[int] = []
        self.begin: list[int] = [0]

    def __missing__(self, token: str) -> int:
        if token[0] in ".!?:;\n\0":
            self.words.append(BREAK)
            self.firsts.append(NONE)
        else:
            for w in [p for p in CAMEL.split(token) if len(p) > 1] or [token]:
                low = w.lower()
                self.words.append(zlib.crc32(low.encode()) % WIDTH)
                self.firsts.append(zlib.crc32(b"~" + low[:STEM].encode()) % WIDTH if len(low) > STEM else NONE)
        self[token] = number = len(self.begin) - 1
        self.begin.append(len(self.words))
        return number


TOKEN = re.compile(r"[^\W\d_]{2,}|[.!?:;](?=\s)|[\n\0]")
MOST_KNOWN = 400_000
_known = Vocabulary()


class Sentences:
    """Sentences of many texts as sparse rows of terms: words, their first letters, and pairs of neighbours.

    ``at`` holds the terms of all sentences one after the other, ``starts`` where each sentence begins, ``text`` the
    text of each sentence. Identifiers count as the words they are made of. Sentences without words are none.
    """

    def __init__(self, texts: list[str]) -> None:
        global _known
        if len(_known) > MOST_KNOWN:
            _known = Vocabulary()
        tokens = TOKEN.findall("\0".join(t.replace("\0", " ") for t in texts) + "\0")
        ids = np.fromiter(map(_known.__getitem__, tokens), np.int64, len(tokens))
        ends = np.cumsum(ids == _known["\0"]) - (ids == _known["\0"])  # the text of each token
        begin = np.array(_known.begin)
        parts = begin[ids + 1] - begin[ids]
        place = np.repeat(begin[ids] - np.concatenate([[0], np.cumsum(parts)[:-1]]), parts) + np.arange(parts.sum())
        both = np.column_stack([np.array(_known.words)[place], np.array(_known.firsts)[place]])
        owner = np.repeat(ends, parts)
        breaks = both[:, 0] == BREAK
        owner = owner[~breaks]
        number = np.cumsum(breaks)[~breaks]
        both = both[~breaks]
        new = np.concatenate([[True], number[1:] != number[:-1]]) if len(number) else np.zeros(0, bool)
        row = np.cumsum(new) - 1
        owner = owner[new]
        pair = np.full(len(row), NONE)
        if len(row):
            same = row[1:] == row[:-1]
            pair[1:] = np.where(same, (both[:-1, 0] * 1_000_003 + both[1:, 0]) % WIDTH, NONE)
        self.at = np.column_stack([both, pair]).ravel()
        self.row = np.repeat(row, 3)
        self.n, self.text, self.texts = int(new.sum()), owner.astype(np.int64), len(texts)
        self._place()

    def _place(self) -> None:
        self.lengths = np.bincount(self.row, self.at != NONE, self.n).astype(np.int64)
        held = np.bincount(self.row, minlength=self.n)
        self.starts = np.concatenate([[0], np.cumsum(held)[:-1]]).astype(np.int64) if self.n else np.zeros(0, np.int64)

    def times(self, table: np.ndarray) -> np.ndarray:
        """Sums of a table's rows over the terms of each sentence."""
        return np.add.reduceat(table[self.at], self.starts, axis=0) if self.n else np.zeros((0, table.shape[1]))

    def some(self, keep: np.ndarray) -> Sentences:
        """The sentences of some texts (ascending numbers), renumbered."""
        number = np.full(self.texts, -1)
        number[keep] = np.arange(len(keep))
        mine = number[self.text] >= 0
        out = Sentences.__new__(Sentences)
        terms = mine[self.row]
        out.at, out.row = self.at[terms], (np.cumsum(mine) - 1)[self.row[terms]]
        out.n, out.text, out.texts = int(mine.sum()), number[self.text[mine]], len(keep)
        out._place()
        return out

    def back(self, weights: np.ndarray) -> np.ndarray:
        """Sums of sentence weights over the sentences of each term."""
        order = np.argsort(self.at, kind="stable")
        terms, begins = np.unique(self.at[order], return_index=True)
        out = np.zeros((WIDTH + 1, weights.shape[1]), np.float32)
        if len(terms):
            out[terms] = np.add.reduceat(weights[self.row[order]], begins, axis=0)
        out[NONE] = 0
        return out


@dataclass
class Model:
    subjects: list[str]  # in the order of the chain, ALONE last
    lexicon: np.ndarray  # term x subject: log-odds of a term in sentences on a subject against other sentences
    weights: np.ndarray  # features x subjects
    bias: np.ndarray
    links: np.ndarray  # links[k, j]: what subject k adds to the score of a later subject j
    scale: np.ndarray  # calibration: scores are multiplied and shifted before they become probabilities
    shift: np.ndarray


def lexicon_of(rows: Sentences, labels: np.ndarray, rounds: int = 3, least: float = 0.05) -> np.ndarray:
    """Log-odds of terms by subject, from texts with labels, by expectation maximisation.

    Each sentence of a text is on one of its subjects or on none; which, is told by the terms of the round before.
    """
    k = labels.shape[1]
    allowed = np.hstack([labels[rows.text], np.ones((rows.n, 1))])  # the last: on none
    post = (allowed * np.where(np.arange(k + 1) < k, 1.0, 0.25)).astype(np.float32)
    post /= post.sum(1, keepdims=True)
    table = np.zeros((WIDTH + 1, k), np.float32)
    for _ in range(rounds):
        counts = rows.back(post)
        every = counts.sum(1, keepdims=True)
        totals = post.sum(0)
        # how often sentences on a subject have the term, against all others
        inside = (counts[:, :k] + least) / (totals[:k] + 1)
        outside = (every - counts[:, :k] + least) / (totals.sum() - totals[:k] + 1)
        table = np.log(inside / outside).astype(np.float32)
        table[every[:, 0] == 0] = 0
        score = np.hstack([subject_scores(rows, table), np.zeros((rows.n, 1))])
        score = np.where(allowed > 0, score + np.log(np.array([1.0] * k + [0.5])), -np.inf)
        post = np.exp(score - score.max(1, keepdims=True)).astype(np.float32) if rows.n else post
        post /= post.sum(1, keepdims=True)
    return table


def subject_scores(rows: Sentences, table: np.ndarray) -> np.ndarray:
    """Scores of sentences: terms overlap in words, first letters and pairs, so their log-odds are damped by the root
    of their number."""
    return rows.times(table) / np.sqrt(np.maximum(rows.lengths, 1))[:, None]


STEPS = (0.03, 0.08, 0.14, 0.2, 0.27, 0.35, 0.5)
NUMBERS = (0.8, 1.6, 2.4, 3.5, 5)
#: Places for sources (hashed) and sizes (by powers of four) behind the subjects' features.
SOURCES, SIZES = 32, 24


def features(rows: Sentences, sources: list[str | None], sizes: list[int], table: np.ndarray) -> np.ndarray:
    """Per text: of each subject the share and number of its sentences (also in steps), its place among the others and
    its part in the first sentence; the source; the size."""
    n, k = rows.texts, table.shape[1]
    score = np.hstack([subject_scores(rows, table) - 1.0, np.zeros((rows.n, 1))])
    post = np.exp(score - score.max(1, keepdims=True)) if rows.n else score
    post = (post / post.sum(1, keepdims=True))[:, :k] if rows.n else score[:, :k]
    number, first = np.zeros((n, k)), np.zeros((n, k))
    length = np.bincount(rows.text, minlength=n)
    has = np.flatnonzero(length)
    if len(has):
        begins = np.concatenate([[0], np.cumsum(length[has])[:-1]])
        number[has] = np.add.reduceat(post, begins, axis=0)
        first[has] = post[begins]
    share = number / np.maximum(number.sum(1, keepdims=True), 1e-9)
    rank = np.argsort(np.argsort(-number, axis=1, kind="stable"), axis=1, kind="stable")
    parts = [share, np.log1p(number), number / np.maximum(length, 1)[:, None], first, rank == 0, (rank == 1) * share]
    parts += [share > s for s in STEPS] + [number > m for m in NUMBERS]
    origin = np.zeros((n, SOURCES + SIZES))
    origin[np.arange(n), [zlib.crc32(str(s).encode()) % SOURCES for s in sources]] = 0.3
    origin[np.arange(n), [SOURCES + min(SIZES - 1, z.bit_length() // 2) for z in sizes]] = 0.3
    return np.hstack([*parts, origin]).astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.2, decay: float = 2e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regressions of a chain, all at once, by Adam; earlier labels are inputs of later ones."""
    k = y.shape[1]
    upper = np.triu(np.ones((k, k)), 1)
    params = [np.zeros((x.shape[1], k)), np.log((y.mean(0) + 1e-3) / (1 - y.mean(0) + 1e-3)), np.zeros((k, k))]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, b, c = params
        error = (_sigmoid(x @ w + b + y @ (c * upper)) - y) / len(x)
        grads = [x.T @ error + decay * w, error.sum(0), (y.T @ error) * upper + 1e-3 * c]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            now = rate * (0.5 if i else 1) * min(1.0, 2 * (1 - step / (steps + 1)))
            params[i] = params[i] - now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return params[0], params[1], params[2] * upper


FOLDS = 3


def train(texts: list[tuple[str, str | None]], labels: list[set[str]], subjects: list[str]) -> Model:
    """Fit a chain; documents whose labels a model of the others finds all but impossible are left out of the last
    fit; scores are calibrated on documents that the model for them hasn't seen. Under 25 documents can't be held out
    in parts, so all of them are fitted and the scores stay as they are."""
    order = sorted(s for s in subjects if s != ALONE) + [s for s in subjects if s == ALONE]
    y = np.array([[float(s in have) for s in order] for have in labels]).reshape(len(labels), len(order))
    rows = Sentences([t for t, _ in texts])
    sources, sizes = [s for _, s in texts], [len(t) for t, _ in texts]
    if len(texts) < 25 or not order:
        table = lexicon_of(rows, y) if order else np.zeros((WIDTH + 1, 0), np.float32)
        x = features(rows, sources, sizes, table)
        w, b, c = _fit(x, y) if len(texts) else (np.zeros((x.shape[1], len(order))), np.zeros(len(order)), np.zeros((len(order),) * 2))
        return Model(order, table, w, b, c, np.ones(len(order)), np.zeros(len(order)))
    # features of a text come from the terms of other texts, as they do for texts without labels
    fold = np.arange(len(texts)) % FOLDS
    x = np.zeros((len(texts), len(order) * (6 + len(STEPS) + len(NUMBERS)) + SOURCES + SIZES))
    for f in range(FOLDS):
        seen, mine = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        table = lexicon_of(rows.some(seen), y[seen])
        x[mine] = features(rows.some(mine), [sources[i] for i in mine], [sizes[i] for i in mine], table)
    held = np.zeros_like(y)
    for f in range(FOLDS):
        seen, mine = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        w, b, c = _fit(x[seen], y[seen])
        held[mine] = x[mine] @ w + b + y[mine] @ c
    # a wrong hand label: next to nothing speaks for it while another subject is sure
    sure = _sigmoid(held)
    keep = np.flatnonzero(~(((y > 0) & (sure < 0.02)).any(1) & ((y == 0) & (sure > 0.8)).any(1)))
    w, b, c = _fit(x[keep], y[keep])
    scale, shift = np.ones(len(order)), np.zeros(len(order))
    for j in range(len(order)):
        scale[j], shift[j] = _platt(held[keep, j], y[keep, j])
    return Model(order, lexicon_of(rows.some(keep), y[keep]), w, b, c, scale, shift)


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make a score a log-odds, by Newton steps with a prior on no change."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = _sigmoid(a * score + b)
        g = np.array([((p - y) * score).sum() + (a - 1), (p - y).sum() + b])
        q = p * (1 - p)
        h = np.array([[(q * score * score).sum() + 1, (q * score).sum()], [(q * score).sum(), q.sum() + 1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return (float(a), float(b)) if np.isfinite(a) and a > 0 else (1.0, 0.0)


def decode(model: Model, scores: np.ndarray) -> list[tuple[list[str], float]]:
    """For each row of plain scores the likeliest combination of one or two subjects, and its log-probability.

    A beam of partial combinations goes along the chain, for all rows at once. ALONE is open only to combinations
    that are empty, and must be taken by them; none gets more than two. The empty one keeps a place in the beam, as
    it may become ALONE.
    """
    n, k = scores.shape
    if not n or not k:
        return [([], 0.0)] * n
    last = k - 1 if model.subjects[-1] == ALONE else -1
    logp = np.full((n, BEAM + 1), -np.inf)
    logp[:, 0] = 0.0  # place 0 is the empty combination
    have = np.zeros((n, BEAM + 1, k), np.int8)
    for j in range(k):
        s = model.scale[j] * (scores[:, j, None] + have @ model.links[:, j]) + model.shift[j]
        yes, no = logp - np.logaddexp(0, -s), logp - np.logaddexp(0, s)
        size = have.sum(2)
        yes = np.where((size == 0) if j == last else (size < 2), yes, -np.inf)
        taken = have.copy()
        taken[:, :, j] = 1
        if j == last:
            no[:, 0] = -np.inf
        rest, mine = np.concatenate([no[:, 1:], yes], 1), np.concatenate([have[:, 1:], taken], 1)
        best = np.argsort(-rest, axis=1, kind="stable")[:, :BEAM]
        logp = np.concatenate([no[:, :1], np.take_along_axis(rest, best, 1)], 1)
        have = np.concatenate([have[:, :1], np.take_along_axis(mine, best[:, :, None], 1)], 1)
    top = logp[:, 1]
    return [([model.subjects[j] for j in np.flatnonzero(have[i, 1])], float(top[i])) for i in range(n)]


def predict(model: Model, texts: list[str], sources: list[str | None]) -> list[tuple[list[str], float]]:
    """The subjects of each text, with the combination's log-probability."""
    x = features(Sentences(texts), sources, [len(t) for t in texts], model.lexicon)
    return decode(model, x @ model.weights + model.bias)


def judgeable(text: str | None) -> bool:
    """Whether a text has words to judge by."""
    return bool(text) and bool(WORD.search(text))


def fit_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model of the labelled documents, at most ``most`` of them (those with the smallest hashes of their ids).

    Labels compare without case and white space; those that are no subject of ``areas`` are left out, and so are
    documents without words. A document with ALONE and another subject counts for the other only.
    """
    found = areas.where("subject is not null").select("subject").distinct().limit(MOST_SUBJECTS + 1).collect()
    if len(found) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    subjects = sorted({r[0].strip().lower() for r in found})
    per = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set(F.lower(F.trim("subject"))).alias("have"))
    per = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # the documented bound
    texts = documents.join(F.broadcast(per), "doc_id").where("text is not null").dropDuplicates(["doc_id"])
    rows = sorted(texts.select("doc_id", "text", "source", "have").collect(), key=lambda r: r[0])
    kept, sets = [], []
    for r in rows:
        have = {s for s in r["have"] if s in subjects}
        if len(have) > 1:
            have.discard(ALONE)
        if have and judgeable(r["text"]):
            kept.append((r["text"], r["source"]))
            sets.append(have)
    return train(kept, sets, subjects)


def assign_subjects(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, log_probability): one or two rows for each document with words, none for the others.

    ``documents`` has (doc_id, text, source). Null, empty and blank texts and mere symbols have no rows; rows with a
    null id are left out; a document delivered repeatedly counts once. Whole texts are read, none is shuffled;
    only doc_id and subjects are.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # WIDTH x subjects numbers, whatever the corpus

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in parts:
            for at in range(0, len(part), 500):
                some = part.iloc[at : at + 500]
                some = some[[judgeable(t) for t in some["text"]]]
                if not len(some) or not m.subjects:
                    continue
                found = predict(m, list(some["text"]), [s if isinstance(s, str) else None for s in some["source"]])
                yield pd.DataFrame(
                    [(i, s, p) for i, (names, p) in zip(some["doc_id"], found, strict=True) for s in names],
                    columns=["doc_id", "subject", "log_probability"],
                )

    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text", "source")
    out = texts.mapInPandas(run, "doc_id long, subject string, log_probability double")
    return out.groupBy("doc_id", "subject").agg(F.max("log_probability").alias("log_probability"))


def composition(assigned: DataFrame) -> DataFrame:
    """(subject, documents, share): documents by subject; one with two subjects is half of each in the share."""
    each = assigned.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    parts = each.select(F.explode("subjects").alias("subject"), (1.0 / F.size("subjects")).alias("part"))
    sums = parts.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("part").alias("part"))
    total = sums.agg(F.sum("part").alias("_all"))  # one row
    return sums.crossJoin(F.broadcast(total)).select("subject", "documents", (F.col("part") / F.col("_all")).alias("share"))
