"""Toxicity by weak supervision.

Voters are words (a mined lexicon) and word beginnings (patterns) found in labelled training
rows. A generative label model knows only their votes: expectation maximisation estimates the
class balance and each voter's firing rate in either class, and excess agreement of two voters
inside a class (their correlation) shrinks the weight of both. The posterior labels train a
linear classifier over the hashed features that are voters, whose scale the training labels
set; it scores every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from opalgrid.llm.common import column_bytes, column_of, hash_sample, stash, tune

#: Most labelled rows to learn from, those with the smallest hashes of their identifier.
TRAIN_ROWS = 12_000
#: Features are hashes this wide: 32-bit numbers, so that words of a large corpus hardly meet.
BUCKETS = (1 << 31) - 1
STRIP = b".,;:!?\"'()[]{}<>*#$%&|-_"
PREFIXES = (4, 5, 6)
#: Correlation inside a class from which two voters count as dependent.
SAME_VOICE = 0.5
_NONE: tuple = ()


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(name: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_features(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and its beginnings, after folding ASCII case and stripping marks."""
    w = word.lower().strip(STRIP)
    if not w:
        return _NONE
    keys = [b"w" + w, *(b"p" + w[:k] for k in PREFIXES if len(w) > k)]
    return tuple(xxhash.xxh3_64_intdigest(k) % BUCKETS for k in keys)


class Features(dict):
    """word -> its buckets among ``wanted`` (all if None); bounded."""

    limit = 200_000

    def __init__(self, wanted: frozenset[int] | None = None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = word_features(word)
        if self.wanted is not None:
            found = tuple(f for f in found if f in self.wanted) or _NONE
        self[word] = found
        return found

    def of(self, text: bytes) -> set[int]:
        out: set[int] = set()
        for f in map(self.__getitem__, set(text.split())):
            if f:
                out.update(f)
        return out


class Model(NamedTuple):
    bias: float
    weights: dict[int, float]


#: Voters: how many at most, in how many toxic rows at least, and how many times likelier there than in others.
MOST_VOTERS, LEAST_ROWS, PURITY = 400, 3, 20.0


def voters(rows: DataFrame, most: int = MOST_VOTERS, least: int = LEAST_ROWS, purity: float = PURITY) -> list[int]:
    """Buckets far likelier in toxic rows than in the others: the ``most`` of best evidence among those in
    ``least`` toxic rows, however many rows there are. ``rows``: found (array of buckets), toxic. Counts
    are aggregates; at most ``most`` buckets leave the executors."""
    n = rows.agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("n")).first()
    counts = rows.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(F.count_if("toxic").alias("pos"), F.count_if(~F.col("toxic")).alias("neg"))
    ratio = ((F.col("pos") + 0.5) / (max(1, n.p) + 1)) / ((F.col("neg") + 0.5) / (max(1, n.n) + 1))
    best = counts.withColumn("ratio", ratio).where((F.col("pos") >= least) & (F.col("ratio") >= purity))
    return [r.f for r in best.orderBy(F.desc(F.round(F.col("pos") * F.ln("ratio"), 9)), "f").limit(most).collect()]


def label_model(votes: np.ndarray, prior: float, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, accuracy of each voter, and its weight after correlation. ``votes``:
    bool, rows by voters. Two classes, firing rates by class, from votes alone. A voter that does
    not fire abstains: the words of one language say nothing by being absent from another. That
    a voter fires alone, backed by no other, is one observation of the row."""
    v = votes.astype(float)
    voices, weight, balance = v.sum(axis=1), np.ones(v.shape[1]), float(np.clip(prior, 1e-3, 0.5))
    q = np.where(voices >= 2, 0.9, np.where(voices == 1, 0.3, 0.01)) if len(v) else np.zeros(0)
    a = b = np.full(v.shape[1], 0.5)
    alone, heard = (voices == 1).astype(float), (voices >= 1).astype(float)
    for step in range(steps):
        s, r = q.sum(), (1 - q).sum()
        a = np.clip((q @ v + 0.1) / (s + 1), 1e-4, 0.999)
        b = np.clip(((1 - q) @ v + 0.02) / (r + 1), 1e-5, 0.999)
        if step == steps // 2:  # voters that agree far beyond chance inside the toxic class share one voice
            c = (v * q[:, None]).T @ v / max(s, 1e-9) - np.outer(a, a)
            d = np.sqrt(np.clip(np.diag(c), 1e-9, None))
            r2 = np.clip(c / np.outer(d, d), 0, 1)
            weight = 1 / np.where(r2 >= SAME_VOICE, r2, 0).sum(axis=1).clip(1)
        lone = np.log((q @ alone + 0.1) / (q @ heard + 0.2)) - np.log(((1 - q) @ alone + 0.1) / ((1 - q) @ heard + 0.2))
        logit = np.log(balance / (1 - balance)) + v @ (weight * np.log(a / b)) + alone * min(lone, 0.0)
        q = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    return q, a * balance / np.maximum(a * balance + b * (1 - balance), 1e-12), weight


def linear(rows: list[np.ndarray], target: np.ndarray, wanted: np.ndarray, epochs: int = 400, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Logistic regression on posterior labels over the wanted buckets (full-batch, Adam)."""
    column = {int(f): i for i, f in enumerate(wanted)}
    at = [(i, column[f]) for i, r in enumerate(rows) for f in r.tolist() if f in column]
    i, j = (np.array(x, np.int64) for x in zip(*at, strict=True)) if at else (np.empty(0, np.int64),) * 2
    w, bias = np.zeros(len(wanted)), 0.0
    m, s, lr = np.zeros(len(wanted) + 1), np.zeros(len(wanted) + 1), 0.1 * rate
    balance = np.where(target > 0.5, 0.5 / max(1e-9, (target > 0.5).sum()), 0.5 / max(1e-9, (target <= 0.5).sum()))
    for t in range(1, epochs + 1):
        z = bias + np.bincount(i, w[j], len(rows))
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * balance
        g = np.append(np.bincount(j, e[i], len(wanted)) + decay * w, e.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        move = lr * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(float(bias), {int(f): float(x) for f, x in zip(wanted, w, strict=True)})


def calibrated(model: Model, rows: list[np.ndarray], y: np.ndarray, steps: int = 50) -> Model:
    """The same order of scores, with slope and bias of the training labels (Platt's smoothed targets)."""
    z = np.array([model.bias + sum(model.weights.get(f, 0.0) for f in r.tolist()) for r in rows])
    pos, neg = y.sum(), (~y).sum()
    target = np.where(y, (pos + 1) / (pos + 2), 1 / (neg + 2))
    t, x = np.array([1.0, 0.0]), np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -50, 50)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        t = t - np.clip(np.linalg.solve(h, x.T @ (p - target)), -5, 5)
    if not np.isfinite(t).all() or t[0] <= 0:
        return model
    return Model(float(model.bias * t[0] + t[1]), {f: w * float(t[0]) for f, w in model.weights.items()})


def fit(rows: list[np.ndarray], y: np.ndarray, wanted: np.ndarray) -> Model:
    """``rows``: the voters that fire in each training row."""
    if not len(rows) or not y.any() or not len(wanted):
        return Model(-5.0, {})
    column = {int(f): i for i, f in enumerate(wanted)}
    votes = np.zeros((len(rows), len(wanted)), bool)
    for k, r in enumerate(rows):
        votes[k, [column[f] for f in r.tolist()]] = True
    posterior, _, _ = label_model(votes, float(y.mean()))
    return calibrated(linear(rows, posterior, wanted), rows, y)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic, found: features of a bounded sample of labelled rows that are not held out, one row
    for each identifier (of several texts the one of the smallest hash), written to the shared
    folder. The sample is drawn from the labels alone (two columns), so one filtered pass reads its texts."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out_column()).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    sample = hash_sample(known, "doc_id", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [sorted(features.of(t)) for t in column_bytes(column_of(batch, "text"))]
            if found:
                yield pa.RecordBatch.from_arrays([column_of(batch, c) for c in ("doc_id", "text_key", "toxic")] + [pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "text_key", "toxic", "found"])

    # at most ``most`` rows of two values: a bound on what is broadcast
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text_key", "toxic", "text")
    got = joined.mapInArrow(run, "doc_id long, text_key long, toxic boolean, found array<int>")
    one = got.groupBy("doc_id").agg(F.min(F.struct("text_key", "toxic", "found")).alias("r"))
    return stash(one.select("doc_id", "r.toxic", "r.found"))


def learnt(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """The model of a bounded sample. The driver gets the voters that fire in each row: at most ``most``
    rows of ``MOST_VOTERS`` numbers."""
    rows = training_rows(docs, labels, most)
    wanted = voters(rows)
    fired = F.filter("found", lambda f: f.isin(wanted)) if wanted else F.slice("found", 1, 0)
    got = sorted((r.doc_id, r.toxic, r.fired) for r in rows.select("doc_id", "toxic", fired.alias("fired")).toLocalIterator())
    return fit([np.array(f, np.int64) for _, _, f in got], np.array([t for _, t, _ in got], bool), np.array(wanted, np.int64))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every row; null texts count as empty.

    Only words of the text enter a score. Rows that repeat get equal scores; a null doc_id is
    scored and not held out. Without toxic training rows every score is small. An empty table
    gives an empty result.
    """
    tune(docs.sparkSession)
    model = learnt(docs, labels, train_rows)
    weights = {f: w for f, w in model.weights.items() if w}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(frozenset(weights))
        for batch in batches:
            z = np.array([model.bias + sum(weights[f] for f in sorted(features.of(t))) for t in column_bytes(column_of(batch, "text"))])
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            ids = column_of(batch, "doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
