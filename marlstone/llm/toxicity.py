"""Toxicity by cumulative-link ordinal regression over hashed words and word beginnings.

P(grade <= k) is the logistic function of a threshold less one score, which
all thresholds share; an L1 penalty leaves few words with a weight, and none is
negative, so that no clean text around a telling word hides it. The result is the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, labelled_sample, table, texts_of

#: Feature slots; words and beginnings share them.
SLOTS = 1 << 18
#: Bytes of a word's beginnings that make features of their own, so that a word's other endings are known too.
STEMS = (4, 5, 6, 7, 8)
#: At most so many labelled documents of each class train the model.
SAMPLE_ROWS = 4_000
#: Grades of severity above none.
GRADES = 3
L1, STEPS, RATE = 0.0003, 250, 0.05
#: A grade counts as reached at this probability unless the training rows choose another: less than half, as some toxic documents hold few telling words.
CUT = 0.25
#: Cuts that the training rows choose among, how many missed toxic shares a flagged clean share weighs as much as, and the most clean ones that may be flagged.
CUTS, CLEAN_COST, CLEAN_SHARE = np.round(np.arange(0.05, 0.51, 0.01), 2), 2.0, 0.02
#: With fewer training rows of either class the cut stays at CUT.
LEAST_ROWS = 50
#: Least distance of neighbouring thresholds.
GAP = 1e-4

_digest = xxhash.xxh64_intdigest


def features_of(text: bytes | None) -> np.ndarray:
    """Slots of the different words, A-Z lower-cased, and of their beginnings, each once."""
    words = set(text.lower().split()) if text else set()
    hashes = [_digest(w) for w in words]
    longer = words
    for n in STEMS:
        longer = [w for w in longer if len(w) >= n]
        hashes += [_digest(x, n) for x in {w[:n] for w in longer}]
    return np.unique(np.array(hashes, dtype=np.uint64) % np.uint64(SLOTS)).astype(np.int64)


@dataclass
class Model:
    """One weight for each slot, the ordered thresholds, and the probability at which a grade counts as reached."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = CUT

    def above(self, score: float) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def grades_of(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Severity of each labelled row: 0 if not toxic, else 1 to GRADES by how many of its features mark toxic rows.

    The labels tell toxic from not and nothing of severity, so the order among toxic rows, by
    thirds of that number, is this operator's own; it comes from the features that the model then weighs.
    """
    toxic = np.array([t for _, t in rows]) > 0
    n = [np.zeros(SLOTS), np.zeros(SLOTS)]
    for (x, _), t in zip(rows, toxic):
        n[int(t)][x] += 1
    odds = np.log((n[1] + 0.5) / (toxic.sum() + 1)) - np.log((n[0] + 0.5) / ((~toxic).sum() + 1))
    marks = (odds > np.log(10)) & (n[1] >= 3)
    told = np.array([marks[x].sum() for x, _ in rows])
    cuts = np.quantile(told[toxic], np.arange(1, GRADES) / GRADES) if toxic.any() else np.zeros(GRADES - 1)
    return np.where(toxic, 1 + np.searchsorted(cuts, told, side="left"), 0)


def loss_and_gradient(rows: np.ndarray, slots: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the grades and its gradient by weights and thresholds; (rows, slots) are the features that are present."""
    n, k = len(y), np.arange(len(y))
    score = np.bincount(rows, weights=w[slots], minlength=n)
    below = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -60, 60)))
    cdf = np.concatenate((np.zeros((n, 1)), below, np.ones((n, 1))), axis=1)
    a, b = cdf[k, y + 1], cdf[k, y]
    p = np.maximum(a - b, 1e-12)
    by_weight = np.bincount(slots, weights=((1 - a - b) / n)[rows], minlength=len(w))
    slope = below * (1 - below) / p[:, None] / n
    by_threshold = np.array([slope[y == j + 1, j].sum() - slope[y == j, j].sum() for j in range(len(theta))])
    return float(-np.log(p).mean()), by_weight, by_threshold


def fit_rows(rows: list[tuple[np.ndarray, int]]) -> Model:
    """Proximal gradient steps with Adam's scaling on the mean negative log likelihood plus the L1 penalty."""
    if not rows or not any(t for _, t in rows):
        return Model(np.zeros(SLOTS), np.full(GRADES, 50.0))
    y = grades_of(rows)
    used, flat, n = np.unique(np.concatenate([x for x, _ in rows]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    # Features of under three rows tell nothing and keep a weight of 0.
    kept = n[flat] >= 3
    used, flat, row = used[n >= 3], (np.cumsum(n >= 3) - 1)[flat[kept]], row[kept]
    w, theta = np.zeros(len(used)), np.linspace(1.0, 3.0, GRADES)
    gaps = GAP * np.arange(GRADES)
    state = [np.zeros(len(used) + GRADES), np.zeros(len(used) + GRADES)]
    for step in range(1, STEPS + 1):
        g = np.concatenate(loss_and_gradient(row, flat, y, w, theta)[1:])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        scale = RATE / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-6)
        move = scale * state[0] / (1 - 0.9**step)
        w = w - move[: len(used)]
        w = np.maximum(w - np.minimum(scale[: len(used)], 1e3) * L1, 0)
        theta = np.maximum.accumulate(theta - move[len(used) :] - gaps) + gaps
    weights = np.zeros(SLOTS)
    weights[used] = w
    return Model(weights, theta)


def chosen_cut(rows: list[tuple[np.ndarray, int]]) -> float:
    """The cut that tells toxic from clean best on training rows that the model which scores them has not seen.

    Every second row of each class is scored by a model of the others. Of the cuts that flag at most CLEAN_SHARE of the
    clean rows, the best has the greatest share of toxic rows flagged less CLEAN_COST times that of clean rows; of equal
    ones it is the highest. If every cut flags more, it is the highest of all.
    """
    toxic = np.array([t for _, t in rows], dtype=bool)
    if min(toxic.sum(), (~toxic).sum()) < LEAST_ROWS:
        return CUT
    fold = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic)) % 2
    p = np.zeros(len(rows))
    for k in (0, 1):
        model = fit_rows([r for r, f in zip(rows, fold) if f != k])
        for i in np.flatnonzero(fold == k):
            p[i] = model.above(model.weights[rows[i][0]].sum())[0]
    shares = [((p[toxic] >= c).mean(), (p[~toxic] >= c).mean(), float(c)) for c in CUTS]
    return max(((hit - CLEAN_COST * clean, c) for hit, clean, c in shares if clean <= CLEAN_SHARE), default=(0.0, float(CUTS[-1])))[1]


def fit(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Model:
    """A model of at most ``bound`` labelled documents of each class, with the cut that they choose.

    A document that the labels list twice counts once, one that they give both labels once in each class; a null label does not count.
    Of a doc_id with several texts the least one counts, so that no repeated id makes more rows than the bound.
    """
    bounded_batches(documents.sparkSession)
    rows: list[tuple[np.ndarray, int]] = []
    for toxic in (0, 1):
        sample = labelled_sample(documents.sparkSession, labels, F.col("toxic") == toxic, bound, [])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [features_of(t).astype(np.int32) for t in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "slots"])

        texts = texts_of(documents, sample).groupBy("doc_id").agg(F.min("text").alias("text"))
        own = texts.mapInArrow(each, "doc_id bigint, slots array<int>").toArrow()
        order = np.argsort(own.column(0).to_numpy(), kind="stable")
        slots = own.column(1).combine_chunks()
        rows += [(slots[int(i)].values.to_numpy().astype(np.int64), toxic) for i in order]
    model = fit_rows(rows)
    model.cut = chosen_cut(rows)
    return model


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) for every row's whole text.

    severity is the expected grade, grade the number of thresholds that are
    passed with a probability of the model's cut or more, toxic whether the first is. A null or empty text has no feature and is
    scored like one without a telling word.
    """
    bounded_batches(documents.sparkSession)
    at = np.flatnonzero(model.weights)
    sparse, thresholds, cut = (at, model.weights[at]), model.thresholds, model.cut

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(SLOTS)
        full[sparse[0]] = sparse[1]
        own = Model(full, thresholds, cut)
        for b in batches:
            p = np.array([own.above(full[features_of(t)].sum()) for t in b.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, GRADES)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= cut).sum(axis=1).astype(np.int32)), pa.array(p[:, 0] >= cut)],
                names=["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(each, "doc_id bigint, severity double, p_toxic double, grade int, toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scored(documents, fit(documents, table(spark, sf_dir, "labels")))
