"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

With grades 0..K-1, ``P(grade >= j) = sigmoid(w.x - t_j)`` for j = 1..K-1: the weights are shared by
all thresholds, which ascend. ``x`` marks which features of the vocabulary a text holds: words, and
beginnings of words, since a stem takes many endings. A text's length does not matter by itself.
The expected severity is the sum of these probabilities.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents, taken by a hash of their id; the
vocabulary holds the ``FEATURES`` features whose presence goes with the grade most surely, by the score
of a test on the mean grade. Scoring reads every whole text.

Cases: a null text has no words; a very long text is read whole; rows without an id are graded; labels that are null count as no label, and of repeated labels the
highest grade counts; without labelled documents, or with one grade only, every document gets the
grade that was seen (0 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.hashing import slices_of, texts_of

SAMPLE_ROWS, FEATURES, MIN_DOCUMENTS = 12_000, 3_000, 3
PENALTY, STEPS, RATE = 3e-4, 300, 0.1
# Weight of documents above the lowest grade, which are rare.
EMPHASIS = 4.0
# Expected severity from which a document counts as toxic.
REJECT = 0.5

# Lengths of the word beginnings that are features, and entries of a worker's cache of words.
BEGINNINGS = (4, 5, 6)
CACHE_ENTRIES = 300_000

# ASCII characters other than letters separate words.
_BREAKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words_in(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text."""
    spaced = (text or "").lower().encode("utf-8", "replace").translate(_BREAKS)
    return set(spaced.decode("utf-8").split())


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def features_in(text: str | None) -> set[str]:
    return {f for w in words_in(text) for f in features_of(w)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    lowest: int = 0

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for every score (rows) and threshold (columns)."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    def scores(self, texts) -> np.ndarray:
        """``w.x`` of each text."""
        known = _Known(self.vocabulary)
        return np.array([self.weights[list({i for found in map(known.__getitem__, words_in(t)) for i in found})].sum()
                         for t in texts])


class _Known(dict):
    """Feature numbers of a word; most words have none."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self[word] = tuple(self.vocabulary[f] for f in features_of(word) if f in self.vocabulary)
        return found


def fit_ordinal(features: list[np.ndarray], grades: np.ndarray, width: int, penalty: float = PENALTY,
                steps: int = STEPS, rate: float = RATE, emphasis: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by gradient descent with adapted steps on the mean
    negative log likelihood, in which grades above 0 have the weight ``emphasis``. ``grades`` run
    from 0 without gaps."""
    top = int(grades.max())
    flat = np.concatenate(features) if features else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    n = len(features)
    weight = np.where(grades > 0, emphasis, 1.0)
    weight /= weight.sum()
    # thresholds = first, then steps that stay positive as exponentials
    share = np.array([(grades >= j).mean() for j in range(1, top + 1)])
    start = np.log((1 - share + 1e-6) / (share + 1e-6))
    theta = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        cuts = theta[width] + np.concatenate([[0.0], np.cumsum(np.exp(theta[width + 1:]))])
        score = np.bincount(row, theta[flat], n)
        above = np.hstack([np.ones((n, 1)), _sigmoid(score[:, None] - cuts[None, :]), np.zeros((n, 1))])
        p_low, p_high = above[np.arange(n), grades], above[np.arange(n), grades + 1]
        mass = np.maximum(p_low - p_high, 1e-9)
        slope_low, slope_high = p_low * (1 - p_low) / mass, p_high * (1 - p_high) / mass
        by_score = -(slope_low - slope_high) * weight
        by_cut = np.zeros(top + 2)
        np.add.at(by_cut, grades, slope_low * weight)
        np.add.at(by_cut, grades + 1, -slope_high * weight)
        by_cut = by_cut[1:top + 1]
        tail = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(flat, by_score[row], width) + penalty * theta[:width],
                                   tail[:1], tail[1:] * np.exp(theta[width + 1:])])
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient ** 2
        theta -= rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return theta[:width], theta[width] + np.concatenate([[0.0], np.cumsum(np.exp(theta[width + 1:]))])


def severity_grade(toxic: Column, quality: Column) -> Column:
    """0 for harmless, 1 for toxic, 2 for toxic without other merit; null without a label."""
    return F.when(toxic == 0, 0).when(toxic > 0, F.when(quality == 0, 2).otherwise(1))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> OrdinalModel:
    """Fit on labelled documents; labels: ``(doc_id, grade)``.

    The driver gets the sampled ids, the vocabulary, and the sampled documents as word numbers; all
    three are bounded by the parameters.
    """
    sample = labels.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(
        F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # Of the rows with one id one is read, whichever has the largest hash, so the sample is bounded in rows.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(
        F.max_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("grade").alias("grade"))

    def spell(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each feature of a slice of documents, with how many hold it and the sum of their grades."""
        for part in (p for f in frames for p in slices_of(f)):
            n, total = Counter(), Counter()
            for t, g in zip(part.column("text").to_pylist(), part.column("grade").to_pylist(), strict=True):
                for w in features_in(t):
                    n[w] += 1
                    total[w] += g
            yield pa.RecordBatch.from_arrays(
                [pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64()), pa.array(total.values(), pa.int64())],
                names=["word", "n", "sum"])

    rated = sample.agg(F.avg("grade").alias("mean"), F.stddev_pop("grade").alias("spread")).first()
    if not rated["spread"]:
        return OrdinalModel({}, np.zeros(0), np.zeros(0), int(rated["mean"] or 0))
    surely = F.abs(F.col("sum") - F.col("n") * rated["mean"]) / (F.sqrt("n") * rated["spread"])
    counted = chosen.select("text", "grade").mapInArrow(spell, "word string, n long, sum long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum")).filter(F.col("n") >= MIN_DOCUMENTS)
    words = [r["word"] for r in counted.orderBy(surely.desc(), "word").limit(features).collect()]
    vocabulary = {w: i for i, w in enumerate(words)}

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [sorted(vocabulary[w] for w in features_in(t) & vocabulary.keys()) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "grade": f["grade"], "words": found})

    rows = chosen.mapInPandas(number, "doc_id long, grade int, words array<int>").toPandas().sort_values(
        "doc_id", kind="stable")
    seen = np.unique(rows["grade"].to_numpy(np.int64))
    if len(seen) < 2:  # the labels that vary belong to documents that are not here
        return OrdinalModel({}, np.zeros(0), np.zeros(0), int(seen[0]) if len(seen) else 0)
    # Grades without an example have no threshold of their own.
    grades = np.searchsorted(seen, rows["grade"].to_numpy(np.int64))
    weights, cuts = fit_ordinal([np.asarray(w, np.int64) for w in rows["words"]], grades, len(words), emphasis=EMPHASIS)
    thresholds = np.repeat(cuts, np.diff(seen))
    return OrdinalModel(vocabulary, weights, thresholds, int(seen[0]))


def grade_documents(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """``(doc_id, expected_severity, grade, toxic, kept)`` for each row of ``docs (doc_id, text)``."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            above = model.at_least(model.scores(texts_of(f)))
            expected = model.lowest + above.sum(1)
            yield pa.RecordBatch.from_arrays(
                [f.column("doc_id"), pa.array(expected.round(6)), pa.array((model.lowest + (above >= 0.5).sum(1)).astype(np.int32)),
                 pa.array(expected >= reject), pa.array(expected < reject)],
                names=["doc_id", "expected_severity", "grade", "toxic", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, expected_severity double, grade int, toxic boolean, kept boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            above = model.at_least(model.scores(texts_of(f)))
            yield f.filter(pa.array(model.lowest + above.sum(1) < reject))

    return docs.mapInArrow(run, docs.schema)
