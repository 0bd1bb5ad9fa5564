"""Document quality by Naive Bayes support vectors.

Features of a text are indicators of hashed n-grams: its words and word pairs; the shapes of words
and of neighbouring words (classes of characters, runs taken as one), each with the order of
magnitude of its rate in the text; and how large a share of its words, word pairs and five-word
runs is distinct. Class log-count ratios of the features are counted over all labelled training
documents; they scale the indicators, rows are brought to unit length, and a linear model is fitted
to the hinge loss by dual coordinate descent. A logistic curve fitted on documents kept from that
fit turns margins into scores.

The counts cover every labelled training row. The linear model and the curve are fitted on a
sample of at most ``MAX_FIT`` of them, those of the smallest hash of doc_id, which bounds the
driver's memory. Scores use the text alone.

Defined cases: a null text counts as empty; an empty text gets the score of a row without
features. Rows that repeat a doc_id are scored on their own. Labels that are null are no labels; of
a doc_id's several labels the smallest counts. If no labelled row of both classes is there to learn
from, every score is the share of label 1 among the training rows (1.0 without any), so that
nothing is rejected for want of evidence. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexora.llm._hashing import join_words, mix, stream, text_buffers, words_of
from lexora.session import bound_batches

BITS = 18
MAX_FIT = 4000
EPOCHS, COST, SMOOTH = 25, 4.0, 1.0
THRESHOLD = 0.3

_U = np.uint64
_SALT = stream(31, 8)


@dataclass(frozen=True)
class Model:
    """weights of the 2 ** BITS features with the ratios folded in, the ratios, and the score curve."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    level: float


def _rated(grams: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Each gram with the order of magnitude of its rate."""
    if not len(grams):
        return grams
    found, counts = np.unique(grams, return_counts=True)
    rate = np.floor(np.log2(counts / len(grams))).clip(-7, 0)
    return mix(found ^ salt ^ (rate + 8).astype(np.uint64))


def _share(grams: np.ndarray, salt: np.uint64) -> np.ndarray:
    """The share of distinct grams, in tenths."""
    if len(grams) < 2:
        return grams[:0]
    return mix(np.array([len(np.unique(grams)) * 10 // len(grams)], dtype=np.uint64) ^ salt)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted feature numbers of each text."""
    raw, edges = text_buffers(column)
    words, counts = words_of(raw, edges)
    shapes, _ = words_of(raw, edges, shape=True)
    at = 0
    for n in counts.tolist():
        w, s = words[at:at + n], shapes[at:at + n]
        at += n
        if not n:
            yield np.zeros(0, np.int32)
            continue
        pairs = join_words(w, 2) if n > 1 else w[:0]
        runs = join_words(w, 5) if n > 4 else w[:0]
        twice = (w[1:] == w[:-1]).astype(np.uint64)
        parts = [
            mix(w ^ _SALT[0]), mix(pairs ^ _SALT[1]),
            _rated(s, _SALT[2]), _rated(join_words(s, 2) if n > 1 else s[:0], _SALT[3]), _rated(twice, _SALT[4]),
            _share(w, _SALT[5]), _share(pairs, _SALT[6]), _share(runs, _SALT[7]),
        ]
        yield np.unique((np.concatenate(parts) >> _U(64 - BITS)).astype(np.int32))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a feature; a row for each feature that a task has seen."""
    seen, size = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for label, own in zip(batch.column(0).to_pylist(), features(batch.column(1)), strict=True):
            seen[label][own] += 1
            size[label] += 1
    held = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(held, -1)), pa.array(np.append(seen[0][held], size[0])), pa.array(np.append(seen[1][held], size[1]))],
        ["feature", "n0", "n1"],
    )


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [x.tobytes() for x in features(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], ["rank", "label", "features"])


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, signs: np.ndarray, costs: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model of rows of indicators scaled by ``scale``."""
    weights, bias = np.zeros(len(scale)), 0.0
    norms = [max(1e-12, float(np.sqrt(np.square(scale[r]).sum()))) for r in rows]
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x = scale[rows[i]] / norms[i]
            slope = signs[i] * (float(weights[rows[i]] @ x) + bias) - 1.0
            fresh = min(max(alpha[i] - slope / 2.0, 0.0), costs[i])
            step = (fresh - alpha[i]) * signs[i]
            if step:
                weights[rows[i]] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = fresh
        if moved < 1e-3:
            break
    return weights, bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and level of the logistic curve of smoothed labels, by Newton's method."""
    n1 = labels.sum()
    n0 = len(labels) - n1
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, level = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + level, -30, 30)))
        error, spread = p - target, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([error @ margins + 1e-3 * slope, error.sum()])
        hess = np.array([[spread @ (margins * margins) + 1e-3, spread @ margins], [spread @ margins, spread.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        slope, level = slope - step[0], level - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(slope, 1e-3)), float(level)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_fit: int = MAX_FIT) -> Model:
    """A model learnt from the labelled documents that are not held out."""
    spark = docs.sparkSession
    bound_batches(spark)
    key = F.col("doc_id").cast("long")
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(key.cast("string").cast("binary")) % 5 != 0))
        .groupBy(key.alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    )
    texts = docs.select(key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Labels grow with the corpus: always a shuffled join, so the plan is the same at every size.
    rows = texts.join(known.hint("merge"), "doc_id").select("label", "text")
    counted = rows.mapInArrow(_counter, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.zeros((2, 1 << BITS))
    sizes = np.zeros(2)
    at = counted["feature"].to_numpy()
    for name, k in (("n0", 0), ("n1", 1)):
        many = counted[name].to_numpy()
        counts[k][at[at >= 0]] = many[at >= 0]
        sizes[k] = many[at < 0].sum()
    flat = np.zeros(1 << BITS, np.float32)
    share = float((sizes[1] + 1) / (sizes.sum() + 1)) if sizes.sum() else 1.0
    plain = Model(flat, flat, 0.0, 1.0, float(np.log(share / (1 - share))) if share < 1 else 30.0)
    if not sizes.all():
        return plain
    rate = (counts + SMOOTH) / (sizes[:, None] + 2 * SMOOTH)
    ratios = np.log(rate[1] / rate[0])

    # max_fit rows of two numbers at most: small enough to send to every task.
    chosen = known.select("doc_id", "label", F.xxhash64("doc_id").alias("rank")).orderBy("rank", "doc_id").limit(max_fit)
    sample = texts.join(F.broadcast(chosen), "doc_id").select("rank", "label", "text").mapInArrow(_sampler, "rank long, label int, features binary")
    fit = sorted((r["rank"], r["label"], r["features"]) for r in sample.toLocalIterator())
    held = [np.frombuffer(f, np.int32) for _, _, f in fit]
    truth = np.array([x for _, x, _ in fit])
    kept = np.arange(len(fit)) % 4 == 0
    if len(set(truth[kept])) < 2 or len(set(truth[~kept])) < 2:
        return plain
    signs = np.where(truth == 1, 1.0, -1.0)
    many = np.array([(truth == 0).sum(), (truth == 1).sum()])
    costs = COST * len(fit) / 2 / many[truth]
    part = np.flatnonzero(~kept)
    weights, bias = dual_coordinate_descent([held[i] for i in part], ratios, signs[part], costs[part])
    folded = weights * ratios
    margin = lambda r: float(folded[r].sum() / max(1e-12, np.sqrt(np.square(ratios[r]).sum()))) + bias
    slope, level = _logistic(np.array([margin(held[i]) for i in np.flatnonzero(kept)]), truth[kept])
    return Model(folded.astype(np.float32), ratios.astype(np.float32), bias, slope, level)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = np.square(model.ratios.astype(np.float64))
        weights = model.weights.astype(np.float64)
        for batch in batches:
            margins = np.array([weights[r].sum() / max(1e-12, np.sqrt(squares[r].sum())) + model.bias for r in features(batch.column(batch.num_columns - 1))])
            scores = 1 / (1 + np.exp(-np.clip(model.slope * margins + model.level, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, from 0 to 1, of every document."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scorer(model), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from ``labels`` first."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, train(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keeper(model: Model, threshold: float, at: int):
    score_of = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            scores = next(iter(score_of(iter([texts])))).column(0).to_numpy()
            yield batch.filter(pa.array(scores >= threshold))

    return run


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, all columns as they are."""
    model = train(docs, labels)
    return docs.mapInArrow(_keeper(model, threshold, docs.columns.index("text")), docs.schema)
