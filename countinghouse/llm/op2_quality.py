"""Quality classifier: positive-unlabelled learning with the non-negative risk.

Trusted positives are training-fold documents that labels mark as quality 1 (at
most POSITIVES of them, those with the smallest hashes of their ids); all rows
outside the held-out fold, labelled or not, are the unlabelled set. Labels of
quality 0 are never read. A linear score of text statistics minimises
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
with the logistic loss and a ridge, by Newton steps whose sums Spark adds up
over all rows. Where the minimum has a second term below zero, the score fits
noise; the ridge is then doubled until the term isn't negative, which is the
non-negative correction: max(0, ...) holds with the term itself.

The class prior is estimated from positives and unlabelled rows alone: a first
model learns from three quarters of the positives; with the others, which it
didn't see, the prior is the least ratio, over all thresholds, of the share of
unlabelled rows above a threshold to the share of positives above it, where a
confidence term keeps out thresholds with few rows (best-bin estimation).

Statistics are computed once a document and written; each Newton step reads
them, and a task hands on sums, whose number depends on the statistics only.
They are added as whole multiples of 1 / UNIT, so the order in which tasks end
changes nothing. Nothing but sums reaches the driver; the positives' ids (at
most POSITIVES) are broadcast.

The held-out fold, crc32(doc_id as text) mod 4 = 2, gives nothing to the model.
Labels, lang, source and doc_id are never inputs of a score.

Defined results: a null or empty text is scored from zero statistics; a null id
is scored like any other (held_out false) but never learned from; a document is
positive if any of its labels is 1; rows that repeat a doc_id count each;
without any positive or unlabelled row every score is 0.5; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .words import Hasher, spaced_table, text_chunks, word_spans

#: Most labelled documents that the model takes as positives.
POSITIVES = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Newton steps, halvings of a step, the change of the risk that ends the fit, the least ridge and how often it may be doubled.
STEPS, HALVINGS, TOLERANCE, RIDGE, DOUBLINGS = 25, 8, 1e-6, 0.1, 12
#: Sums are multiples of 1 / UNIT; tasks that add up the sums of other tasks.
UNIT, ADDERS = 1 << 20, 16
#: The prior that the first model assumes, cells of its scores, and the confidence of the estimate.
FIRST_PRIOR, CELLS, DELTA, GAMMA = 0.5, 2000, 0.1, 0.01
_PUNCTUATION = b".,;:!?#*$%&|<>=+-_/\\()[]{}\"'@~"


def _byte_classes() -> np.ndarray:
    """A class for each byte: 0 other, 1 space, 2 line end, 3 digit, 4 capital, 5 small letter, 6 beyond ASCII, 7... one for each punctuation mark."""
    kind = np.zeros(256, np.int64)
    kind[[0x20, 9, 11, 12, 13]], kind[10], kind[48:58], kind[65:91], kind[97:123], kind[128:] = 1, 2, 3, 4, 5, 6
    for i, b in enumerate(_PUNCTUATION):
        kind[b] = 7 + i
    return kind


N_CLASSES = 7 + len(_PUNCTUATION)


def statistics(column) -> np.ndarray:
    """A row of statistics for each text of a column: shares of kinds of bytes, lengths and repetition of words, lines."""
    kind, spaced, hasher, out = _byte_classes(), spaced_table(), Hasher(), []
    for lo, hi, data, offsets in text_chunks(column):
        n, size = hi - lo, np.diff(offsets)
        doc = np.repeat(np.arange(n), size)
        counts = np.bincount(doc * N_CLASSES + kind[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        starts, ends, bounds = word_spans(data, offsets, spaced)
        words, of = np.diff(bounds), np.repeat(np.arange(n), np.diff(bounds))
        hashes, length = hasher.of_words(data, starts, ends), ends - starts
        total = np.bincount(of, weights=length, minlength=n)
        square = np.bincount(of, weights=length.astype(float) ** 2, minlength=n)
        short = np.bincount(of, weights=length <= 3, minlength=n)
        inner = of[1:] == of[:-1]
        again = np.bincount(of[1:], weights=inner & (hashes[1:] == hashes[:-1]), minlength=n)
        order = np.lexsort((hashes, of))
        first = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1]))[: len(order)]
        distinct = np.bincount(of[order], weights=first, minlength=n)
        capital = np.bincount(of, weights=kind[data[starts]] == 4, minlength=n)
        per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
        mean = total / per_word
        lines = counts[:, 2] + 1
        columns = [
            counts / per_byte[:, None],
            np.minimum(counts[:, 7:] / per_word[:, None], 3.0),
            np.log1p(counts[:, 7:]),
            np.stack(
                [np.log1p(words), np.log1p(lines), np.log1p(words / lines), mean / 10, np.sqrt(np.maximum(square / per_word - mean**2, 0)) / 10, short / per_word, again / per_word, np.log1p(again), distinct / per_word, (distinct / per_word) ** 2, capital / per_word, np.log1p(counts[:, 4]), words == 0],
                axis=1,
            ),
        ]
        out.append(np.concatenate(columns, axis=1).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, N_CLASSES + 2 * len(_PUNCTUATION) + 13), np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


class Model:
    """Standardised statistics, weights and intercept, and the class prior that they were fitted with."""

    def __init__(self, centre, scale, weights, intercept, prior=0.5):
        self.centre, self.scale, self.weights, self.intercept, self.prior = centre, scale, weights, intercept, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.inputs(x) @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(column) -> np.ndarray:
    """The statistics in a binary column, a row each."""
    rows = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + rows + 1]
    return np.frombuffer(column.buffers()[2], np.float32)[offsets[0] // 4 : offsets[-1] // 4].reshape(rows, -1)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and x (the statistics as bytes) of each row, written once."""

    def run(batches):
        for batch in batches:
            x = statistics(batch["text"])
            width = x.shape[1] * 4
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x.data.cast("B")[i : i + width] for i in range(0, x.size * 4, width)], pa.binary())], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(run, "doc_id long, x binary").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x"))


def _added(rows: DataFrame, run) -> np.ndarray | None:
    """The sum over all batches (x, part) of the matrices that run gives, all of one shape; None if there is no row."""

    def task(batches):
        total = None
        for batch in batches:
            if len(batch):
                m = np.rint(run(_matrix(batch["x"]), batch["part"].to_numpy()) * UNIT).astype(np.int64)
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([len(total)], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["height", "sums"])

    def add(batches):
        height, total = 0, 0
        for batch in batches:
            for height, blob in zip(batch["height"].to_pylist(), batch["sums"].to_pylist()):  # noqa: B007
                total = total + np.frombuffer(blob, np.int64)
        if height:
            yield pa.RecordBatch.from_arrays([pa.array([height], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["height", "sums"])

    kind = "height int, sums binary"
    parts = rows.mapInArrow(task, kind).repartition(ADDERS).mapInArrow(add, kind).collect()  # ADDERS rows at most
    return sum(np.frombuffer(r["sums"], np.int64) for r in parts).reshape(parts[0]["height"], -1) / UNIT if parts else None


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def risk_sums(z: np.ndarray, x: np.ndarray, part: np.ndarray, fitted: int) -> np.ndarray:
    """What the risk, its gradient and its curvature need from some rows.

    x has a last column of ones, z = x @ w; rows with part in 1..fitted are positives, and all rows are unlabelled. The
    rows of the result: the curvature of R_u(-), the gradients of R_u(-), R_p(-) and R_p(+), and the losses and counts,
    each as a sum.
    """
    positive = (part > 0) & (part <= fitted)
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    xp, zp, sp = x[positive], z[positive], s[positive]
    last = np.zeros(x.shape[1])
    last[:5] = softplus(z).sum(), softplus(zp).sum(), softplus(-zp).sum(), len(z), len(zp)
    return np.vstack([(x * (s * (1 - s))[:, None]).T @ x, x.T @ s, xp.T @ sp, xp.T @ (sp - 1), last])


def risk(sums: np.ndarray, w: np.ndarray, prior: float, ridge: float):
    """(unbiased risk, its second term, gradient, curvature) from added risk_sums, with the ridge on all but the intercept."""
    d = len(w)
    u, p = max(sums[-1, 3], 1), max(sums[-1, 4], 1)
    losses = sums[-1, 0] / u, sums[-1, 1] / p, sums[-1, 2] / p
    second = losses[0] - prior * losses[1]
    weight = ridge * np.append(np.ones(d - 1), 0)
    gradient = sums[d] / u - prior * sums[d + 1] / p + prior * sums[d + 2] / p + weight * w
    # With the logistic loss R_p(+) - R_p(-) is linear, so that only R_u(-) and the ridge curve: the risk is convex.
    curvature = sums[:d] / u + np.diag(weight + 1e-9)
    return prior * losses[2] + second + (weight * w * w).sum() / 2, second, gradient, curvature


def fit(added, width: int, prior: float, start: np.ndarray | None = None, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """The weights (intercept last) that minimise the non-negative risk, and the ridge they took; added(w) gives the risk_sums of all rows."""
    w = np.zeros(width + 1) if start is None else start
    sums = added(w)
    for _ in range(DOUBLINGS + 1):
        value, second, gradient, curvature = risk(sums, w, prior, ridge)
        for _ in range(STEPS):
            step = np.linalg.solve(curvature, gradient)
            for _ in range(HALVINGS):
                tried = added(w - step)
                new = risk(tried, w - step, prior, ridge)
                if new[0] <= value:
                    break
                step = step / 2
            else:
                break
            gain = value - new[0]
            w, sums, (value, second, gradient, curvature) = w - step, tried, new
            if gain <= TOLERANCE:
                break
        if second >= 0:
            break
        ridge *= 2
    return w, ridge


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from counts of held-back positives and unlabelled rows by score, in ascending order of score."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    above_p, above_u = (np.cumsum(c[::-1])[::-1] / n for c, n in ((positive, n_p), (unlabelled, n_u)))
    has = above_p > 0
    above_p, above_u = above_p[has], above_u[has]
    doubt = (1 + GAMMA) * (math.sqrt(math.log(4 / DELTA) / (2 * n_u)) + math.sqrt(math.log(4 / DELTA) / (2 * n_p)))
    best = np.argmin((above_u + doubt) / above_p)
    return float(min(0.98, max(0.02, above_u[best] / above_p[best])))


def train_on(rows: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> Model:
    """The model of a labelled corpus whose features rows are."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where((F.col("quality") == 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).select("id").distinct()
    # At most `positives` ids are broadcast. Part 1 to 3 teaches both models, part 4 the second only.
    chosen = marks.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(positives).select("id", (F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(4)) + 1).cast("int").alias("part"))
    known = rows.where(F.col("doc_id").isNotNull() & ~F.col("held_out"))
    known = known.join(F.broadcast(chosen), known["doc_id"] == chosen["id"], "left").select("x", F.coalesce("part", F.lit(0)).alias("part"))
    width = statistics(pa.array([""])).shape[1]

    def moments(x, part):
        x = x.astype(float)
        return np.vstack([x.sum(axis=0), (x * x).sum(axis=0), np.append([len(x), (part > 0).sum(), (part == 4).sum()], np.zeros(width - 3))])

    sums = _added(known, moments)
    if sums is None or not sums[2, 1]:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    centre = sums[0] / sums[2, 0]
    model = Model(centre, np.sqrt(np.maximum(sums[1] / sums[2, 0] - centre**2, 0)) + 1e-3, np.zeros(width), 0.0)

    def adder(fitted: int):
        def added(w):
            def run(x, part):
                x = np.hstack([model.inputs(x), np.ones((len(x), 1))])
                return risk_sums(x @ w, x, part, fitted)

            return _added(known, run)

        return added

    prior, first, ridge = 0.5, None, RIDGE
    if 0 < sums[2, 2] < sums[2, 1]:
        first, ridge = fit(adder(3), width, FIRST_PRIOR)

        def by_score(x, part):
            cell = np.minimum((CELLS / (1 + np.exp(-np.clip(model.inputs(x) @ first[:-1] + first[-1], -30, 30)))).astype(int), CELLS - 1)
            return np.vstack([np.bincount(cell[part == 4], minlength=CELLS), np.bincount(cell, minlength=CELLS)])

        prior = least_ratio(*_added(known, by_score))
    w, _ = fit(adder(4), width, prior, first, ridge)
    return Model(model.centre, model.scale, w[:-1], float(w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> Model:
    """The model of a labelled corpus; docs gives the unlabelled documents and all texts."""
    return train_on(features(docs), labels, positives)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Per row of features: doc_id, held_out, score and predicted."""

    def run(batches):
        for batch in batches:
            scores = model.scores(_matrix(batch["x"])) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_rejected(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold; all columns stay as they are."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(statistics(batch["text"])) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    rows = features(table(spark, sf_dir, "documents"))
    return score(rows, train_on(rows, table(spark, sf_dir, "labels")))
