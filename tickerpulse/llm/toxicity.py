"""Severity grades from sparse text features by cumulative-link ordinal regression.

For ordered grades 0..K-1, P(grade <= k | x) = sigmoid(threshold_k - w . x): one weight vector for all thresholds,
which ascend. The features say which hashed words a text holds, whatever their number. An L1 term leaves most
weights at zero, so long texts do not drift. ``fit`` learns from a documented number of labelled rows per grade, each
weighted to stand for its grade; ``score`` gives every text the chance of each grade, the expected severity
(sum of k * P(grade = k)) and the likeliest grade.

Texts that are NULL or empty have no feature and get the chances that the thresholds alone give. Without labelled
rows the severity is 0 for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpulse.llm import textio


@dataclass
class Model:
    """Ascending grades, weights per hashed word, ascending thresholds between the grades."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = k) per row."""
        below = sigmoid(self.thresholds[None, :] - scores[:, None])
        edges = np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1)
        return np.diff(edges, axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def features(texts: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of lower-case texts: first and last text, hashed words, and where each text's words begin."""
    data, starts = textio.column_bytes(texts)
    for a, z in textio.blocks(starts):
        _, _, hashes, first = textio.words(data[starts[a] : starts[z]], starts[a : z + 1] - starts[a])
        yield a, z, (hashes % np.uint64(buckets)).astype(np.int64), first


def train(columns: list[np.ndarray], grade: np.ndarray, weight: np.ndarray, n_grades: int, buckets: int, l1: float, rounds: int, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds: proximal Adam on the weighted log-likelihood, with soft thresholding after each step.
    Words of fewer than three rows are left out."""
    length = np.fromiter(map(len, columns), np.int64, len(columns))
    flat, row = (np.concatenate(columns) if columns else np.zeros(0, np.int64)), np.repeat(np.arange(len(columns)), length)
    used = np.flatnonzero(np.bincount(flat, minlength=buckets) >= 3)
    back = np.full(buckets, -1)
    back[used] = np.arange(len(used))
    col = back[flat]
    row, col = row[col >= 0], col[col >= 0]
    weight = weight / weight.sum()
    share = np.array([weight[grade <= k].sum() for k in range(n_grades - 1)])
    first = np.log(share / (1 - share))
    # Thresholds as the lowest one and the logs of the steps above it, so that they stay in order.
    place = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    w, mean, square = np.zeros(len(used)), np.zeros(len(used) + len(place)), np.zeros(len(used) + len(place))
    for t in range(1, rounds + 1):
        steps = np.concatenate([place[:1], np.exp(place[1:])])
        thresholds = np.cumsum(steps)
        score = np.bincount(row, w[col], minlength=len(columns))
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        upper, lower = sigmoid(edges[grade + 1] - score), sigmoid(edges[grade] - score)
        # Of -log(upper - lower): the density at each edge over the mass between them.
        mass = np.maximum(upper - lower, 1e-12)
        at_upper, at_lower = upper * (1 - upper) / mass * weight, lower * (1 - lower) / mass * weight
        g_w = np.bincount(col, (at_upper - at_lower)[row], minlength=len(used))
        g_t = np.array([at_lower[grade == k + 1].sum() - at_upper[grade == k].sum() for k in range(n_grades - 1)])
        g_place = np.cumsum(g_t[::-1])[::-1] * np.concatenate([[1.0], steps[1:]])
        gradient = np.concatenate([g_w, g_place])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        scale = rate / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
        step = scale * mean / (1 - 0.9**t)
        w = w - step[: len(w)]
        w = np.sign(w) * np.maximum(np.abs(w) - scale[: len(w)] * l1, 0)
        place = place - step[len(w) :]
    out = np.zeros(buckets, np.float32)
    out[used] = w
    return out, np.cumsum(np.concatenate([place[:1], np.exp(place[1:])]))


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, grade_col: str, rows_per_grade: int = 4000,
        buckets: int = 1 << 18, l1: float = 2e-4, rounds: int = 200, seed: int = 11) -> Model:
    """Fit on about ``rows_per_grade`` labelled rows of each grade, chosen by a hash of their id. That many ids are
    broadcast and that many sets of hashed words come to the driver."""
    known = labels.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL")
    sizes = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    grades = sorted(sizes)
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(buckets, np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for g in grades for x in (g, min(1.0, rows_per_grade / sizes[g]))])
    some = known.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share[F.col("grade")] * (1 << 20))
    texts = df.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")).join(F.broadcast(some), "id").select("text", "grade")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, buckets_of, first in features(batch.column("text"), buckets):
                values, offsets = textio.sets_of(buckets_of, first)
                yield pa.record_batch([batch.column("grade").slice(a, z - a), textio.lists(values, offsets, pa.int32())], ["grade", "words"])

    rows = texts.mapInArrow(hashed, "grade int, words array<int>").toArrow()
    grade = np.searchsorted(grades, rows.column("grade").to_numpy())
    offsets, flat = [0], [np.zeros(0, np.int64)]
    for chunk in rows.column("words").chunks:
        flat.append(chunk.flatten().to_numpy().astype(np.int64))
        offsets.extend((np.cumsum(chunk.value_lengths().to_numpy()) + offsets[-1]).tolist())
    columns = np.split(np.concatenate(flat), offsets[1:-1]) if len(grade) else []
    counts = np.bincount(grade, minlength=len(grades))
    if (counts == 0).any():
        return Model(grades, np.zeros(buckets, np.float32), np.linspace(30, 60, len(grades) - 1))
    weight = (np.array([sizes[g] for g in grades]) / counts)[grade]
    # The order of rows from Spark is not fixed; sums must not depend on it.
    order = np.lexsort((np.fromiter((int(c.sum()) for c in columns), np.int64, len(columns)), np.fromiter(map(len, columns), np.int64, len(columns)), grade))
    w, thresholds = train([columns[i] for i in order], grade[order], weight[order], len(grades), buckets, l1, rounds)
    return Model(grades, w, thresholds)


def score(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """Per row: the id, expected_severity, grade and chances (array<double>, one per grade)."""
    source = df.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: one weight per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grades = np.array(model.grades)
        for batch in batches:
            for a, z, words, first in features(batch.column("text"), len(model.weights)):
                heavy = model.weights[words] != 0
                before = np.concatenate([[0], np.cumsum(heavy)])[first]
                values, offsets = textio.sets_of(np.compress(heavy, words), before)
                total = np.bincount(np.repeat(np.arange(z - a), np.diff(offsets)), model.weights[values], minlength=z - a)
                chance = model.chances(total)
                severity = (chance * grades).sum(1)
                likeliest = grades[chance.argmax(1)]
                columns = [pa.array(severity), pa.array(likeliest, pa.int32()), textio.lists(chance.reshape(-1), np.arange(z - a + 1) * len(grades), pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), *columns], ["doc_id", "expected_severity", "grade", "chances"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, expected_severity double, grade int, chances array<double>")
