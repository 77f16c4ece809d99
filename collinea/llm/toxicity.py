"""Operator 3, toxicity: cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w.x + b_k), with one weight vector for all ordered thresholds and
falling biases; the expected severity is the sum of these probabilities. Features are hashed
words and word beginnings of the whole text, each counted as log(1 + n).

The model is fitted on the driver, on a sample of labelled rows with a fixed bound for each
grade (``sample_per_grade``: the rows of least id hash), so its cost does not grow with the
input. Each sampled row weighs as many labels as it stands for (labels of its grade / sampled
ones), so the fit keeps the grades' true shares. Scoring is one Arrow pass with the weights (a fixed size) broadcast.

Defined results: a null or empty text has no features and gets the base rate; labels with a
null grade or without a document are ignored, repeated labels count once for each row; without
labels, or with one grade only, every severity is that grade (0 without any); extra columns
are ignored; rows with a null id are scored; a very long text is scored whole, its words in a few
8-byte arrays; equal rows score alike, so ties need no rule; ids must be integers or texts of such,
else the job ends with a cast error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from collinea.llm.common import ALNUM, LOWER, Chunk, RangeHash, chunks, cut, mix, word_spans

BITS = 18
#: code points of the word beginnings that count as features of longer words
BEGINNINGS = (4, 5, 6, 7)
SAMPLE_PER_GRADE = 4000
#: features seen in fewer sample texts say nothing about other texts
SEEN = 3
#: features that keep a weight
FEATURES = 4000


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, log count), sorted by row; each row's features once."""
    data = LOWER[chunk.data]
    start, end, row = word_spans(Chunk(chunk.lo, chunk.hi, data, chunk.offsets), ALNUM)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    hashes = RangeHash(data)
    points = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(points, start), np.searchsorted(points, end)
    rows, found = [row], [hashes.of(start, end)]
    for n in BEGINNINGS:
        longer = np.flatnonzero(last - first > n)
        found.append(mix(hashes.of(start[longer], points[first[longer] + n]) + np.uint64(n)))
        rows.append(row[longer])
    key = np.concatenate(rows) << BITS | (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    key, n = np.unique(key, return_counts=True)
    return key >> BITS, key & (1 << BITS) - 1, np.log1p(n)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    #: falling; one for each threshold between neighbouring grades
    biases: np.ndarray
    grades: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each threshold, in columns."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] + self.biases, -50, 50)))

    def severity(self, score: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.at_least(score) @ np.diff(self.grades)


def fit(rows: np.ndarray, found: np.ndarray, values: np.ndarray, grade: np.ndarray, steps: int = 200, rate: float = 0.05, ridge: float = 3e-5, weight: np.ndarray | None = None) -> OrdinalModel:
    """Maximum likelihood by Adam on the cumulative-link loss, all texts in each step.

    ``weight`` is the number of rows that each text stands for, 1 if not given.
    """
    grades = np.unique(grade)
    model = OrdinalModel(np.zeros(1 << BITS), np.zeros(len(grades) - 1), grades.astype(float))
    if len(grades) < 2:
        return model
    weight = np.ones(len(grade)) if weight is None else weight / weight.mean()
    seen = np.bincount(found, minlength=1 << BITS)
    # the features whose texts differ most from the others in mean grade, in standard errors
    centred = weight * (grade - np.average(grade, weights=weight))
    spread = np.bincount(found, weights=weight[rows] ** 2, minlength=1 << BITS)
    strength = np.abs(np.bincount(found, weights=centred[rows], minlength=1 << BITS)) / np.sqrt(np.where(seen > 0, spread, 1))
    strength[seen < SEEN] = 0
    chosen = np.zeros(1 << BITS, bool)
    chosen[np.argsort(-strength, kind="stable")[:FEATURES]] = True
    keep = chosen[found] & (strength[found] > 0)
    rows, found, values = rows[keep], found[keep], values[keep]
    used, local = np.unique(found, return_inverse=True)
    place = np.searchsorted(grades, grade)
    upper = place[:, None] >= np.arange(1, len(grades))  # whether each threshold is passed
    share = np.average(upper, axis=0, weights=weight)
    # free parameters: weights, the first bias, and logs of the falls between biases
    bias = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(len(used)), bias[:1], np.log(np.maximum(-np.diff(bias), 1e-2))])
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    n = len(grade)
    for step in range(1, steps + 1):
        w, falls = theta[: len(used)], np.exp(theta[len(used) + 1 :])
        b = theta[len(used)] - np.concatenate([[0.0], np.cumsum(falls)])
        score = np.bincount(rows, weights=values * w[local], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] + b, -50, 50)))
        edge = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        mass = np.maximum(edge[np.arange(n), place] - edge[np.arange(n), place + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
        low, high = weight * slope[np.arange(n), place] / mass, weight * slope[np.arange(n), place + 1] / mass
        per_text = -(low - high) / n
        per_bias = np.array([(-(low * (place == k + 1)) + high * (place == k)).sum() / n for k in range(len(b))])
        after = np.cumsum(per_bias[::-1])[::-1]
        gradient = np.concatenate([np.bincount(local, weights=values * per_text[rows], minlength=len(used)) + ridge * w, after[:1], -after[1:] * falls])
        moment, square = 0.9 * moment + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        theta -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    model.weights[used] = theta[: len(used)]
    model.biases = theta[len(used)] - np.concatenate([[0.0], np.cumsum(np.exp(theta[len(used) + 1 :]))])
    return model


def _featured(docs: DataFrame, extra: str) -> DataFrame:
    """``extra`` and the features of each row as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text", 500_000):
                row, found, value = features(chunk)
                edges = np.searchsorted(row, np.arange(chunk.rows + 1)).tolist()
                pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column(extra).slice(chunk.lo, chunk.rows), pack(found.astype("<i4")), pack(value.astype("<f4"))], [extra, "found", "value"])

    return docs.select(F.col(extra).cast("int").alias(extra), "text").mapInArrow(run, f"{extra} int, found binary, value binary")


def fit_on(docs: DataFrame, labels: DataFrame, grades: list[int], sample_per_grade: int = SAMPLE_PER_GRADE) -> OrdinalModel:
    """Fit on at most ``sample_per_grade`` labelled documents of each of the given grades.

    ``labels`` holds doc_id and grade.
    """
    known = docs.selectExpr("cast(doc_id as long) doc_id").filter("doc_id is not null")
    labels = labels.selectExpr("cast(doc_id as long) doc_id", "cast(grade as int) grade").filter("doc_id is not null")
    # labels without a document neither count nor take a place in the sample
    labels = cut(labels.join(known, "doc_id", "left_semi"), "labels-of-documents")
    counts = {r["grade"]: r["count"] for r in labels.filter(F.col("grade").isin(grades)).groupBy("grade").count().collect()}
    sample = None
    for grade in grades:
        part = labels.filter(F.col("grade") == grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_grade)
        sample = part if sample is None else sample.unionAll(part)
    # at most sample_per_grade rows a grade, 12 bytes each
    joined = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(sample), "doc_id")
    table = _featured(joined, "grade").toArrow()
    grade = np.array(table.column("grade").to_pylist(), np.int64)
    if not len(grade):
        return OrdinalModel(np.zeros(1 << BITS), np.zeros(0), np.zeros(1))
    found = [np.frombuffer(x, "<i4") for x in table.column("found").to_pylist()]
    value = [np.frombuffer(x, "<f4") for x in table.column("value").to_pylist()]
    rows = np.repeat(np.arange(len(grade)), [len(x) for x in found])
    stands_for = {g: n / min(n, sample_per_grade) for g, n in counts.items()}
    return fit(rows, np.concatenate(found), np.concatenate(value), grade, weight=np.array([stands_for[g] for g in grade.tolist()]))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_severity, p_toxic (of any grade above the least) and toxic of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for chunk in chunks(batch, "text", 1_000_000):
                row, found, value = features(chunk)
                total = np.bincount(row, weights=value * model.weights[found], minlength=chunk.rows)
                above = model.at_least(total)
                p = above[:, 0] if above.shape[1] else np.zeros(chunk.rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.lo, chunk.rows), pa.array(model.severity(total)), pa.array(p), pa.array(p >= 0.5)], ["doc_id", "expected_severity", "p_toxic", "toxic"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, toxic boolean")


def severity_grades(labels: DataFrame) -> DataFrame:
    """Three grades from the two marks: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    return labels.select("doc_id", grade.alias("grade"))
