"""Toxicity: cumulative-link ordinal regression on sparse text features.

Words and their first bytes are hashed into a fixed number of features. One weight vector is shared by
all thresholds; P(grade > k) = sigmoid(x.w - t_k) with t_0 < t_1, and the expected severity is the sum of
these probabilities. The labels say toxic or not; among toxic documents of the sample the upper half by
the share of their words that go with the label is grade 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns_apart, per_batch, stored
from .text import chunks
from .words import training_share, word_hashes


@dataclass(frozen=True)
class ToxicitySpec:
    """``training_rows`` bounds the labelled sample."""

    features: int = 1 << 17
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    training_rows: int = 10_000
    least_documents: int = 4
    least_z: float = 2.5
    steps: int = 150
    penalty: float = 2e-4
    grades: int = 3


def sparse_features(column: pa.Array, spec: ToxicitySpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct features of each document, their values, and bounds per document.

    A value is sqrt(count): repetition counts less and less, and rows are not scaled by length, so that a
    few words of a long text weigh as much as in a short one.
    """
    places, values, bounds = [], [], [np.zeros(1, np.int64)]
    for _, data, ends in chunks(column):
        h, signs, words, first = word_hashes(data, ends, spec.prefixes)
        allh = np.concatenate([h, *[f[~signs] for f in first]])
        doc = np.repeat(np.arange(len(words) - 1), np.diff(words))
        docs = np.concatenate([doc, *[doc[~signs] for _ in first]])
        key, counts = np.unique(docs * spec.features + (allh % np.uint64(spec.features)).astype(np.int64), return_counts=True)
        places.append(key % spec.features)
        values.append(np.sqrt(counts))
        bounds.append(bounds[-1][-1] + np.searchsorted(key, np.arange(1, len(words)) * spec.features))
    return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0), *values]), np.concatenate(bounds)


@dataclass
class OrdinalModel:
    """Shared weights and increasing thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    spec: ToxicitySpec

    def exceed(self, places: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade > k) per document and threshold."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[places] * values)])
        z = (sums[bounds[1:]] - sums[bounds[:-1]])[:, None] - self.thresholds[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id, expected_severity, severity, toxic`` per row; a null text counts as empty.

        ``severity`` is the most likely grade; ``toxic`` whether a grade above 0 is at least as likely as 0. Null and
        repeated ids are kept, each row by itself; whole texts of any length are read, other columns are ignored, and an
        empty table gives an empty result.
        """

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = self.exceed(*sparse_features(batch.column("text"), self.spec))
            edges = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)
            grade = np.argmax(edges[:, :-1] - edges[:, 1:], axis=1)
            columns = [batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array((p[:, 0] >= 0.5).astype(np.int32))]
            return pa.record_batch(columns, names=["doc_id", "expected_severity", "severity", "toxic"])

        rows = columns_apart(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return per_batch(rows, run, "doc_id long, expected_severity double, severity int, toxic int")


def telling_features(in_toxic: np.ndarray, in_clean: np.ndarray, n1: int, n0: int, spec: ToxicitySpec) -> tuple[np.ndarray, np.ndarray]:
    """Features that stand out, by how many toxic and clean documents have them, and those that go with toxic ones.

    A feature stands out if enough documents have it and its log-odds ratio is well above its standard error.
    """
    lift = np.log((in_toxic + 0.5) / (max(1, n1) + 1)) - np.log((in_clean + 0.5) / (max(1, n0) + 1))
    usable = (in_toxic + in_clean >= spec.least_documents) & (np.abs(lift) >= spec.least_z * np.sqrt(1 / (in_toxic + 0.5) + 1 / (in_clean + 0.5)))
    return usable, usable & (lift > 0)


def graded(toxic: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Grades 0 to 2: the toxic documents with more than the median share are grade 2."""
    grades = toxic.astype(np.int64)
    if toxic.any():
        grades[(toxic == 1) & (share > np.median(share[toxic == 1]))] = 2
    return grades


def fit_ordinal(places: np.ndarray, values: np.ndarray, bounds: np.ndarray, grades: np.ndarray, usable: np.ndarray, spec: ToxicitySpec) -> OrdinalModel:
    """Penalised maximum likelihood by Adam over the whole sample. Without two grades all weights are zero."""
    k = spec.grades - 1
    seen = np.array([(grades > j).mean() if len(grades) else 0.0 for j in range(k)])
    thresholds = np.sort(-np.log((seen + 1e-3) / (1 - seen + 1e-3)))
    weights = np.zeros(spec.features)
    if len(np.unique(grades)) < 2:
        return OrdinalModel(weights, thresholds, spec)
    keep = usable[places]
    rows = np.repeat(np.arange(len(grades)), np.diff(bounds))[keep]
    p, v = places[keep], values[keep]
    used, local = np.unique(p, return_inverse=True)
    w, base, gap = np.zeros(len(used)), thresholds[0], np.log(max(thresholds[1] - thresholds[0], 0.1))
    state = [np.zeros(len(used) + 2), np.zeros(len(used) + 2)]
    n = len(grades)
    for t in range(1, spec.steps + 1):
        eta = np.bincount(rows, w[local] * v, n)
        cut = np.array([base, base + np.exp(gap)])
        above = 1 / (1 + np.exp(-np.clip(eta[:, None] - cut, -40, 40)))
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        prob = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-9)
        d_eta = -(slope[at, grades] - slope[at, grades + 1]) / prob / n
        d_cut = [np.where(grades == j + 1, slope[:, j + 1] / prob, np.where(grades == j, -slope[:, j + 1] / prob, 0)).sum() / n for j in range(k)]
        g = np.concatenate([np.bincount(local, d_eta[rows] * v, len(used)) + spec.penalty * w, [d_cut[0] + d_cut[1], d_cut[1] * np.exp(gap)]])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        step = 0.03 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-10)
        w -= step[:-2]
        base, gap = base - step[-2], gap - step[-1]
    weights[used] = w
    return OrdinalModel(weights, np.array([base, base + np.exp(gap)]), spec)


def fit_toxicity(docs: DataFrame, labels: DataFrame, spec: ToxicitySpec = ToxicitySpec(), label: str = "toxic") -> OrdinalModel:
    """Fit on a bounded sample of labelled documents, those with the smallest hashes of their id.

    The rows that quality labels may be learned from are also those for this label. Labels other than 0
    and 1, null ids and ids without a document take no part.
    """
    sample = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & training_share("doc_id"))
    sample = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(spec.training_rows)
    # At most training_rows rows, so that the broadcast is bounded; a fixed number of tasks reads their texts.
    known = columns_apart(docs, ["doc_id", "text"]).join(F.broadcast(stored(sample, "training-sample")), "doc_id")
    known = stored(known.select("y", "text", F.xxhash64("doc_id").alias("o")).repartition(16, "o"), "training-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros((2, spec.features), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            places, _, bounds = sparse_features(batch.column("text"), spec)
            of = np.repeat(y, np.diff(bounds))
            for k in (0, 1):
                found[k] += np.bincount(places[of == k], minlength=spec.features).astype(np.int32)
                rows[k] += int((y == k).sum())
        yield pa.record_batch([pa.array([found.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], names=["c", "n"])

    found, n = np.zeros((2, spec.features), np.int64), np.zeros(2, np.int64)
    for r in known.select("y", "text").repartition(16).mapInArrow(count, "c binary, n binary").toLocalIterator():
        found += np.frombuffer(r["c"], np.int32).reshape(2, -1)
        n += np.frombuffer(r["n"], np.int64)
    usable, telling = telling_features(found[1], found[0], int(n[1]), int(n[0]), spec)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, values, bounds = sparse_features(batch.column("text"), spec)
        cut, share = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            p, v = places[a:b], values[a:b]
            share.append(float((v[telling[p]] ** 2).sum() / max((v**2).sum(), 1)))
            keep = usable[p]
            cut.append((p[keep].astype(np.int32).tobytes(), v[keep].astype(np.float32).tobytes()))
        columns = [batch.column("o"), batch.column("y"), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary()), pa.array(share, pa.float64())]
        return pa.record_batch(columns, names=["o", "y", "p", "v", "s"])

    # Only features that stand out come to the driver, of at most training_rows documents.
    got = sorted(per_batch(known, run, "o long, y int, p binary, v binary, s double").collect(), key=lambda r: (r["o"], r["y"]))
    places = np.frombuffer(b"".join(bytes(r["p"]) for r in got), np.int32).astype(np.int64)
    values = np.frombuffer(b"".join(bytes(r["v"]) for r in got), np.float32).astype(np.float64)
    bounds = np.concatenate([[0], np.cumsum([len(r["p"]) // 4 for r in got])]).astype(np.int64)
    grades = graded(np.array([r["y"] for r in got], np.int64), np.array([r["s"] for r in got]))
    return fit_ordinal(places, values, bounds, grades, usable, spec)
