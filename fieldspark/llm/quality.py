"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Every word bucket has a sparse random index vector. A bucket's word vector is the sum of the index
vectors around its words in the whole corpus: tasks add up integers, the sums meet in bounded slices,
and the table has a fixed size. A document is the mean of its word vectors and the mean of the products
of neighbouring ones. Two dense layers in numpy are fitted on a bounded sample of labelled rows, and one
temperature on rows that the fit has not seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns_apart, per_batch, stored
from .text import chunks, mixed
from .words import training_share, word_hashes


@dataclass(frozen=True)
class QualitySpec:
    """Sizes and limits. ``training_rows`` bounds the labelled sample that the network is fitted on."""

    buckets: int = 8192
    sign_buckets: int = 256
    dimensions: int = 48
    nonzeros: int = 4
    window: int = 2
    slices: int = 32
    hidden: int = 32
    training_rows: int = 12_000
    epochs: int = 40
    seed: int = 7


def index_vectors(spec: QualitySpec) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzeros of every bucket's index vector."""
    rng = np.random.Generator(np.random.PCG64(spec.seed))
    return rng.integers(0, spec.dimensions, (spec.nonzeros, spec.buckets)), rng.choice([-1.0, 1.0], (spec.nonzeros, spec.buckets))


def bucketed(data: np.ndarray, ends: np.ndarray, spec: QualitySpec) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, and the words' bounds per document. Runs of signs have buckets of their own."""
    h, signs, bounds, _ = word_hashes(data, ends)
    words = spec.buckets - spec.sign_buckets
    out = np.where(signs, words + (h % np.uint64(spec.sign_buckets)).astype(np.int64), (h % np.uint64(words)).astype(np.int64))
    return out, bounds


def context_sums(docs: DataFrame, spec: QualitySpec) -> np.ndarray:
    """The summed index vectors around each bucket's words, over all documents: buckets x dimensions."""
    per_slice = spec.buckets // spec.slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(spec)
        total = np.zeros(spec.buckets * spec.dimensions)
        for batch in batches:
            for _, data, ends in chunks(batch.column("text")):
                b, bounds = bucketed(data, ends, spec)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for step in range(1, spec.window + 1):
                    near = np.flatnonzero(doc[step:] == doc[:-step])
                    for own, other in ((near, near + step), (near + step, near)):
                        for k in range(spec.nonzeros):
                            total += np.bincount(b[own] * spec.dimensions + places[k, b[other]], signs[k, b[other]], len(total))
        parts = total.astype(np.int64).reshape(spec.slices, -1)
        full = np.flatnonzero(parts.any(axis=1))
        salt = TaskContext.get().partitionId() % 64
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), salt, np.int32)), pa.array([parts[i].tobytes() for i in full], pa.binary())], names=["slice", "salt", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = np.zeros(per_slice * spec.dimensions, np.int64), None
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("slice")[i]
                total += np.frombuffer(batch.column("sums")[i].as_buffer(), np.int64)
        yield pa.record_batch([pa.array([key.as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "salt", "sums"])

    schema = "slice int, salt int, sums binary"
    sums = columns_apart(docs, ["text"]).mapInArrow(count, schema)
    # Two steps: what one task adds up stays bounded by the number of tasks over 64.
    sums = sums.groupBy("slice", "salt").applyInArrow(added, schema).groupBy("slice").applyInArrow(added, schema)
    out = np.zeros((spec.slices, per_slice * spec.dimensions), np.int64)
    for row in sums.collect():
        out[row["slice"]] = np.frombuffer(row["sums"], np.int64)
    return out.reshape(spec.buckets, spec.dimensions)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context sums at unit length; buckets without context are zero."""
    norm = np.sqrt((sums.astype(float) ** 2).sum(axis=1, keepdims=True))
    return (sums / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray, spec: QualitySpec) -> np.ndarray:
    """Two pooled vectors per document, side by side; documents without words are zero."""
    width = vectors.shape[1]
    out = np.zeros((len(column), 2 * width), np.float32)
    for rows, data, ends in chunks(column, 1 << 18):
        b, bounds = bucketed(data, ends, spec)
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        v = vectors[b]
        at = np.arange(rows.start, rows.stop)[full]
        out[at, :width] = np.add.reduceat(v, bounds[full], axis=0) / n[full, None]
        # The last word of a document has no right neighbour.
        v[:-1] *= v[1:]
        v[bounds[full + 1] - 1] = 0
        out[at, width:] = np.add.reduceat(v, bounds[full], axis=0) / np.maximum(n[full, None] - 1, 1)
    return out


@dataclass
class Network:
    """Two dense layers on standardised inputs; probabilities are calibrated by one temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = field(default=None)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, spec: QualitySpec) -> Network:
    """Adam on the log loss. With fewer than two classes the score is a constant: their label, or 0.5."""
    width = x.shape[1]
    rng = np.random.Generator(np.random.PCG64(spec.seed))
    net = Network(np.zeros(width), np.ones(width), rng.normal(0, (2 / width) ** 0.5, (width, spec.hidden)), np.zeros(spec.hidden), rng.normal(0, spec.hidden**-0.5, spec.hidden), 0.0)
    if len(np.unique(y)) < 2:
        net.constant = float(y[0]) if len(y) else 0.5
        return net
    order = rng.permutation(len(x))
    held = order[: len(x) // 5] if len(x) >= 50 else order[:0]
    own = order[len(held) :]
    x = x.astype(np.float64)
    net.centre, net.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    z = (x - net.centre) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(spec.epochs):
        rng.shuffle(own)
        for a in range(0, len(own), 128):
            part = own[a : a + 128]
            zb, yb = z[part], y[part]
            hidden = np.maximum(zb @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -40, 40)))
            d = (p - yb) / len(part)
            dh = np.outer(d, params[2]) * (hidden > 0)
            grads = [zb.T @ dh + 1e-4 * params[0], dh.sum(axis=0), hidden.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            t += 1
            rate = 3e-3 * (1 - epoch / spec.epochs) + 1e-4
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(held) and len(np.unique(y[held])) == 2:
        s, yh = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.2), np.log(20), 120))
        losses = [np.logaddexp(0, np.where(yh > 0, -1, 1) * s / g).mean() for g in grid]
        net.temperature = float(grid[int(np.argmin(losses))])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network
    spec: QualitySpec

    def probability(self) -> Callable[[Column], Column]:
        """A column function: the score of a text column, from the text alone; a null text counts as empty."""
        vectors, network, spec = self.vectors, self.network, self.spec

        def run(text: pa.Array) -> pa.Array:
            return pa.array(network.probabilities(pooled(text, vectors, spec)))

        return F.arrow_udf(run, "double")

    def score(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """``keep`` columns and ``score``, one row per row of ``docs``; other columns, whatever their names, take no part.

        Null and repeated ids are kept, texts of any length are read whole, and an empty table gives an empty result.
        """
        if "score" in keep:
            raise ValueError("a kept column cannot have the name of the result")
        return columns_apart(docs, [*dict.fromkeys([*keep, "text"])]).select(*[f"`{c}`" for c in keep], self.probability()("text").alias("score"))

    def accepted(self, docs: DataFrame, least: float = 0.5) -> DataFrame:
        """The rows of ``docs``, all their columns, whose score is at least ``least``. Columns of any name and type stay as they are."""
        return docs.filter(self.probability()(F.col("text")) >= least)


def fit_quality(docs: DataFrame, labels: DataFrame, spec: QualitySpec = QualitySpec(), label: str = "quality") -> QualityModel:
    """Word vectors from all documents, the network from a bounded sample of the labels that may be learned.

    Labels other than 0 and 1, null ids and ids without a document take no part. With repeated rows each
    is an example. The sample are the rows with the smallest hashes of their id.
    """
    vectors = word_vectors(context_sums(docs, spec))
    sample = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & training_share("doc_id"))
    # At most training_rows rows, so that the broadcast is bounded.
    sample = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(spec.training_rows)
    sample = stored(sample, "training-sample")
    known = columns_apart(docs, ["doc_id", "text"]).join(F.broadcast(sample), "doc_id").select("y", "text", F.xxhash64("doc_id").alias("o"))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pooled(batch.column("text"), vectors, spec)
        return pa.record_batch([batch.column("o"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["o", "y", "x"])

    got = sorted(per_batch(known, features, "o long, y int, x binary").collect())
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(len(got), 2 * spec.dimensions)
    return QualityModel(vectors, fit_network(x, np.array([r["y"] for r in got], np.float64), spec), spec)
