"""Best-fit packing of token pieces into fixed-length sequences.

A piece is a demand vector (tokens, one document, attention cost = squared length) and a sequence a bin
with a capacity for each. Pieces of one length have equal demands, so the packing needs only the
histogram of lengths, which has at most ``tokens`` entries whatever the input size. Bins of equal
residuals are one group; each length in turn, longest first, goes to the feasible group that the chosen
score prefers. The plan is a small table of ranges (length, ranks, bins), and every piece finds its own
place by its rank among the pieces of its length, which Spark counts in salted parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pretokens import added_token_cache, library_cache
from .shared import columns_apart, per_batch, stored
from .text import chunks

# Pieces of one length that are ranked together, about; up to PARTS parts of a length are smaller, down to SMALL pieces.
PART, PARTS, SMALL = 1 << 17, 64, 256


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. By default documents and attention cost never bind before tokens do."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def encoded_documents(column: pa.Array, definition: bytes, end_id: int | None, added_tokens: bool = False) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, ids, bounds of each document's ids) for runs of documents; null counts as empty.

    ``added_tokens``: strings of added tokens have their own ids, as by default in the library; else they are text.
    """
    cache = added_token_cache(definition) if added_tokens else library_cache(definition)
    for rows, data, ends in chunks(column):
        ids, bounds, *_ = cache.ids_of(data, ends)
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end_id))
            bounds = bounds + np.arange(len(bounds))
        yield rows, ids, bounds


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens: only the first may be shorter."""
    return ([n % most] if n % most else []) + [most] * (n // most)


def token_pieces(docs: DataFrame, definition: bytes, end_id: int = 0, tokens: int = 2048, with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document's pieces.

    Null texts count as empty and give one piece with the end id. Null and repeated ids are kept; other
    columns are ignored, whole texts of any length are cut, and an empty table gives an empty result. ``definition``: a tokenizer file of the tokenizers library; ``added_tokens``: as in
    :func:`encoded_documents`.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc_ids = batch.column("doc_id").to_pylist()
        out: list[list] = [[], [], [], [], [], []]
        for rows, ids, bounds in encoded_documents(batch.column("text"), definition, end_id, added_tokens):
            for d, a, b in zip(doc_ids[rows], bounds[:-1].tolist(), bounds[1:].tolist()):
                at = a
                for k, n in enumerate(cut_lengths(b - a, tokens)):
                    part = ids[at : at + n]
                    for x, v in zip(out, (d, k, at - a, n, zlib.crc32(part.astype("<u4").tobytes()))):
                        x.append(v)
                    if with_ids:
                        out[5].append(part.astype(np.int32))
                    at += n
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
        return pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return per_batch(columns_apart(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def best_fit_plan(histogram: Mapping[int, int], capacity: Capacity = Capacity(), score: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where the pieces of each length go, and the number of bins.

    Rows are (length, first rank, pieces, first bin, pieces per bin, offset): the j-th of these pieces
    goes to bin ``first bin + j // per bin``, at ``offset + (j % per bin) * length``. ``score``: "norm"
    prefers the bins whose weighted residual is smallest after the piece, "dot" those whose residual
    has the smallest weighted dot product with the piece; every capacity must hold the piece.
    """
    if score not in ("norm", "dot"):
        raise ValueError("score is 'norm' or 'dot'")
    whole = capacity.vector()
    w = np.array(weights)
    state = np.zeros((1024, 5), np.int64)  # residual tokens, documents, attention; first bin; bins
    used, bins, plan = 0, 0, []

    def add(residual: np.ndarray, first: int, count: int) -> None:
        nonlocal state, used
        if used == len(state):
            state = np.concatenate([state[: used], np.zeros_like(state)])
        state[used] = (*residual, first, count)
        used += 1

    for length in sorted(histogram, reverse=True):
        left, rank = int(histogram[length]), 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((state[:used, 4] > 0) & (state[:used, :3] >= need).all(axis=1))
            if len(fits):
                share = state[fits, :3] / whole
                after = share - need / whole
                value = ((after**2) * w).sum(axis=1) if score == "norm" else (share * (need / whole) * w).sum(axis=1)
                g = fits[np.argmin(value)]
                n = min(left, int(state[g, 4]))
                first, residual = int(state[g, 3]), state[g, :3].copy()
                plan.append((length, rank, n, first, 1, int(whole[0] - residual[0])))
                state[g, 3] += n
                state[g, 4] -= n
                add(residual - need, first, n)
            else:
                per_bin = int((whole // need).min())
                full, n = left // per_bin, left
                if full:
                    n = full * per_bin
                    plan.append((length, rank, n, bins, per_bin, 0))
                    add(whole - per_bin * need, bins, full)
                    bins += full
                else:
                    plan.append((length, rank, n, bins, n, 0))
                    add(whole - n * need, bins, 1)
                    bins += 1
            left -= n
            rank += n
        if used > 512:
            # Bins without room, and groups that were used up, go.
            kept = state[:used][(state[:used, 4] > 0) & (state[:used, :3].min(axis=1) > 0)]
            state, used = np.concatenate([kept, np.zeros_like(state)]), len(kept)
    return plan, bins


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), score: str = "norm", key: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every sequence is filled from 0 without gaps.

    ``pieces`` needs ``length`` (at least 1) and the ``key`` columns, which only order pieces of equal
    length: rows with equal keys are the same piece twice and both get a place. Nulls are allowed in the
    key. An empty table gives an empty result.
    """
    rows = stored(pieces, "pieces")
    histogram = {r[0]: r[1] for r in rows.groupBy("length").agg(F.count(F.lit(1))).collect()}
    # A piece that fills a sequence has one for itself, whatever its rank, and is not sorted.
    n_full = histogram.pop(capacity.tokens, 0)
    if n_full and capacity.attention is not None and capacity.attention < capacity.tokens**2:
        raise ValueError(f"a piece of {capacity.tokens} tokens fits no sequence")
    plan, bins = best_fit_plan(histogram, capacity, score)
    spark = pieces.sparkSession
    own = [F.col(f"`{c}`") for c in pieces.columns]
    full = rows.filter(F.col("length") == capacity.tokens).select(*own, (F.lit(bins) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    slots = spark.createDataFrame(plan or [], "length long, __rank long, __count long, __bin long, __per long, __at long")
    # Lengths are ranked in parts, so that a length that many pieces have is sorted by many tasks.
    parts = spark.createDataFrame([(n, max(-(-c // PART), min(PARTS, -(-c // SMALL)))) for n, c in histogram.items()], "length long, __parts long")
    rest = rows.filter(F.col("length") != capacity.tokens).join(F.broadcast(parts), "length")
    rest = rest.withColumn("__salt", F.pmod(F.xxhash64(*key), F.col("__parts"))).drop("__parts")
    counts = rest.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    # At most PARTS rows per length, or one per PART pieces, and a few per length: both tables are small at any size.
    offsets = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = rest.withColumn("__r", F.row_number().over(W.partitionBy("length", "__salt").orderBy(*key)) - 1)
    placed = ranked.join(F.broadcast(offsets), ["length", "__salt"]).withColumn("__r", F.col("__r") + F.col("__before"))
    found = placed.join(F.broadcast(slots.withColumnRenamed("length", "__length")), (F.col("length") == F.col("__length")) & F.col("__r").between(F.col("__rank"), F.col("__rank") + F.col("__count") - 1))
    j = F.col("__r") - F.col("__rank")
    ranged = found.select(
        *own,
        (F.col("__bin") + F.floor(j / F.col("__per"))).cast("long").alias("sequence_id"),
        (F.col("__at") + (j % F.col("__per")) * F.col("length")).cast("long").alias("offset"),
    )
    return ranged.unionAll(full)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, starts`` of each sequence, from packed pieces that carry ``ids``.

    A sequence has at most its capacity of ids, so that no group grows with the input.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts")
    )
