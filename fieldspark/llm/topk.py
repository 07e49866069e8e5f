"""Exact top-k search: term-at-a-time accumulation of integer inner products.

A vector component is a term. Query rows go to all tasks in blocks of bounded size; the candidates stay where
they are stored. A task takes its candidates in blocks, builds their postings per term, scatters every query's
weighted postings into a dense score array, takes the k best of the block by partition selection, and
merges them with those it has. Only k rows a query leave a task, and two merges leave the k best.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import columns_apart, stored

# Query rows that go to the tasks together, and candidates scored at once: their products bound a task's arrays.
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 16384
# Parts of the first merge.
MERGES = 64

RESULT = "query_id long, salt int, vec_id long, score long"


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, v)`` with v = floor(scale * x) per component, one row per row that takes part.

    Rows with a null id, a null vector, or a null, NaN or infinite component take no part. Repeated ids are
    rows of their own. An empty vector scores 0 against all.
    """
    rows = columns_apart(vectors, [id_column, vector_column]).toDF("vec_id", "v")
    # An infinite component less itself is NaN, as NaN less itself.
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double") - x.cast("double")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are padded with zeros."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    lengths = np.diff(ends)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], lengths)] = flat[ends[0] : ends[-1]]
    return out


def score_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query row the ids and scores of its k best candidates of a block, best first; rows of its own id are none.

    Raises ArithmeticError where scores could pass 64 bits.
    """
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound >= 1 << 63:
        raise ArithmeticError("components too large for 64-bit scores")
    kind = np.int32 if bound < 1 << 31 else np.int64
    order = np.argsort(c_ids, kind="stable")
    c_ids, c, q = c_ids[order], c[order].astype(kind), q.astype(kind)
    postings = []
    for t in range(c.shape[1]):
        where = np.flatnonzero(c[:, t])
        postings.append((slice(None) if len(where) == len(c) else where, np.ascontiguousarray(c[where, t])))
    out = []
    first, last = np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")
    for a, b, row in zip(first.tolist(), last.tolist(), q):
        scores = np.zeros(len(c), kind)
        for t in np.flatnonzero(row):
            where, weights = postings[t]
            scores[where] += row[t] * weights
        there = np.concatenate([np.arange(a), np.arange(b, len(c))])
        if len(there) > k:
            # Everything above the k-th score, then ties in id order.
            kth = np.partition(scores[there], len(there) - k)[len(there) - k]
            above = there[scores[there] > kth]
            there = np.concatenate([above, there[scores[there] == kth][: k - len(above)]])
        out.append(merged(c_ids[there], scores[there].astype(np.int64), k))
    return out


def merged(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, highest score first, ties to the smaller id."""
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k highest inner products of each query among all rows of other ids.

    ``vectors``: ``(vec_id long, v array<long>)``, as :func:`quantised` gives it; ``is_query``: a condition on vec_id.
    Returns ``query_id, rank, vec_id, score``, ranks from 1, ties to the smaller id. Ids may repeat: every row is a
    candidate of the queries of other ids, and the rows of one query id are one query, whose k best are those of all its
    rows together. A query with no other row gives none; an empty table gives an empty result. Components whose scores could pass 64 bits raise an error. Query rows are
    taken in blocks, each of which is a pass over the stored vectors.
    """
    rows = vectors.select("vec_id", "v").withColumn("q", F.coalesce(is_query, F.lit(False)))
    rows = stored(rows, "topk-vectors")
    n_queries, width = rows.agg(F.count_if("q"), F.max(F.size("v"))).first()
    blocks, width = max(1, -(-(n_queries or 0) // query_block)), max(1, width or 1)
    parts = [_block(rows, b, blocks, width, k, candidate_block) for b in range(blocks)]
    # Of several blocks each is written before the next is sent.
    best = functools.reduce(DataFrame.unionAll, [stored(p, "topk-block") for p in parts] if blocks > 1 else parts)
    order = [F.desc("score"), F.asc("vec_id")]
    best = best.withColumn("r", F.row_number().over(W.partitionBy("query_id", "salt").orderBy(*order))).filter(F.col("r") <= k)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _block(rows: DataFrame, block: int, blocks: int, width: int, k: int, candidate_block: int) -> DataFrame:
    """The k best of every task for one block of query rows."""
    queries = rows.filter(F.col("q") & (F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == block)).select("vec_id", "v").toArrow().combine_chunks()
    q_ids = queries["vec_id"].to_numpy()
    q = _matrix(pa.concat_arrays(queries["v"].chunks), width) if len(q_ids) else np.zeros((0, width), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(q_ids)
        held: list[pa.RecordBatch] = []

        def scored() -> None:
            c_ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
            c = np.concatenate([_matrix(b.column("v"), width) for b in held])
            for i, (ids, scores) in enumerate(score_block(q_ids, q, c_ids, c, k)):
                best[i] = merged(np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], scores]), k)

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= candidate_block:
                scored()
                held, n = [], 0
        if n:
            scored()
        sizes = [len(ids) for ids, _ in best]
        salt = np.full(sum(sizes), TaskContext.get().partitionId() % MERGES, np.int32)
        columns = [np.repeat(q_ids, sizes), salt, np.concatenate([none, *[x for x, _ in best]]), np.concatenate([none, *[x for _, x in best]])]
        yield pa.record_batch([pa.array(x) for x in columns], names=["query_id", "salt", "vec_id", "score"])

    return rows.select("vec_id", "v").mapInArrow(run, RESULT)
