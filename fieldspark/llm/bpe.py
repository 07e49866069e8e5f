"""Byte-level BPE from a rank file, encoding and decoding.

Pre-tokens come from the scan in ``pretokens``; a table in front of the merges holds the ids of those met
before. Each merge joins the leftmost pair of lowest rank. Decoding is a gather from the vocabulary's bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PieceCache, gathered
from .shared import columns_apart, per_batch
from .text import chunks

# Longer pieces are merged with a heap.
SHORT_PIECE = 48


def ranks_of(file: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in file.splitlines() if line)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > SHORT_PIECE:
        return merged_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, len(ranks)
    costs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while costs:
        best = min(costs)
        if best == none:
            break
        i = costs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            costs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long pieces: neighbours in linked lists, pairs in a heap by rank and place."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            r = ranks.get(piece[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if gone[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        gone[j], end[i], after[i] = 1, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


_caches: dict[bytes, PieceCache] = {}


def rank_cache(file: bytes) -> PieceCache:
    """The table in front of the merges, one per process and rank file."""
    key = hashlib.sha256(file).digest()
    if key not in _caches:
        ranks = ranks_of(file)

        def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = [merged(p, ranks) for p in pieces]
            return np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

        _caches[key] = PieceCache(encode)
    return _caches[key]


def bpe_encode(docs: DataFrame, rank_file: bytes, with_slices: bool = True) -> DataFrame:
    """``doc_id, ids`` and ``slice_starts``, the byte offsets in the text of its pre-tokens.

    Null texts count as empty: no ids. Null and repeated doc_ids are kept; other columns are ignored, whole texts of any
    length are read, and an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = rank_cache(rank_file)
        ids, id_ends, slices, slice_ends = [], [np.zeros(1, np.int64)], [], [np.zeros(1, np.int64)]
        for _, data, ends in chunks(batch.column("text")):
            own, bounds, starts, slice_bounds, _ = cache.ids_of(data, ends)
            ids.append(own.astype(np.int32))
            id_ends.append(bounds[1:] + id_ends[-1][-1])
            if with_slices:
                slices.append((starts - np.repeat(ends[:-1], np.diff(slice_bounds))).astype(np.int32))
                slice_ends.append(slice_bounds[1:] + slice_ends[-1][-1])
        out = [batch.column("doc_id"), listed(id_ends, ids)]
        if with_slices:
            out.append(listed(slice_ends, slices))
        return pa.record_batch(out, names=["doc_id", "ids", "slice_starts"][: len(out)])

    rows = columns_apart(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_batch(rows, run, "doc_id long, ids array<int>" + (", slice_starts array<int>" if with_slices else ""))


def listed(ends: list[np.ndarray], values: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(flat))


def bpe_decode(encoded: DataFrame, rank_file: bytes) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of ``ids``. A null id array gives null; an unknown id is an error."""
    kept = encoded.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, starts, sizes = vocabulary_bytes(rank_file)
        column = batch.column("ids")
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(sizes) or not sizes[flat].all()):
            raise ValueError("an id is not in the vocabulary")
        counts = np.array(column.value_lengths().fill_null(0), np.int64)
        lengths = sizes[flat]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = sums[np.concatenate([[0], np.cumsum(counts)])]
        raw = data[gathered(starts[flat], lengths)] if len(flat) else np.zeros(0, np.uint8)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw.tobytes())])
        if column.null_count:
            whole = pa.array([None if n else v for n, v in zip(column.is_null().to_pylist(), whole.to_pylist())], pa.large_binary())
        return pa.record_batch([*[batch.column(c) for c in kept], whole.cast(pa.binary())], names=[*kept, "decoded"])

    return per_batch(encoded, run, schema)


_vocabularies: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def vocabulary_bytes(rank_file: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and where each id's begin and how many they are."""
    key = hashlib.sha256(rank_file).digest()
    if key not in _vocabularies:
        ranks = ranks_of(rank_file)
        by_id: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            by_id[r] = t
        sizes = np.fromiter(map(len, by_id), np.int64, len(by_id))
        _vocabularies[key] = np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(sizes) - sizes, sizes
    return _vocabularies[key]
