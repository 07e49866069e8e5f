"""Whole columns of text as byte arrays: word spans and span hashes without a loop over words.

A chunk is one uint8 array that holds the UTF-8 bytes of several documents, with the offsets of
their ends. All functions work on such chunks; a document is never split between two chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of one chunk; a longer document is a chunk by itself.
CHUNK_BYTES = 1 << 20

ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_CODES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd number and of its inverse, modulo 2**64; kept between calls."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (ODD, ODD_INVERSE))
    return _powers


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of documents of at most ``size`` bytes: (rows, bytes, offsets from 0)."""
    if not len(column):
        return
    data, ends = as_bytes(column)
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield slice(at, to), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def spans(inside: np.ndarray, ends: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``; no run crosses a document's end.

    ``breaks``: a class per byte; a run also ends where it changes.
    """
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(len(inside) + 1, bool)
    first[0] = first[-1] = True
    np.logical_not(inside[:-1], out=first[1:-1])
    if breaks is not None:
        first[1:-1] |= breaks[1:] != breaks[:-1]
    first[ends] = True
    last = first[1:].copy()
    last[:-1] |= ~inside[1:]
    return np.flatnonzero(inside & first[:-1]), np.flatnonzero(inside & last) + 1


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`span_hashes` takes the hash of any span."""
    up, _ = powers(len(codes) + 1)
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixing, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, wherever it stands: for the buckets of trained scorers, where two in one do no harm.

    A sum of products has texts that meet by rule; :func:`span_keys` is for spans that must be told apart.
    """
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def lower_codes() -> np.ndarray:
    """Byte codes under which A-Z equal a-z."""
    out = BYTE_CODES.copy()
    out[65:91] = out[97:123]
    return out


LOWER_CODES = lower_codes()
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] = LOWER_BYTES[97:123]
# Numbers of k bytes, by k.
BYTE_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
# 8-byte words of a span that are hashed side by side; longer spans are digested one by one.
LONG_WORDS = 32


def byte_windows(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)).copy()


def span_word(windows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """The k-th 8 bytes of every span as a number, without what stands after the span."""
    return windows[np.minimum(starts + 8 * k, len(windows) - 1)] & BYTE_MASKS[np.clip(lengths - 8 * k, 0, 8)]


def span_keys(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span's bytes, 128 bits together.

    The bytes go in eight at a time and are mixed before the next eight, so that no rule of the text's
    makes two spans meet, as it can where the hash is a sum of products; spans of up to 8 bytes and one length have
    different first hashes always. Spans above 256 bytes have a cryptographic digest.
    """
    lengths = stops - starts
    windows = byte_windows(data)
    size = lengths.astype(np.uint64)
    a, b = mixed(size * ODD + np.uint64(1)), mixed(size * ODD + np.uint64(2))
    some, k = np.flatnonzero(lengths <= 8 * LONG_WORDS), 0
    while len(some):
        word = span_word(windows, starts[some], lengths[some], k)
        if len(some) == len(a):
            a, b = mixed(a ^ word), mixed(b * ODD + word)
        else:
            a[some], b[some] = mixed(a[some] ^ word), mixed(b[some] * ODD + word)
        k += 1
        some = some[lengths[some] > 8 * k]
    for i in np.flatnonzero(lengths > 8 * LONG_WORDS).tolist():
        digest = hashlib.blake2b(data[starts[i] : stops[i]].tobytes(), digest_size=16).digest()
        a[i], b[i] = np.frombuffer(digest, np.uint64)
    return a, b


def blank_separated(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each of the lower-cased words between ASCII blanks, and per document where its words begin."""
    starts, stops = spans(~BLANK[data], ends)
    return *span_keys(LOWER_BYTES[data], starts, stops), np.searchsorted(starts, ends)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words in each document (fewer words: the whole as one).

    ``bounds``: where each document's words begin, and the end. Returns hashes and their bounds.
    """
    counts = np.diff(bounds)
    out_counts = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(out_counts)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], out_counts) + np.arange(out_bounds[-1])
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    out = np.zeros(len(first), np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    for k in range(width):
        out = out * ODD + padded[first + k]
    for d in short:
        h = np.uint64(0)
        for w in words[bounds[d] : bounds[d + 1]]:
            h = (h * ODD + w) & np.uint64(0xFFFFFFFFFFFFFFFF)
        out[out_bounds[d]] = h ^ np.uint64(counts[d])
    return mixed(out), out_bounds


def distinct_per_document(hashes: np.ndarray, second: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each document, sorted by the first, with the second beside it, and their bounds."""
    parts = []
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        a, b = hashes[x:y], second[x:y]
        order = np.argsort(a)
        a, b = a[order], b[order]
        same, other = a[1:] == a[:-1], b[1:] != b[:-1]
        if (same & other).any():
            # Two that share only the first hash: equal ones stand side by side only after a sort by both.
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            same, other = a[1:] == a[:-1], b[1:] != b[:-1]
        kept = np.ones(len(a), bool)
        kept[1:] = ~same | other
        parts.append((a[kept], b[kept]))
    sizes = np.fromiter((len(a) for a, _ in parts), np.int64, len(parts))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *[a for a, _ in parts]]), np.concatenate([none, *[b for _, b in parts]]), np.concatenate([[0], np.cumsum(sizes)])
