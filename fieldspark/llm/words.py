"""Words and sign runs of documents as hashed buckets, for the trained scorers."""

from __future__ import annotations

import numpy as np

from .text import LOWER_CODES, mixed, prefix_hashes, span_hashes, spans

BLANK, WORD, SIGN = 0, 1, 2


def _classes() -> np.ndarray:
    out = np.full(256, SIGN, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = BLANK
    out[48:58] = out[65:91] = out[97:123] = out[128:] = WORD
    return out


CLASSES = _classes()


def word_hashes(data: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Per word or run of signs: hash, whether it is of signs, then bounds per document, and hashes of the first bytes."""
    kinds = CLASSES[data]
    starts, stops = spans(kinds > 0, ends, kinds)
    with np.errstate(over="ignore"):
        sums = prefix_hashes(LOWER_CODES[data])
        whole = span_hashes(sums, starts, stops)
        first = [mixed(span_hashes(sums, starts, np.minimum(stops, starts + p)) + np.uint64(p)) for p in prefixes]
    return whole, kinds[starts] == SIGN, np.searchsorted(starts, ends), first


def training_share(doc_id) -> "Column":  # noqa: F821
    """True for rows whose labels may be learned from: crc32 of the id's text, modulo 3, is not 1."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(True))
