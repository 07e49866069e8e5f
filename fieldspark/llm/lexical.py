"""Ranked lexical search with pair-bound MaxScore, in integer scores.

Documents become vectors of the terms that some item asks for, counted by tasks where they lie and stored
once; only the statistics (documents, terms, documents per term) are added up over all of them. A task then
takes its stored documents in blocks of bounded size. For a block it builds posting lists with impacts, and
for the pairs of terms that items ask for the list of documents that hold both, with their joint impacts.
A pair adds at most the largest of its joint impacts and of its two terms' own maxima to a document, which
is less than the two maxima together wherever the terms' best documents differ.

An item's pairs are taken by falling bound. Those whose bounds together stay below the item's k-th best score
so far open no documents. Documents that others opened are dropped as soon as what they have and the bounds of
what is left cannot reach that score. The score so far is kept from block to block of a task. Tasks give k
rows an item, and two merges leave the k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import columns_apart, per_batch, stored
from .text import chunks, spans

# Documents whose postings are in memory at once, and postings that end a block early.
BLOCK_DOCUMENTS, BLOCK_POSTINGS = 4096, 1 << 22
# Terms of the items that are searched for together, with repeats: the bound of what tasks are sent.
ITEM_TERMS = 1 << 14
# Parts of the first merge.
MERGES = 64

NO_ID = np.iinfo(np.int64).max


def _term_bytes() -> np.ndarray:
    out = np.zeros(256, bool)
    out[48:58] = out[65:91] = out[97:123] = out[128:] = True
    return out


def _lower_bytes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] = out[97:123]
    return out


TERM_BYTES, LOWER = _term_bytes(), _lower_bytes()


def terms_of(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[slice, pa.Array, np.ndarray]]:
    """(rows, terms with repeats, bounds per document) for runs of documents."""
    for rows, data, ends in chunks(column, size):
        inside = TERM_BYTES[data]
        starts, stops = spans(inside, ends)
        offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
        body = LOWER[data[inside]]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        yield rows, words, np.searchsorted(starts, ends)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, terms``: the distinct terms of every item. Rows of one id are one item; without id there is none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, terms = [], []
        own = batch.column("item_id").to_numpy()
        for rows, words, bounds in terms_of(batch.column("text")):
            ids.append(np.repeat(own[rows], np.diff(bounds)))
            terms.append(words.cast(pa.large_string()))
        return pa.record_batch([pa.array(np.concatenate(ids)), pa.concat_arrays(terms).cast(pa.string())], names=["item_id", "term"])

    rows = columns_apart(items, ["item_id", "text"]).filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return per_batch(rows, run, "item_id long, term string").groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def term_vectors(docs: DataFrame, vocabulary: Sequence[bytes]) -> DataFrame:
    """``doc_id, n, terms, counts``: all terms of a document counted, and those of the vocabulary by their place in it.

    Documents without a term are left out.
    """
    words_known = pa.array(vocabulary, pa.large_binary())
    width = max(1, len(vocabulary))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, ends, terms, counts = [], [], [np.zeros(1, np.int64)], [], []
        own = batch.column("doc_id")
        at = 0
        for rows, words, bounds in terms_of(batch.column("text")):
            n = np.diff(bounds)
            place = pc.index_in(words, value_set=words_known).fill_null(-1).to_numpy().astype(np.int64)
            known = np.flatnonzero(place >= 0)
            keys, tf = np.unique(np.repeat(np.arange(len(n)), n)[known] * width + place[known], return_counts=True)
            full = np.flatnonzero(n)
            ids.append(own.slice(rows.start, rows.stop - rows.start).take(pa.array(full)))
            sizes.append(n[full])
            ends.append(at + np.cumsum(np.bincount(keys // width, minlength=len(n))[full]))
            at += len(keys)
            terms.append(keys % width)
            counts.append(tf)
        offsets = pa.array(np.concatenate(ends), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (terms, counts)]
        return pa.record_batch([pa.concat_arrays(ids), pa.array(np.concatenate(sizes).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = columns_apart(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_batch(rows, run, "doc_id long, n long, terms array<int>, counts array<int>")


def term_weight(n_documents: int, n_holding: int) -> int:
    """floor(1000 * ln((2N + 2) / (2 df + 1))), in doubles."""
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * n_holding + 1)))


@dataclass(frozen=True)
class Queries:
    """What tasks need to know: term weights, pairs of terms, the pairs of every item, and the corpus counts.

    Terms of an item are paired in the order of their weights, the last of an odd number with none (-1).
    """

    weights: np.ndarray
    pairs: np.ndarray
    items: list[np.ndarray]
    n_documents: int
    n_terms: int


def paired(terms: Sequence[Sequence[int]], weights: np.ndarray, n_documents: int, n_terms: int) -> Queries:
    """The pairs of all items; a pair that several items ask for is there once. Terms of weight 0 score nothing."""
    places: dict[tuple[int, int], int] = {}
    items = []
    for own in terms:
        own = sorted((t for t in own if weights[t] > 0), key=lambda t: (-weights[t], t))
        both = [(t, own[i + 1] if i + 1 < len(own) else -1) for i, t in enumerate(own) if i % 2 == 0]
        items.append(np.array([places.setdefault(p, len(places)) for p in both], np.int64))
    return Queries(weights, np.array(list(places), np.int64).reshape(-1, 2), items, n_documents, n_terms)


class BlockIndex:
    """Posting lists of a block of documents, and the intersection lists of pairs with their joint impacts.

    ``ids`` ascend, so that a document's place breaks ties. ``bound[p]`` is the most that pair p adds to a
    document, ``single[p]`` the most it adds to one that holds only one of the two.
    """

    def __init__(self, queries: Queries, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        m = 10 + 90 * n * queries.n_documents // max(1, queries.n_terms)
        impact = queries.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        doc = place[doc]
        by = np.lexsort((doc, term))
        self.docs, self.impacts = doc[by], impact[by]
        self.starts = np.searchsorted(term[by], np.arange(len(queries.weights) + 1))
        held = np.flatnonzero(np.diff(self.starts))
        self.most = np.zeros(len(queries.weights) + 1, np.int64)  # the last place is that of term -1
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impacts, self.starts[held])
        self.both: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.zeros(0, np.int64)
        joint_most = np.zeros(len(queries.pairs), np.int64)
        dense = np.zeros(len(ids), np.int64)
        for p, (t, u) in enumerate(queries.pairs.tolist()):
            if not (self.most[t] and self.most[u]):
                self.both.append((none, none))
                continue
            (a, x), (b, y) = self.postings(t), self.postings(u)
            dense[a] = x
            other = dense[b]
            dense[a] = 0
            hit = np.flatnonzero(other)
            joint = other[hit] + y[hit]
            joint_most[p] = joint.max(initial=0)
            self.both.append((b[hit], joint))
        self.single = self.most[queries.pairs].max(axis=1, initial=0)
        self.bound = np.maximum(joint_most, self.single)
        self.pairs = queries.pairs

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        if t < 0:
            return self.docs[:0], self.impacts[:0]
        part = slice(self.starts[t], self.starts[t + 1])
        return self.docs[part], self.impacts[part]

    def search(self, pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of documents; every one with a score above 0 that is not below ``least`` is there."""
        pairs = pairs[np.argsort(-self.bound[pairs], kind="stable")]
        pairs = pairs[self.bound[pairs] > 0]
        # left[i]: the most that the pairs from i on add together.
        left = np.append(np.cumsum(self.bound[pairs][::-1])[::-1], 0)
        opening = int((left[:-1] >= max(1, least)).sum())
        total = np.zeros(len(self.ids), np.int64)
        for p in pairs[:opening].tolist():
            for t in self.pairs[p].tolist():
                docs, impacts = self.postings(t)
                total[docs] += impacts
        found = np.flatnonzero(total)
        scores = total[found]
        for i, p in enumerate(pairs[opening:].tolist(), opening):
            keep = scores + left[i] >= least
            found, scores = found[keep], scores[keep]
            if not len(found):
                break
            docs, joint = self.both[p]
            at, hit = _lookup(docs, found)
            # A document that holds both terms has its joint impact; the others add one term's at most.
            gain = np.zeros(len(found), np.int64)
            gain[hit] = joint[at[hit]]
            open_to = np.flatnonzero(~hit & (scores + self.single[p] + left[i + 1] >= least))
            for t in self.pairs[p].tolist():
                docs, impacts = self.postings(t)
                at, has = _lookup(docs, found[open_to])
                gain[open_to[has]] += impacts[at[has]]
            scores = scores + gain
        keep = scores >= least
        return found[keep], scores[keep]


def _lookup(docs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted documents stand in an ascending list, and whether they are in it."""
    at = np.searchsorted(docs, wanted)
    if not len(docs):
        return at, np.zeros(len(wanted), bool)
    at = np.minimum(at, len(docs) - 1)
    return at, docs[at] == wanted


class BestSoFar:
    """The k best (score, id) of every item; of equal scores the smallest ids."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * n_items
        self.ids = [np.zeros(0, np.int64)] * n_items

    def least(self, item: int) -> int:
        """Documents below this score cannot be among the best."""
        return int(self.scores[item][-1]) if len(self.scores[item]) == self.k else 1

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """``ids`` ascend."""
        if len(ids) > self.k:
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            above, equal = np.flatnonzero(scores > kth), np.flatnonzero(scores == kth)
            some = np.concatenate([above, equal[: self.k - len(above)]])
            ids, scores = ids[some], scores[some]
        ids, scores = np.concatenate([self.ids[item], ids]), np.concatenate([self.scores[item], scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids[item], self.scores[item] = ids[best], scores[best]


def search_task(batches: Iterator[pa.RecordBatch], queries: Queries, k: int) -> BestSoFar:
    """The k best documents of every item among a task's stored vectors, block by block."""
    best = BestSoFar(len(queries.items), k)
    held: list[pa.RecordBatch] = []
    rows = postings = 0

    def block() -> None:
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t.column("doc_id").fill_null(NO_ID).to_numpy()
        terms, counts = t.column("terms").combine_chunks(), t.column("counts").combine_chunks()
        doc = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
        index = BlockIndex(queries, ids, t.column("n").to_numpy(), doc, terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64))
        for item, pairs in enumerate(queries.items):
            if len(pairs):
                found, scores = index.search(pairs, best.least(item))
                if len(found):
                    best.add(item, index.ids[found], scores)

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_DOCUMENTS):
            part = batch.slice(at, BLOCK_DOCUMENTS)
            held.append(part)
            rows += part.num_rows
            postings += len(part.column("terms").flatten())
            if rows >= BLOCK_DOCUMENTS or postings >= BLOCK_POSTINGS:
                block()
                held, rows, postings = [], 0, 0
    if held:
        block()
    return best


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, together: int = ITEM_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of highest score above 0 for every item.

    ``docs``: ``doc_id, text``; ``items``: ``item_id, text``; other columns are ignored. Terms are maximal runs of
    letters, digits and signs beyond ASCII, A-Z lower-cased, of the whole text; a null or empty text has none. Each
    row of ``docs`` is a document, also where ids repeat; one without an id counts in the statistics and may be
    found (doc_id null), after others of its score. Rows of ``items`` with one id are one item, rows without an
    id none; items that nothing matches have no rows, and an empty table gives an empty result. Equal scores rank by
    doc_id. Items are searched for in blocks of about ``together`` terms, each a pass over the documents.
    """
    asked = stored(item_terms(items), "lexical-items")
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-n_terms // together))
    out = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        found = _search_block(docs, own, k)
        out = found if out is None else out.unionAll(found)
    return out


def _search_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    vocabulary = sorted({t.encode() for r in items for t in r["terms"]})
    place = {t: i for i, t in enumerate(vocabulary)}
    vectors = stored(term_vectors(docs, vocabulary), "lexical-vectors")
    n_documents, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    holding = dict(map(tuple, vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect()))
    weights = np.array([term_weight(n_documents, holding.get(i, 0)) if holding.get(i) else 0 for i in range(len(vocabulary))], np.int64)
    queries = paired([[place[t.encode()] for t in r["terms"]] for r in items], weights, n_documents, n_terms or 0)
    item_ids = np.array([r["item_id"] for r in items], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = search_task(batches, queries, k)
        ids = np.concatenate([np.zeros(0, np.int64), *best.ids])
        salt = np.full(len(ids), TaskContext.get().partitionId() % MERGES, np.int32)
        columns = [pa.array(np.repeat(item_ids, [len(x) for x in best.ids])), pa.array(salt), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([np.zeros(0, np.int64), *best.scores]))]
        yield pa.record_batch(columns, names=["item_id", "salt", "doc_id", "score"])

    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    tops = vectors.filter(F.size("terms") > 0).mapInArrow(run, "item_id long, salt int, doc_id long, score long")
    tops = tops.withColumn("r", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("r") <= k)
    ranked = tops.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
