"""Near-duplicate documents by MinHash with tensored banding, every link verified on full sets.

Two collections A and B of ``halves`` short keys each (every key from ``rows`` minhashes) are computed
per document; table (i, j) has the key (A_i, B_j). So ``2 * halves * rows`` minhashes serve ``halves ** 2``
tables. A half that no other document has cannot be part of a shared table key, and goes before the
pairs are formed.

Documents with equal sets are one class, represented by its smallest id. In every bucket the document
that meets most others (in all tables) leads, and the others are tried against it; a second round has
other leaders. Most copies are in one component then. What is left are buckets whose members are in
several components: everyone who met a leader there is in the leader's region, and two documents of a
bucket share a region. In a region the documents outside the leader's component are compared with all
others in cells of bounded blocks, by a product of incidence matrices, and a cell gives every two
components that it joins once. So no pair is emitted that is not a link, and no candidate pair is left out.
Pairs whose set sizes rule out the similarity are not tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import columns_apart, per_batch, stored
from .text import ODD, blank_separated, chunks, distinct_per_document, mixed, shingles

SEED = 11


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters: words per shingle, similarity in percent, half keys per collection, minhashes per half key.

    With 12 halves of 2 minhashes a pair at similarity 0.8 meets in some of the 144 tables with
    probability (1 - 0.36 ** 12) ** 2 = 0.99999.
    """

    words: int = 5
    percent: int = 80
    halves: int = 12
    rows: int = 2
    leader_rounds: int = 2
    block: int = 256


#: An element of a set: two independent hashes of its words, 128 bits together.
SHINGLE = np.dtype([("a", "<u8"), ("b", "<u8")])


def single_numbers(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Sets of :data:`SHINGLE` as sets of numbers, equal where both hashes are: the first ones, if no two elements share only that."""
    whole = np.concatenate(sets)
    order = np.argsort(whole["a"], kind="stable")
    a, b = whole["a"][order], whole["b"][order]
    if not ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        return [s["a"] for s in sets]
    order = np.lexsort((whole["b"], whole["a"]))
    both = whole[order]
    numbers = np.empty(len(whole), np.uint64)
    numbers[order] = np.concatenate([[0], np.cumsum(both[1:] != both[:-1])])
    return [np.sort(x) for x in np.split(numbers, np.cumsum([len(s) for s in sets])[:-1])]


def document_sets(column: pa.Array, words: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, sorted distinct shingle hashes, second hashes beside them, bounds per document) for runs of documents."""
    with np.errstate(over="ignore"):
        for rows, data, ends in chunks(column):
            first, second, bounds = blank_separated(data, ends)
            hashes, own_bounds = shingles(first, bounds, words)
            yield rows, *distinct_per_document(hashes, shingles(second, bounds, words)[0], own_bounds)


def minhash_keys(hashes: np.ndarray, bounds: np.ndarray, halves: int, rows: int) -> np.ndarray:
    """The 2 * halves half keys of every document with a non-empty set (others: zeros)."""
    n = len(bounds) - 1
    out = np.zeros((n, 2 * halves), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    multipliers = np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, 2 * halves * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if len(full):
        with np.errstate(over="ignore"):
            for k in range(2 * halves):
                key = np.zeros(len(full), np.uint64)
                for m in multipliers[k * rows : (k + 1) * rows]:
                    key = key * ODD + np.minimum.reduceat(hashes * m, bounds[full])
                # The half's own number tells the collections and their keys apart.
                out[full, k] = mixed(key + np.uint64(k))
    return out


def signatures(docs: DataFrame, spec: NearDuplicates) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, halves``: set size, a 128-bit hash of the set, half keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, a, b, keys = [], [], [], []
        with np.errstate(over="ignore"):
            for _, hashes, second, bounds in document_sets(batch.column("text"), spec.words):
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(h ^ np.uint64(s)), dtype=np.uint64)]) for s, h in ((1, hashes), (2, second))]
                sizes.append(np.diff(bounds))
                for x, s in zip((a, b), sums):
                    x.append(s[bounds[1:]] - s[bounds[:-1]])
                keys.append(minhash_keys(hashes, bounds, spec.halves, spec.rows))
        flat = np.concatenate(keys).view(np.int64).ravel()
        ends = np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(2 * spec.halves)
        columns = [pa.array(np.concatenate(sizes).astype(np.int64)), *[pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        return pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "n_shingles", "set_a", "set_b", "halves"])

    return per_batch(docs, run, "doc_id long, n_shingles long, set_a long, set_b long, halves array<long>")


def table_rows(classes: DataFrame, spec: NearDuplicates) -> DataFrame:
    """``key, id, n, d``: the table keys of every class whose two halves are shared with another class each.

    ``d``: with how many classes its halves are shared, added up.
    """
    halves = classes.select("id", "n", "set_a", "set_b", F.posexplode("halves").alias("i", "half"))
    common = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    left = halves.join(common, "half")
    sides = left.groupBy("id", "n", "set_a", "set_b").agg(
        F.collect_list(F.when(F.col("i") < spec.halves, F.col("half"))).alias("a"),
        F.collect_list(F.when(F.col("i") >= spec.halves, F.col("half"))).alias("b"),
        F.sum("c").alias("d"),
    )
    rows = sides.select("id", "n", "d", F.explode("a").alias("a"), "b").select("id", "n", "d", "a", F.explode("b").alias("b"))
    return rows.select(F.xxhash64("a", "b").alias("key"), "id", "n", "d")


def _sizes_allow(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough: the smaller one within the larger."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``x, y``: the labels of the pairs ``a, b, x, y`` for which 100 * intersection >= percent * union on the full sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = np.zeros(batch.num_rows, bool)
        a, b = batch.column("sa"), batch.column("sb")
        for r in range(batch.num_rows):
            both = np.concatenate(single_numbers([np.frombuffer(c[r].as_buffer(), SHINGLE) for c in (a, b)]))
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            ok[r] = 100 * common >= percent * (len(both) - common)
        return batch.select(["x", "y"]).filter(pa.array(ok))

    with_sets = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("sb")), "b")
    return per_batch(with_sets.select("x", "y", "sa", "sb"), run, "x long, y long")


def cell_links(labels: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], percent: int) -> set[tuple[int, int]]:
    """The components that a link between full sets joins, as pairs of labels.

    ``labels``: of the documents of a cell; ``asks``: those that are compared with the ones that do not ask.
    """
    q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(q) or not len(c):
        return set()
    # Only shingles on both sides count for an intersection.
    shared = np.intersect1d(np.concatenate([sets[i] for i in q]), np.concatenate([sets[i] for i in c]))
    common = np.zeros((len(q), len(c)), np.float32)
    where = [np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)]) for s in sets]
    for a in range(0, len(shared), 8192):
        sides = []
        for side in (q, c):
            m = np.zeros((len(side), min(8192, len(shared) - a)), np.float32)
            for r, i in enumerate(side):
                m[r, where[i][np.searchsorted(where[i], a) : np.searchsorted(where[i], a + 8192)] - a] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    both = common.astype(np.int64)
    linked = (100 * both >= percent * (sizes[q][:, None] + sizes[c][None, :] - both)) & (labels[q][:, None] != labels[c][None, :])
    rows, columns = np.nonzero(linked)
    ends = np.stack([labels[q[rows]], labels[c[columns]]], axis=1)
    return set(map(tuple, np.unique(np.sort(ends, axis=1), axis=0).tolist()))


def region_links(regions: DataFrame, sets: DataFrame, spec: NearDuplicates) -> DataFrame:
    """``x, y``: labels of components that links join, in every region ``leader, leading, id, n, label``.

    ``leading`` is the leader's component. A region's documents are dealt into blocks; those outside the
    leading component ask all blocks.
    """
    sizes = regions.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("label") != F.col("leading")).alias("q"))
    blocks = lambda c: F.ceil(F.col(c) / spec.block).cast("int")
    # The leader's own pairs were tried in the first round, so that a region of two holds nothing new.
    least = 3 if spec.leader_rounds else 2
    sized = regions.join(sizes.filter((F.col("m") >= least) & (F.col("q") > 0)), "leader").join(sets, "id")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    block = lambda c: F.pmod(F.xxhash64("id"), blocks(c))
    rows = ["leader", "label", "hashes"]
    asking = sized.filter("label != leading").select(*rows, block("q").cast("int").alias("qb"), every("m").alias("cb"), F.lit(True).alias("asks"))
    others = sized.select(*rows, every("q").alias("qb"), block("m").cast("int").alias("cb"), F.lit(False).alias("asks"))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, asks, hashes = [], [], []
        for b in batches:
            labels.append(b.column("label").to_numpy())
            asks.append(b.column("asks").to_numpy(zero_copy_only=False))
            hashes += [np.frombuffer(x.as_buffer(), SHINGLE) for x in b.column("hashes")]
        found = cell_links(np.concatenate(labels), np.concatenate(asks), single_numbers(hashes), spec.percent)
        if found:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], names=["x", "y"])

    return asking.unionAll(others).groupBy("leader", "qb", "cb").applyInArrow(cell, "x long, y long")


def near_duplicates(docs: DataFrame, spec: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    A document's set holds its distinct runs of ``words`` words (A-Z lower-cased, words between ASCII
    blanks; with fewer words, the whole). Null and empty texts have an empty set, are linked with
    nothing and kept. ``component_id`` is the smallest id reachable by links of the given similarity.
    Rows with a null doc_id are linked with nothing (component null, kept). Rows with a repeated doc_id
    share links of each other's texts. Other columns are ignored, whole texts of any length are read, and an empty
    table gives an empty result.
    """
    rows = columns_apart(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(rows, spec), "signatures")
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "set_a", "set_b"]
    # Stored, so that the join that carries it back to all rows is one of two plain tables, which is split where a set is hot.
    firsts = stored(full.groupBy(*same).agg(F.min("doc_id").alias("id")), "firsts")
    # A repeated id may have several sets of one size; each keeps its keys.
    classes = full.join(firsts.withColumnRenamed("id", "doc_id"), [*same, "doc_id"]).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "set_a", "set_b", "halves").dropDuplicates(["id", "n", "set_a", "set_b"])
    tables = table_rows(classes, spec)
    busy = tables.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    tables = stored(tables.join(busy, "key", "left_semi"), "tables")
    members = stored(tables.select("id").distinct(), "members")

    def full_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[bytes] = []
        for _, hashes, second, bounds in document_sets(batch.column("text"), spec.words):
            whole = np.empty(len(hashes), SHINGLE)
            whole["a"], whole["b"] = hashes, second
            out += [whole[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
        return pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary())], names=["id", "hashes"])

    texts = rows.join(members.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    # A repeated id has one set per text; any of them may link.
    sets = stored(per_batch(texts, full_sets, "id long, hashes binary"), "sets")

    # Components grow from round to round: links are between labels, and only they are contracted.
    labels = members.withColumn("label", F.col("id"))
    left = tables
    for step in range(spec.leader_rounds + 1):
        own = left.join(labels, "id") if step else left.withColumn("label", F.col("id"))
        if step:
            open_keys = own.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("key")
            own = stored(own.join(open_keys, "key", "left_semi"), "open-buckets")
            left = own.drop("label")
            if own.isEmpty():
                break
        last = step == spec.leader_rounds
        order = F.col("d") if step == 0 or last else F.xxhash64("id", F.lit(step))
        leaders = own.groupBy("key").agg(F.max(F.struct(order.alias("o"), F.col("id").alias("id"), F.col("n").alias("n"), F.col("label").alias("label"))).alias("m"))
        met = own.join(leaders, "key")
        if last:
            links = region_links(met.select(F.col("m.id").alias("leader"), F.col("m.label").alias("leading"), "id", "n", "label").distinct(), sets, spec)
        else:
            met = met.filter((F.col("label") != F.col("m.label")) & _sizes_allow(F.col("n"), F.col("m.n"), spec.percent))
            ends = F.struct(F.col("id").alias("id"), F.col("label").alias("label")), F.struct(F.col("m.id").alias("id"), F.col("m.label").alias("label"))
            pairs = met.select(F.least(*ends).alias("p"), F.greatest(*ends).alias("q")).distinct()
            links = verified(pairs.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.label").alias("x"), F.col("q.label").alias("y")), sets, spec.percent)
        joined = connected_components(links, "x", "y").withColumnRenamed("id", "label")
        labels = stored(labels.join(joined, "label", "left").select("id", F.coalesce("component", "label").alias("label")), "components")
    found = signed.drop("halves").join(firsts, same, "left")
    found = found.join(labels, "id", "left")
    known = F.col("n_shingles") > 0
    component = F.when(F.col("doc_id").isNotNull() & known, F.coalesce("label", "id")).otherwise(F.col("doc_id"))
    out = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
