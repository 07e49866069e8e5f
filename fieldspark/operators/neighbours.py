"""The nearest samplings of every sampling by Bray-Curtis, without a row per pair.

The similarity of two samplings is twice their shared cover over their total covers. Samplings are packed into chunks of bounded
size, and every chunk meets every other in one task at a time (a Cartesian product of stored chunks, which shuffles
nothing). Inside, the lists of one chunk's species are walked for the samplings of the other, shared covers are
added up in the order of the species, and each sampling keeps its k best from chunk to chunk. So only those leave a task.

Species that very many samplings hold need not be walked everywhere. A first look at a few short lists gives a sampling
with long lists a similarity that its k-th neighbour has at least. From it follows

* how far the neighbour's total may be from its own, so that most of a list is out of reach, and
* which of its long lists need no look: taken from the longest down, as long as what they can add together
  stays below the cover that a neighbour has to share. A neighbour shares some other species as well.

Pairs whose shared cover so far, and the most that the lists left out can add, miss the bound are dropped; of the
others those with lists left out are compared in full. Samplings with equal covers of all species are one class, so that
many equal ones do not make pairs among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# Totals of one block are within this ratio; postings of a block.
TOTAL_RATIO, BLOCK = 1.1, 512
# Lists, blocks of each, and pairs in all that the first look takes for one sampling.
PROBE_LISTS, PROBE_BLOCKS, PROBE_PAIRS = 3, 2, 64
# A list of no more postings is walked anyway: that is cheaper than to compare whole samplings instead.
SHORT_LIST = 64
# Bounds are compared with this share to spare, which covers rounding in sums of covers.
SLACK = 1e-9
# Covers of one chunk; tasks wanted for the product of the chunks; shared covers added up at a time, and samplings among them.
CHUNK, TASKS, PIECE, PIECE_ROWS = 1 << 21, 96, 1 << 22, 1 << 19


def species_cover(df: DataFrame, row: Sequence[str], species: str, cover: str) -> DataFrame:
    """``*row, s, c``: positive covers, added up, by the number ``s`` of the species.

    Whole numbers are their own; other species are numbered in their order.
    """
    long = df.filter(F.col(species).isNotNull()).groupBy(*row, F.col(species).alias("__s")).agg(F.sum(F.col(cover).cast("double")).alias("c")).filter(F.col("c") > 0)
    if isinstance(df.schema[species].dataType, T.IntegralType):
        return long.withColumn("s", F.col("__s").cast("long")).drop("__s")
    numbers = cut_lineage(df.select(F.col(species).alias("__s")).dropna().distinct().sort("__s").withColumn("s", F.monotonically_increasing_id()))
    return long.join(numbers, "__s").drop("__s")


def sampling_vectors(df: DataFrame, row: Sequence[str], species: str = "species", cover: str = "cover") -> DataFrame:
    """``id`` (struct of the row columns), ``total``, ``vec`` (struct of the arrays ``s`` and ``c``, by species).

    Covers of one species are added up; only positive ones count, and rows without a species do not. A
    sampling without cover is left out.
    """
    long = species_cover(df, row, species, cover)
    rows = long.groupBy(F.struct(*row).alias("id")).agg(F.sort_array(F.collect_list(F.struct("s", "c"))).alias("v"))
    # Added up in one order, so that equal vectors have equal totals.
    vec = F.struct(F.col("v.s").alias("s"), F.col("v.c").alias("c"))
    return rows.select("id", F.aggregate("v", F.lit(0.0), lambda t, x: t + x["c"]).alias("total"), vec.alias("vec"))


def equal_classes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal vectors, their first members, and the class of every sampling.

    Classes: ``rep`` (smallest id), ``total``, ``vec``. Firsts: ``rep, ids`` (the k + 1 smallest, which are all that can be among
    anyone's k nearest). Samplings: ``id, rep``.
    """
    grouped = vectors.groupBy(F.xxhash64("vec").alias("h"), "vec").agg(F.min("id").alias("rep"), F.first("total").alias("total"), F.count(F.lit(1)).alias("n"))
    grouped = cut_lineage(grouped.drop("h"))
    classes = grouped.select("rep", "total", "vec")
    alone = grouped.filter("n = 1")
    members, firsts = alone.select(F.col("rep").alias("id"), "rep"), alone.select("rep", F.array("rep").alias("ids"))
    shared = grouped.filter("n > 1").select("vec", "rep")
    if shared.isEmpty():
        return classes, members, firsts
    equal = cut_lineage(vectors.select("id", "vec").join(shared, "vec").select("id", "rep"))
    # Row numbers in parts first: a class of very many is never in one place.
    part = equal.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = part.withColumn("r", F.row_number().over(W.partitionBy("rep", "p").orderBy("id"))).filter(F.col("r") <= k + 1)
    some = some.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1)
    ids = some.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return classes, members.unionAll(equal), firsts.unionAll(ids)


def _bin(total: Column | str) -> Column:
    return F.floor(F.log(F.col(total) if isinstance(total, str) else total) / F.log(F.lit(TOTAL_RATIO))).cast("int")


def posting_lists(entries: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Postings ``s, bin, part, b, total`` of ``a, ta, s``, and their blocks ``s, bin, parts``.

    ``bin`` is that of the totals; a bin of more than ``block`` postings is dealt into parts.
    """
    rows = entries.select("s", _bin("ta").alias("bin"), F.col("a").alias("b"), F.col("ta").alias("total"))
    bins = cut_lineage(rows.groupBy("s", "bin").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    return rows.join(bins, ["s", "bin"]).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts"), bins


def _compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b, sim`` of pairs ``a, b``, from their whole vectors; pairs that share nothing have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, covers = [], []
            sides = [batch.column(x) for x in ("va", "vb")]
            species = np.concatenate([v.field("s").flatten().to_numpy() for v in sides])
            # Numbered in the order of the species, so that every sum is added up in that order.
            known, species = np.unique(species, return_inverse=True)
            width, n_a = len(known), len(sides[0].field("s").flatten())
            for v, part in zip(sides, (slice(0, n_a), slice(n_a, None))):
                pair = np.repeat(np.arange(batch.num_rows), v.field("s").value_lengths().to_numpy())
                keys.append(pair * width + species[part])
                covers.append(v.field("c").flatten().to_numpy())
            _, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
            shared = np.bincount(keys[0][i] // width, np.minimum(covers[0][i], covers[1][j]), batch.num_rows)
            total = batch.column("ta").to_numpy() + batch.column("tb").to_numpy()
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(2 * shared / total)], names=["a", "b", "sim"])

    kind = classes.schema["rep"].dataType.simpleString()
    pairs = cut_lineage(pairs)
    if pairs.isEmpty():
        # No vector is moved for nothing.
        return pairs.sparkSession.createDataFrame([], f"a {kind}, b {kind}, sim double")
    own = lambda x: classes.select(F.col("rep").alias(x), F.col("total").alias(f"t{x}"), F.col("vec").alias(f"v{x}"))
    rows = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "ta", "tb", "va", "vb")
    return rows.mapInArrow(run, f"a {kind}, b {kind}, sim double")


def _bounds(placed: DataFrame, k: int, block: int) -> DataFrame | None:
    """``a, least, left, skipped`` of the samplings that hold a long list; None where all lists are short.

    ``least``: a similarity that the k-th neighbour has at least, ``skipped``: species whose lists need no look, ``left``: the
    most cover that those can add.
    """
    entries = placed.select(F.col("code").alias("a"), F.col("total").alias("ta"), F.inline(F.arrays_zip(F.col("vec.s").alias("s"), F.col("vec.c").alias("ca"))))
    lists = cut_lineage(entries.groupBy("s").agg(F.count(F.lit(1)).alias("length"), F.max("ca").alias("most")))
    long = lists.filter(F.col("length") > SHORT_LIST)
    if long.isEmpty():
        return None
    held = cut_lineage(entries.join(long, "s"))

    # A first look: the shortest lists, in the blocks of the nearest totals.
    some = entries.join(held.select("a").distinct(), "a", "left_semi").join(lists.select("s", "length"), "s")
    probe = some.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy("length", "s"))).filter(F.col("r") <= PROBE_LISTS)
    probe = cut_lineage(probe.select("a", "ta", "s", _bin("ta").alias("bin")))
    postings, bins = posting_lists(entries.join(probe.select("s").distinct(), "s", "left_semi"), block)
    probe = probe.join(bins, ["s", "bin"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.least(F.col("parts"), F.lit(PROBE_BLOCKS)) - 1)))
    looked = probe.drop("parts").join(postings, ["s", "bin", "part"]).filter("a != b").groupBy("a", "b").agg(F.first(F.abs(F.col("ta") - F.col("total"))).alias("off"))
    looked = looked.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy("off", "b"))).filter(F.col("r") <= PROBE_PAIRS).select("a", "b")
    kth = _compared(looked, _as_classes(placed)).withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim")))).filter(F.col("r") == k)
    least = kth.select("a", (F.col("sim") * (1 - SLACK)).alias("least"))

    # A neighbour of similarity at least t shares x with 2 x / (total + other) >= t, and its total is at least x.
    needed = F.col("least") * F.col("ta") / (2 - F.col("least"))
    longest = W.partitionBy("a").orderBy(F.desc("length"), "s").rowsBetween(W.unboundedPreceding, 0)
    bounded = held.join(least, "a").withColumn("so_far", F.sum(F.least("ca", "most")).over(longest))
    skipped = F.col("so_far") < needed * (1 - SLACK)
    out = bounded.groupBy("a").agg(F.first("least").alias("least"), F.coalesce(F.max(F.when(skipped, F.col("so_far"))), F.lit(0.0)).alias("left"), F.collect_list(F.when(skipped, F.col("s"))).alias("skipped"))
    return cut_lineage(out)


def _as_classes(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("code").alias("rep"), "total", "vec")


_PACKED = {"code": "int64", "total": "float64", "least": "float64", "left": "float64", "n": "int64", "s": "int64", "c": "float64", "open": "bool", "order": "int32"}


def _chunks(rows: DataFrame) -> DataFrame:
    """Samplings ``code, total, vec, least, left, skipped`` packed into rows of about ``CHUNK`` covers, one column of bytes per array.

    ``n`` are the covers of each sampling, ``s`` and ``c`` those covers by sampling, ``open`` those whose lists are walked; samplings are in the order
    of their totals, and ``order`` has the covers by species.
    """

    def packed(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        whole = {x: np.concatenate([p[x] for p in parts]) for x in parts[0]}
        by_total = np.argsort(whole["total"], kind="stable")
        n = whole["n"][by_total]
        first = np.cumsum(whole["n"]) - whole["n"]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[by_total], n)
        out = {x: v[at if x in ("s", "c", "open") else by_total] for x, v in whole.items()}
        out["order"] = np.argsort(out["s"], kind="stable")
        return pa.record_batch([pa.array([out[x].astype(t).tobytes()], pa.binary()) for x, t in _PACKED.items()], names=list(_PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            lengths = batch.column("vec").field("s").value_lengths().to_numpy()
            # Cut where a chunk is full.
            number = (held + np.cumsum(lengths) - lengths) // CHUNK
            for i in np.unique(number):
                rows = batch.slice(int(np.searchsorted(number, i)), int((number == i).sum()))
                if held >= CHUNK:
                    yield packed(parts)
                    parts, held = [], 0
                vec, n = rows.column("vec"), lengths[number == i]
                part = {x: rows.column(x).to_numpy() for x in ("code", "total", "least", "left")}
                part |= {"n": n.astype("int64"), "s": vec.field("s").flatten().to_numpy(), "c": vec.field("c").flatten().to_numpy()}
                part["open"] = np.ones(len(part["s"]), bool)
                skipped = rows.column("skipped")
                if len(skipped.flatten()):
                    known, both = np.unique(np.concatenate([part["s"], skipped.flatten().to_numpy()]), return_inverse=True)
                    m = len(part["s"])
                    held_by = np.repeat(np.arange(len(n)), n)
                    left_by = np.repeat(np.arange(len(n)), skipped.value_lengths().to_numpy())
                    part["open"] = ~np.isin(held_by * len(known) + both[:m], left_by * len(known) + both[m:])
                parts.append(part)
                held += int(n.sum())
        if parts:
            yield packed(parts)

    return rows.mapInArrow(run, ", ".join(f"`{x}` binary" for x in _PACKED))


class _Queries:
    """A chunk's samplings, and the k best others of each so far."""

    def __init__(self, chunk: dict[str, np.ndarray], k: int):
        self.k, self.code, self.total, self.least, self.left = k, chunk["code"], chunk["total"], chunk["least"], chunk["left"]
        row = np.repeat(np.arange(len(self.code)), chunk["n"])
        self.row, self.c = row[chunk["open"]], chunk["c"][chunk["open"]]
        self.species, self.which = np.unique(chunk["s"][chunk["open"]], return_inverse=True)
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.kth = np.zeros(len(self.code))

    def meet(self, other: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Take in the other chunk's samplings; gives the pairs that have to be compared in full."""
        order, n_b = other["order"], len(other["code"])
        s, row_b, c_b = other["s"][order], np.repeat(np.arange(n_b), other["n"])[order], other["c"][order]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        place = np.minimum(np.searchsorted(s[start], self.species), len(start) - 1)
        there = s[start][place] == self.species
        low, high = start[place], np.where(there, np.r_[start[1:], len(s)][place], start[place])
        low, high = low[self.which], high[self.which]
        # Totals in reach, with some to spare for rounding.
        bound = np.maximum(self.least, self.kth * (1 - SLACK))
        with np.errstate(divide="ignore"):
            reach = (2 - bound) / bound * (1 + 2 * SLACK)
        near, far = np.searchsorted(other["total"], self.total / reach), np.searchsorted(other["total"], self.total * reach, side="right")
        if near.any() or (far < n_b).any():
            # A list is in the order of the totals.
            key = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(s)])) * n_b + row_b
            at = place[self.which] * n_b
            low, high = np.maximum(low, np.searchsorted(key, at + near[self.row])), np.minimum(high, np.searchsorted(key, at + far[self.row]))
        n = high - low
        hit = np.flatnonzero(n > 0)
        row, low, n, c = self.row[hit], low[hit], n[hit], self.c[hit]
        upto = np.r_[0, np.cumsum(n)]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
        ends = np.r_[first[1:], len(row)]
        todo, i = [], 0
        while i < len(first):
            j = max(i + 1, min(int(np.searchsorted(upto[ends], upto[first[i]] + PIECE, side="right")), i + PIECE_ROWS))
            part = slice(first[i], ends[j - 1])
            todo.append(self._added(row[part], low[part], n[part], c[part], row_b, c_b, other))
            i = j
        return tuple(np.concatenate(x) for x in zip(*todo)) if todo else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _added(self, row, low, n, c, row_b, c_b, other) -> tuple[np.ndarray, np.ndarray]:
        total, n_b, r0 = int(n.sum()), len(other["code"]), row[0]
        at = np.arange(total) + np.repeat(low - (np.cumsum(n) - n), n)
        key = np.repeat((row - r0) * n_b, n) + row_b[at]
        x = np.minimum(np.repeat(c, n), c_b[at])
        width = (int(row[-1] - r0) + 1) * n_b
        # Both ways add up in the order of the species.
        if total * 16 > width:
            dense = np.bincount(key, x, width)
            key = np.flatnonzero(dense)
            x = dense[key]
        else:
            key = np.sort((key << 22) | np.arange(total))
            x, key = x[key & ((1 << 22) - 1)], key >> 22
            new = np.r_[True, key[1:] != key[:-1]]
            x, key = np.bincount(np.cumsum(new) - 1, x), key[new]
        a, b = key // n_b + r0, key % n_b
        other_total = self.total[a] + other["total"][b]
        sim = 2 * x / other_total
        # Those that the lists left out may still lift.
        bound = np.maximum(self.least, self.kth * (1 - SLACK))
        use = self.code[a] != other["code"][b]
        maybe = use & (self.left[a] > 0) & (2 * (x + self.left[a]) * (1 + SLACK) >= bound[a] * other_total)
        use &= sim >= self.kth[a]
        found = self.code[a[maybe]], other["code"][b[maybe]]
        a, b, sim = a[use], other["code"][b[use]], sim[use]
        if len(a):
            # The k-th largest at least, first; then only few are put in order.
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            rest, group = sim.copy(), np.cumsum(np.r_[True, a[1:] != a[:-1]]) - 1
            for _ in range(self.k):
                top = np.maximum.reduceat(rest, starts)
                rest[rest >= top[group]] = 0.0
            keep = sim >= top[group]
            a, b, sim = (np.r_[old, new[keep]] for old, new in zip(self.best, (a, b, sim)))
            by = np.lexsort((b, -sim, a))
            a, b, sim = a[by], b[by], sim[by]
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
            self.kth[a[rank == self.k - 1]] = sim[rank == self.k - 1]
            self.best = tuple(v[rank < self.k] for v in (a, b, sim))
        return found


def _met(chunks: DataFrame, k: int) -> DataFrame:
    """Every chunk with every other: ``a, b, sim`` of each sampling's k best in a task, and pairs to be compared (``sim`` is NULL)."""

    def unpack(batch: pa.RecordBatch, side: str, i: int) -> dict[str, np.ndarray]:
        return {x: np.frombuffer(batch.column(side + x)[i].as_buffer(), t) for x, t in _PACKED.items()}

    def rows(a, b, sim) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), 100_000):
            p = slice(i, i + 100_000)
            yield pa.record_batch([pa.array(a[p]), pa.array(b[p]), pa.nulls(len(a[p]), pa.float64()) if sim is None else pa.array(sim[p])], names=["a", "b", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, _Queries] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                first = int(np.frombuffer(batch.column("a_code")[i].as_buffer(), "int64", 1)[0])
                if first not in queries:
                    queries[first] = _Queries(unpack(batch, "a_", i), k)
                yield from rows(*queries[first].meet(unpack(batch, "b_", i)), None)
        for q in queries.values():
            a, b, sim = (v[q.left[q.best[0]] == 0] for v in q.best)
            yield from rows(q.code[a], b, sim)

    n = max(1, chunks.rdd.getNumPartitions())
    named = lambda x: chunks.select(*[F.col(c).alias(f"{x}_{c}") for c in _PACKED])
    # The right side is held in a task, the left one passes by.
    pairs = named("b").coalesce(max(1, min(n, TASKS // n))).hint("shuffle_replicate_nl").crossJoin(named("a").hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(run, "a long, b long, sim double")


def nearest_samplings(df: DataFrame, row: Sequence[str], k: int, species: str = "species", cover: str = "cover", block: int = BLOCK) -> DataFrame:
    """The ``k`` samplings nearest to each by Bray-Curtis: ``*row, rank, near_*row, bray, jaccard``.

    Samplings are the distinct ``row`` values of the long table ``df``. Neighbours share at least one species (bray below
    1), so that a sampling may have fewer than ``k``; equal distances rank by the row columns. The result is exact
    whatever the bounds leave out. ``block``: postings of a species with like totals that meet in one place.
    """
    vectors = cut_lineage(sampling_vectors(df, row, species, cover))
    classes, members, firsts = equal_classes(vectors, k)
    covers = classes.agg(F.sum(F.size("vec.s"))).first()[0] or 0
    n = -(-covers // CHUNK) or 1
    # Numbers in the order of the ids, so that those decide ties.
    placed = cut_lineage(classes.repartitionByRange(n, "rep").sortWithinPartitions("rep").withColumn("code", F.monotonically_increasing_id()))
    bounds = _bounds(placed, k, block)
    rows = placed.select("code", "total", "vec")
    if bounds is None:
        rows = rows.withColumns({"least": F.lit(0.0), "left": F.lit(0.0), "skipped": F.lit([]).cast("array<bigint>")})
    else:
        rows = rows.join(bounds.withColumnRenamed("a", "code"), "code", "left").repartitionByRange(n, "code")
        rows = rows.withColumns({"least": F.coalesce("least", F.lit(0.0)), "left": F.coalesce("left", F.lit(0.0)), "skipped": F.coalesce("skipped", F.lit([]).cast("array<bigint>"))})
    met = cut_lineage(_met(cut_lineage(_chunks(rows)), k))
    known = met.filter("sim IS NOT NULL").unionAll(_compared(met.filter("sim IS NULL").select("a", "b"), _as_classes(placed)).filter("sim > 0"))

    # The classes a member of a can need are the k best others and its own; each brings its k + 1 smallest ids.
    best = known.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))).filter(F.col("r") <= k).select("a", "b", "sim")
    coded = cut_lineage(placed.select("code", "rep").join(firsts, "rep"))
    own = coded.select(F.col("code").alias("a"), F.col("code").alias("b"), F.lit(1.0).alias("sim"))
    offered = best.unionAll(own).join(coded.select(F.col("code").alias("b"), "ids"), "b").select("a", "sim", F.explode("ids").alias("id"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("d"), "id")))
    offers = offered.groupBy("a").agg(F.slice(ranked, 1, k + 1).alias("near"))
    each = members.join(coded.select(F.col("code").alias("a"), "rep"), "rep").join(offers, "a")
    others = each.select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("r", "x"))
    bray = 1 + F.col("x.d")
    out = others.select(*[F.col("id")[c].alias(c) for c in row], (F.col("r") + 1).alias("rank"), *[F.col("x.id")[c].alias(f"near_{c}") for c in row], bray.alias("bray"))
    return out.withColumn("jaccard", 2 * F.col("bray") / (1 + F.col("bray")))
