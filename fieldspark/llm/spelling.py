"""Spelling variants: words one edit apart, by bit-sliced position indexes.

Two words are near if one inserted, deleted or replaced code point turns one into the other. The first place
where they differ is such a place of edit, so that every near pair has one place p, counted in the shorter
word (or the first, at equal length).

Words are dealt into groups by a region [a, b) that p may lie in: a group's words agree in everything before
and after the region. A word of length L is in the groups of its own length and, as a longer word, in those
of length L - 1. A group of more words than fit one index is split by halving its region, once with the left
half free and once with the right. A region of one place leaves so few letters open that the size of the
alphabet bounds the group; no group is dropped, capped or compared in parts.

In a group the vocabulary is indexed by bit sets: for every (position, letter) the words that have that letter
there, one bit a word. The recurrences run over a query's letters, for all queries at once: a set of words
without an error so far, and sets with one error, in which replaced letters keep the position and inserted
ones shift it by one. Many small groups share one index; a query starts from the bits of its own group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns_apart, per_batch, stored
from .text import chunks, spans

# Words of one index; a group at the end of the halving may have more (its alphabet's square).
GROUP = 2048
# Queries whose sets are held at once.
AT_ONCE = 512


def _letter_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and of U+00C0 to U+00FF, which are 0xC3 and a byte after it."""
    lead = data == 0xC3
    out = (((data | 0x20) >= 97) & ((data | 0x20) <= 122)) | lead
    out[1:] |= lead[:-1]
    return out


def _lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] = out[97:123]
    return out


LOWER = _lower_table()


def without_letter(word: str, doc_id: int | None, every: int) -> str:
    """The run less one code point, where the hash of the document and the run says so; without an id as it is."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, noise: int | None = 31) -> DataFrame:
    """``word, n``: words of at least ``least_length`` code points that occur at least ``least_count`` times.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, of whole texts. ``noise``: where
    this number divides the hash of document id and run, one code point of the run goes first; None leaves all as
    they are, and so does a null id. Null texts have no words; repeated rows count each.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").to_pylist()
        words, counts = [], []
        for rows, data, ends in chunks(batch.column("text"), 4 << 20):
            starts, stops = spans(_letter_bytes(data), ends)
            # Code points, not bytes.
            at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            long = np.flatnonzero(at[stops] - at[starts] >= least_length)
            if not len(long):
                continue
            doc = np.searchsorted(ends, starts[long], "right") - 1
            lengths = stops[long] - starts[long]
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            body = LOWER[data[np.arange(offsets[-1]) + np.repeat(starts[long] - offsets[:-1], lengths)]]
            text = pa.Array.from_buffers(pa.large_string(), len(long), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
            known = text.dictionary.to_pylist()
            keys, n = np.unique(doc * len(known) + text.indices.to_numpy(), return_counts=True)
            if noise is None:
                words += [known[k] for k in (keys % len(known)).tolist()]
            else:
                words += [without_letter(known[k], ids[rows.start + d], noise) for d, k in zip((keys // len(known)).tolist(), (keys % len(known)).tolist())]
            counts.append(n)
        if not words:
            return None
        both = pa.table({"word": pa.array(words, pa.string()), "n": np.concatenate(counts)})
        both = both.filter(pc.greater_equal(pc.utf8_length(both["word"]), least_length)).group_by("word").aggregate([("n", "sum")])
        if not both.num_rows:
            return None
        return pa.record_batch([both["word"].combine_chunks(), both["n_sum"].combine_chunks()], names=["word", "n"])

    rows = columns_apart(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_batch(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _dealt(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows ``word, n, longer, size`` under the region [a, b): what stands before and after it is the key."""
    after = b + F.when(F.col("longer"), 1).otherwise(0) + 1
    # Past the end, substring gives nothing.
    key = F.struct(F.expr("substring(word, 1, a)").alias("before"), F.expr("substring(word, after, length(word))").alias("after"))
    return rows.withColumns({"a": a, "b": b}).withColumn("after", after).withColumn("key", key).select("size", "a", "b", "key", "word", "n", "longer")


def _halves(rows: DataFrame) -> DataFrame:
    """The two halves of every row's region."""
    middle = ((F.col("a") + F.col("b") + 1) / 2).cast("int")
    both = rows.withColumn("half", F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))))
    return _dealt(both.select("size", "word", "n", "longer", F.col("half.a").alias("x"), F.col("half.b").alias("y")), F.col("x"), F.col("y"))


GROUP_COLUMNS = ["size", "a", "b", "key"]


def groups(words: DataFrame, least_length: int = 7, most: int = GROUP) -> DataFrame:
    """``size, a, b, key, word, n, longer``: words of one group can be near with a first difference in [a, b).

    Groups of more than ``most`` words are halved until a region has one place.
    """
    length = F.length("word")
    roles = F.array(F.struct(length.alias("size"), F.lit(False).alias("longer")), F.struct((length - 1).alias("size"), F.lit(True).alias("longer")))
    rows = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.size", "r.longer").filter(F.col("size") >= least_length)
    # Places 0 to size: at the last a letter is added to the end.
    rows = rows.withColumns({"a": F.lit(0), "b": F.col("size") + 1})
    done = None
    while True:
        rows = stored(_halves(rows), "spelling-groups")
        large = rows.groupBy(*GROUP_COLUMNS).agg(F.count(F.lit(1)).alias("c")).filter((F.col("c") > most) & (F.col("b") - F.col("a") > 1))
        large = stored(large.drop("c"), "spelling-large")
        if large.isEmpty():
            return rows if done is None else done.unionAll(rows)
        small = rows.join(large, GROUP_COLUMNS, "left_anti")
        done = small if done is None else done.unionAll(small)
        rows = rows.join(large, GROUP_COLUMNS, "left_semi").drop("key")


def _bits(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int) -> np.ndarray:
    """A bit matrix with the given places set, one row of 64-bit words each."""
    out = np.zeros((n_rows, -(-n_columns // 64)), np.uint64)
    np.bitwise_or.at(out, (rows, columns >> 6), np.uint64(1) << (columns & 63).astype(np.uint64))
    return out


def near_in_index(letters: np.ndarray, longer: np.ndarray, group: np.ndarray, width: int, at_end: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, word) for all near words of some groups with one shape of region, in parts.

    ``letters``: the region's code points of every word, ``width`` for the shorter and one more for the longer ones
    (the shorter ones are padded); queries are the shorter words. ``at_end``: the region reaches the words' end, so that
    a letter may be added after it.
    """
    n = len(letters)
    codes, symbol = np.unique(letters, return_inverse=True)
    symbol = symbol.reshape(letters.shape)
    everyone = np.arange(n)
    # index[p][s]: the words with letter s at position p.
    index = [_bits(symbol[:, p], everyone, len(codes), n) for p in range(width + 1)]
    long_words = _bits(np.zeros(int(longer.sum()), np.int64), np.flatnonzero(longer), 1, n)[0]
    _, place = np.unique(group, return_inverse=True)
    members = _bits(place, everyone, int(place.max()) + 1, n)
    queries = np.flatnonzero(~longer)
    for at in range(0, len(queries), AT_ONCE):
        q = queries[at : at + AT_ONCE]
        same = members[place[q]]
        exact = same.copy()  # no error so far
        replaced = np.zeros_like(exact)  # one letter replaced: position kept
        inserted = np.zeros_like(exact)  # one letter more: position shifted by one
        for j in range(width):
            own = symbol[q, j]
            here, shifted = index[j][own], index[j + 1][own]
            replaced = (replaced & here) | (exact & ~here)
            inserted = (inserted | exact) & shifted
            exact = exact & here
        # Longer words that agree in the whole region differ after it: another group's, but for the words' end.
        inserted = (inserted | exact) if at_end else (inserted & ~exact)
        near = (replaced & ~long_words) | (inserted & long_words)
        row, column = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n])
        yield q[row], column


def group_matches(words: np.ndarray, n: np.ndarray, longer: np.ndarray, group: np.ndarray, size: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: number of near words found here, and the place of the best one (-1: none), for groups of one shape."""
    width = min(b, size) - a
    region = np.array([w[a : a + width + 1].ljust(width + 1, "\0") if x else w[a : a + width] + "\0" for w, x in zip(words, longer)], dtype=f"<U{width + 1}")
    letters = np.frombuffer(region.tobytes(), np.uint32).reshape(len(words), width + 1)
    # Best: largest n, then smallest word. Text arrays sort by code point.
    order = np.lexsort((np.array(words.tolist()), -n))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    found, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for x, y in near_in_index(letters, longer, group, width, b > size):
        found += np.bincount(x, minlength=len(words))
        np.minimum.at(best, x, rank[y])
        # Shorter words are queries themselves; a longer one learns of the pair here.
        up = longer[y]
        found += np.bincount(y[up], minlength=len(words))
        np.minimum.at(best, y[up], rank[x[up]])
    return found, np.where(found > 0, order[np.minimum(best, len(words) - 1)], -1), rank


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group in, ``word, found, form_n, form`` of the words with near ones out."""
    held: list[pa.RecordBatch] = []

    def matched(t: pa.Table) -> pa.RecordBatch | None:
        words = np.array(t["word"].to_pylist(), object)
        n, longer = t["n"].to_numpy(), t["longer"].to_numpy()
        found, best, _ = group_matches(words, n, longer, t["group"].to_numpy(), t["size"][0].as_py(), t["a"][0].as_py(), t["b"][0].as_py())
        some = np.flatnonzero(found)
        if not len(some):
            return None
        return pa.record_batch([pa.array(words[some].tolist(), pa.string()), pa.array(found[some]), pa.array(n[best[some]]), pa.array(words[best[some]].tolist(), pa.string())], names=["word", "found", "form_n", "form"])

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        """Indexes of whole groups; the last group may go on in the next batch."""
        nonlocal held
        t = pa.Table.from_batches(held).combine_chunks()
        columns = [t[c].to_numpy() for c in ("size", "a", "b")]
        before, after = (pc.struct_field(t["key"], c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("before", "after"))
        shape = np.ones(t.num_rows, bool)
        shape[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        first = shape.copy()
        first[1:] |= (before[1:] != before[:-1]) | (after[1:] != after[:-1])
        t = t.append_column("group", pa.array(np.cumsum(first)))
        starts = np.append(np.flatnonzero(first), t.num_rows)
        at = 0
        for g in range(len(starts) - 1):
            # An index ends before the group that it cannot hold, and where the shape changes.
            if starts[g] > at and (shape[starts[g]] or starts[g + 1] - at > GROUP):
                yield matched(t.slice(at, starts[g] - at))
                at = starts[g]
        if last:
            if at < t.num_rows:
                yield matched(t.slice(at))
            held = []
        else:
            held = t.slice(at).drop_columns(["group"]).to_batches()

    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 4 * GROUP:
                yield from filter(None, cut(False))
                rows = sum(b.num_rows for b in held)
    if held:
        yield from filter(None, cut(True))


def _followed(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to the last.

    A form has a larger count by a factor than its word, so that chains end and their length is bounded by the counts' digits;
    every round doubles what has been followed.
    """
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = stored(step, "spelling-roots")
        links = step.drop("moved")
        if step.filter("moved").isEmpty():
            return links


def spelling_variants(words: DataFrame, least_length: int = 7, factor: int = 10, most: int = GROUP) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``words``: ``word, n`` with distinct words of at least ``least_length`` (2 or more) code points, as :func:`word_counts` gives
    them. ``n_near``: words that differ by exactly one inserted, deleted or replaced code point. ``form``: of those the one with
    the largest n (ties: smallest in code-point order), if that is at least ``factor`` (2 or more) times the word's n, else null.
    ``root``: the last form on the way, or the word itself. An empty table gives an empty result.
    """
    if least_length < 2 or factor < 2:
        raise ValueError("least_length and factor are 2 or more")
    words = stored(columns_apart(words, ["word", "n"]).filter(F.length("word") >= least_length), "spelling-words")
    rows = groups(words, least_length, most)
    # Every group is bounded, so that tasks hold whole ones; they come one after another in a task.
    dealt = rows.repartition(*GROUP_COLUMNS).sortWithinPartitions(*GROUP_COLUMNS)
    found = dealt.mapInArrow(_matches, "word string, found long, form_n long, form string")
    whole = words.select("word", "n", F.lit(0).cast("long").alias("found"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    parts = whole.unionAll(found.select("word", F.lit(None).cast("long").alias("n"), "found", "form_n", "form"))
    # The smallest of (-n, word) is the largest n and the smallest word.
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form"))))
    near = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("found").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.m")
    close = F.coalesce(form_n >= factor * F.col("n"), F.lit(False))
    near = stored(near.select("word", "n", "n_near", F.when(close, F.col("best.form")).alias("form"), F.when(close, form_n).alias("form_n")), "spelling-forms")
    roots = _followed(near.filter("form IS NOT NULL"))
    out = near.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
