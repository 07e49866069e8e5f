"""Token-id files: one zstandard frame per document, a shared dictionary and an offset index.

A file set is a folder of Parquet files that Spark writes and commits, so that a lost executor leaves
nothing half done and any store that Spark reaches will do. Each row is a block of consecutive documents:

    shard, block          place in id order (shards are ranges of doc_id)
    first_token           ids of the shard before this block
    dictionary_hash       sha256 of the dictionary that the frames need
    width                 bytes per id, little-endian
    doc_ids, n_tokens     per document
    offsets               of the frames in ``frames``; one more than documents
    frames                the concatenated frames

and the dictionary itself is a row in a folder beside it. One document is read by its block and offset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import encoded_documents
from .shared import columns_apart, per_batch

BLOCK_BYTES = 4 << 20
BLOCK_DOCUMENTS = 2048
# Shards are at most this many, which bounds the table of their sizes.
MOST_SHARDS = 100_000
BLOCKS = "shard int, block int, first_token long, dictionary_hash string, width int, doc_ids array<long>, n_tokens array<int>, offsets array<int>, frames binary"


def id_width(definition: bytes, end_id: int) -> int:
    """2 bytes where the vocabulary allows it, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_str(definition.decode("utf-8")).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, definition: bytes, end_id: int, width: int, documents: int = 1000, most_chars: int = 8000, size: int = 64 << 10, added_tokens: bool = False) -> bytes:
    """A zstandard dictionary from the serialised ids of a bounded sample of short documents.

    The sample has at most ``documents`` distinct texts of 1 to ``most_chars`` characters, those with the smallest
    hashes. With too few of them to train on, the dictionary is empty and frames stand alone.
    """
    short = docs.filter(F.length("text").between(1, most_chars)).select("text", F.xxhash64("text").alias("h"))
    # Hashes are made distinct, not texts: only the chosen texts are shuffled.
    chosen = short.select("h").distinct().orderBy("h").limit(documents)
    sample = short.join(F.broadcast(chosen), "h", "left_semi").distinct().orderBy("h", "text").select("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, ids, bounds in encoded_documents(batch.column("text"), definition, end_id, added_tokens):
            out += [ids[a:b].astype(f"<u{width}").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.record_batch([pa.array(out, pa.binary())], names=["s"])

    samples = [bytes(r[0]) for r in per_batch(sample, run, "s binary").collect()]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, path: str, definition: bytes, end_id: int, shards: int | None = None, level: int = 3, added_tokens: bool = False) -> None:
    """Write all documents in ascending doc_id order (null ids first, repeated ids by text).

    A null text counts as empty and holds the end id alone. Other columns are ignored; an empty table
    gives an empty file set. ``added_tokens``: as in :func:`.packing.encoded_documents`.
    """
    spark = docs.sparkSession
    rows = columns_apart(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = id_width(definition, end_id)
    data = train_dictionary(rows, definition, end_id, width, added_tokens=added_tokens)
    digest = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(digest, width, bytearray(data))], "dictionary_hash string, width int, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shards = min(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pressed = zstandard.ZstdCompressor(level=level, dict_data=dictionary_of(data))
        shard, block, first, before = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list = []
        counts: list[int] = []
        offsets, frames = [0], bytearray()

        def closed() -> pa.RecordBatch:
            nonlocal block, first, doc_ids, counts, offsets, frames
            values = [[shard], [block], [first], [digest], [width], [doc_ids], [counts], [offsets], [bytes(frames)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            out = pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], names=names)
            block, first = block + 1, before
            doc_ids, counts, offsets, frames = [], [], [0], bytearray()
            return out

        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            for part, ids, bounds in encoded_documents(batch.column("text"), definition, end_id, added_tokens):
                raw = ids.astype(f"<u{width}")
                for d, a, b in zip(own[part], bounds[:-1].tolist(), bounds[1:].tolist()):
                    frames += pressed.compress(raw[a:b].tobytes())
                    doc_ids.append(d)
                    counts.append(b - a)
                    offsets.append(len(frames))
                    before += b - a
                    if len(frames) >= BLOCK_BYTES or len(doc_ids) >= BLOCK_DOCUMENTS:
                        yield closed()
        if doc_ids:
            yield closed()

    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    # The frames are compressed already.
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_dictionary(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.schema("dictionary_hash string, width int, dictionary binary").parquet(f"{path}/dictionary").first()
    data = bytes(row["dictionary"] or b"")
    if hashlib.sha256(data).hexdigest() != row["dictionary_hash"]:
        raise ValueError("the dictionary does not have its hash")
    return data, row["dictionary_hash"], row["width"]


def read_token_files(spark: SparkSession, path: str, doc_ids: Column | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files.

    ``start``: ids of all documents before it. ``ids``: little-endian unsigned 32-bit integers as
    binary. ``doc_ids``: a condition on doc_id under which a document's frame is opened at all.
    Files that need another dictionary than the one beside them raise an error.
    """
    data, digest, _ = read_dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = {r[0]: r[1] for r in blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x))).collect()}
    starts, total = [], 0
    for shard in sorted(sizes):
        starts.append((shard, total))
        total += sizes[shard]
    before = spark.createDataFrame(starts, "shard int, __before long")
    index = F.posexplode(F.arrays_zip("doc_ids", "n_tokens"))
    if doc_ids is None:
        wanted = F.transform("doc_ids", lambda d: F.lit(True))
    else:
        chosen = blocks.select("shard", "block", index.alias("i", "e")).select("shard", "block", "i", F.col("e.doc_ids").alias("doc_id")).filter(doc_ids)
        marks = chosen.groupBy("shard", "block").agg(F.collect_set("i").alias("__i"))
        blocks = blocks.join(marks, ["shard", "block"])
        wanted = F.transform("doc_ids", lambda d, i: F.array_contains("__i", i))
    # One row per shard, and shards are bounded.
    rows = blocks.join(F.broadcast(before), "shard").select((F.col("first_token") + F.col("__before")).alias("first"), "dictionary_hash", "width", "doc_ids", "n_tokens", "offsets", "frames", wanted.alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor(dict_data=dictionary_of(data))
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r] for n in batch.schema.names}
                if row["dictionary_hash"].as_py() != digest:
                    raise ValueError("a block needs another dictionary")
                width, at = row["width"].as_py(), row["first"].as_py()
                frames, offsets = row["frames"].as_buffer(), row["offsets"].as_py()
                out: list[list] = [[], [], [], []]
                held = 0
                for k, (d, n, w) in enumerate(zip(row["doc_ids"].as_py(), row["n_tokens"].as_py(), row["wanted"].as_py())):
                    if w:
                        raw = opened.decompress(frames[offsets[k] : offsets[k + 1]], max_output_size=n * width)
                        ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                        held += len(ids)
                        for x, v in zip(out, (d, at, n, ids)):
                            x.append(v)
                    at += n
                    if held >= BLOCK_BYTES:
                        yield _documents(out)
                        out, held = [[], [], [], []], 0
                if out[0]:
                    yield _documents(out)

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _documents(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "start", "n_tokens", "ids"])
