"""From raw documents to packed training sequences, in five stages.

Every stage takes what the one before kept, written as Parquet and read again. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import exactdup, neardup, packing, quality, secrets
from fieldspark.llm.queries import TOKENIZER
from fieldspark.llm.shared import file_bytes, prepare, stored, table

#: SQL cannot express a trained classifier, MinHash or a tokenizer.
ORACLE_SQL = None


# All stages keep extra columns of any name and type (of names that differ only in case, Spark itself takes none), read
# whole texts of any length, and give an empty result for an empty table. Null texts count as empty.


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5. Empty texts are scored as all others; repeated rows are judged each."""
    prepare(spark)
    return quality.fit_quality(docs, table(spark, sf_dir, "labels")).accepted(docs, 0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id.

    A row without an id stays only where its text has no other; null and empty texts are equal. Of rows with equal
    texts and ids one stays.
    """
    prepare(spark)
    return exactdup.distinct_documents(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect the one with the smallest id.

    Null and empty texts and rows without an id stay. Rows that share an id go or stay together.
    """
    prepare(spark)
    # Filtering the dropped ids, not joining the kept ones: rows without an id stay.
    dropped = neardup.near_duplicates(docs, neardup.NearDuplicates(words=5, percent=80)).filter(~F.col("kept")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; null and empty texts and repeated rows stay as they are."""
    prepare(spark)
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences.

    Every row is packed, also with a null or repeated id; a null or empty text is its end id alone. Extra columns end here.
    """
    prepare(spark)
    pieces = packing.token_pieces(docs, file_bytes(public_tokenizers.path(TOKENIZER)), end_id=0, tokens=2048, added_tokens=True)
    return packing.pack(pieces, packing.Capacity(2048))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_redaction),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
