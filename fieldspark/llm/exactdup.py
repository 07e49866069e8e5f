"""Exact deduplication with DataFrame operations only.

Rows meet by a 128-bit content hash and by their bytes: the hash is the first grouping key and the
text the second, and the aggregation compares key bytes. Partial aggregation leaves one row per text
and task, so a text that a third of all rows share is never gathered in one place. The text moves once.
Every row then finds its group by two hashes of its text; groups of different texts under the same
hashes, if there are any, are told apart by a join on the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from .shared import columns_apart, stored, text_or_empty


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest", content_hash=None, second_hash=None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; null counts as empty. The row with the largest (or smallest)
    id of a group stays. Null ids are members of their group but stay only if no other id is there
    (keep_id is then null); of rows with a repeated id each is a member, and all with the keeper's id
    are kept. An empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    h = content_hash or (lambda c: F.unhex(F.md5(c)))
    second = second_hash or F.xxhash64
    text: Column = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = columns_apart(docs, [id_column, text_column]).toDF("doc_id", "text").select("doc_id", text.alias("text"))
    keyed = rows.withColumn("h", h(F.col("text")))
    pick = F.max if keep == "largest" else F.min
    groups = keyed.groupBy("h", "text").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Without the text from here on; the second hash tells apart texts under one first hash.
    known = stored(groups.select("h", second("text").alias("h2"), "keep_id", "group_size"), "exact-groups")
    hashes = keyed.select("doc_id", "h", second("text").alias("h2"), "text")
    if known.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        found = hashes.select("doc_id", "h", "h2", F.sha2("text", 256).alias("sha")).join(known.filter("group_size > 1"), ["h", "h2"], "left")
    else:
        found = hashes.withColumn("sha", F.sha2("text", 256)).join(groups, ["h", "text"], "left").drop("text")
    single = F.col("group_size").isNull()
    keep_id = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(keep_id), F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One whole row of ``docs`` per distinct text: the one with the largest (or smallest) id.

    The grouping is that of :func:`exact_groups`, and the survivor's row travels with it. A null text
    equals an empty one; a row with a null id survives only where its text has no other. Of rows that
    share text and id one survives: that of the smallest hash of its other columns, of which maps and variants take no
    part. Columns of any name and type stay as they are; an empty table gives an empty result.
    """
    best = F.max_by if keep == "largest" else F.min_by
    first = F.col("doc_id").isNull() if keep == "smallest" else F.col("doc_id").isNotNull()
    text = text_or_empty()
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" and _hashable(f.dataType)]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    # The larger hash is the smaller one's complement, so that either side takes the same row.
    tie = F.xxhash64(*hashed) if keep == "smallest" else F.bitwise_not(F.xxhash64(*hashed))
    order = F.struct(first.alias("f"), F.col("doc_id").alias("i"), tie.alias("h"))
    rows = docs.select(F.unhex(F.md5(text)).alias("h"), text.alias("t"), whole.alias("r"), order.alias("o"))
    groups = rows.groupBy("h", "t").agg(best("r", "o").alias("r"))
    return groups.select(*[F.col("r")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def _hashable(kind: DataType) -> bool:
    """Whether Spark hashes values of this type."""
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (MapType, VariantType))
