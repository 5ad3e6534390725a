"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id.

Native: DataFrame operations only. Texts meet in one hash aggregation keyed by (hash, text): the hash
spreads the groups and the text as second key compares bytes, so a collision makes two groups. Partial
aggregation runs before the shuffle, so a group of copies of any size sends one row per map task.
The labels then join back on digests; no text takes part, and skewed digests are split at run time.

Null text counts as empty. Rows without an id stay only where no row of their group has one. Rows that
repeat an id with equal text share its decision. An empty table gives an empty result. Extra columns are
ignored (`decisions`) or kept (`deduplicate`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import SPACES, one_per_key, stored


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def distinct_texts(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """One row per distinct text: hash, text, smallest id, number of rows."""
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body")).select("id", "body", F.unhex(F.md5("body")).alias("hash"))
    return rows.groupBy("hash", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("body")).select("id", F.unhex(F.md5("body")).alias("hash"), F.sha2("body", 256).alias("text_sha256"))
    groups = (
        distinct_texts(docs, id_col, normalised(text_col))
        .filter("group_size > 1")
        .select(F.col("hash").alias("g_hash"), F.sha2("body", 256).alias("g_sha"), "keep_id", "group_size")
    )
    joined = rows.join(groups, (rows.hash == groups.g_hash) & (rows.text_sha256 == groups.g_sha), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: exactly one of each group of equal texts.

    It is one with the smallest id; rows that repeat that id too, and groups without any id, keep one row."""
    groups = stored(decisions(docs, id_col, text_col).filter("group_size > 1").select(F.col(id_col).alias("id"), "text_sha256", "kept"), "copies")
    gone = stored(groups.filter(~F.col("kept")).select("id", "text_sha256").distinct(), "gone")
    twice = stored(groups.filter("kept").groupBy("id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "text_sha256"), "twice")
    return one_per_key(docs, F.col(id_col), F.sha2(normalised(text_col), 256), gone, twice)
