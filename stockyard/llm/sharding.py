"""Sharding by proportional stratified interleaving, law `rows`: shard sizes differ by one row at most.

Rows are ranked within their source in the order of a seeded hash of the id; (2 rank - 1) / (2 n) is a
row's fractional rank; all rows sorted by it are cut into equal runs, so every shard holds each source in
its share. Native: DataFrame operations only, and no rank is computed in one task. Either ranking counts
rows per small bucket first (1/4096 of a source, or of the whole; 1/65536 and so on where a bucket of the whole
would have over `rows` rows), adds the counts of the buckets before, and numbers rows only inside a bucket; so a
source with a third of all rows is spread over 4096 groups or more. Texts take no part in a shuffle.

Null text is empty, a null source is a source of its own, null ids come first. Rows that repeat an id get
neighbouring ranks, by size and checksum. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockyard.llm.common import stored

OVERHEAD = 16


def _before(counts: DataFrame, within: list[str], bucket: str) -> DataFrame:
    """Rows in the buckets before each bucket; `counts` has one row per group and bucket."""
    w = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def shard(docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digits: int = 3, rows: int = 100_000) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null under this law). digits: 16 ** digits buckets at least."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    base = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"),
            (F.octet_length(body).cast("long") + OVERHEAD).alias("size"),
            F.crc32(body).alias("text_crc32"),
            key.alias("key"),
        ),
        "shard-base",
    )
    total = max(1, base.count())
    while total > rows * 16**digits:
        digits += 1
    base = base.withColumn("bucket", F.substring("key", 1, digits))
    order = [F.col("key"), F.col("id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]

    counts = base.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("source").agg(F.sum("n").alias("of_source"))
    offsets = _before(counts, ["source"], "bucket").join(totals, "source").drop("n")
    ranked = (
        base.withColumn("place", F.row_number().over(Window.partitionBy("source", "bucket").orderBy(*order)))
        .join(offsets, ["source", "bucket"])
        .withColumn("share", (2 * (F.col("before") + F.col("place")) - 1) / (2 * F.col("of_source")))
        .drop("before", "place", "of_source", "bucket")
    )
    ranked = stored(ranked.withColumn("bucket", F.floor(F.col("share") * 16**digits)), "shard-ranked")

    counts = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = _before(counts, [], "bucket").drop("n")
    placed = (
        ranked.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("share", "source", *order)))
        .join(offsets, "bucket")
        .withColumn("at", F.col("before") + F.col("place") - 1)
        .withColumn("shard", F.expr(f"(at * {shards}) div {total}").cast("int"))
    )
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
