"""What the training-data operators share: tables, shared storage, hold-out buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockyard.shipping import delete, results_dir, shared_dir, ship, stored

__all__ = ["FEW", "SPACES", "Workspace", "bucket_of", "if_small", "numbered", "one_per_key", "results_dir", "shared_dir", "ship", "stored", "table"]

#: ASCII white space, the only separator of words in the contracts.
SPACES = r"[\x20\x09-\x0D]+"
#: Most rows of ids, or of ids and a digest, that are broadcast: some 100 MB on an executor.
FEW = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Written tables that go when the work is done: `stored` within a block, deleted at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{results_dir(spark)}/work-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.path}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)


def if_small(df: DataFrame, most: int = FEW) -> DataFrame:
    """The rows, written and counted, with a broadcast hint if they are at most `most`."""
    df = stored(df, "keys")
    return F.broadcast(df) if df.count() <= most else df


def one_per_key(docs: DataFrame, id_: Column, tag: Column, gone: DataFrame, twice: DataFrame, most: int = FEW) -> DataFrame:
    """`docs` without the rows whose (id, tag) is in `gone`, and with one row for each (id, tag) in `twice`.

    `gone` and `twice` are stored tables of distinct (id, tag) without common rows. Rows equal in id and tag
    may differ in other columns; which of them stays is not defined."""
    sent = lambda df: F.broadcast(df) if df.count() <= most else df

    def same(df: DataFrame, left_id: Column, left_tag: Column) -> Column:
        return left_id.eqNullSafe(df["g_id"]) & (left_tag == df["g_tag"])

    gone, twice = (df.toDF("g_id", "g_tag") for df in (gone, twice))
    left = docs.join(sent(gone), same(gone, id_, tag), "left_anti")
    if not twice.limit(1).count():
        return left
    # only rows that repeat both id and text are gathered, after one of each task's has been chosen
    repeated = left.join(sent(twice), same(twice, id_, tag), "left_semi")
    each = repeated.groupBy(id_.alias("g_id"), tag.alias("g_tag")).agg(F.any_value(F.struct(*docs.columns)).alias("row"))
    return left.join(sent(twice), same(twice, id_, tag), "left_anti").union(each.select("row.*"))


def bucket_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the contracts' hold-out rule. A null id falls in bucket 0's complement, 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(1))


def numbered(rows: DataFrame, order: list[Column], within: str, label: str) -> DataFrame:
    """The rows with `at`, their place from 0 on in `order` among the rows of one value of `within`, and `of`, how
    many these are.

    Rows are sorted by ranges, written, and counted by range; no task sees more than a range, and a value that
    holds most rows lies in many."""
    by = [F.col(within), *order]
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("line", F.monotonically_increasing_id())
    ranges = stored(ranges.withColumn("part", F.shiftright("line", 33)), label)
    runs = ranges.groupBy(F.col(within).alias("r_within"), F.col("part").alias("r_part")).agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("r_within")
    runs = stored(runs.withColumn("before", F.coalesce(F.sum("n").over(one.orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("of", F.sum("n").over(one)), f"{label}-runs")
    places = ranges.join(runs, F.col("part").eqNullSafe(F.col("r_part")) & F.col(within).eqNullSafe(F.col("r_within")))
    return places.withColumn("at", F.col("line") - F.col("first") + F.col("before")).select(*rows.columns, "at", "of")
