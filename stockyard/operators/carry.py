"""What comes before each row of its item in a log, also where one item has a large share of all rows.

Items with at most `hot` rows are windows as usual. The rows of the others are cut into ranges of their order of
about `hot` rows; a window works inside a range, and each range is handed the last row, or the number of rows, of
those before it. So no task holds an item, and the table that is handed on has one row for each item and range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.shipping import stored

#: Rows of an item that one task sorts.
HOT = 1_000_000
PART = "__part"


def _same(keys: list[str], names: list[str]) -> Column:
    out = F.lit(True)
    for k, n in zip(keys, names):
        out = out & F.col(k).eqNullSafe(F.col(n))
    return out


def segmented(df: DataFrame, keys: list[str], order: str, hot: int = HOT) -> tuple[DataFrame, DataFrame | None]:
    """The rows with their range (`__part`, 0 for items that are not cut), and those of the items that are, if any."""
    names = [f"__h{i}" for i in range(len(keys))]
    counts = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot)
    counts = stored(counts, "hot-items")
    total = counts.agg(F.sum("__n")).first()[0]
    if not total:
        return df.withColumn(PART, F.lit(0)), None
    parts = math.ceil(total / hot)
    heavy = df.join(counts, _same(keys, names), "left_semi").repartitionByRange(parts, *keys, order).withColumn(PART, F.spark_partition_id() + 1)
    heavy = stored(heavy, "hot-rows")
    return df.join(counts, _same(keys, names), "left_anti").withColumn(PART, F.lit(0)).union(heavy), heavy


def _handed(df: DataFrame, keys: list[str], of_part: DataFrame, value: Column, out: str) -> DataFrame:
    """Joins `out`, `value` of a range, to the rows of that range; `of_part` has one row for each item and range."""
    names = [f"__h{i}" for i in range(len(keys))]
    handed = of_part.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(PART).alias("__p"), value.alias(out))
    cold, hot = df.filter(F.col(PART) == 0), df.filter(F.col(PART) > 0)
    hot = hot.join(handed, _same(keys, names) & (F.col(PART) == F.col("__p")), "left").drop(*names, "__p")
    return cold.withColumn(out, F.lit(None).cast(dict(hot.dtypes)[out])).unionByName(hot)


def with_prior(df: DataFrame, keys: list[str], order: str, columns: list[str], out: str = "__prior", hot: int = HOT) -> DataFrame:
    """Adds `out`, the columns of the row just before in its item, null for the first one."""
    rows, heavy = segmented(df, keys, order, hot)
    row = F.struct(*columns)
    if heavy is None:
        return rows.withColumn(out, F.lag(row).over(Window.partitionBy(*keys).orderBy(order))).drop(PART)
    tails = heavy.groupBy(*keys, PART).agg(F.max_by(row, F.struct(order)).alias("__tail"))
    rows = _handed(rows, keys, tails, F.lag("__tail").over(Window.partitionBy(*keys).orderBy(PART)), "__tail")
    inside = F.lag(row).over(Window.partitionBy(*keys, PART).orderBy(order))
    return rows.withColumn(out, F.coalesce(inside, F.col("__tail"))).drop(PART, "__tail")


def with_place(df: DataFrame, keys: list[str], order: str, out: str, hot: int = HOT) -> DataFrame:
    """Adds `out`, the place of the row in its item, from 1 on."""
    rows, heavy = segmented(df, keys, order, hot)
    if heavy is None:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long")).drop(PART)
    sizes = heavy.groupBy(*keys, PART).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    rows = _handed(rows, keys, sizes, before, "__before")
    inside = F.row_number().over(Window.partitionBy(*keys, PART).orderBy(order))
    return rows.withColumn(out, (inside + F.coalesce("__before", F.lit(0))).cast("long")).drop(PART, "__before")
