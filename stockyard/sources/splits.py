"""Texts whose records may span lines, read in splits: what a line means depends on all lines before it in its file.

Every line is a row (file, block, at, value): its file, the first byte of its split, its place there. A line maps
the state before it (0 or 1: outside or inside quotes) to the state behind it, or has an amount to be summed. Both
are composed in two steps: within each split by a window, and over the splits of a file by a window over one row a
split, which is joined back. So a file of any size is read by as many tasks as it has splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "block"]
#: Place of a row in its partition, from monotonically_increasing_id; a split lies in one partition.
_IN_PARTITION = (1 << 33) - 1


def texts(spark: SparkSession, path, end: str | None = None) -> DataFrame:
    """(file, block, at, value, and columns named by folders) of each line, or of each piece that `end` ends."""
    reader = spark.read.option("lineSep", end) if end else spark.read
    rows = reader.text(path)
    named = [c for c in rows.columns if c != "value"]
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("at"), "value", *named)


def with_state(rows: DataFrame, after_0: Column, after_1: Column) -> DataFrame:
    """Adds `inside`, the state before each row (0 at the beginning of a file), given the states behind it for either."""
    rows = rows.withColumn("__a0", after_0.cast("int")).withColumn("__a1", after_1.cast("int"))
    flip, fixed = (F.col("__a0") == 1) & (F.col("__a1") == 0), F.when(F.col("__a0") == F.col("__a1"), F.col("__a0"))
    order = Window.partitionBy(*SPLIT).orderBy("at")
    past, here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__flips", F.sum(flip.cast("long")).over(here)).withColumn("__set", F.when(fixed.isNotNull(), F.struct(fixed.alias("state"), F.col("__flips").alias("flips"))))
    rows = rows.withColumn("__last", F.last("__set", ignorenulls=True).over(past)).withColumn("__past", F.coalesce(F.max("__flips").over(past), F.lit(0)))
    ends = rows.groupBy(*SPLIT).agg(F.max("__flips").alias("flips"), F.max_by("__set", F.when(F.col("__set").isNotNull(), F.col("at"))).alias("set"))
    # a split sets a state, or flips the one before it an even or odd number of times
    state = F.when(F.col("set").isNotNull(), (F.col("set.state") + F.col("flips") - F.col("set.flips")) % 2)
    ends = ends.select(*SPLIT, state.alias("state"), F.when(F.col("set").isNull(), F.col("flips")).otherwise(0).alias("odd"))
    order = Window.partitionBy("file").orderBy("block")
    past, here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("sum", F.sum("odd").over(here)).withColumn("known", F.when(F.col("state").isNotNull(), F.struct("state", "sum")))
    ends = ends.withColumn("last", F.last("known", ignorenulls=True).over(past)).withColumn("past", F.coalesce(F.max("sum").over(past), F.lit(0)))
    begin = F.when(F.col("last").isNull(), F.col("past") % 2).otherwise((F.col("last.state") + F.col("past") - F.col("last.sum")) % 2)
    ends = ends.select(F.col("file").alias("__f"), F.col("block").alias("__b"), begin.alias("__begin"))
    rows = rows.join(ends, (F.col("file") == F.col("__f")) & (F.col("block") == F.col("__b")))
    inside = F.when(F.col("__last").isNull(), F.col("__begin") + F.col("__past")).otherwise(F.col("__last.state") + F.col("__past") - F.col("__last.flips"))
    return rows.withColumn("inside", (inside % 2).cast("int")).drop("__a0", "__a1", "__flips", "__set", "__last", "__past", "__begin", "__f", "__b")


def with_sum(rows: DataFrame, amount: Column, out: str) -> DataFrame:
    """Adds `out`, the sum of `amount` over the rows before each row in its file."""
    past = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__n", amount.cast("long"))
    ends = rows.groupBy(*SPLIT).agg(F.sum("__n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(F.col("file").alias("__f"), F.col("block").alias("__b"), before.alias("__begin"))
    rows = rows.withColumn(out, F.coalesce(F.sum("__n").over(past), F.lit(0)))
    rows = rows.join(ends, (F.col("file") == F.col("__f")) & (F.col("block") == F.col("__b")))
    return rows.withColumn(out, F.col(out) + F.col("__begin")).drop("__n", "__f", "__b", "__begin")


def joined(rows: DataFrame, number: str, end: str) -> DataFrame:
    """(file, number, text): the values of the rows of one number in their order, each but the last followed by `end`,
    and the values of `block` and `at` at the first one."""
    parts = F.array_sort(F.collect_list(F.struct("block", "at", F.col("value").alias("value"))))
    return rows.groupBy("file", number).agg(parts.alias("parts")).select("file", number, F.array_join(F.transform("parts", lambda p: p["value"]), end).alias("text"), F.get("parts", F.lit(0))["block"].alias("block"), F.get("parts", F.lit(0))["at"].alias("at"))


def _walked(value: Column, sep: str, inside: bool) -> Column:
    """(state, seps) behind a line that begins inside quotes or not: 0 outside, 1 inside, 2 behind a quote that closes a
    cell or is the first of two; and the separators outside quotes. A quote opens a cell only at its beginning, two
    quotes inside a cell stand for one."""
    parts = F.split(value, '"', -1)
    seps = lambda p: F.length(p) - F.length(F.replace(p, F.lit(sep)))

    def step(acc, part):
        # each part but the last has a quote behind it
        opens = (acc["first"] & (part == "")) | part.endswith(sep)
        state = F.when(acc["state"] == 1, F.lit(2)).when((acc["state"] == 2) & (part == ""), F.lit(1)).when(opens, F.lit(1)).otherwise(F.lit(0))
        return F.struct(state.alias("state"), (acc["seps"] + F.when(acc["state"] == 1, F.lit(0)).otherwise(seps(part))).alias("seps"), F.lit(False).alias("first"))

    start = F.struct(F.lit(1 if inside else 0).alias("state"), F.lit(0).alias("seps"), F.lit(not inside).alias("first"))
    found = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step)
    tail = F.when(found["state"] == 1, F.lit(0)).otherwise(seps(F.element_at(parts, -1)))
    return F.struct(found["state"].alias("state"), (found["seps"] + tail).alias("seps"))


def state_behind(value: Column, sep: str, inside: bool) -> Column:
    """Whether a line ends inside quotes, given whether it begins there."""
    return F.when(F.contains(value, F.lit('"')), (_walked(value, sep, inside)["state"] == 1).cast("int")).otherwise(F.lit(int(inside)))


def cells(value: Column, sep: str) -> Column:
    """How many cells a record has."""
    return 1 + F.when(F.contains(value, F.lit('"')), _walked(value, sep, False)["seps"]).otherwise(F.length(value) - F.length(F.replace(value, F.lit(sep))))
