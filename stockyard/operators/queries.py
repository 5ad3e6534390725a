"""Summaries, pages and listings of results and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.functions.cells import shortened
from stockyard.operators import ladder, spend

TIER = "IAB Tier 1"


class UnknownColumn(ValueError):
    """A page asks for a column that the results do not have."""


def _value(name: str) -> Column:
    v = F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))
    return F.when(v == "", "(blank)").otherwise(v)


def summarize(results: DataFrame) -> DataFrame:
    """(dimension, value, n) of Quality, Type and IAB Tier 1, by grouping sets in one pass."""
    rows = results.select(_value("Quality").alias("q"), _value("Type").alias("t"), _value(TIER).alias("i"))
    out = rows.groupingSets([[F.col("q")], [F.col("t")], [F.col("i")]], F.col("q"), F.col("t"), F.col("i")).agg(F.count(F.lit(1)).alias("n"), F.grouping("q").alias("gq"), F.grouping("t").alias("gt"))
    dimension = F.when(F.col("gq") == 0, "Quality").when(F.col("gt") == 0, "Type").otherwise(TIER)
    return out.select(dimension.alias("dimension"), F.coalesce("q", "t", "i").alias("value"), "n")


def top_categories(results: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent first tiers; of equals, the one that came first."""
    per = results.groupBy(_value(TIER).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return per.orderBy(F.desc("n"), "first_seq").limit(k).select("value", "n")


def _holding(rows: DataFrame, offset: int, limit: int, most: int, ranges: int = 1024) -> tuple[DataFrame, int, int]:
    """The rows among which the page lies, how many come before them, and how many rows there are.

    Rows are counted by range of seq, and the range that holds the page is counted again in narrower ones, until at
    most `most` rows are left or one seq; each count is a scan with a filter on seq, of which `ranges` numbers come back."""
    seq = F.col("seq")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(seq.isNull()).alias("unset"), F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    if offset >= whole.n or offset < whole.unset or whole.n <= most:
        return (rows.limit(0) if offset >= whole.n else rows), 0, whole.n
    low, high, before = whole.low, whole.high, whole.unset
    while True:
        width = (high - low) // ranges + 1
        part = rows.filter(seq.between(low, high))
        found = part.groupBy(F.expr(f"(seq - ({low})) div {width}").alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts = dict(sorted((r["range"], r.n) for r in found))
        first, passed = None, before
        held = 0
        for r, n in counts.items():
            if first is None and passed + n <= offset:
                passed += n
                continue
            if first is None:
                first, before = r, passed
            held, last = held + n, r
            if before + held >= offset + limit:
                break
        low, high = low + first * width, min(high, low + (last + 1) * width - 1)
        if held <= most or width == 1:
            return rows.filter(seq.between(low, high)), before, whole.n


def page(results: DataFrame, offset: int = 0, limit: int = 50, quality: str | None = None, columns: list[str] | None = None, longest: int = 600, most: int = 10_000) -> tuple[DataFrame, int]:
    """Rows offset to offset + limit by seq, nulls first, their cells cut, and how many rows match.

    Pages beyond the first `most` rows are sought by ranges of seq (a whole number), so that the rows before them are
    counted and not sorted. The quality is compared in lower case and trimmed; null cells are blank."""
    offset, limit = max(0, offset), min(max(0, limit), 200)
    names = [c for c in results.columns if c != "seq"]
    wrong = [c for c in columns or () if c not in names]
    if wrong:
        raise UnknownColumn(f"unknown column {wrong[0]!r}; available: {', '.join(names)}")
    rows = results
    if quality:
        rows = rows.filter(F.lower(F.trim(F.coalesce(F.col("Quality"), F.lit("")))) == quality.strip().lower())
    cut = [shortened(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), longest, "…").alias(c) for c in columns or names]
    if offset + limit <= most or not isinstance(results.schema["seq"].dataType, T.IntegralType):
        return rows.orderBy("seq").offset(offset).limit(limit).select("seq", *cut), rows.count()
    near, before, n = _holding(rows, offset, limit, most)
    return near.orderBy("seq").offset(offset - before).limit(limit).select("seq", *cut), n


def list_runs(runs: DataFrame, status: str | None = None, limit: int = 20) -> DataFrame:
    """Newest first, with how many match in all."""
    rows = runs.filter(F.col("status") == status) if status else runs
    newest = rows.orderBy(F.desc("created_at"), F.desc("run_id")).limit(min(max(1, limit), 100))
    return newest.withColumn("matching", F.lit(rows.count()).cast("long"))


def run_view(runs: DataFrame, attempts: DataFrame, calls: DataFrame, now: Column) -> DataFrame:
    """Each run with its progress, spend and estimate; percent with one place, half to even."""
    summary = ladder.progress_summary(ladder.latest_state(attempts), runs)
    out = runs.select("run_id", "status", "created_at").join(summary, "run_id", "left").join(spend.run_cost(calls), "run_id", "left").join(ladder.eta(summary, runs, now), "run_id", "left")
    percent = F.when(F.col("total") > 0, F.bround(F.col("processed").cast("decimal(20,0)") * 100 / F.col("total"), 1)).otherwise(F.lit(0))
    return out.select("run_id", "status", "created_at", "total", "processed", "successful", "errors", "retrying", percent.cast("decimal(7,1)").alias("percent"), F.coalesce("usd", F.lit(0)).cast("decimal(28,9)").alias("usd"), F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), "eta")


def merge_runs(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Known runs, and archived ones that only files tell of (run_id, created_at), newest first."""
    only = artifacts.groupBy("run_id").agg(F.min("created_at").alias("created_at")).join(runs, "run_id", "left_anti").withColumn("status", F.lit("archived"))
    return runs.select("run_id", "status", "created_at").unionByName(only).orderBy(F.desc("created_at"), F.desc("run_id"))


def with_file(df: DataFrame) -> DataFrame:
    """Adds `source_file`, `size` and `modified` of the file that each row was read from; files are told apart by path."""
    return df.withColumns({"source_file": F.col("_metadata.file_path"), "size": F.col("_metadata.file_size"), "modified": F.col("_metadata.file_modification_time")})


def list_inputs(spark: SparkSession, folder: str, counts: DataFrame) -> DataFrame:
    """(source_file, size, modified, and the columns of `counts`) of the files of a folder and those below it, newest
    first.

    `counts` is a composition by source_file, a whole path as `with_file` gives it: files of one name in two folders
    are two files. A file that no row came from has its size and time and nulls; files of no bytes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("_metadata.file_path").alias("source_file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.join(counts.drop("size", "modified"), "source_file", "left").orderBy(F.desc("modified"), "source_file")
