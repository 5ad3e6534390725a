"""Spend of model calls: exact decimals, so sums do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,9)"


def parse_cost(c: Column) -> Column:
    """A finite number of at least 0, or NULL: unpriced. Booleans and other texts are NULL."""
    d = c.cast("string").try_cast("double") if hasattr(c, "try_cast") else F.expr(f"try_cast({c} as double)")
    fine = d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d < 1e8)
    return F.when(fine, c.cast("string").try_cast("double").cast(MONEY))


def parse_costs(calls: DataFrame, col: str = "usage_cost") -> DataFrame:
    """Adds `cost`; null, so unpriced, for nulls and for whatever is not a finite number of at least 0."""
    return calls.withColumn("cost", parse_cost(F.col(col)))


def _sums() -> list[Column]:
    return [F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(28,9)").alias("usd"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("cost").isNull()).alias("unpriced_calls")]


def run_cost(calls: DataFrame) -> DataFrame:
    """(run_id, usd, calls, unpriced_calls); calls without a run are a run of their own, repeated rows all count."""
    return calls.groupBy("run_id").agg(*_sums())


def model_cost(calls: DataFrame) -> DataFrame:
    """Spend per run and model, per run, and in all (6 places); a blank model is `unknown`."""
    named = calls.withColumn("model", F.when(F.coalesce(F.trim("model"), F.lit("")) == "", "unknown").otherwise(F.col("model")))
    usd = F.round(F.coalesce(F.sum("cost"), F.lit(0)), 6).cast("decimal(28,6)").alias("usd")
    return named.rollup("run_id", "model").agg(usd, F.grouping_id().cast("int").alias("level"))


def item_cost(items: DataFrame, calls: DataFrame, key: str = "item") -> DataFrame:
    """6-place text per item: blank if no call had a price, 0.000000 without calls."""
    per = calls.groupBy(key).agg(*_sums())
    cost = F.when(F.col("calls").isNull(), "0.000000").when(F.col("calls") == F.col("unpriced_calls"), "").otherwise(F.round("usd", 6).cast("decimal(28,6)").cast("string"))
    return items.select(key).join(per, key, "left").select(key, cost.alias("Cost_USD"))


def resume_cost(snapshot: DataFrame, calls: DataFrame) -> DataFrame:
    """Saved totals per run (usd, calls, unpriced_calls, by_model map) plus new calls."""
    new = calls.groupBy("run_id").agg(*_sums())
    cols = ["run_id", "usd", "calls", "unpriced_calls"]
    both = snapshot.select(*cols).unionByName(new.select(*cols))
    totals = both.groupBy("run_id").agg(F.sum("usd").cast("decimal(28,9)").alias("usd"), F.sum("calls").alias("calls"), F.sum("unpriced_calls").alias("unpriced_calls"))
    saved = snapshot.select("run_id", F.explode("by_model").alias("model", "usd"))
    fresh = calls.filter("cost is not null").select("run_id", "model", F.col("cost").cast("decimal(28,9)").alias("usd"))
    by = saved.select("run_id", "model", F.col("usd").cast("decimal(28,9)").alias("usd")).unionByName(fresh).groupBy("run_id", "model").agg(F.sum("usd").cast("decimal(28,9)").alias("usd"))
    maps = by.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "usd")))).alias("by_model"))
    return totals.join(maps, "run_id", "left")


def token_usage(calls: DataFrame) -> DataFrame:
    """(model, requests, total_tokens, mean_tokens); null tokens count as requests of none, a null model is its own."""
    n, total = F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))
    return calls.groupBy("model").agg(n.alias("requests"), total.cast("long").alias("total_tokens"), (total.cast("decimal(20,0)") / n).cast("decimal(18,2)").alias("mean_tokens"))
