"""The attempt ladder: latest states, who is retried on which rung, progress, failures.

`attempts` is an append-only log (run_id, item, type, seq, ts, rung, status, error, seconds); seq is unique.
Latest states are struct maxima, which aggregate before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.operators.carry import HOT, with_prior
from stockyard.operators.evidence import is_antibot

KEY = ["run_id", "item"]
SUCCESS, PENDING, ERROR = "success", "retry_pending", "error"


def latest_state(attempts: DataFrame) -> DataFrame:
    """The last attempt of each item, with the place at which the item first appeared."""
    rest = [c for c in attempts.columns if c not in KEY]
    out = attempts.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("s"), F.min("seq").alias("first_seq"))
    return out.select(*KEY, "s.*", "first_seq")


def ids_by_status(state: DataFrame, status: str) -> DataFrame:
    """(run_id, item) of a status, sorted, nulls first; items without a status are of none."""
    return state.filter(F.col("status") == status).select(*KEY).orderBy(*KEY)


def _keys(items: DataFrame, state: DataFrame) -> list[str]:
    return [k for k in KEY if k in items.columns and k in state.columns]


def pending_items(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items that have not succeeded."""
    return items.join(state.filter(F.col("status") == SUCCESS), _keys(items, state), "left_anti")


def first_pass(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items that neither succeeded nor wait for a retry; null items, which have no state, and repeated ones stay."""
    return items.join(state.filter(F.col("status").isin(SUCCESS, PENDING)), _keys(items, state), "left_anti")


def retry_set(items: DataFrame, state: DataFrame) -> DataFrame:
    """Websites to be tried again."""
    return items.filter(F.col("type") == "website").join(state.filter(F.col("status").isin(PENDING, ERROR)), _keys(items, state), "left_semi").orderBy("row_no")


def deep_set(items: DataFrame, state: DataFrame) -> DataFrame:
    """Websites for the deep rung, or `blocked` where an anti-bot system answered."""
    waiting = state.filter(F.col("status").isin(PENDING, ERROR) & ~((F.col("status") == PENDING) & (F.col("rung") == "deep")))
    keys = _keys(items, state)
    out = items.filter(F.col("type") == "website").join(waiting.select(*keys, "error"), keys)
    return out.withColumn("route", F.when(is_antibot(F.col("error")), "blocked").otherwise("deep")).drop("error")


def next_rung(items: DataFrame, state: DataFrame, deep: bool = True, research: bool = True) -> DataFrame:
    """done, first_pass, deep, research or failed for every item."""
    keys = _keys(items, state)
    known = items.join(state.select(*keys, "status", "rung", "error"), keys, "left")
    site, status = F.col("type") == "website", F.col("status")
    blocked = is_antibot(F.col("error"))
    tried_deep = (status == PENDING) & (F.col("rung") == "deep")
    tried_research = F.coalesce(F.col("rung"), F.lit("")) == "research"
    route = F.when(status == SUCCESS, "done").when(status.isNull() | (~site & (status == PENDING)), "first_pass")
    if deep:
        route = route.when(site & ~tried_deep & ~blocked & ~tried_research, "deep")
    if research:
        route = route.when(site & ~((status == ERROR) & tried_research), "research")
    return known.withColumn("route", route.otherwise("failed")).drop("status", "rung", "error")


def finalize_pending(state: DataFrame) -> DataFrame:
    """Pending items become errors; `finalized` marks them."""
    waiting = F.col("status") == PENDING
    return state.withColumn("finalized", waiting).withColumn("status", F.when(waiting, ERROR).otherwise(F.col("status")))


def reset_failed(state: DataFrame) -> DataFrame:
    """The states without errors; those without a status are left out too."""
    return state.filter(F.col("status") != ERROR)


def bot_protection(attempts: DataFrame, hot: int = HOT) -> DataFrame:
    """Adds bot_protection, from each outcome and the one just before it; no error or rung counts as blank.

    Items with over `hot` attempts are worked on in ranges. Of attempts with one seq it is not defined which is first."""
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = with_prior(attempts, KEY, "seq", ["error", "rung"], hot=hot)
    rows = rows.withColumn("prior_error", text(F.col("__prior.error"))).withColumn("prior_rung", text(F.col("__prior.rung"))).drop("__prior")
    failed = F.col("status") != SUCCESS
    now = failed & is_antibot(F.col("error"))
    research = F.col("rung") == "research"
    before = F.when(F.col("prior_rung") == "", "direct").otherwise(F.col("prior_rung"))
    rung = F.when(now & ~research, F.col("rung")).when(is_antibot(F.col("prior_error")) | now, before)
    verdict = F.when(rung == "deep", "Aggressive").when(rung.isNotNull(), "Moderate").when(failed | research, "Unknown").otherwise("None Detected")
    return rows.withColumn("bot_protection", verdict).drop("prior_error", "prior_rung")


def best_per_identifier(results: DataFrame, key: str = "Domain") -> DataFrame:
    """One row per identifier: the last good one, else the last; `first_seq` gives the order of appearance."""
    rest = [c for c in results.columns if c != key]
    good = (F.coalesce(F.col("Quality"), F.lit("")) != "Failed").cast("int")
    out = results.groupBy(f"`{key}`").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(good.alias("g"), F.col("seq"))).alias("r"), F.min("seq").alias("first_seq"))
    return out.select(f"`{key}`", "r.*", "first_seq")


def chain_errors(attempts: DataFrame, hot: int = HOT) -> DataFrame:
    """Failed research attempts tell what failed before. Items with over `hot` attempts are worked on in ranges."""
    rows = with_prior(attempts, KEY, "seq", ["error"], hot=hot)
    prior = F.coalesce("__prior.error", F.lit(""))
    chained = F.when((F.col("rung") == "research") & (F.col("status") != SUCCESS) & (prior != ""), F.concat(prior, F.lit("; research fallback: "), F.col("error"))).otherwise(F.col("error"))
    return rows.withColumn("message", chained).drop("__prior")


def progress_counts(state: DataFrame) -> DataFrame:
    """(run_id, entries, successful, errors, retrying, first, last): items by status, and the seconds of the earliest
    and the latest of their last attempts."""
    second = F.unix_timestamp("ts")
    of = lambda status: F.count_if(F.col("status") == status)
    return state.groupBy("run_id").agg(F.count(F.lit(1)).alias("entries"), of(SUCCESS).alias("successful"), of(ERROR).alias("errors"), of(PENDING).alias("retrying"), F.min(second).alias("first"), F.max(second).alias("last"))


def summary_of(counts: DataFrame, runs: DataFrame) -> DataFrame:
    """The progress summary of runs from `progress_counts`, however they came about."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = runs.select("run_id", F.col("total").cast("long").alias("total")).join(counts, "run_id", "left")
    out = out.select("run_id", "total", z("entries").alias("entries"), z("successful").alias("successful"), z("errors").alias("errors"), z("retrying").alias("retrying"), (F.col("last") - F.col("first")).alias("elapsed"))
    out = out.withColumn("processed", F.col("entries") - F.col("retrying")).withColumn("remaining", F.greatest(F.col("total") - F.col("processed"), F.lit(0).cast("long")))
    share = F.when(F.col("total") > 0, (F.col("processed").cast("decimal(20,0)") * 100 / F.col("total")).cast("decimal(9,2)")).otherwise(F.lit(0).cast("decimal(9,2)"))
    pace = F.when((F.col("processed") > 0) & (F.col("elapsed") > 0), F.expr("(elapsed * remaining) div processed"))
    return out.withColumn("completion", share).withColumn("eta_seconds", pace)


def progress_summary(state: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts per run: total (from runs), processed, successful, errors, retrying, remaining, completion, mean pace."""
    return summary_of(progress_counts(state), runs)


def eta(summary: DataFrame, runs: DataFrame, now: Column, deep_seconds: int = 15) -> DataFrame:
    """Two-rate estimate in whole seconds, half to even: mean pace for the rest, a fixed cost per retry."""
    s = summary.select("run_id", "total", "entries", "retrying").join(runs.select("run_id", "status", "started_at"), "run_id")
    elapsed = F.unix_timestamp(now) - F.unix_timestamp("started_at")
    left = F.greatest(F.col("total") - F.col("entries"), F.lit(0).cast("long"))
    guess = F.bround(left.cast("double") * elapsed / F.col("entries") + F.col("retrying") * deep_seconds, 0).cast("long")
    return s.select("run_id", F.when((F.col("status") == "running") & (elapsed > 5) & (F.col("entries") > 0), guess).alias("eta"))


def progress_shares(summary: DataFrame, runs: DataFrame) -> DataFrame:
    """Percent done well, retrying and failed, and overall, which is 100 for completed runs."""
    pct = lambda c: F.when(F.col("total") > 0, (c.cast("decimal(20,0)") * 100 / F.col("total")).cast("decimal(9,2)")).otherwise(F.lit(0).cast("decimal(9,2)"))
    bound = lambda c: F.least(F.greatest(c, F.lit(0).cast("decimal(9,2)")), F.lit(100).cast("decimal(9,2)"))
    out = summary.join(runs.select("run_id", F.col("status").alias("run_status")), "run_id")
    overall = F.when(F.col("run_status") == "completed", F.lit(100).cast("decimal(9,2)")).otherwise(bound(pct(F.col("processed"))))
    return out.select("run_id", pct(F.col("successful")).alias("ok"), pct(F.col("retrying")).alias("retry"), pct(F.col("errors")).alias("fail"), overall.alias("overall"))


def outcome_counts(attempts: DataFrame) -> DataFrame:
    """Items, not attempts, by their last outcome."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col("status") == SUCCESS)
    return latest_state(attempts).groupBy("run_id").agg(n.alias("items"), ok.alias("ok"), (n - ok).alias("failed"), ((n - ok).cast("decimal(20,0)") * 100 / n).cast("decimal(7,2)").alias("failure_rate"))


def short_error(c: Column, longest: int = 80) -> Column:
    """First line, first sentence, at most `longest` characters."""
    line = F.trim(F.substring_index(F.trim(c), "\n", 1))
    sentence = F.substring_index(line, ". ", 1)
    return F.when(F.length(sentence) > longest, F.concat(F.left(sentence, F.lit(longest - 1)), F.lit("…"))).otherwise(sentence)


def failure_digest(state: DataFrame, n: int = 5) -> DataFrame:
    """Failures by short error: their number, the first n items, and how many more there are."""
    failed = state.filter(F.col("status") == ERROR).withColumn("short", short_error(F.coalesce(F.col("error"), F.lit(""))))
    counts = failed.groupBy("run_id", "short").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("run_id", "short").orderBy("first_seq", "item"))
    first = failed.withColumn("place", place).filter(F.col("place") <= n).groupBy("run_id", "short").agg(F.array_sort(F.collect_list(F.struct("place", F.col("item").cast("string").alias("item")))).alias("s"))
    items = F.array_join(F.transform("s", lambda x: x["item"]), ",")
    return counts.join(first, ["run_id", "short"]).select("run_id", "short", "n", items.alias("sample"), F.greatest(F.col("n") - n, F.lit(0).cast("long")).alias("more"))


def recent_activity(attempts: DataFrame, n: int = 10) -> DataFrame:
    """The last n items by the order in which they first appeared."""
    return latest_state(attempts).orderBy(F.desc("first_seq")).limit(n)
