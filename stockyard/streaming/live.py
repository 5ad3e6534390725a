"""Progress that is maintained while attempts arrive."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stockyard.operators import ladder
from stockyard.shipping import children, delete, ship


def live_progress(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the latest state of every item; each batch writes only the items that changed.

    A batch that runs again after a failure overwrites its own folder, so its rows count once. Items are
    kept until the query ends: an attempt may follow at any time, so there is no watermark.
    """
    rest = [c for c in stream.columns if c not in ladder.KEY]
    state = stream.groupBy(*ladder.KEY).agg(F.max_by(F.struct(*rest), "seq").alias("s"), F.min("seq").alias("first_seq"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(*ladder.KEY, "s.*", "first_seq").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_live_state(spark: SparkSession, out: str) -> DataFrame:
    """The latest state over all batches so far."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*ladder.KEY, "batch")]
    return rows.groupBy(*ladder.KEY).agg(F.max_by(F.struct(*rest), F.struct("seq", "batch")).alias("s")).select(*ladder.KEY, "s.*")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
COUNTS = "run_id long, status string, second long, n long"


NONE = -(1 << 63)  # stands for a missing number on the way to Python, where a column with nulls would be floats
STATE = "held string"


def _retract(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the new attempts of one bucket of items change in the counts of their runs: old states go, new ones come.

    `held` has run, item, and number, status and second of the last attempt, for each item of the bucket. Attempts that
    are no later than the one known change nothing, so that repeated and late rows count once; an item without any
    number is an entry all the same."""
    best = {(run, item): tuple(last) for run, item, *last in json.loads(state.get[0])} if state.exists else {}
    old: dict[tuple, tuple | None] = {}
    for batch in batches:
        for run, item, seq, status, second in zip(*(batch[c].tolist() for c in ("run_id", "item", "seq", "status", "second"))):
            at = run, item
            known = best.get(at)
            if known is None:
                best[at], old[at] = (seq, status, second) if seq != NONE else (NONE, None, NONE), None
            elif seq > known[0]:
                old.setdefault(at, known)
                best[at] = seq, status, second
    if not old:
        return
    state.update((json.dumps([(*at, *last) for at, last in best.items()]),))
    changed: Counter = Counter()
    for at, was in old.items():
        changed[at[0], *best[at][1:]] += 1
        if was is not None:
            changed[at[0], *was[1:]] -= 1
    rows = [(*k, n) for k, n in changed.items() if n]
    run, status, second, n = zip(*rows) if rows else ((),) * 4
    number = lambda of: pd.Series([None if x == NONE else x for x in of], dtype="Int64")
    yield pd.DataFrame({"run_id": number(run), "status": pd.Series(status, dtype=object), "second": number(second), "n": pd.Series(n, dtype="int64")})


def live_summary(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False, buckets: int = 1 << 12) -> StreamingQuery:
    """Keep the counts behind the progress summary of every run (L12) while attempts (run_id, item, seq, ts, status)
    arrive: items by run, status and the second of their last attempt.

    The last attempt of each item is in the state store (RocksDB, so on disk), by buckets of items: Python is called once
    for each bucket that a batch touches, not for each item, and reads and writes the bucket whole. With far more than
    a million items and small batches take more `buckets`; they stay as they are as long as the checkpoint is used. Items
    are told apart by their text. Each batch takes what it changes, adds
    it to the counts of the batch before and writes them as its own version; so a batch that runs again writes
    the same. Counts have a row for each second in which some item's last attempt lies, not for each item. Items are
    kept until the query ends, as an attempt may follow at any time."""
    spark = stream.sparkSession
    ship(spark)
    number = lambda c: F.coalesce(c.cast("long"), F.lit(NONE))
    item = F.col("item").cast("string")
    bucket = F.pmod(F.xxhash64(F.col("run_id").cast("long"), item), F.lit(buckets))
    rows = stream.select(bucket.alias("bucket"), number(F.col("run_id")).alias("run_id"), item.alias("item"), number(F.col("seq")).alias("seq"), "status", number(F.unix_timestamp("ts")).alias("second"))
    changes = rows.groupBy("bucket").applyInPandasWithState(_retract, COUNTS, STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if f"version={batch_id - 1}" in children(session, out):
            batch = batch.unionByName(session.read.schema(COUNTS).parquet(f"{out}/version={batch_id - 1}"))
        batch.groupBy("run_id", "status", "second").agg(F.sum("n").alias("n")).filter("n <> 0").write.mode("overwrite").parquet(f"{out}/version={batch_id}")
        delete(session, f"{out}/version={batch_id - 2}")

    held = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.unset(PROVIDER) if held is None else spark.conf.set(PROVIDER, held)


def read_live_summary(spark: SparkSession, out: str, runs: DataFrame) -> DataFrame:
    """`ladder.progress_summary` of all attempts so far, from the newest counts."""
    written = [int(f.removeprefix("version=")) for f in children(spark, out) if f.startswith("version=") and "_SUCCESS" in children(spark, f"{out}/{f}")]
    counts = spark.read.schema(COUNTS).parquet(f"{out}/version={max(written)}") if written else spark.createDataFrame([], COUNTS)
    of = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0))
    per = counts.groupBy("run_id").agg(F.sum("n").alias("entries"), of(ladder.SUCCESS).alias("successful"), of(ladder.ERROR).alias("errors"), of(ladder.PENDING).alias("retrying"), F.min("second").alias("first"), F.max("second").alias("last"))
    return ladder.summary_of(per, runs)
