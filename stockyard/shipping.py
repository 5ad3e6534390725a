"""What driver and executors share: this package, and a folder for written tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark context.

    Batches of texts between the JVM and Python have 2,000 rows, not Spark's default of 10,000, so that those of
    long texts fit beside the heap; a session that sets another number keeps it."""
    sc = spark.sparkContext
    if spark.conf.get(ROWS_PER_BATCH) == "10000":
        spark.conf.set(ROWS_PER_BATCH, "2000")
    if getattr(sc, "_stockyard_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="spark-"), "stockyard_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.join("stockyard", os.path.relpath(path, root)))
    sc.addPyFile(out)
    sc._stockyard_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets
    one of its own; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get()
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def files_of(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files that paths, folders and patterns name, in the order given, those of one by name; hidden ones are not."""
    found: dict[str, None] = {}
    for path in [paths] if isinstance(paths, str) else paths:
        named = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = named.getFileSystem(spark._jsc.hadoopConfiguration())
        todo = [f for f in fs.globStatus(named) or ()]
        inner = []
        while todo:
            f = todo.pop()
            if f.isDirectory():
                todo += [g for g in fs.listStatus(f.getPath()) if g.getPath().getName()[0] not in "._"]
            else:
                inner.append(f.getPath().toString())
        found |= dict.fromkeys(sorted(inner))
    return list(found)


def results_dir(spark: SparkSession) -> str:
    """This application's folder for tables that lazy results read; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/stockyard-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_stockyard_results", None) != path:
        spark.sparkContext._stockyard_results = path

        def clear() -> None:
            with contextlib.suppress(Exception):  # the session may have been stopped before
                delete(spark, path)

        atexit.register(clear)
    return path


def release(spark: SparkSession) -> None:
    """Delete the tables written so far in this session. Results that still read them cannot be used any more, so a long
    session calls this between pieces of work whose results are written or collected."""
    delete(spark, results_dir(spark))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    spark = df.sparkSession
    path = f"{results_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
