"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its content. A ledger holds (blob, rule version, findings); a
scan takes the distinct blobs that the ledger lacks for the rule version in force, scans each once and
joins findings back to every path (row) that holds the blob. Native: DataFrame operations only.

The ledger is a folder of Parquet files, one subfolder per rule version, that scans append to: a new batch
of versions costs the scan of the texts that no batch before had, and a new rule version scans all again.

Distinct blobs come out of one hash aggregation on (digest, text) with map-side partial aggregation, so
copies cost one scan and a group of any size is no hot task; findings join back by digest, and skewed
digests are split at run time. Spans count code points: a regex splits a text into gaps and
matches, whose running lengths are the positions.

Null text is empty and has no findings; empty tables give empty results; repeated rows each get a row;
columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.llm.common import if_small

#: Kind, pattern, group whose length counts, least length; in the order of ties.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
RULE_VERSION = "base-1"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans_of(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of all leftmost non-overlapping matches whose group is long enough."""
    bound = rf"(?<![0-9a-f])[0-9a-f]{{{least},}}" if kind == "hex" else pattern
    # a run of hex digits that is too short is dropped by the rule: only the long runs are cut out
    whole = F.regexp_extract_all(text, F.lit(bound), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(bound), F.lit(group)) if group else whole
    gaps = F.split(text, bound, -1)
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("hit"), counted.alias("part"))
    empty = F.lit(None).cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast(SPAN)).alias("found"))

    def step(acc, x):
        at = acc["at"] + F.length(x["gap"])
        end = at + F.length(x["hit"])
        one = F.array(F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(bound), F.aggregate(steps, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(SPAN))


def blobs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(blob, body): each distinct text once, under its content address."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("body")).select(F.unhex(F.sha2("body", 256)).alias("blob"), "body")
    return rows.groupBy("blob", "body").agg(F.count(F.lit(1)).alias("n")).select("blob", "body")


def scan(new_blobs: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """Ledger entries (blob, version, found) of the blobs given."""
    found = F.concat(*(spans_of(F.col("body"), i, *rule) for i, rule in enumerate(RULES)))
    return new_blobs.select("blob", F.lit(version).alias("version"), F.array_sort(found).alias("found"))


def extend_ledger(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """The entries that the ledger lacks: unseen blobs, or blobs not yet scanned by this rule version."""
    todo = blobs(docs, text_col)
    if ledger is not None:
        seen = if_small(ledger.filter(F.col("version") == version).select(F.col("blob").alias("seen")))
        todo = todo.join(seen, todo.blob == seen.seen, "left_anti")
    return scan(todo, version)


class Ledger:
    """A ledger at a path of the shared folder. One scan at a time may append; a failed one leaves no entries."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        """(blob, found, version); empty before the first scan."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = f"blob binary, found {SPAN}, version string"
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def extend(self, docs: DataFrame, version: str = RULE_VERSION, text_col: str = "text") -> None:
        """Scan what is new in `docs`, and append its findings."""
        extend_ledger(docs, self.entries(), version, text_col).write.mode("append").partitionBy("version").parquet(self.path)


def findings(docs: DataFrame, ledger: DataFrame, version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per path: id and the spans found in its blob."""
    paths = docs.select(F.col(id_col).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("p_blob"))
    entries = ledger.filter((F.col("version") == version) & (F.size("found") > 0)).select("blob", "found")
    return paths.join(entries, paths.p_blob == entries.blob, "left").select(F.col("path").alias(id_col), F.coalesce("found", F.array().cast(SPAN)).alias("found"))
