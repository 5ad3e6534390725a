"""Target-distribution importance resampling: which documents look like the target texts, drawn with Gumbel noise.

1. Features. The tokenizers library's untrained Regex Split cuts the text, A-Z lowered, into words with byte
   offsets. A window is a pair of words, the first and last of 1 to `upto` consecutive ones; the words between
   their offsets, joined by one space, are a feature, and its CRC-32 modulo `buckets` is its bucket. A
   document's buckets are written, two bytes a feature, so that texts are cut once.
2. Histograms. Each task counts its features by bucket; the counts are summed. Their number is `buckets` at any
   corpus size, so the gains of all buckets fit in a closure.
3. Gains. floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for s of S source and t of T target
   features in the bucket. A document's weight is the sum over its features.
4. Draw. score = weight + floor(-1000 ln(-ln u)), u from the SHA-256 of seed and id. The highest scores of
   documents with `least` words are drawn, `percent` of such documents. Places come from a sort by ranges.

Null and empty texts have no features and weight 0. A null id counts as an empty one in u and comes last in ties;
rows that repeat an id share u and stand side by side. Bytes that are no UTF-8 count as U+FFFD. An empty table
gives an empty result; without target texts t and T are 0. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import numbered, ship, stored
from stockyard.llm.tokens import LOWER, pieces

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def windows(spans: list[tuple[int, int]], text: bytes, upto: int) -> Iterator[bytes]:
    """Runs of 1 to `upto` words, given the words' offsets."""
    for a, b in spans:
        yield text[a:b]
    for n in range(2, upto + 1):
        for i in range(len(spans) - n + 1):
            yield b" ".join([text[a:b] for a, b in spans[i : i + n]])


def feature_batches(batches: Iterator[pa.RecordBatch], upto: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_features, buckets as packed numbers) of each row."""
    from tokenizers import PreTokenizedString, Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
    bucket = lru_cache(1 << 16)(lambda feature: zlib.crc32(feature) % buckets)
    kind = width(buckets)
    for batch in batches:
        for lo, hi, data, offs in pieces(batch.column(1)):
            lowered, at = LOWER[data].tobytes(), offs.tolist()
            n_words, n_features, packed = [], [], []
            for r in range(hi - lo):
                text = lowered[at[r] : at[r + 1]]
                spans: list[tuple[int, int]] = []
                if text:
                    whole = text.decode("utf-8", "replace")
                    text = whole.encode()
                    cut = PreTokenizedString(whole)
                    split.pre_tokenize(cut)
                    spans = [span for _, span, _ in cut.get_splits("original", "byte") if span[0] < span[1]]
                found = np.fromiter(map(bucket, windows(spans, text, upto)), dtype=kind)
                n_words.append(len(spans))
                n_features.append(len(found))
                packed.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(packed, pa.binary())], names=["id", "n_words", "n_features", "buckets"])


def width(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def count_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of all features of a task."""
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for _, _, data, _ in pieces(batch.column(0)):
            total += np.bincount(data.view(width(buckets)), minlength=buckets)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])


def weight_batches(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weights = []
        for _, _, data, offs in pieces(batch.column(3)):
            kind = width(len(gains))
            sums = np.concatenate(([0], np.cumsum(gains[data.view(kind)])))
            weights.append(np.diff(sums[offs // np.dtype(kind).itemsize]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(weights) if weights else np.zeros(0, np.int64))], names=["id", "n_words", "n_features", "weight"])


def features(texts: DataFrame, id_: Column, text_col: str, upto: int, buckets: int, label: str) -> DataFrame:
    rows = texts.select(id_.alias("id"), F.col(text_col).alias("body"))
    return stored(rows.mapInArrow(lambda it: feature_batches(it, upto, buckets), "id long, n_words long, n_features long, buckets binary"), label)


def histogram(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n)."""
    return found.select("buckets").mapInArrow(lambda it: count_batches(it, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket; `buckets` numbers, whatever the corpus."""
    s = source.select(F.col("bucket").alias("s_bucket"), F.col("n").alias("s"))
    t = target.select(F.col("bucket").alias("t_bucket"), F.col("n").alias("t"))
    every = source.sparkSession.range(buckets).join(s, F.col("id") == F.col("s_bucket"), "left").join(t, F.col("id") == F.col("t_bucket"), "left")
    every = every.select("id", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    S, T = (x or 0.0 for x in every.agg(F.sum("s"), F.sum("t")).first())
    gain = F.floor(1000 * F.log((F.col("t") + 1) * (F.lit(float(S)) + buckets) / ((F.col("s") + 1) * (F.lit(float(T)) + buckets))))
    out = np.zeros(buckets, dtype=np.int64)
    for r in every.select("id", gain.alias("gain")).toLocalIterator():
        out[r.id] = r.gain
    return out


def resample(docs: DataFrame, target: DataFrame, upto: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (1 for the highest score drawn, null if not drawn).

    upto: most words of a feature. percent: share of the documents with at least `least` words that is drawn."""
    ship(docs.sparkSession)
    found = features(docs, F.col(id_col).cast("long"), text_col, upto, buckets, "features")
    wanted = features(target, F.lit(None).cast("long"), target_col, upto, buckets, "target-features")
    gains = gains_of(histogram(found, buckets), histogram(wanted, buckets), buckets)
    weighted = found.mapInArrow(lambda it: weight_batches(it, gains), "id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighted.withColumn("score", F.col("weight") + noise)
    able = numbered(scored.filter(F.col("n_words") >= least).withColumn("every", F.lit(0)), [F.desc("score"), F.asc_nulls_last("id")], "every", "resample-order")
    rank = F.when(F.expr(f"at < ({percent} * of) div 100"), F.col("at") + 1)
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return able.select(*columns, rank.alias("rank")).union(scored.filter(F.col("n_words") < least).select(*columns, F.lit(None).cast("long").alias("rank")))
