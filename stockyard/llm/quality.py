"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics come from the whole text alone (character classes, word and line shapes, repetition); label,
language, source and id never enter a score. Random Fourier features approximate a Gaussian kernel over
the standardised statistics. Each of a fixed number of training partitions sums its normal equations; the
few matrices are added up on the driver and solved with a ridge. Scores of training rows that the fit did
not see are pooled into a grid, and isotonic regression over the grid turns scores into probabilities.

Bounded sample: at most about `most` labelled rows are fitted, chosen by a hash of the id when there are
more. Everything else covers all rows. Null texts are empty, and empty texts get a score like any other.
Labels that are null are left out; an id labelled more than once counts with its mean label. Without
labelled rows every score is 0.5. Rows that repeat an id are scored alike for like text; of different texts
of a labelled id the one with the smallest statistics is learned. A null id is held out by nobody and never
labelled. Empty tables give empty results; other columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import bucket_of, if_small, ship, stored
from stockyard.llm.tokens import NOT_SPACE, Words, pieces

_KIND = np.full(256, 9, dtype=np.int64)
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()", b"!?", b"#$%&*@^~+=_", b"|<>[]{}\\/`")):
    _KIND[list(_chars)] = _kind
_KIND[128:192] = 10
_KIND[192:] = 11
KINDS = 12
NOT_NEWLINE = np.ones(256, dtype=bool)
NOT_NEWLINE[10] = False
WIDTH = KINDS + 11


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of WIDTH statistics for each text of a piece."""
    n = len(offs) - 1
    sizes = np.diff(offs)
    row = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(row * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS)
    per_byte = kinds / np.maximum(sizes, 1)[:, None]
    w = Words(data, offs, NOT_SPACE)
    lines = Words(data, offs, NOT_NEWLINE)

    def repetition(x: Words) -> tuple[np.ndarray, np.ndarray]:
        """Share of distinct among all, and share of the most frequent."""
        order = np.lexsort((x.hash, x.row))
        h, r = x.hash[order], x.row[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        most = np.zeros(n)
        np.maximum.at(most, r[at], np.diff(np.concatenate((at, [len(h)]))))
        total = np.maximum(x.counts, 1)
        return np.bincount(r[new], minlength=n) / total, most / total

    total = np.maximum(w.counts, 1)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.row, length, minlength=n) / total
    spread = np.sqrt(np.maximum(np.bincount(w.row, length**2, minlength=n) / total - mean**2, 0))
    first, last = _KIND[data[w.start]], _KIND[data[w.end - 1]]
    share = lambda flag: np.bincount(w.row[flag], minlength=n) / total
    words, lines_ = repetition(w), repetition(lines)
    more = (np.log1p(w.counts), mean, spread, share(first == 1), share(last == 6), share(last == 7), share((last == 5)), *words, *lines_)
    return np.column_stack((per_byte, *more))


def stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [statistics(data, offs).astype(np.float32) for _, _, data, offs in pieces(batch.column(1))]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0, dtype=np.float32)
        column = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, WIDTH, dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["id", "stats"])


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(stat_batches, f"id {rows.schema['id'].dataType.simpleString()}, stats array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the statistics' random projection
    phase: np.ndarray
    beta: np.ndarray | None = None
    grid: np.ndarray | None = None
    level: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        rff = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase)
        return np.column_stack((np.ones(len(z)), rff))

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(stats), 0.5)
        raw = self.ridge(stats)
        # a hundredth of the raw order keeps ties of the calibration apart
        return 0.99 * np.interp(raw, self.grid, self.level) + 0.01 / (1 + np.exp(-4 * (raw - 0.5)))


def isotonic(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over grid points; the centre and level of each pooled block."""
    blocks: list[list[float]] = []
    for a, n, k in zip(x.tolist(), total.tolist(), ones.tolist()):
        blocks.append([a * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def unpacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(float)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", label_id: str = "doc_id", folds: int = 5, held_out: int = 0, most: int = 200_000, features: int = 160, width: float = 4.0, penalty: float = 1e-3, seed: int = 11, partitions: int = 8) -> Model:
    """Fit on labelled rows of `stats` (id, stats) outside fold `held_out`; fold `held_out` + 1 calibrates."""
    rng = np.random.default_rng(seed)
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("l_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    rows = stats.filter("id is not null").withColumn("fold", bucket_of("id", folds)).filter(F.col("fold") != held_out)
    rows = rows.join(known, rows.id == known.l_id).groupBy("id", "fold", "label").agg(F.min("stats").alias("stats"))
    rows = stored(rows.select("id", "stats", "label", "fold"), "labelled")
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(most / n * (1 << 20)))
    means = [f(F.col("stats")[i].cast("double")) for i in range(WIDTH) for f in (F.avg, F.stddev_pop)]
    found = rows.agg(*(m.alias(f"m{i}") for i, m in enumerate(means))).first() if n else None
    mean = np.array([found[2 * i] for i in range(WIDTH)]) if n else np.zeros(WIDTH)
    scale = np.array([found[2 * i + 1] for i in range(WIDTH)]) if n else np.ones(WIDTH)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / width, (WIDTH, features)), rng.uniform(0, 2 * np.pi, features))
    if not n:
        return model
    sent = model

    def normal(batches):
        m = len(sent.phase) + 2
        total = np.zeros((m, m))
        for batch in batches:
            z = np.column_stack((sent.features(unpacked(batch.column(0))), batch.column(1).to_numpy()))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], names=["m"])

    fold = (held_out + 1) % folds
    train = rows.filter(F.col("fold") != fold) if rows.filter(F.col("fold") == fold).limit(1).count() and rows.filter(F.col("fold") != fold).limit(1).count() else rows
    sums = sum(np.frombuffer(bytes(r.m)).reshape(features + 2, -1) for r in train.select("stats", "label").repartition(partitions).mapInArrow(normal, "m binary").collect())
    a, b = sums[:-1, :-1], sums[:-1, -1]
    reg = penalty * max(a[0, 0], 1.0) * np.eye(len(a)) / len(a)
    reg[0, 0] = 0
    model.beta = np.linalg.solve(a + reg, b)

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.rint(sent.ridge(unpacked(batch.column(0))) * 500), -1000, 1500).astype(np.int32)), batch.column(1)], names=["at", "label"])

    unseen = rows.filter(F.col("fold") == fold) if train is not rows else rows
    grid = unseen.select("stats", "label").mapInArrow(raw, "at int, label double").groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).orderBy("at").collect()
    x, total, ones = (np.array([r[i] for r in grid], dtype=float) for i in range(3))
    # one virtual row of either label keeps probabilities off 0 and 1
    model.grid, model.level = isotonic(x / 500, total, ones)
    model.level = np.clip(model.level, 0.001, 0.999)
    return model


def score(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of rows (id, stats)."""
    ship(stats.sparkSession)
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = sent.value.score(unpacked(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return stats.select("id", "stats").mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    stats = stored(with_statistics(docs, id_col, text_col), "statistics")
    model = fit(stats, labels, folds=folds, held_out=held_out, **options)
    out = score(stats, model, threshold)
    return out.select(F.col("id").alias(id_col), (bucket_of("id", folds) == held_out).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The documents predicted to be good, with all their columns, each row by its own text; only texts of
    labelled documents are looked at for the fit, and texts are shuffled only if their ids cannot be broadcast."""
    label_id = options.get("label_id", "doc_id")
    known = if_small(labels.select(F.col(label_id).alias("l_id")).filter("l_id is not null").distinct())
    labelled = docs.join(known, docs[id_col] == known["l_id"], "left_semi")
    stats = stored(with_statistics(labelled, id_col, text_col), "statistics")
    sent = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, **options))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            parts = [sent.value.score(statistics(data, offs).astype(np.float32).astype(float)) for _, _, data, offs in pieces(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(parts) >= threshold)) if parts else batch

    return docs.mapInArrow(run, docs.schema)
