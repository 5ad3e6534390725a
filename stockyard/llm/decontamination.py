"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scanned over token windows.

The benchmark's distinct windows are made in Spark and their index is measured before it is gathered: up to
`index_bytes`, by an estimate of what it takes in a Python worker, it is sent to every task, and a hit
counts only when its words are equal to the benchmark's. A larger benchmark is not broadcast: document
windows that pass a bitmap of fixed size (8 MB) meet benchmark windows in a shuffle join on two 64-bit
hashes, and only hits travel on, never texts. A window that many documents hold is dealt to several tasks.

Words are runs of digits, letters and anything beyond ASCII, A-Z lower-cased. An item of fewer than
`n` words is one window of its own length. Null or empty texts have no words, an item without words has
no window, and a null item id is left out of lists. Repeated items count once. Rows that repeat an id are
judged each by its own text. An empty table gives an empty result; other columns are ignored
(`contamination`) or kept (`clean`).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import FEW, if_small, ship, stored
from stockyard.llm.tokens import ALNUM, Words, pieces, signed

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
BITS = 26
#: What tells windows apart.
WINDOW = ["length", "hash", "second"]


def item_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(item, length, hash, second, words) of every window of every item."""
    for batch in batches:
        for lo, hi, data, offs in pieces(batch.column(1)):
            w = Words(data, offs, ALNUM, lower=True)
            for k in range(1, n + 1):
                at, h = w.shingles(k)
                second = w.shingles(k, 1)[1]
                if k < n:
                    whole = w.counts[w.row[at]] == k
                    at, h, second = at[whole], h[whole], second[whole]
                words = pa.array([w.bytes_of(i, k) for i in at.tolist()], type=pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + w.row[at])), pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(signed(h)), pa.array(signed(second)), words], names=["item", "length", "hash", "second", "words"])


def hashed(rows: list) -> list[tuple[int, np.ndarray, np.ndarray, list]]:
    """For each length: sorted hashes, a table of their first 20 bits, and (words, items) in that order."""
    by: dict[int, list] = defaultdict(list)
    for r in rows:
        by[r.length].append((r.hash % (1 << 64), bytes(r.words), list(r.items)))
    out = []
    for k, found in sorted(by.items()):
        found.sort(key=lambda r: r[:2])
        keys = np.array([r[0] for r in found], dtype=np.uint64)
        first = np.zeros(1 << 20, dtype=bool)
        first[(keys >> np.uint64(44)).astype(np.int64)] = True
        out.append((k, keys, first, [r[1:] for r in found]))
    return out


def hits(column: pa.Array, index: list) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[str]]]]:
    """For each piece of a text column: words, words hit, and items hit, of every row."""
    for lo, hi, data, offs in pieces(column):
        w = Words(data, offs, ALNUM, lower=True)
        edge = np.zeros(len(w) + 1, dtype=np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        for k, keys, first, rows in index:
            at, h = w.shingles(k)
            near = np.flatnonzero(first[(h >> np.uint64(44)).astype(np.int64)])
            at, h = at[near], h[near]
            low, high = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
            for i, a, b in zip(*(x[low < high].tolist() for x in (at, low, high))):
                words = w.bytes_of(i, k)
                for j in range(a, b):
                    if rows[j][0] == words:
                        edge[i] += 1
                        edge[i + k] -= 1
                        items[int(w.row[i])].update(rows[j][1])
        covered = np.cumsum(edge[:-1]) > 0
        yield w.counts, np.bincount(w.row[covered], minlength=hi - lo), [sorted(items.get(r, ())) for r in range(hi - lo)]


def scan(batches: Iterator[pa.RecordBatch], index: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [[] for _ in range(5)]
        for counts, n_hit, lists in hits(batch.column(1), index):
            for part, values in zip(parts, (counts.tolist(), n_hit.tolist(), [len(x) for x in lists], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], (n_hit > 0).tolist())):
                part.extend(values)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p, type=t) for p, t in zip(parts, types))], names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def window_batches(batches: Iterator[pa.RecordBatch], lengths: list[int], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, tag, n_words, at, length, hash, second): the windows of every row that pass the bitmap, and one
    row with a null length for the words of the row."""
    for batch in batches:
        for lo, hi, data, offs in pieces(batch.column(2)):
            w = Words(data, offs, ALNUM, lower=True)
            found = [(np.arange(hi - lo), np.zeros(hi - lo, dtype=np.int64), None, None, None)]
            for k in lengths:
                at, h = w.shingles(k)
                near = np.flatnonzero(bitmap[(h >> np.uint64(64 - BITS + 3)).astype(np.int64)] >> ((h >> np.uint64(64 - BITS)) & np.uint64(7)).astype(np.uint8) & 1)
                second = w.shingles(k, 1)[1][near]
                at, h = at[near], h[near]
                found.append((w.row[at], at - w.first[w.row[at]], k, h, second))
            for row, at, k, h, second in found:
                take = pa.array(lo + row)
                more = [pa.nulls(len(row), t) for t in (pa.int32(), pa.int64(), pa.int64())] if k is None else [pa.array(np.full(len(row), k, dtype=np.int32)), pa.array(signed(h)), pa.array(signed(second))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(w.counts[row].astype(np.int64)), pa.array(at.astype(np.int32)), *more], names=["id", "tag", "n_words", "at", "length", "hash", "second"])


def bitmap_of(windows: DataFrame) -> np.ndarray:
    """One bit for each value of the first bits of a hash: 2 ** BITS bits, whatever the benchmark's size."""
    slot = F.expr(f"shiftrightunsigned(hash, {64 - BITS})").cast("long") + 1
    rows = windows.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros((1 << BITS) // 8 + 4096, dtype=np.uint8)
    for r in rows:
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def windows_of(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """(item, length, hash, second, words) of the benchmark's distinct pairs of an item and a window, stored."""
    ship(benchmark.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("body"))
    rows = items.mapInArrow(lambda it: item_batches(it, n), "item string, length int, hash long, second long, words binary")
    return stored(rows.distinct(), "benchmark-windows")


def small_index(windows: DataFrame, index_bytes: int) -> list | None:
    """The index, if what it takes in a worker is within bounds: some 400 bytes a window, 60 an item's mention.

    Items of a window are counted first, and gathered only within these bounds."""
    of_window = windows.groupBy(*WINDOW, "words")
    size = of_window.agg(F.count("item").alias("n")).agg(F.sum(F.octet_length("words") + 400 + 60 * F.col("n")).alias("n")).first().n or 0
    return hashed(of_window.agg(F.collect_set("item").alias("items")).select("length", "hash", "words", "items").collect()) if size <= index_bytes else None


def tag_of(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def parted(rows: DataFrame, keys: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with `part`, to be joined on WINDOW and `part`: the rows of a window that has more than `many`
    are dealt to several parts, and its keys are repeated once for each.

    At most FEW windows are so frequent, as `many` rises with the rows beyond `many` * FEW of them; these
    windows are broadcast."""
    most = max(many, rows.count() // FEW + 1)
    often = rows.groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    often = F.broadcast(stored(often.select(*WINDOW, F.ceil(F.col("n") / most).alias("parts")), "frequent-windows"))
    dealt = rows.join(often, WINDOW, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("parts")), F.lit(0).cast("long")))
    each = keys.join(often, WINDOW, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)))
    return dealt.drop("parts"), each.drop("parts")


def meet(rows: DataFrame, keys: DataFrame, many: int) -> DataFrame:
    """The inner join of both on WINDOW, whatever share of the rows one window has."""
    rows, keys = parted(rows, keys, many)
    return rows.join(keys, [*WINDOW, "part"]).drop("part")


def by_join(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, many: int) -> DataFrame:
    """(id, tag, n_words, n_hit, items) of each distinct (id, text), by a shuffle join of window hashes."""
    rows = docs.select(F.col(id_col).alias("id"), tag_of(text_col).alias("tag"), F.col(text_col).alias("body"))
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())
    sent = rows.sparkSession.sparkContext.broadcast(bitmap_of(windows))
    kind = rows.schema["id"].dataType.simpleString()
    found = stored(rows.mapInArrow(lambda it: window_batches(it, lengths, sent.value), f"id {kind}, tag binary, n_words long, at int, length int, hash long, second long").distinct(), "document-windows")
    near = found.filter("length is not null").select("id", "tag", "at", *WINDOW)
    met = stored(meet(near, windows.select(*WINDOW).distinct(), many), "hits")
    # windows of a row in order: what one adds to the cover ends at its last word and begins behind the one before
    spans = F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("length")).alias("end"))))
    grown = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], a["to"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")), lambda a: a["n"].cast("long"))
    cover = met.groupBy("id", "tag").agg(spans.alias("spans")).select(F.col("id").alias("c_id"), F.col("tag").alias("c_tag"), grown.alias("n_hit"))
    hit = stored(met.select("id", "tag", *WINDOW).distinct(), "windows-hit")
    named = meet(hit, windows.filter("item is not null").select(*WINDOW, "item").distinct(), many)
    items = named.groupBy(F.col("id").alias("i_id"), F.col("tag").alias("i_tag")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    whole = found.filter("length is null").select("id", "tag", "n_words")
    out = whole.join(cover, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("tag") == F.col("c_tag")), "left").join(items, F.col("id").eqNullSafe(F.col("i_id")) & (F.col("tag") == F.col("i_tag")), "left")
    return out.select("id", "tag", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index_bytes: int = 64 << 20, many: int = 100_000) -> DataFrame:
    """One row per document: words, words inside any benchmark window, and the items hit.

    many: places of one window that a task takes, where the benchmark is joined."""
    windows = windows_of(benchmark, n, item_col, item_text_col)
    index = small_index(windows, index_bytes)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    if index is not None:
        sent = docs.sparkSession.sparkContext.broadcast(index)
        return rows.mapInArrow(lambda it: scan(it, sent.value), f"id {rows.schema['id'].dataType.simpleString()}, {RESULT}").withColumnRenamed("id", id_col)
    found = by_join(docs, windows, id_col, text_col, many).withColumnsRenamed({"id": "f_id", "tag": "f_tag"})
    every = docs.select(F.col(id_col).alias("id"), tag_of(text_col).alias("tag"))
    out = every.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("tag") == F.col("f_tag")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", index_bytes: int = 64 << 20, many: int = 100_000) -> DataFrame:
    """The documents without any word inside a benchmark window, with all their columns.

    Each row is judged by its own text, so rows that share an id, or have none, stay or go one by one."""
    windows = windows_of(benchmark, n, "item_id", "text")
    index = small_index(windows, index_bytes)
    if index is None:
        dirty = by_join(docs, windows, id_col, text_col, many).filter("n_hit > 0").select(F.col("id").alias("g_id"), F.col("tag").alias("g_tag"))
        dirty = if_small(dirty)
        return docs.join(dirty, docs[id_col].eqNullSafe(dirty["g_id"]) & (tag_of(text_col) == dirty["g_tag"]), "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = [n_hit == 0 for _, n_hit, _ in hits(batch.column(at), sent.value)]
            yield batch.filter(pa.array(np.concatenate(found))) if found else batch

    return docs.mapInArrow(run, docs.schema)
