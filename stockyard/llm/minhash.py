"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct 5-word shingles (64-bit hashes; words are not compared beyond them).

1. Classes. Documents with equal sets are one class; copies take no further part. Sets that no other set can be
   near enough to, by size alone, end here.
2. Signature. One hash of each shingle: its leading bits choose one of bands * width bins, and a bin keeps its
   smallest hash. An empty bin borrows that of a full one, found by hashing the bin's number and an attempt until
   a full bin is met (the same attempts for all documents), so two signatures agree in a bin with a probability of
   the similarity.
3. Bands. `width` bins together are a bucket. With 64 bands of 8, two sets of similarity 0.85 share no bucket with
   a probability of 1.5e-9, sets of 0.5 share one with 0.22.
4. Stars. In a bucket every class is tied to one centre, the class of the smallest hash, so a bucket of m classes
   has m - 1 candidate edges. A task ties the classes of its own rows first and sends on one centre a bucket;
   centres meet in the shuffle. A bucket in a third of all documents is one row per run of each task.
5. Links. Every candidate edge is confirmed on full sets, those of one centre in tiles of bounded bytes.
6. What stars miss. Two classes of a bucket that are near each other, but not near their centre, are still apart
   after 5. Buckets with several components are searched whole: the classes outside the largest component ask
   tiles that hold the bucket's classes. So the components are those of all pairs that share a bucket.

Null or empty text, or text without words, has an empty set and links with nothing. Fewer words than a shingle are
one shingle. Rows that repeat an id with the same set share its class; rows that repeat an id with other texts are
separate documents. Null ids never name a component unless it has no other id. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import Workspace, stored
from stockyard.llm.components import components
from stockyard.llm.similarity_join import Search, divide_skip, keys_of, packed, set_batches, sets_of
from stockyard.llm.tokens import Words, mix, pieces, signed

U = np.uint64


def signatures(row: np.ndarray, h: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """The densified one-permutation sketch of each row; (row, h) distinct, by row and then hash. Empty rows stay 0."""
    shift = U(64 - bins.bit_length() + 1)
    place = (h >> shift).astype(np.int64)
    low = np.ones(len(h), dtype=bool)
    low[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    sketch, full = np.zeros((rows, bins), dtype=np.uint64), np.zeros((rows, bins), dtype=bool)
    sketch[row[low], place[low]] = h[low]
    full[row[low], place[low]] = True
    r, b = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        lender = (mix(b.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(attempt * 0xD1342543DE82EF95 % 2**64)) % U(bins)).astype(np.int64)
        met = full[r, lender]
        sketch[r[met], b[met]] = sketch[r[met], lender[met]]
        r, b = r[~met], b[~met]
    return sketch


def buckets_of(sketch: np.ndarray, bands: int) -> np.ndarray:
    """The bucket of each row in each band."""
    by_band = sketch.reshape(len(sketch), bands, -1)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), by_band.shape[:2])
    for i in range(by_band.shape[2]):
        out = mix(out ^ mix(by_band[:, :, i]))
    return out


def stars(bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, key) by bucket, the centre first; and where buckets begin."""
    order = np.lexsort((key, mix(key.view(np.uint64)), bucket))
    bucket, key = bucket[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])
    bucket, key = bucket[new], key[new]
    first = np.ones(len(key), dtype=bool)
    first[1:] = bucket[1:] != bucket[:-1]
    return bucket, key, first


def tied(bucket: np.ndarray, key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, class, centre) of the classes that are not centres."""
    centre = key[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else key
    return bucket[~first], key[~first], centre[~first]


def band_batches(batches: Iterator[pa.RecordBatch], k: int, seed: int, least: int, bands: int, width: int, parts: int, many: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(part, buckets, keys, centres): postings of a run of rows, packed by part of the hash range. Postings have no
    centres; classes that the run has tied already come with theirs."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    names = ["part", "buckets", "keys", "centres"]

    def flush():
        bucket, key, first = stars(*(np.concatenate(x) for x in zip(*held)))
        ties = tied(bucket, key, first)
        bucket, key = bucket[first], key[first]
        part = (bucket % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, bucket, key = part[order], bucket[order], key[order]
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ends = np.append(edges, len(part))
        yield pa.RecordBatch.from_arrays([pa.array(part[edges]), packed(bucket, ends), packed(key, ends), pa.nulls(len(edges), pa.binary())], names=names)
        if len(ties[0]):
            whole = np.array([0, len(ties[0])])
            yield pa.RecordBatch.from_arrays([pa.array([int(ties[0][0] % U(parts))]), *(packed(x, whole) for x in ties)], names=names)

    size = 0
    for batch in batches:
        for lo, hi, data, offs in pieces(batch.column(0)):
            row, h = sets_of(Words(data, offs, lower=True), k)
            key, _ = keys_of(row, h, hi - lo, seed)
            n = np.bincount(row, minlength=hi - lo)
            first = np.zeros(hi - lo, dtype=bool)
            first[np.unique(key, return_index=True)[1]] = True
            use = first & (n >= least)
            inside = use[row]
            if not use.any():
                continue
            found = buckets_of(signatures((np.cumsum(use) - 1)[row[inside]], h[inside], int(use.sum()), bands * width), bands)
            held.append((found.ravel(), np.repeat(signed(key)[use], bands)))
            size += found.size
            if size >= many:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def meet(table: pa.Table) -> pa.Table:
    """(bucket, u, v): the classes of one part of the hash range and their centres."""
    columns = [[np.frombuffer(x.as_py(), dtype=kind) for x in table[c].filter(mask)] for mask in (table["centres"].is_null(), table["centres"].is_valid()) for c, kind in (("buckets", np.uint64), ("keys", np.int64))]
    buckets, keys, *ties = columns
    out = [(b, k, np.frombuffer(c.as_py(), dtype=np.int64)) for b, k, c in zip(*ties, table["centres"].filter(table["centres"].is_valid()))]
    if buckets:
        out.append(tied(*stars(np.concatenate(buckets), np.concatenate(keys))))
    bucket, u, v = (np.concatenate(x) for x in zip(*out))
    return pa.table([pa.array(signed(bucket)), pa.array(u), pa.array(v)], names=["bucket", "u", "v"])


class Bands(Search):
    """The search of the similarity join with banded buckets in place of inverted lists."""

    def __init__(self, work: Workspace, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, bands: int, width: int, few: int, tile: int):
        super().__init__(work, docs, id_col, text_col, k, percent, 0, 0.0, few, tile, False)
        self.bands, self.width = bands, width

    def edges(self) -> DataFrame:
        """(bucket, u, v): every class that shares a bucket, tied to a centre of it."""
        k, seed, bands, width = self.k, self.seed, self.bands, self.width
        least = next(n for n in range(1, 101) if self.percent * (n + 1) <= 100 * n)
        parts = max(64, math.ceil(self.classes.filter(self.linkable("n")).count() * bands / 1_000_000))
        postings = self.rows.select("body").mapInArrow(lambda it: band_batches(it, k, seed, least, bands, width, parts), "part long, buckets binary, keys binary, centres binary")
        return self.work.stored(postings.groupBy("part").applyInArrow(meet, "bucket long, u long, v long"), "stars")

    def full_sets(self, keys: DataFrame) -> DataFrame:
        """(key, n, toks) of the classes in `keys` (node)."""
        left = self.work.stored(self.classes.join(keys, F.col("key") == F.col("node")).select("key", "first_id", "n"), "candidates")
        sent = F.broadcast if left.count() <= self.few else (lambda df: df)
        ids = sent(left.select(F.col("first_id").alias("i")).distinct())
        k, seed = self.k, self.seed
        texts = self.rows.select("id", "body").join(ids, F.col("id").eqNullSafe(F.col("i")), "left_semi")
        sets = texts.mapInArrow(lambda it: set_batches(it, k, seed), "id long, key long, toks array<long>")
        wanted = left.select(F.col("key").alias("w"), "first_id", "n")
        sets = sets.join(sent(wanted), (F.col("key") == F.col("w")) & F.col("id").eqNullSafe(F.col("first_id")))
        return self.work.stored(sets.groupBy("key").agg(F.any_value("n").alias("n"), F.any_value("toks").alias("toks")), "full-sets")

    def by_stars(self, edges: DataFrame, sets: DataFrame) -> DataFrame:
        """(u, v) of the candidate edges that are links. Centres are targets of tiles, what is tied to them asks there."""
        sizes = sets.select(F.col("key").alias("s_key"), F.col("n").alias("s_n"))
        pairs = edges.select("u", "v").distinct()
        for end in ("u", "v"):
            pairs = pairs.join(sizes, F.col(end) == F.col("s_key")).withColumn(f"n_{end}", F.col("s_n")).drop("s_key", "s_n")
        pairs = self.work.stored(pairs.filter(100 * F.least("n_u", "n_v") >= self.percent * F.greatest("n_u", "n_v")), "pairs")
        size = lambda n: 8 * F.col(n) + 64
        targets = pairs.groupBy("v").agg(F.max(size("n_v")).alias("bytes"))
        tiles = max(1, math.ceil((targets.agg(F.sum("bytes")).first()[0] or 0) / self.tile))
        home = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(tiles))
        asked = self.work.stored(pairs.select(home.alias("tile"), F.col("u").alias("key"), size("n_u").alias("bytes")).distinct(), "star-queries")
        slices = asked.groupBy("tile").agg(F.ceil(F.sum("bytes") / self.tile).alias("s"))
        ask = asked.join(slices, "tile").select("tile", F.pmod(F.xxhash64("key"), F.col("s")).alias("part"), "key", F.lit(False).alias("target"))
        give = targets.select(home.alias("tile"), F.col("v").alias("key")).join(slices, "tile")
        give = give.select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("part"), "key", F.lit(True).alias("target"))
        both = ask.unionByName(give).withColumn("label", F.col("key")).join(sets, "key")
        return self.work.stored(both.groupBy("tile", "part").applyInArrow(divide_skip(self.percent), "u long, v long"), "star-links")

    def run(self) -> DataFrame:
        """(node, label) of linked class keys."""
        edges = self.edges()
        met = edges.select("bucket", F.col("u").alias("key")).union(edges.select("bucket", F.col("v").alias("key"))).distinct()
        met = self.work.stored(met, "met")
        sets = self.full_sets(met.select(F.col("key").alias("node")).distinct())
        first = self.by_stars(edges, sets)
        labels = components(first, self.work)
        # only buckets that several components share are searched further
        named = met.join(labels, F.col("key") == F.col("node"), "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))
        mixed = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("bucket", "df")
        self.lists = self.work.stored(met.join(mixed, "bucket").select(F.col("bucket").alias("tok"), "key", "df"), "lists")
        return components(first.union(self.by_tiles(sets, labels)), self.work)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 85, bands: int = 64, width: int = 8, few: int = 1 << 20, tile: int = 4 << 20) -> DataFrame:
    """One row per document: n_shingles, component_id (the smallest id reachable by links), kept (it is the row's own).

    bands, width: bands * width bins, a power of two. few: most ids that are broadcast. tile: bytes of sets in a tile,
    of targets and of queries each."""
    if bands * width & (bands * width - 1):
        raise ValueError("bands * width must be a power of two")
    with Workspace(docs.sparkSession) as work:
        s = Bands(work, docs, id_col, text_col, k, percent, bands, width, few, tile)
        named = work.stored(s.classes.join(s.run(), F.col("key") == F.col("node"), "left").select("key", "first_id", F.coalesce("label", "key").alias("label")), "named-classes")
        lowest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
        of_class = named.join(lowest, "label").select(F.col("key").alias("c_key"), "component_id")
        rows = s.base.join(of_class, (F.col("key") == F.col("c_key")) & (F.col("n") > 0), "left")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
        return stored(rows.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")), "near-duplicates")
