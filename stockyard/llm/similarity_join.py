"""N-gram Jaccard join by T-occurrence search over word shingles, DivideSkip style.

A document's set is its distinct 5-word shingles (64-bit hashes; words are not compared beyond them). A
partner with similarity of at least t shares T = ceil(t n) of a document's n shingles, whoever it is.

1. Classes. Documents with equal sets are one class; copies take no further part.
2. Count filter. A class with fewer than T shingles that any other class has too can have no partner. It
   is first decided on the shingles in the lower `low` share of the hash range, where a class may miss
   n - T: packed postings go to buckets of the hash range, and each bucket returns how many shingles of
   a class it has seen elsewhere. Texts with little but words of their own end here.
3. Inverted lists. What is left is counted in full. Shingles are put in one order, rare ones first; of T
   shared shingles one is among the first n - T + 1, so these are the short lists by which partners are
   found, and the T - 1 most frequent ones are the long lists that are only probed.
4. Search. Targets are dealt to tiles of bounded bytes by a shingle of theirs, and each class is a query
   to the tiles that hold a target it shares a short list with. In a tile the lists of a query are split
   by DivideSkip's rule: the short ones are merged (numpy sorts the concatenated postings and counts runs
   where a heap would pop them), long ones are probed by binary search for what the merge left, and
   targets that reach the overlap are links.
5. Large groups of near copies. Where a list is long, three of its classes, chosen by hash, are compared
   with every class of the list first. Queries of a list are then the classes outside its largest
   component. A group costs its size, not its square, and no component is split whatever a list's size.
   Links inside a component are not all made: the result has components, not a document's links.

No text is shuffled but, where the classes left by step 2 are too many for a broadcast (over `few` ids),
those texts in one join. Classes are keyed by a 64-bit hash of the set; a second one must agree, else
keys are made anew with another seed.

Null or empty text, or text without words, has an empty set and links with nothing. Fewer words than a
shingle are one shingle. Rows that repeat an id with the same set share its class; rows that repeat an id
with other texts are separate documents. Null ids never name a component unless it has no other id.
Empty tables give empty results; other columns are ignored (`join`) or kept (`one_of_each`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import Workspace, one_per_key, ship, stored
from stockyard.llm.components import components
from stockyard.llm.tokens import Words, mix, pieces, signed

U = np.uint64
MANY = 0  # the owner of a posting that stands for several classes


def sets_of(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of all rows, distinct, by row and then hash."""
    at, h = w.shingles(k)
    row = w.row[at]
    brief = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(brief):
        h = np.concatenate((h, np.array([w.whole_hash(r) for r in brief.tolist()], dtype=np.uint64)))
        row = np.concatenate((row, brief))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def keys_of(row: np.ndarray, h: np.ndarray, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the set of each row."""
    n = np.bincount(row, minlength=rows)
    ends = np.concatenate(([0], np.cumsum(n)))
    out = []
    for salt in (2 * seed + 1, 2 * seed + 2):
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(h ^ U(salt * 0x9E3779B97F4A7C15 % 2**64)))))
        out.append(mix(sums[ends[1:]] - sums[ends[:-1]] + n.astype(np.uint64)))
    return out[0], out[1]


def row_batches(batches: Iterator[pa.RecordBatch], k: int, bound: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(id, tag, key, check, n, low) of each row; low: shingles with a hash below `bound`."""
    for batch in batches:
        for lo, hi, data, offs in pieces(batch.column(2)):
            row, h = sets_of(Words(data, offs, lower=True), k)
            key, check = keys_of(row, h, hi - lo, seed)
            n = np.bincount(row, minlength=hi - lo)
            low = np.bincount(row[h < U(bound)], minlength=hi - lo)
            columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(signed(key)), pa.array(signed(check)), pa.array(n.astype(np.int32)), pa.array(low.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "tag", "key", "check", "n", "low"])


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of a number array as binaries."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def posting_batches(batches: Iterator[pa.RecordBatch], k: int, bound: int, seed: int, buckets: int, least: int, many: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(bucket, counts, owners, tokens): postings of about `many` shingles at a time, packed by bucket.

    A shingle that two classes of the run share is settled here: it is counted for its classes (a row with
    `counts`) and sent once, as a posting of MANY."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        key, h = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((key, h))
        key, h = key[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])  # copies in other pieces
        key, h = key[new], h[new]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(at, len(h)))
        shared = np.repeat(size > 1, size)
        owner, times = np.unique(key[shared], return_counts=True)
        token = h[at]
        owners = np.where(size > 1, MANY, key[at])
        bucket = ((token & U((1 << 30) - 1)) % U(buckets)).astype(np.int64)
        order = np.lexsort((owners, bucket))
        bucket, owners, token = bucket[order], owners[order], ((token >> U(30)) & U(0xFFFFFFFF)).astype(np.uint32)[order]
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.append(edges, len(bucket))
        names = ["bucket", "counts", "owners", "tokens"]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges]), pa.array(np.zeros(len(edges), dtype=bool)), packed(owners, ends), packed(token, ends)], names=names)
        if len(owner):
            whole = np.array([0, len(owner)])
            yield pa.RecordBatch.from_arrays([pa.array([int(token[0]) % buckets]), pa.array([True]), packed(owner, whole), packed(times.astype(np.uint32), whole)], names=names)

    size = 0
    for batch in batches:
        for lo, hi, data, offs in pieces(batch.column(0)):
            row, h = sets_of(Words(data, offs, lower=True), k)
            key, _ = keys_of(row, h, hi - lo, seed)
            n = np.bincount(row, minlength=hi - lo)
            first = np.zeros(hi - lo, dtype=bool)
            first[np.unique(key, return_index=True)[1]] = True
            use = (h < U(bound)) & (first & (n >= least))[row]
            held.append((signed(key)[row[use]], h[use]))
            size += int(use.sum())
            if size >= many:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def elsewhere(table: pa.Table) -> pa.Table:
    """(owner, here, local) of one bucket: how many of a class's shingles another class has too."""
    counts = table["counts"].to_numpy()
    owners = [np.frombuffer(x.as_py(), dtype=np.int64) for x in table["owners"]]
    tokens = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in table["tokens"]]
    out = [(o, np.zeros(len(o), dtype=np.int64), t.astype(np.int64)) for o, t, c in zip(owners, tokens, counts) if c]
    if not counts.all():
        owner = np.concatenate([o for o, c in zip(owners, counts) if not c])
        token = np.concatenate([t for t, c in zip(tokens, counts) if not c])
        order = np.lexsort((owner, token))
        owner, token = owner[order], token[order]
        at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(at, len(token)))
        shared = np.repeat(owner[at] != owner[at + size - 1], size)
        shared[1:] &= (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])  # a class once for each shingle
        found, times = np.unique(owner[shared & (owner != MANY)], return_counts=True)
        out.append((found, times, np.zeros(len(found), dtype=np.int64)))
    return pa.table([np.concatenate(x) for x in zip(*out)], names=["owner", "here", "local"])


def set_batches(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(id, key, toks) of each row."""
    for batch in batches:
        for lo, hi, data, offs in pieces(batch.column(1)):
            row, h = sets_of(Words(data, offs, lower=True), k)
            key, _ = keys_of(row, h, hi - lo, seed)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(signed(key)), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(h)))], names=["id", "key", "toks"])


class Forest:
    """Which labels of a tile are linked already."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        while (b := self.up.get(a, a)) != a:
            self.up[a] = self.up.get(b, b)
            a = b
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def divide_skip(percent: int, mu: float = 0.01):
    """T-occurrence search of the queries of one block among its targets. Of links between the same components
    of the block one is enough. Shingles that no two classes share are left out of `toks`, but count in `n`."""

    def run(table: pa.Table) -> pa.Table:
        lists = table["toks"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        keys, labels, n, is_target = (table[c].to_numpy() for c in ("key", "label", "n", "target"))
        targets = np.flatnonzero(is_target)
        sizes, total = np.diff(ends), n.astype(np.int64)
        owner = np.repeat(np.arange(len(targets)), sizes[targets])
        tokens = np.concatenate([flat[ends[t] : ends[t + 1]] for t in targets]) if len(targets) else flat[:0]
        order = np.argsort(tokens, kind="stable")  # postings of a list stand in the order of their targets
        tokens, owner = tokens[order], owner[order]
        forest, out = Forest(), []
        for q in np.flatnonzero(~is_target).tolist():
            mine = flat[ends[q] : ends[q + 1]]
            need = (percent * int(total[q]) + 99) // 100
            begin = np.searchsorted(tokens, mine)
            size = np.searchsorted(tokens, mine, side="right") - begin
            begin, size = begin[size > 0], size[size > 0]
            if len(size) < need:
                continue
            by_size = np.argsort(size, kind="stable")
            begin, size = begin[by_size], size[by_size]
            # DivideSkip: so many of the longest lists are probed, not merged
            longest = min(need - 1, int(need / (mu * math.log2(max(2, int(size[-1]))) + 1)))
            cut = len(size) - longest
            at = np.repeat(begin[:cut] - np.concatenate(([0], np.cumsum(size[:cut])[:-1])), size[:cut]) + np.arange(int(size[:cut].sum()))
            found, count = np.unique(owner[at], return_counts=True)
            near = count >= need - longest
            found, count = found[near], count[near].copy()
            apart = np.array([forest.root(int(labels[targets[c]])) != forest.root(int(labels[q])) for c in found.tolist()], dtype=bool)
            found, count = found[apart], count[apart]
            for b, s in zip(begin[cut:].tolist(), size[cut:].tolist()):
                if not len(found):
                    break
                posting = owner[b : b + s]
                slot = np.searchsorted(posting, found)
                slot[slot == s] = 0
                count += posting[slot] == found
            linked = found[100 * count >= percent * (total[q] + total[targets[found]] - count)]
            for c in linked.tolist():
                if forest.join(int(labels[q]), int(labels[targets[c]])):
                    out.append((int(keys[q]), int(keys[targets[c]])))
        return pa.table([pa.array([x[0] for x in out], type=pa.int64()), pa.array([x[1] for x in out], type=pa.int64())], names=["u", "v"])

    return run


class Search:
    def __init__(self, work: Workspace, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, short: int, low: float, few: int, tile: int, tagged: bool):
        self.k, self.percent, self.short, self.few, self.tile = k, percent, short, few, tile
        self.bound = int(low * 2**64)
        self.spark, self.work = docs.sparkSession, work
        ship(self.spark)
        tag = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))) if tagged else F.lit(None).cast("binary")
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), tag.alias("tag"), F.col(text_col).alias("body"))
        self.seed = 0
        while True:
            bound, seed = self.bound, self.seed
            self.base = work.stored(self.rows.mapInArrow(lambda it: row_batches(it, k, bound, seed), "id long, tag binary, key long, check long, n int, low int"), "sets")
            classes = self.base.filter("n > 0").groupBy("key").agg(F.min("id").alias("first_id"), F.max("n").alias("n"), F.max("low").alias("low"), F.min("check").alias("c0"), F.max("check").alias("c1"))
            self.classes = work.stored(classes, "classes")
            found = self.classes.agg(F.count_if(F.col("c0") != F.col("c1")).alias("clashes"), F.sum("low").alias("low")).first()
            if not found.clashes:
                break
            self.seed += 1
        self.low_total = found.low or 0

    def linkable(self, n: str) -> str:
        """Sets of which another size or content can be near enough."""
        return f"{self.percent} * ({n} + 1) <= 100 * {n}"

    def left_by_counts(self) -> DataFrame:
        """(key, first_id, n) of classes that the count filter leaves."""
        k, bound, seed, buckets = self.k, self.bound, self.seed, max(64, math.ceil(self.low_total / 1_000_000))
        least = next(n for n in range(1, 101) if self.percent * (n + 1) <= 100 * n)
        postings = self.rows.select("body").mapInArrow(lambda it: posting_batches(it, k, bound, seed, buckets, least), "bucket long, counts boolean, owners binary, tokens binary")
        seen = postings.groupBy("bucket").applyInArrow(elsewhere, "owner long, here long, local long")
        seen = seen.groupBy("owner").agg((F.sum("here") + F.max("local")).alias("shared"))
        must = F.col("low") - (F.col("n") - F.ceil(F.col("n") * self.percent / 100))
        left = self.classes.filter(self.linkable("n")).join(seen, F.col("key") == F.col("owner"), "left").filter(F.coalesce("shared", F.lit(0)) >= must)
        return self.work.stored(left.select("key", "first_id", "n"), "left")

    def ordered(self) -> DataFrame:
        """(key, n, toks, prefix): shared shingles, rare ones first, and those of the short lists, of classes with T shared ones."""
        left = self.left_by_counts()
        sent = F.broadcast if left.count() <= self.few else (lambda df: df)
        ids = sent(left.select(F.col("first_id").alias("i")).distinct())
        k, seed = self.k, self.seed
        texts = self.rows.select("id", "body").join(ids, F.col("id").eqNullSafe(F.col("i")), "left_semi")
        sets = texts.mapInArrow(lambda it: set_batches(it, k, seed), "id long, key long, toks array<long>")
        wanted = left.select(F.col("key").alias("w"), "first_id", "n")
        sets = sets.join(sent(wanted), (F.col("key") == F.col("w")) & F.col("id").eqNullSafe(F.col("first_id")))
        sets = self.work.stored(sets.groupBy("key").agg(F.any_value("n").alias("n"), F.any_value("toks").alias("toks")), "full-sets")
        posts = sets.select("key", "n", F.explode("toks").alias("tok"))
        df = posts.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        shared = posts.join(df, "tok").groupBy("key").agg(F.any_value("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("found"))
        must = F.ceil(F.col("n") * self.percent / 100).cast("int")
        shared = shared.select("key", "n", F.col("found.tok").alias("toks"), (F.size("found") - must + 1).alias("p")).filter("p > 0")
        return self.work.stored(shared.select("key", "n", "toks", F.slice("toks", 1, F.col("p")).alias("prefix")), "ordered-sets")

    def run(self) -> DataFrame:
        """(node, label) of linked class keys."""
        sets = self.ordered()
        posts = sets.select("key", F.explode("prefix").alias("tok"))
        met = posts.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        self.lists = self.work.stored(posts.join(met, "tok"), "lists")
        first = self.by_leaders(sets)
        labels = components(first, self.work)
        found = self.by_tiles(sets, labels)
        return components(first.union(found), self.work)

    def by_leaders(self, sets: DataFrame) -> DataFrame:
        """Links of the classes of long lists with three classes of their longest list each."""
        long_ = self.lists.filter(F.col("df") > self.short)
        home = long_.groupBy("key").agg(F.max_by("tok", F.struct("df", "tok")).alias("tok"))
        leaders = home.groupBy("tok").agg(*(F.min_by("key", F.xxhash64("key", F.lit(i))).alias(f"l{i}") for i in range(3)))
        pairs = home.join(leaders, "tok").select(F.col("key").alias("u"), F.explode(F.array_distinct(F.array("l0", "l1", "l2"))).alias("v")).filter("u <> v")
        pairs = self.work.stored(pairs, "leader-pairs")
        one = sets.select(F.col("key").alias("u"), F.col("n").alias("nu"), F.col("toks").alias("tu"))
        other = sets.select(F.col("key").alias("v"), F.col("n").alias("nv"), F.col("toks").alias("tv"))
        lead = pairs.select("v").distinct().join(other, "v")
        both = pairs.join(one, "u").join(lead, "v").filter(100 * F.least("nu", "nv") >= self.percent * F.greatest("nu", "nv"))
        common = F.size(F.array_intersect("tu", "tv"))
        return self.work.stored(both.filter(100 * common >= self.percent * (F.col("nu") + F.col("nv") - common)).select("u", "v"), "leader-links")

    def by_tiles(self, sets: DataFrame, labels: DataFrame) -> DataFrame:
        """Links of the classes that share a short list and are not in its largest component with those that are in it."""
        named = self.lists.join(labels, F.col("key") == F.col("node"), "left").select("tok", "key", "df", F.coalesce("label", "key").alias("label"))
        named = self.work.stored(named, "named-lists")
        sizes = named.groupBy("tok", "label").agg(F.count(F.lit(1)).alias("n"), F.max("df").alias("df"))
        most = sizes.groupBy("tok").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.max("n").alias("n"), F.max("df").alias("df")).filter("n < df").select("tok", "most")
        mixed = self.work.stored(named.join(most, "tok"), "mixed-lists")
        homes = mixed.groupBy("key").agg(F.max_by("tok", F.struct("df", "tok")).alias("home"), F.any_value("label").alias("label"))
        homes = self.work.stored(homes.join(sets.select("key", (8 * F.size("toks") + 64).alias("bytes")), "key"), "homes")
        total = homes.agg(F.sum("bytes").alias("n")).first().n or 0
        tiles = max(1, math.ceil(total / self.tile))
        parts = homes.groupBy("home").agg(F.ceil(F.sum("bytes") / self.tile).alias("k"))
        placed = homes.join(parts, "home").select("key", "label", "bytes", F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("k"))), F.lit(tiles)).alias("tile"))
        placed = self.work.stored(placed, "targets")
        where = mixed.select("tok", "key").join(placed.select("key", "tile"), "key").select("tok", "tile").distinct()
        asked = mixed.filter("label <> most").select("tok", "key", "label").join(where, "tok").select("tile", "key", "label").distinct()
        asked = self.work.stored(asked.join(placed.select("key", "bytes"), "key"), "queries")
        slices = asked.groupBy("tile").agg(F.ceil(F.sum("bytes") / self.tile).alias("s"))
        ask = asked.join(slices, "tile").select("tile", F.pmod(F.xxhash64("key"), F.col("s")).alias("part"), "key", "label", F.lit(False).alias("target"))
        give = placed.join(slices, "tile").select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("part"), "key", "label", F.lit(True).alias("target"))
        both = ask.unionByName(give).join(sets.select("key", "n", "toks"), "key")
        return self.work.stored(both.groupBy("tile", "part").applyInArrow(divide_skip(self.percent), "u long, v long"), "tile-links")


def _components(work: Workspace, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, short: int, low: float, few: int, tile: int, tagged: bool = False) -> DataFrame:
    """(id, tag, key, n, label, component_id) of every row."""
    s = Search(work, docs, id_col, text_col, k, percent, short, low, few, tile, tagged)
    named = work.stored(s.classes.join(s.run(), F.col("key") == F.col("node"), "left").select("key", "first_id", F.coalesce("label", "key").alias("label")), "named-classes")
    lowest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(lowest, "label").select(F.col("key").alias("c_key"), "label", "component_id")
    return s.base.join(of_class, (F.col("key") == F.col("c_key")) & (F.col("n") > 0), "left").select("id", "tag", "n", "label", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, short: int = 32, low: float = 0.4, few: int = 1 << 20, tile: int = 4 << 20) -> DataFrame:
    """One row per document: n_shingles and component_id, the smallest id reachable by links.

    short: lists with more classes than this get leaders. low: share of the hash range of the count filter.
    few: most ids that are broadcast. tile: bytes of sets in a tile, of targets and of queries each."""
    with Workspace(docs.sparkSession) as work:
        rows = _components(work, docs, id_col, text_col, k, percent, short, low, few, tile)
        return stored(rows.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id"), "components")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, short: int = 32, low: float = 0.4, few: int = 1 << 20, tile: int = 4 << 20) -> DataFrame:
    """The documents that stay when exactly one of each component does, with all their columns.

    It is the row with the smallest id, nulls last, and of rows that repeat an id the one with the smallest
    digest of its text; rows equal in both are one. Documents without shingles all stay."""
    with Workspace(docs.sparkSession) as work:
        rows = work.stored(_components(work, docs, id_col, text_col, k, percent, short, low, few, tile, tagged=True).filter("n > 0"), "tagged")
        place = F.struct(F.col("id").isNull().alias("no_id"), "id", "tag")
        stays = rows.groupBy(F.col("label").alias("s_label")).agg(F.min(place).alias("stay"), F.count(F.lit(1)).alias("times")).filter("times > 1")
        grouped = rows.join(stays, rows.label == stays.s_label)
        is_stay = F.col("id").eqNullSafe(F.col("stay.id")) & (F.col("tag") == F.col("stay.tag"))
        gone = stored(grouped.filter(~is_stay).select("id", "tag").distinct(), "gone")
        twice = stored(grouped.filter(is_stay).groupBy("id", "tag").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("id", "tag"), "twice")
    return one_per_key(docs, F.col(id_col), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))), gone, twice, few)
