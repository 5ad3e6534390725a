"""Substring dedup: documents joined on winnowed anchors, matches extended both ways, repeats removed.

A window is `length` consecutive words. Every word inside a window that also starts earlier (in a smaller
document, or before in the same one) is removed; what is earlier is judged on the input.

Seeds: of the `length - k + 1` k-grams in a window the one with the smallest hash is its anchor, so equal
windows have equal anchors, and about one k-gram in seven is an anchor at all. Anchors that occur once in
the corpus end there. Extension: all windows around a repeated anchor, to the left and right as far as
that anchor reaches, form its run. Equal runs are whole repeats: only their first place is kept in full.
Runs of one anchor that differ are extended window by window, and each window is compared with the first
place where it stands. Overlapping windows add up to maximal repeats of at least `length` words.

Anchors of more than `hot` places, the 2000 most frequent of them, are found beforehand with map-side partial
aggregation: a broadcast says that they repeat, and their places are spread over all tasks. The places of any other
anchor meet in one task, which counts them; they are less than 1 / 2000 of all. Which they are changes no result.
So are runs of more than `hot` places and anchors of more than `hot` kinds of runs: the 2000 most frequent of either are
broadcast and their rows stay where they are. Other joins on runs and windows are plain equi-joins: a run is joined
once for each place, a window once for each kind of run around it. Texts are shuffled compressed, by their
digest: copies are one text there, so groups of copies of any size are one row. Equal windows and runs are told by 64-bit hashes; words are not compared beyond them.

Null text has no words. Texts of equal words are one class: its first document is the smallest id; others
of `length` words or more lose all their words. Rows that repeat an id with equal words share a result;
rows that repeat an id with other words are ordered by digest. A null id comes last. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockyard.llm.common import ship, stored
from stockyard.llm.tokens import Words, mix, pieces, rolled, signed

U = np.uint64
LAST = (1 << 63) - 1


def window_anchors(w: Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, first word of the anchor, hash of the anchor) of every window of one row."""
    n = len(w) - length + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    h = rolled(w.hash, k, 3)
    low, at = h[:n].copy(), np.zeros(n, dtype=np.int16)
    for j in range(1, length - k + 1):
        other = h[j : j + n]
        less = other <= low
        np.copyto(low, other, where=less)
        at[less] = j
    start = np.flatnonzero(w.row[:n] == w.row[length - 1 :])
    return start, start + at[start], low[start]


def run_edges(start: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Indexes at which a run of consecutive windows with one anchor begins."""
    if not len(start):
        return start
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    return np.flatnonzero(new)


def digest_batches(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """(id, digest, and the words joined by one space, compressed) of each row."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        digests, packed = [], []
        for lo, hi, data, offs in pieces(batch.column(1)):
            whole, at = data.tobytes(), offs.tolist()
            for r in range(hi - lo):
                words = b" ".join(whole[at[r] : at[r + 1]].split())
                digests.append(hashlib.md5(words).digest())
                if with_text:
                    packed.append(squeeze.compress(words))
        columns = [batch.column(0), pa.array(digests, type=pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, *([pa.array(packed, type=pa.binary())] if with_text else [])], names=["id", "digest", "packed"][: 2 + with_text])


def unpacked(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """`pieces` of compressed texts."""
    expand = zstandard.ZstdDecompressor()
    held, first, size = [], 0, 0
    for i, x in enumerate(column):
        held.append(expand.decompress(x.as_py()))
        size += len(held[-1])
        if size > 1 << 21 or i + 1 == len(column):
            ends = np.concatenate(([0], np.cumsum([len(t) for t in held])))
            yield first, i + 1, np.frombuffer(b"".join(held), dtype=np.uint8), ends
            held, first, size = [], i + 1, 0


def anchor_batches(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in unpacked(batch.column(1)):
            w = Words(data, offs)
            start, anchor, h = window_anchors(w, length, k)
            e = run_edges(start, anchor)
            row = w.row[start[e]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(signed(h[e])), pa.array((start[e] - w.first[row]).astype(np.int32))], names=["digest", "anchor", "at"])


def anchor_counts(batches: Iterator[pa.RecordBatch], length: int, k: int, least: int = 4) -> Iterator[pa.RecordBatch]:
    """(anchor, n) of the anchors with `least` places in a piece: a frequent one has about as many in any piece."""
    for batch in batches:
        for _, _, data, offs in pieces(batch.column(0)):
            w = Words(data, offs)
            start, _, h = window_anchors(w, length, k)
            anchor, n = np.unique(h[run_edges(start, h)], return_counts=True)
            often = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[often])), pa.array(n[often])], names=["anchor", "n"])


def run_batches(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Runs of the repeated anchors of each text: column 3 lists where they begin."""
    names = ["first_id", "digest", "anchor", "run", "at", "windows"]
    for batch in batches:
        for lo, hi, data, offs in unpacked(batch.column(2)):
            w = Words(data, offs)
            start, anchor, h = window_anchors(w, length, k)
            e = run_edges(start, anchor)
            seeds = batch.column(3).slice(lo, hi - lo)
            listed = pa.compute.list_parent_indices(seeds).to_numpy(zero_copy_only=False)
            begins = w.first[listed] + seeds.flatten().to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero(np.isin(start[e], begins))
            sizes = np.diff(np.append(e, len(start)))
            window = rolled(w.hash, length, 5)[start] if len(start) else h
            place = np.arange(len(start)) - np.repeat(e, sizes)
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(window + place.astype(np.uint64) * U(0x9E3779B97F4A7C15)))))
            run = mix(sums[e + sizes] - sums[e] + sizes.astype(np.uint64)) if len(e) else h
            row = w.row[start[e]][wanted]
            chosen = np.zeros(len(e), dtype=bool)
            chosen[wanted] = True
            inside = np.repeat(chosen, sizes)
            ends = np.concatenate(([0], np.cumsum(sizes[wanted]))).astype(np.int32)
            take = pa.array(row)
            columns = [batch.column(0).slice(lo, hi - lo).take(take), batch.column(1).slice(lo, hi - lo).take(take), pa.array(signed(h[e][wanted])), pa.array(signed(run[wanted])), pa.array((start[e][wanted] - w.first[row]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(window[inside])))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def cut_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Counts and digests of what stays of each text, given its covered windows (column 2: [at, n] pairs)."""
    names = ["c_digest", "first_id", "n_words", "n_removed", "kept_sha256", "kept"]
    for batch in batches:
        for lo, hi, data, offs in unpacked(batch.column(1)):
            w = Words(data, offs)
            gone = np.zeros(len(w) + 1, dtype=np.int64)
            covered = batch.column(2).slice(lo, hi - lo)
            listed = pa.compute.list_parent_indices(covered).to_numpy(zero_copy_only=False)
            flat = covered.flatten()
            at = w.first[listed] + flat.field("at").to_numpy(zero_copy_only=False)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + flat.field("n").to_numpy(zero_copy_only=False) + length - 1, -1)
            stays = np.cumsum(gone[:-1]) == 0
            kept = []
            for r in range(hi - lo):
                words = data[offs[r] : offs[r + 1]].tobytes().split()
                flags = stays[w.first[r] : w.first[r + 1]]
                kept.append(b" ".join(words if flags.all() else [x for x, f in zip(words, flags.tolist()) if f]))
            removed = np.bincount(w.row[~stays], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), pa.array(w.counts), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept], type=pa.string())], names=names)


def frequent_of(df: DataFrame, by: str, least: int, most: int = 2000) -> DataFrame:
    """The `most` rows with the largest `by` over `least`, to be broadcast: no other has more than 1 / `most` of the sum."""
    return df.filter(F.col(by) > least).orderBy(F.desc(by)).limit(most)


def with_runs(runs: DataFrame, again: DataFrame, hot: int) -> DataFrame:
    """The runs that stand in `again` (anchor, run, head, times), with its head. The rows of frequent ones stay where they
    are and meet a broadcast; the others meet in a shuffle, where none of them is large."""
    often = F.broadcast(frequent_of(again, "times", hot).select(F.col("anchor").alias("o_anchor"), F.col("run").alias("o_run"), F.col("head").alias("o_head")))
    marked = runs.join(often, (F.col("anchor") == F.col("o_anchor")) & (F.col("run") == F.col("o_run")), "left")
    known = marked.filter("o_head is not null").select(*runs.columns, F.col("o_head").alias("head"))
    rest = marked.filter("o_head is null").select(*runs.columns).join(again.select("anchor", "run", "head"), ["anchor", "run"]).select(*runs.columns, "head")
    return known.unionByName(rest)


def of_several_kinds(heads: DataFrame, hot: int) -> DataFrame:
    """The kinds of runs whose anchor has several. Those of an anchor with many kinds need no join to know it."""
    kinds = stored(heads.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "several-kinds")
    often = F.broadcast(frequent_of(kinds, "kinds", hot).select(F.col("anchor").alias("o_anchor")))
    marked = heads.join(often, F.col("anchor") == F.col("o_anchor"), "left")
    known = marked.filter("o_anchor is not null").select(*heads.columns)
    rest = marked.filter("o_anchor is null").select(*heads.columns)
    return known.unionByName(rest.join(kinds.select("anchor"), "anchor", "left_semi"))


def remove_repeats(docs: DataFrame, length: int = 20, k: int = 8, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot: int = 500) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256, and the text that stays if asked for.

    hot: places of an anchor above which it is spread; the 2000 most frequent of such anchors are, since no
    other one can have more than 1 / 2000 of all places."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    rows = source.mapInArrow(lambda it: digest_batches(it, False), "id long, digest binary")
    # one row per distinct word sequence; its text is any of its equal texts
    packed = source.mapInArrow(lambda it: digest_batches(it, True), "id long, digest binary, packed binary")
    texts = packed.groupBy("digest").agg(F.any_value("packed").alias("body"), F.coalesce(F.min("id"), F.lit(LAST)).alias("first_id"))

    # every use takes the same columns of `texts`, so that one shuffle of them serves all uses in a job
    anchors = texts.select("digest", "body", "first_id").mapInArrow(lambda it: anchor_batches(it, length, k), "digest binary, anchor long, at int")
    counted = stored(source.select("body").mapInArrow(lambda it: anchor_counts(it, length, k), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter(f"n > {hot}"), "frequent-anchors")
    frequent = counted.orderBy(F.desc("n"), "anchor").limit(2000).select(F.col("anchor").alias("frequent"))
    # places of frequent anchors are spread by their text; those of any other one meet in one task, which counts them
    known = F.col("frequent").isNotNull()
    marked = anchors.join(F.broadcast(frequent), F.col("anchor") == F.col("frequent"), "left").select("digest", "at", F.when(known, F.xxhash64("digest", "at")).otherwise(F.col("anchor")).alias("spread"), known.alias("known"))
    met = marked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("spread"))).filter("known or n > 1")
    seeds = met.groupBy(F.col("digest").alias("s_digest")).agg(F.collect_list("at").alias("begins"))
    seeded = texts.join(seeds, texts.digest == seeds.s_digest).select("first_id", "digest", "body", "begins")
    runs = stored(seeded.mapInArrow(lambda it: run_batches(it, length, k), "first_id long, digest binary, anchor long, run long, at int, windows array<long>"), "runs")

    place = F.struct("first_id", "digest", "at")
    heads = stored(runs.groupBy("anchor", "run").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("times"), F.any_value("windows").alias("windows")), "run-heads")
    # the windows of a run are not needed here, only how many there are
    brief = runs.select("first_id", "digest", "anchor", "run", "at", F.size("windows").alias("n"))
    again = heads.filter("times > 1").select("anchor", "run", "head", "times")
    tails = with_runs(brief, again, hot).filter((F.col("first_id") != F.col("head.first_id")) | (F.col("digest") != F.col("head.digest")) | (F.col("at") != F.col("head.at"))).select("digest", "at", "n")

    # written before the windows are listed one by one: a run's text and place then stand there once
    kinds = stored(of_several_kinds(heads.select("anchor", "head", "windows"), hot), "kinds-of-runs")
    single = kinds.select("anchor", "head", F.posexplode("windows").alias("i", "window"))
    single = single.select("anchor", "window", F.struct(F.col("head.first_id"), F.col("head.digest"), (F.col("head.at") + F.col("i")).alias("at")).alias("place"))
    firsts = single.groupBy("anchor", "window").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    late = single.join(firsts, ["anchor", "window"]).filter("place <> first").select("place.digest", "place.at", F.lit(1).alias("n"))

    covered = tails.union(late).groupBy(F.col("digest").alias("v_digest")).agg(F.collect_list(F.struct("at", "n")).alias("covered"))
    judged = texts.join(covered, texts.digest == covered.v_digest, "left").select("digest", "body", F.coalesce("covered", F.array().cast("array<struct<at:int,n:int>>")).alias("covered"), "first_id")
    cut = judged.mapInArrow(lambda it: cut_batches(it, length), "c_digest binary, first_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    if not keep_text:
        cut = cut.drop("kept")
    out = rows.select("id", "digest").join(cut, F.col("digest") == F.col("c_digest"), "left")
    copy = (F.coalesce("id", F.lit(LAST)) != F.col("first_id")) & (F.col("n_words") >= length)
    columns = [F.col("id").alias(id_col), "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    if keep_text:
        columns.append(F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*columns)
