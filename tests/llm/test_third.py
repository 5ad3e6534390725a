"""Importance resampling, Merkle manifest and MinHash near-duplicates against brute force, on odd rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockyard.llm import importance, merkle, minhash, substring_dedup
from stockyard.llm.common import numbered

from test_second import brute_groups, brute_sets, planted  # noqa: F401

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_resample(rows, target, upto, buckets, percent, least):
    def found(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, upto + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(found(text))
    for text in target:
        t.update(found(text))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for id_, text in rows:
        f = found(text)
        h = int(hashlib.sha256(f"2024:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((id_, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    order = sorted((i for i, r in enumerate(out) if r[4]), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    rank = {i: p + 1 for p, i in enumerate(order[: percent * len(order) // 100])}
    return sorted(((*r[:4], rank.get(i)) for i, r in enumerate(out)), key=str)


@pytest.mark.parametrize("upto, buckets, percent, least", [(1, 10_000, 10, 20), (3, 70_000, 50, 2)])
def test_resample(spark, odd, messy, documents, upto, buckets, percent, least):
    target = ["one two three, FOUR five", None, "", "w1 w2 w3 secret"]
    targets = spark.createDataFrame([(t,) for t in target], "text string")
    for docs in (documents.limit(60).unionByName(odd, allowMissingColumns=True), messy):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = importance.resample(docs, targets, upto, buckets, percent, least)
        # rows that repeat an id may swap ranks only where their scores are equal too
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(rows, target, upto, buckets, percent, least)


def test_resample_of_nothing(spark, none, odd):
    assert importance.resample(none, none).collect() == []
    rows = importance.resample(odd, none).collect()
    assert len(rows) == odd.count() and {r.weight for r in rows if r.n_features == 0} == {0}


def test_offsets_are_those_of_the_words():
    text = "Ünï x\x00y 12ab\n　é".encode()
    spans = [m.span() for m in re.finditer(WORD.encode(), text)]
    assert list(importance.windows(spans, text, 2))[: len(spans)] == [text[a:b] for a, b in spans]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, arity):
    """Root, and the siblings (left, right) of each leaf by level."""
    nodes, owners, paths = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        up, up_owners = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for j in range(len(run)):
                for i in owners[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            up_owners.append(sum(owners[a : a + arity], []))
        nodes, owners = up, up_owners
    return nodes[0], paths


def brute_manifest(rows, arity):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*(field(r[f]) for f in merkle.FIELDS))
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, bytes.fromhex(leaf(r)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, out = [], []
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        subs.append(brute_tree([x[2].hex() for x in groups[g]], arity))
    root, tops = brute_tree([s for s, _ in subs], arity) if subs else (None, [])
    for g, (sub, paths), top in zip(names, subs, tops):
        for x, path in zip(groups[g], paths):
            r = dict(x[3])
            if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                r["n_chars"] += 1
            acc = leaf(r)
            for left, right in path + top:
                acc = H(left, acc, right)
            out.append((r["doc_id"], x[2].hex(), sub, root, tuple(path + top), acc, acc == root))
    return sorted(out, key=str)


def changed():
    return {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


@pytest.mark.parametrize("arity, height, n", [(2, 8, 0), (2, 2, 37), (3, 1, 30), (2, 1, 64), (2, 3, 1)])
def test_manifest(spark, odd, messy, documents, arity, height, n):
    few = documents.orderBy("doc_id").limit(n) if n else documents
    for docs in (few, odd, messy) if n in (0, 37) else (few,):
        rows = [r.asDict() for r in docs.select(*merkle.FIELDS).collect()]
        got = merkle.manifest(docs, changed(), arity=arity, height=height).collect()
        assert sorted(((r[0], r[1], r[2], r[3], tuple((s.left, s.right) for s in r[4]), r[5], r[6]) for r in got), key=str) == brute_manifest(rows, arity)


def test_manifest_of_one_large_and_many_small_groups(spark):
    rows = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, F.lit("big")).otherwise(F.concat(F.lit("g"), F.col("id").cast("string"))).alias("lang"), F.lit(5).cast("long").alias("n_chars"), F.lit("t").alias("text"))
    got = merkle.manifest(rows, height=3).collect()
    want = brute_manifest([{**r.asDict(), "n_chars": None} for r in rows.collect()], 2)
    assert len(got) == 700 and all(r.verified for r in got) and len({r.root for r in got}) == 1 and len(want) == 700
    assert merkle.manifest(rows.limit(0)).collect() == []


def test_numbers_are_gapless_within_each_value(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 6 > 0, F.lit("b")).alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    got = numbered(rows, [F.col("v")], "g", "numbers").collect()
    for g in (None, "hot", "b"):
        mine = sorted((r.at, r.v, r.of) for r in got if r.g == g)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1] for m in mine] == sorted(m[1] for m in mine) and {m[2] for m in mine} == {len(mine)}


def check_near(docs, percent=85, **kw):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets, want = brute_sets(rows), {}
    for group in brute_groups(rows, percent):
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            want.setdefault((rows[i][0], len(sets[i])), Counter())[min(ids, default=None) if sets[i] else rows[i][0]] += 1
    got = {}
    for r in minhash.near_duplicates(docs, percent=percent, **kw).collect():
        got.setdefault((r.doc_id, r.n_shingles), Counter())[r.component_id] += 1
        assert r.kept == (r.doc_id == r.component_id)
    assert got == want


def test_near_duplicates(odd, messy, none):
    check_near(odd)
    check_near(messy)
    assert minhash.near_duplicates(none).collect() == []


def test_near_duplicates_of_planted_groups(planted):  # noqa: F811
    check_near(planted, tile=1 << 14)
    check_near(planted, few=0)


def test_what_stars_miss(spark):
    """Texts that share buckets with a common centre without being near it, in pairs that are near each other."""
    r = random.Random(4)
    common, rows = [f"c{i}" for i in range(60)], []
    for j in range(60):
        own = [f"o{j}x{i}" for i in range(14)]
        rows.append((2 * j, " ".join(common + own)))
        rows.append((2 * j + 1, " ".join(common + own[: 13 - r.randrange(2)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_near(docs)
    check_near(docs, tile=1 << 13)


def test_signatures_agree_with_the_similarity():
    """Bins agree with the similarity's probability, full or borrowed, and no bin stays empty."""
    r = np.random.Generator(np.random.PCG64(3))
    for n in (6, 40, 3000):
        agree = []
        for _ in range(40):
            both = r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = np.sort(both[: n - n // 6]), np.sort(both[n // 6 :])
            row = np.repeat([0, 1], [len(a), len(b)])
            s = minhash.signatures(row, np.concatenate((a, b)), 2, 512)
            assert s.all()
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - (n - 2 * (n // 6)) / n) < 0.06


def test_a_common_bucket_is_bounded(spark):
    """Of a bucket that all rows share, a run of rows sends one posting to the shuffle."""
    import pyarrow as pa

    texts = [" ".join(f"a{i}" for i in range(400)) + f" tail{j}" for j in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["body"])
    out = list(minhash.band_batches(iter([batch]), 5, 0, 6, 64, 8, 16))
    posted = sum(len(x.as_py()) // 8 for b in out for x, c in zip(b.column(1), b.column(3)) if not c.is_valid)
    tied = sum(len(x.as_py()) // 8 for b in out for x, c in zip(b.column(1), b.column(3)) if c.is_valid)
    assert posted + tied == 300 * 64 and posted < 64 * 30


def test_one_phrase_in_every_text(spark):
    """A phrase in all texts, in contexts of their own: its anchors have a kind of run for each text."""
    r = random.Random(9)
    phrase = [f"p{i}" for i in range(24)]
    rows = [(i, " ".join([f"a{r.randrange(10**6)}" for _ in range(30)] + phrase + [f"b{r.randrange(10**6)}" for _ in range(30)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    split = sorted(map(tuple, substring_dedup.remove_repeats(docs, hot=20).collect()))
    assert plain == split and [(d, n) for d, _, n, _ in plain] == [(i, 24 if i else 0) for i in range(400)]


def test_rows_of_frequent_runs_and_anchors_meet_no_shuffle(spark):
    heads = spark.range(3000).selectExpr("cast(id % 3 = 0 as int) * 7 + id * cast(id % 3 > 0 as int) anchor", "id run", "struct(id, id) head").repartition(3)
    kinds = substring_dedup.of_several_kinds(heads, 100)
    assert sorted(r.run for r in kinds.collect()) == [i for i in range(3000) if i % 3 == 0 or i == 7]
    runs = spark.range(3000).selectExpr("5 anchor", "id % 2 * id run", "id at").repartition(3)
    again = runs.groupBy("anchor", "run").agg(F.count("*").alias("times"), F.min("at").alias("head")).filter("times > 1")
    got = substring_dedup.with_runs(runs, again, 100)
    assert got.count() == 1500 and {r.head for r in got.collect()} == {0}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_shards_by_a_plain_ranking(spark, documents):
    """Law `rows` by the method's own words: ranks in a source by seeded hash, fractional ranks, equal runs."""
    from stockyard.llm import sharding

    rows = [(r.doc_id, r.source, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in documents.collect()]
    key = lambda r: (hashlib.md5(f"17:{r[0]}".encode()).hexdigest(), r[0], r[2], r[3])
    by_source, shares = {}, []
    for r in rows:
        by_source.setdefault("" if r[1] is None else "=" + r[1], []).append(r)
    for source, mine in by_source.items():
        shares += [((2 * (i + 1) - 1) / (2 * len(mine)), source, key(r), r) for i, r in enumerate(sorted(mine, key=key))]
    n = len(rows)
    want = {}
    for at, (_, _, _, r) in enumerate(sorted(shares, key=lambda s: s[:3])):
        shard = at * 40 // n
        want[r[0]] = (shard, at - -(-shard * n // 40))
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(documents, shards=40).collect()}
    assert got == want
