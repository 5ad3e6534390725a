"""Exact dedup, decontamination, sharding, BPE, WARC and secret scans against brute force."""

import hashlib
import re
import uuid
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stockyard.llm.common import results_dir, stored
from stockyard.llm import bpe, decontamination, entries, exact_dedup, secret_scan, sharding, warc

sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["odd", "messy", "documents", "none"])
def test_exact_dedup(request, which):
    df = request.getfixturevalue(which)
    rows = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows_of(df)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    expected = []
    for i, t in rows:
        keep = min((x for x in groups[t] if x is not None), default=None)
        expected.append((i, keep, len(groups[t]), i == keep, sha(t)))
    got = [tuple(r) for r in exact_dedup.decisions(df).collect()]
    assert Counter(got) == Counter(expected)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    got = sorted((re.sub("[\x20\x09-\x0d]+", " ", t or ""), str(i)) for i, t in rows_of(kept))
    assert got == sorted((t, str(min((x for x in g if x is not None), default=None))) for t, g in groups.items())


def contaminated(docs, items, n=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for key, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].update([] if key is None else [str(key)])
    lengths = {len(w) for w in windows}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit.update(range(j, j + k))
                    found |= windows[tuple(w[j : j + k])]
        yield i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


@pytest.mark.parametrize("which", ["odd", "messy", "documents", "none"])
@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination(request, spark, sf, which, limit):
    df = request.getfixturevalue(which)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame([(100, "W5 w6 w7"), (101, None), (102, ""), (None, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12"), (100, "W5 w6 w7"), (103, " ".join(f"bench{i}" for i in range(14)))], "item_id long, text string"))
    got = [tuple(r) for r in decontamination.contamination(df, bench, index_bytes=limit).collect()]
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    assert Counter(got) == Counter(contaminated(rows_of(df), items))
    clean = decontamination.clean(df, bench, index_bytes=limit)
    assert clean.columns == df.columns
    flags = [x[5] for x in contaminated(rows_of(df), items)]
    assert Counter(rows_of(clean)) == Counter(r for r, f in zip(rows_of(df), flags) if not f)


def test_a_passage_in_every_document_meets_the_benchmark_in_many_groups(spark):
    passage = " ".join(f"bench{i}" for i in range(12))
    docs = spark.range(600, numPartitions=3).select(F.col("id").alias("doc_id"), F.concat(F.lit("d"), "id", F.lit(f" {passage} e"), "id").alias("text"))
    bench = spark.createDataFrame([(i, f"{passage} more{i}") for i in range(300)] + [(900, "words that no document has"), (None, passage)], "item_id long, text string")
    got = [tuple(r) for r in decontamination.contamination(docs, bench, index_bytes=0, many=50).collect()]
    assert Counter(got) == Counter(contaminated(rows_of(docs), [tuple(r) for r in bench.collect()]))
    assert decontamination.clean(docs, bench, index_bytes=0, many=50).count() == 0

    rows = spark.range(3000, numPartitions=3).select("id", F.lit(10).alias("length"), F.when(F.col("id") < 2900, 5).otherwise(F.col("id")).alias("hash"), F.lit(6).cast("long").alias("second"))
    keys = spark.range(3000).select(F.lit(10).alias("length"), F.col("id").alias("hash"), F.lit(6).cast("long").alias("second"))
    dealt, each = decontamination.parted(rows, keys, 100)
    groups = [r["count"] for r in dealt.groupBy(*decontamination.WINDOW, "part").count().collect()]
    assert sum(groups) == 3000 and max(groups) < 200
    assert each.count() == 3000 + 28
    assert Counter(r.id for r in decontamination.meet(rows, keys, 100).collect()) == Counter(range(3000))


@pytest.mark.parametrize("which", ["odd", "documents", "none"])
def test_sharding(request, which):
    df = request.getfixturevalue(which)
    got = sharding.shard(df, shards=7, digits=2).collect()
    rows = rows_of(df)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    if rows:
        sizes = [len(shards[k]) for k in range(7)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    again = sharding.shard(df.repartition(5), shards=7, digits=1).collect()
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert Counter(map(key, got)) == Counter(map(key, again))


def test_shards_match_the_mixture(spark):
    df = spark.range(7000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 6, "hot").otherwise((F.col("id") % 10).cast("string")).alias("source"))
    got = sharding.shard(df, shards=10).join(df, "doc_id").groupBy("shard", "source").count().collect()
    for r in got:
        assert abs(r["count"] - (420 if r.source == "hot" else 70)) <= 2


@pytest.mark.parametrize("which", ["odd", "documents", "none"])
def test_bpe(request, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(entries.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    expected = []
    for i, text in rows_of(df):
        ids = t.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(t.decode(ids, skip_special_tokens=False))))
    out = bpe.encode(df, entries.tokenizer_path(), keep_ids=True)
    assert Counter(tuple(r)[:4] for r in out.collect()) == Counter(expected)
    decoded = bpe.decode_ids(out, entries.tokenizer_path()).collect()
    assert Counter((r.doc_id, sha(r.decoded)) for r in decoded) == Counter((e[0], e[3]) for e in expected)


def test_warc(spark, sf):
    pages = [(1, "u", "x" * 100), (2, None, "x" * 100), (3, "v\r\nA: b", "short"), (4, "v", "short"), (5, "w", None), (6, "w", ""), (7, "é", "é" * 99), (9, "", "x" * 100), (9, "", "x" * 100), (None, "n", "x" * 100), (10, " b ", "\r\n\r\nWARC/1.1\r\n" * 30_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("id", F.lit(2)).repartition(2)
    archives = warc.write_archives(df, archive_bytes=1000)
    normal = warc.normalise(archives)
    normal = stored(normal, "members")
    index = stored(warc.sidecar(normal), "index")
    got = warc.read_records(normal, index).collect()
    expected = []
    for i, _, html in pages:
        b = (html or "").encode()
        first = min((p for p, _, h in pages if p is not None and (h or "").encode() == b), default=None) if len(b) >= 100 else i
        expected.append((i, len(b), sha(b), "response" if i == first else "revisit", None if i == first else first))
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected)
    assert {r.url for r in got if r.page_id == 7} == {"é"} and {r.url for r in got if r.page_id == 10} == {" b "}
    assert index.count() == len(pages)
    some = index.filter("offset = 0")
    assert warc.read_records(normal, some).count() == some.count()
    again = warc.normalise(normal).collect()  # members in, the same members out
    assert Counter(bytes(r.archive) for r in again) == Counter(bytes(r.archive) for r in normal.collect())
    empty = stored(warc.normalise(warc.write_archives(df.limit(0))), "members")
    assert warc.read_records(empty, warc.sidecar(empty)).count() == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(secret_scan.RULES):
        for m in re.finditer(pattern, text or "", re.A):
            if len(m[group]) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


@pytest.mark.parametrize("which", ["odd", "documents", "none"])
def test_secret_scan(request, which):
    df = request.getfixturevalue(which)
    half = df.filter("doc_id % 2 = 0")
    ledger = secret_scan.extend_ledger(half)
    more = secret_scan.extend_ledger(df, ledger)
    assert more.join(ledger, "blob").count() == 0
    whole = ledger.unionByName(more)
    got = Counter((r.doc_id, tuple(tuple(x) for x in r.found)) for r in secret_scan.findings(df, whole).collect())
    assert got == Counter((i, tuple(brute_spans(t))) for i, t in rows_of(df))
    assert secret_scan.extend_ledger(df, ledger, version="next").count() == secret_scan.blobs(df).count()
    kept = secret_scan.Ledger(df.sparkSession, f"{results_dir(df.sparkSession)}/ledger-{which}-{uuid.uuid4().hex}")
    for rows in (half, df, df):
        kept.extend(rows)
    assert kept.entries().count() == secret_scan.blobs(df).count()
    kept.extend(half, version="next")
    assert kept.entries().filter("version = 'next'").count() == secret_scan.blobs(half).count()
