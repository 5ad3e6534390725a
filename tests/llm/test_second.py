"""Quality, substring dedup, suffix tree, similarity join and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from stockyard.llm import quality, similarity_join, substring_dedup, suffix_tree
from stockyard.llm.common import Workspace, stored
from stockyard.llm.components import components
from stockyard.llm.tokens import Words, pieces

SPACE = "[^\x20\x09-\x0d]+"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def lowered(t):
    return re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.fixture(scope="module")
def planted(spark, documents):
    """Documents plus a large group of near copies, chained near copies and a passage shared by many."""
    r = random.Random(1)
    base, more = [f"b{r.randrange(500)}" for _ in range(120)], []
    for j in range(150):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        more.append((10**6 + j, " ".join(w)))
    for j in range(120):
        more.append((2 * 10**6 + j, " ".join([f"u{r.randrange(10**6)}" for _ in range(r.randrange(60))] + base[:60])))
    return documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).repartition(3)


def brute_sets(rows, k=5):
    sets = []
    for _, t in rows:
        w = lowered(t)
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    return sets


def brute_groups(rows, percent=75):
    """Rows by component, a list of places for each."""
    sets = brute_sets(rows)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    index = defaultdict(list)
    for a, s in enumerate(sets):
        for x in s:
            index[x].append(a)
    for a, s in enumerate(sets):
        shared = Counter()
        for x in s:
            shared.update(index[x])
        for b, n in shared.items():
            if b > a and 100 * n >= percent * (len(s) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for a in range(len(rows)):
        groups[find(a)].append(a)
    return list(groups.values())


def brute_components(rows):
    sets, out = brute_sets(rows), Counter()
    for group in brute_groups(rows):
        low = min((rows[a][0] for a in group if rows[a][0] is not None), default=None)
        out.update((rows[a][0], len(sets[a]), low if sets[a] else rows[a][0]) for a in group)
    return out


@pytest.mark.parametrize("which,options", [("odd", {}), ("none", {}), ("planted", {}), ("planted", {"short": 3, "tile": 3000}), ("planted", {"short": 10**6, "tile": 500, "few": 0, "low": 0.7}), ("messy", {"few": 0})])
def test_similarity_join(request, which, options):
    df = request.getfixturevalue(which)
    got = Counter(tuple(r) for r in similarity_join.join(df, **options).collect())
    assert got == brute_components(rows_of(df))


def by_hash(texts, k=5):
    """Hash of the one shingle of each text of five words."""
    out = []
    for _, _, data, offs in pieces(pa.array(texts, type=pa.string())):
        row, h = similarity_join.sets_of(Words(data, offs, lower=True), k)
        out += h[row.argsort(kind="stable")].tolist()
    return out


def test_overlap_in_front_of_a_short_list(spark):
    """X and Y share seven shingles; the first in the order is in a long list, where they do not meet."""
    r = random.Random(7)
    for _ in range(100_000):
        x = [f"t{r.randrange(10**9)}" for _ in range(11)]
        y = x + [f"t{r.randrange(10**9)}"]
        h = by_hash([" ".join(y[j : j + 5]) for j in range(8)])
        first = sorted(h[:7])
        if h[7] > first[3]:
            break
    line = " ".join(x[h.index(first[0]) :][:5])
    rows = [(1, " ".join(x)), (2, " ".join(y))]
    # long documents with the line in their prefix: they are not alike, but its list gets long
    rows += [(10 + j, " ".join(f"f{j}-{i}" for i in range(60)) + " " + line) for j in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {q.doc_id: q.component_id for q in similarity_join.join(df).collect()}
    assert got[2] == 1
    assert Counter(tuple(q) for q in similarity_join.join(df).collect()) == brute_components(rows)


def test_long_list_that_stays_in_the_prefix(spark):
    """Sets of one shingle that are equal though their texts differ, and small sets whose lists are all long."""
    rows = [(j, " ".join(["same"] * j)) for j in range(5, 65)]
    r = random.Random(8)
    while True:
        x = [f"t{r.randrange(10**9)}" for _ in range(7)]
        if max(by_hash([" ".join(x[j : j + 5]) for j in range(3)])) < 0.15 * 2**64:
            break
    rows += [(1000, " ".join(x)), (1001, " ".join([*x, "more"]))]
    rows += [(2000 + j, " ".join(x + [f"f{j}-{i}" for i in range(70)])) for j in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(q) for q in similarity_join.join(df).collect())
    assert got == brute_components(rows)
    assert {c for i, _, c in got if i < 1000} == {5} and (1001, 4, 1000) in got


@pytest.mark.parametrize("which,options", [("odd", {}), ("none", {}), ("messy", {}), ("messy", {"few": 0}), ("planted", {})])
def test_one_of_each(request, which, options):
    df = request.getfixturevalue(which)
    kept = similarity_join.one_of_each(df, **options)
    assert kept.columns == df.columns
    rows = rows_of(df)
    got = Counter(map(tuple, kept.select("doc_id", "text").collect()))
    groups = brute_groups(rows)
    place = lambda a: (rows[a][0] is None, rows[a][0] or 0, hashlib.md5((rows[a][1] or "").encode()).digest())
    stays = [min(g, key=place) for g in groups if lowered(rows[g[0]][1])]
    bare = [a for a, (_, t) in enumerate(rows) if not lowered(t)]
    assert got == Counter(rows[a] for a in stays + bare)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    with Workspace(spark) as work:
        got = {x.node: x.label for x in components(spark.createDataFrame(edges, "u long, v long"), work).collect()}
    groups = defaultdict(set)
    for a in got:
        groups[find(a)].add(got[a])
    assert all(len(x) == 1 for x in groups.values())
    assert len({min(x) for x in groups.values()}) == len(groups)


def brute_repeats(rows, length=20):
    words = {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))
    first = {}
    for i, t in order:
        w = words[i] = re.findall(SPACE, t or "")
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s : s + length]), (i, s))
    out = Counter()
    for i, t in rows:
        w = words[i]
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] != (i, s):
                gone[s : s + length] = [True] * length
        out[(i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("which", ["odd", "none", "documents", "planted"])
def test_substring_dedup(request, which):
    df = request.getfixturevalue(which)
    got = substring_dedup.remove_repeats(df, keep_text=True).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_repeats(rows_of(df))
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def symbol_classes(words, endings):
    out = {}
    for x in words:
        for _, _, data, offs in pieces(pa.array([x])):
            out[x] = int(suffix_tree.ending(Words(data, offs, lower=True), endings)[0])
    return out


def brute_scores(rows, words, endings, depth, least, keep):
    """A tree of dictionaries: contexts are tuples of symbols, the latest first."""
    counts = Counter(x for i, t in rows if not held(i) for x in lowered(t))
    ends = sum(not held(i) for i, _ in rows)
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    steps = defaultdict(list)
    for x, n in counts.items():
        steps[math.floor(math.log2(n) * 16)].append(x)
    top = []
    for k in sorted(steps, reverse=True):
        if len(top) + len(steps[k]) > words:
            break
        top += steps[k]
    top = set(top)
    ending = symbol_classes({x for _, t in rows for x in lowered(t)}, endings)
    symbol = lambda x: x if x in top else ("ending", ending[x])
    sequence = lambda t: [("start",), *(symbol(x) for x in lowered(t)), ("end",)]
    alphabet = len(top) + endings + 1
    train = [sequence(t) for i, t in rows if not held(i)]
    first = Counter(x for q in train for x in q[1:])
    zero = lambda x: (first[x] + 0.5) / (sum(first.values()) + 0.5 * alphabet)
    states, diverging = {(): None}, {()}

    def p(context, x):
        while context not in states:
            context = context[:-1]
        if not context:
            return zero(x)
        own = states[context]
        n, kinds = sum(own.values()), len(own)
        return (own[x] + kinds * p(context[:-1], x)) / (n + kinds)

    for d in range(1, depth + 1):
        found = defaultdict(Counter)
        for q in train:
            for at in range(d, len(q)):
                found[tuple(reversed(q[at - d : at]))][q[at]] += 1
        new = {c: own for c, own in found.items() if sum(own.values()) >= least}
        for c, own in new.items():
            n = sum(own.values())
            if sum(k * math.log(k / n / p(c[:-1], x)) for x, k in own.items()) > keep * len(own):
                diverging |= {c[:k] for k in range(1, d + 1)}
        states |= new
    states = {c: own for c, own in states.items() if c in diverging}
    inside = defaultdict(lambda: [0, 0])
    for x, n in counts.items():
        if x not in top:
            inside[ending[x]][0] += n
            inside[ending[x]][1] += 1
    out = []
    for i, t in rows:
        q, w, sum_ = sequence(t), lowered(t), 0.0
        for at in range(1, len(q)):
            sum_ += math.log10(p(tuple(reversed(q[max(0, at - depth) : at])), q[at]))
        for x in w:
            if x not in top:
                n, v = inside[ending[x]]
                sum_ += math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1)))
        base = sum(math.log10((n + 0.1) / (total + 0.1 * (distinct + 1))) for n in [*(counts[x] for x in w), ends])
        out.append((i, held(i), len(w) + 1, sum(x in counts for x in w) + (ends > 0), total, round(base, 4), round(sum_, 2)))
    return out, len(states), max(map(len, states))


@pytest.mark.parametrize("which,options", [("documents", {"least": 4}), ("documents", {"listed": 300, "words": 60, "endings": 30, "depth": 5, "least": 2}), ("odd", {}), ("messy", {"least": 2}), ("none", {})])
def test_suffix_tree(request, which, options):
    df = request.getfixturevalue(which)
    model = {"words": 2048, "endings": 512, "depth": 6, "least": 16, "keep": 1.0} | {k: v for k, v in options.items() if k != "listed"}
    expected, states, longest = brute_scores(rows_of(df), **model)
    got = suffix_tree.score(df, **options).collect()
    close = lambda r: (str(r[0]), *r[1:5], round(r[5]), round(r[6]))
    for a, b in zip(sorted(map(tuple, got), key=close), sorted(expected, key=close), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-3 and abs(a[6] - b[6]) < 1e-3 * max(10, abs(b[6]))
    if which == "documents":
        assert states > 50 and longest > 2
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_tree_is_a_distribution(documents):
    tree = suffix_tree.Model(documents.select("text"), 50, 40, 4, 4, 1.0, 1000, 1 << 20).tree
    states, symbols = len(tree.parent), tree.symbols
    assert states > 20 and tree.parent.max() > 0
    p = 10.0 ** tree.log(np.repeat(np.arange(states), symbols), np.tile(np.arange(symbols), states))
    assert abs(p.reshape(states, symbols).sum(axis=1) - 1).max() < 1e-4


def test_a_long_context_behind_one_that_tells_nothing(spark):
    """Two words decide the next one, where one word alone says nothing of it."""
    r = random.Random(6)
    rows = []
    for _ in range(200):
        x = [r.randrange(3), r.randrange(3)]
        while len(x) < 60:
            x.append((x[-1] + x[-2]) % 3 if r.random() < 0.8 else r.randrange(3))
        rows.append((" ".join(f"w{i}" for i in x),))
    tree = suffix_tree.Model(spark.createDataFrame(rows, "text string"), 100, 8, 2, 16, 8.0, 1000, 1 << 20).tree
    behind = np.unique(tree.children[1][0] // (tree.symbols + 1))
    assert len(behind) == 3 and not tree.far[behind].any() and tree.far[tree.children[1][1]].all()


def test_tree_keeps_to_its_bound(documents):
    few = suffix_tree.Model(documents.select("text"), 50, 40, 4, 4, 1.0, 1000, 400).tree
    assert 0 < len(few.codes) <= 400


@pytest.mark.parametrize("which,entries", [("documents", 400), ("documents", 6000), ("documents", 40000), ("messy", 60)])
def test_contexts_beyond_the_tree_sent(request, which, entries):
    """What does not go into the part that is sent counts all the same: scores are those of the whole tree."""
    df = request.getfixturevalue(which)
    options = {"words": 60, "endings": 30, "depth": 5, "least": 2 if which == "messy" else 4, "keep": 1.0}
    expected, _, _ = brute_scores(rows_of(df), **options)
    got = suffix_tree.score(df, entries=entries, **options).collect()
    close = lambda r: (str(r[0]), *r[1:5], round(r[5]), round(r[6]))
    for a, b in zip(sorted(map(tuple, got), key=close), sorted(expected, key=close), strict=True):
        assert a[:5] == b[:5] and abs(a[6] - b[6]) < 1e-3 * max(10, abs(b[6]))


@pytest.mark.parametrize("which,heavy", [("documents", 6), ("documents", 60), ("messy", 3)])
def test_long_contexts_sent_and_the_rest_behind_them(request, which, heavy):
    """Frequent contexts of several symbols are sent, others are counted behind them, with the scores of the whole tree."""
    df = request.getfixturevalue(which)
    options = {"words": 60, "endings": 30, "depth": 5, "least": 2 if which == "messy" else 4, "keep": 1.0}
    expected, _, _ = brute_scores(rows_of(df), **options)
    got = suffix_tree.score(df, entries=12000 if which == "documents" else 400, heavy=heavy, **options).collect()
    close = lambda r: (str(r[0]), *r[1:5], round(r[5]), round(r[6]))
    for a, b in zip(sorted(map(tuple, got), key=close), sorted(expected, key=close), strict=True):
        assert a[:5] == b[:5] and abs(a[6] - b[6]) < 1e-3 * max(10, abs(b[6]))


def test_places_beyond_the_tree_travel_in_packs(documents):
    """Few bytes for the symbols and the row of a place, not a row of three numbers."""
    model = suffix_tree.Model(documents.select("text"), 60, 30, 4, 4, 1.0, 1000, 400)
    places, often = model.total, [np.arange(model.tree.symbols + 1)] + [np.zeros(0, dtype=np.int64)] * 3
    empty = suffix_tree.Tree(model.tree.top, model.tree.symbols, model.tree.endings)
    packs = model.part.select("row", "train", "symbols").mapInArrow(lambda it: suffix_tree.exits(it, empty, often, 5), suffix_tree.PACK).collect()
    assert len(packs) < places / 50 and {p.bucket for p in packs} <= set(range(5))
    assert sum(p.places for p in packs) == places and sum(len(p.data) for p in packs) < 8 * places


def test_lookup_tables_are_bounded_together():
    """Contexts of six lengths behind 2,600 states each took a table from code 0 on, 26 MB for each length."""
    r = np.random.default_rng(3)
    many = [np.unique(r.integers(d * 2600 * 2563, (d + 1) * 2600 * 2563, 60_000)) for d in range(6)] + [np.array([5, 6_000_000]), np.zeros(0, dtype=np.int64)]
    found = suffix_tree.finders(many, 1 << 24)
    assert sum(x.places for x in found) <= 1 << 24 and found[0].places and found[1].places and not found[6].places
    for known, find in zip(many, found):
        wanted = np.concatenate((known, r.integers(0, 7 * 2600 * 2563, 1000), [0, 1 << 61]))
        slot, hit = find(wanted)
        assert (hit == np.isin(wanted, known)).all() and (known[slot[hit]] == wanted[hit]).all()


def test_the_session_keeps_its_setting(spark):
    held = spark.conf.get(suffix_tree.CLEAN, None)
    assert suffix_tree.written(spark.range(1000).selectExpr("id % 9 AS k").distinct(), "t").count() == 9
    assert spark.conf.get(suffix_tree.CLEAN, None) == held


def test_more_text_has_longer_contexts(spark):
    """A passage that stands `least` times is known by long contexts, whatever else there is."""
    r = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"r{r.randrange(200)}" for _ in range(40)) + (" " + passage if i < 20 else "")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.score / x.n_tokens for x in suffix_tree.score(df, least=8).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 300))


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    truth = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = ([s for s, q in truth if q == v] for v in (1, 0))
    pairs = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert pairs > 0.9


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (5, 1), (5, 1), (7, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in got)


def brute_statistics(text):
    """The same statistics, told by Python's own string functions."""
    b = (text or "").encode()
    kinds = [0] * quality.KINDS
    for x in b:
        kinds[int(quality._KIND[x])] += 1
    words, lines = re.findall(rb"[^\x20\x09-\x0d]+", b), [x for x in b.split(b"\n") if x]
    n = max(len(words), 1)
    mean = sum(map(len, words)) / n
    share = lambda f: sum(map(f, words)) / n
    most = lambda xs: (len(set(xs)) / max(len(xs), 1), max(Counter(xs).values(), default=0) / max(len(xs), 1))
    spread = math.sqrt(max(sum(len(w) ** 2 for w in words) / n - mean**2, 0))
    ends = [share(lambda w, k=k: quality._KIND[w[-1]] == k) for k in (6, 7, 5)]
    return [k / max(len(b), 1) for k in kinds] + [math.log1p(len(words)), mean, spread, share(lambda w: quality._KIND[w[0]] == 1), *ends, *most(words), *most(lines)]


def test_quality_by_brute_force(spark):
    """Statistics, ridge and isotonic steps made again with plain numpy on the driver."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = sorted(rows_of(docs))
    stats = {i: np.array(brute_statistics(t), dtype=np.float32).astype(float) for i, t in rows}
    model = quality.fit(quality.with_statistics(docs, "doc_id", "text"), labels)
    label = {r.doc_id: float(r.quality) for r in labels.collect() if r.quality is not None}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = [i for i, _ in rows if i in label and fold(i) != 0]
    x = np.array([stats[i] for i in known])
    assert np.allclose(x.mean(axis=0), model.mean, atol=1e-4) and np.allclose(np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1), model.scale, rtol=1e-3, atol=1e-4)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    f = np.column_stack((np.ones(len(z)), np.sqrt(2 / len(model.phase)) * np.cos(z @ model.weights + model.phase)))
    y, train = np.array([label[i] for i in known]), np.array([fold(i) != 1 for i in known])
    a = f[train].T @ f[train]
    ridge = 1e-3 * train.sum() * np.eye(len(a)) / len(a)
    ridge[0, 0] = 0
    beta = np.linalg.solve(a + ridge, f[train].T @ y[train])
    assert np.allclose(f @ beta, f @ model.beta, atol=1e-3)
    raw = np.rint(f[~train] @ model.beta * 500) / 500
    grid = sorted(set(raw.tolist()))
    # isotonic regression by its definition: the largest mean over lower ends of the smallest over upper ends
    total, ones = (np.array([np.sum(v[raw == g]) for g in grid]) for v in (np.ones((~train).sum()), y[~train]))
    t, o = np.concatenate(([0], np.cumsum(total))), np.concatenate(([0], np.cumsum(ones)))
    means = lambda i: np.array([[(o[b] - o[a]) / (t[b] - t[a]) for b in range(i + 1, len(t))] for a in range(i + 1)])
    level = np.array([means(i).min(axis=1).max() for i in range(0, len(grid), 7)])
    got = np.array([model.level[min(np.searchsorted(edges, i, side="right") - 1, len(model.level) - 1)] for edges in [block_starts(model, grid, total)] for i in range(0, len(grid), 7)])
    assert np.allclose(np.clip(level, 0.001, 0.999), got, atol=1e-6)
    scored = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    sample = [i for i, _ in rows][:200]
    assert np.allclose([scored[i] for i in sample], model.score(np.array([stats[i] for i in sample])), atol=1e-3)


def block_starts(model, grid, total):
    """The first grid point of each pooled block, found by the blocks' centres."""
    starts, at = [], 0
    for centre in model.grid:
        starts.append(at)
        weight = weighted = 0.0
        while at < len(grid):
            weight, weighted, at = weight + total[at], weighted + total[at] * grid[at], at + 1
            if abs(weighted / weight - centre) < 1e-9:
                break
    return starts


@pytest.mark.parametrize("which", ["odd", "messy", "none"])
def test_pipeline_stages_on_odd_rows(request, spark, sf, which):
    """Each stage on rows with null ids, repeated ids, copies and clashing columns."""
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows, kept = rows_of(docs), out.collect()
        if name == "bpe":
            assert Counter(r.doc_id for r in kept) == Counter(i for i, _ in rows)
            return
        assert out.columns == docs.columns
        got = Counter((r.doc_id, r.text) for r in kept)
        assert not got - Counter(rows)
        if name == "exact_dedup":
            flat = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
            assert Counter(flat(t) for _, t in got.elements()) == Counter({flat(t) for _, t in rows})
        if name == "near_dedup":
            groups = [g for g in brute_groups(rows) if lowered(rows[g[0]][1])]
            assert sum(got.values()) == len(groups) + sum(not lowered(t) for _, t in rows)
        docs = stored(out, "stage")


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.collect()}
        assert kept <= ids and (name != "exact_dedup" or len(kept) == docs.selectExpr("count(distinct text) n").first().n)
        ids = kept
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == ids
