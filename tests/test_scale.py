"""Files cut anywhere, hot items, live counts, large taxonomies, deep pages and first partitions against plain answers."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from stockyard.operators import carry, evidence, identify, labels, ladder, queries
from stockyard.sources import splits, tables
from stockyard.streaming import live


@pytest.fixture(params=["128m", "900", "257"])
def cut(spark, request):
    """Files in one split, in some and in many."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def written(path, header, rows, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(header)
        w.writerows(rows)
    return str(path)


def test_files_in_the_order_given(spark, tmp_path, cut):
    """Quoted line breaks, quotes within cells, two headers, one file name in two folders, the larger file last."""
    r = random.Random(2)
    cells = ["plain", "two\nlines", 'say "x", y', '5" wide', '"lead', "\n\n", " sp ", "a,b", ""]
    make = lambda n, tag: [(f"{tag}{i}", r.choice(cells)) for i in range(n)]
    a, b = make(30, "a"), make(150, "b")
    files = [written(tmp_path / "x y+%20" / "list.csv", ["Note", "Domain"], [(n, d) for d, n in a]), written(tmp_path / "b" / "list.csv", ["Domain", "Note"], b, "\r\n")]
    (tmp_path / "raw.csv").write_text('Domain,Note\nx.com,5" raw\ny.com,plain\n')
    files.append(str(tmp_path / "raw.csv"))
    want = [*a, *b, ("x.com", '5" raw'), ("y.com", "plain")]
    rows = tables.read_inventory(spark, files).orderBy("row_no").collect()
    assert [(x.Domain, x.Note) for x in rows] == want and len({x.row_no for x in rows}) == len(want)
    got = tables.read_results(spark, files)
    assert got.columns == ["Note", "Domain"] and sorted((x.Domain, x.Note) for x in got.collect()) == sorted(want)


def test_results_by_their_own_headers(spark, tmp_path):
    one = written(tmp_path / "1.csv", ["Domain", "Quality"], [("a.com", "Premium"), ("short",), ("long", "x", "beyond"), ()])
    two = written(tmp_path / "2.csv", ["Quality", "Domain", "Type", "Type"], [("Standard", "b.com", "WEBSITE", "late")])
    (tmp_path / "3.csv").write_bytes(b'Domain,Quality\nbad\xff,"broken off')
    got = tables.read_results(spark, [one, two, str(tmp_path / "3.csv")])
    assert got.columns == ["Domain", "Quality", "Type"]
    assert sorted(map(tuple, got.collect())) == [("a.com", "Premium", ""), ("b.com", "Standard", "WEBSITE"), ("bad�", "broken off", ""), ("long", "x", ""), ("short", "", "")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("\n \n")
    assert tables.read_results(spark, str(tmp_path / "none")).collect() == []


def test_sink_without_rows(spark, tmp_path):
    tables.write_results(spark.createDataFrame([], "A string"), str(tmp_path / "o"), ["A", "B"])
    assert next((tmp_path / "o").glob("part*")).read_bytes() == b"A,B\r\n"


def document(r, n):
    entries = {}
    for i in range(n):
        e = {"status": r.choice(["success", "error"]), "timestamp": f"t{i}", "processing_time": i / 2, "error": r.choice(["", "a } b", 'quote " and \\ {', '{[\\"}', "}"]), "mode": "deep"}
        if i % 3 == 0:
            e["result"] = {"a": {"b": [{"c": "}"}]}, "x": "{"}
        entries[f'k{i}"}}{{' if i % 7 == 0 else f"k{i}"] = e
    return {"total_domains": n, "spend": {"usd": 1, "by_model": {"m": {"z": 1}}}, "processed_domains": entries, "start_time": "s", "other": {"k1": {"status": "no"}}, "last_updated": "u}"}


def test_progress_documents_cut_anywhere(spark, tmp_path, cut):
    r, want = random.Random(1), []
    for run, name, n, indent in ((3, "a", 90, 2), (4, "b", 40, None), (4, "c", 0, None)):
        folder = tmp_path / f"run={run}"
        folder.mkdir(exist_ok=True)
        doc = document(r, n)
        (folder / f"{name}.json").write_text(json.dumps(doc, indent=indent))
        want += [(run, n, "s", "u}", k, v["status"], v["error"], v["processing_time"]) for k, v in doc["processed_domains"].items()] or [(run, n, "s", "u}", None, None, None, None)]
    (tmp_path / "run=4" / "bad.json").write_text("not json")
    want.append((4, None, None, None, None, None, None, None))
    got = tables.read_progress(spark, str(tmp_path)).select("run", "total_domains", "start_time", "last_updated", "item", "status", "error", "processing_time")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_cells_of_records(spark):
    rows = ['a,b', '"a,b",c', '"a""b,",c', 'a"b,c"d', '"x"y,z', "", '"', ',"",']
    df = spark.createDataFrame([(x,) for x in rows], "v string").select("v", splits.cells(F.col("v"), ",").alias("n"))
    assert [r.n for r in df.collect()] == [max(1, len(next(csv.reader([x]), []))) for x in rows]


def log_of(spark):
    """An item with half of all rows, others with a few, null keys."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 401 == 0, None).otherwise(F.col("id") % 97 + 10).cast("long").alias("item"), F.lit(5).cast("long").alias("run_id"), (F.col("id") * 7919 % 4001).alias("seq"))
    kind = F.col("seq") % 5
    return rows.withColumns({"rung": F.when(kind == 0, "deep").when(kind == 1, "research").otherwise("direct"), "status": F.when(kind == 2, "success").otherwise("error"), "error": F.when(kind == 2, None).when(kind == 3, "http status 403").otherwise(F.concat(F.lit("e"), F.col("seq").cast("string")))}).repartition(5)


@pytest.mark.parametrize("operator", [lambda t, hot: ladder.bot_protection(t, hot), lambda t, hot: ladder.chain_errors(t, hot), lambda t, hot: labels.retry_budget(t.withColumn("parse_error", F.coalesce("error", F.lit(""))), hot=hot)])
def test_hot_items(spark, operator):
    t = log_of(spark)
    plain, ranged = (operator(t, hot) for hot in (carry.HOT, 300))
    assert plain.columns == ranged.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, ranged.collect()))


def test_no_range_of_a_hot_item_is_large(spark):
    rows, heavy = carry.segmented(log_of(spark), ["run_id", "item"], "seq", 300)
    sizes = [r["count"] for r in rows.groupBy("item", carry.PART).count().collect()]
    assert heavy.count() == 2000 and sum(sizes) == 4000 and max(sizes) < 3 * 300


def test_live_summary_after_every_batch(spark, tmp_path):
    """Late, repeated and retracted attempts, an item that moves the first second, and a run again."""
    schema = "run_id long, item long, seq long, ts timestamp, rung string, status string, error string"
    at = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02}"
    r = random.Random(5)
    log = [(r.randrange(3), r.randrange(9), i, at(i), "direct", r.choice(["success", "error", "retry_pending"]), "") for i in range(240)]
    r.shuffle(log)
    log = [*log[:160], *log[100:240], *log[:20], (0, None, 900, at(1), "d", "error", ""), (None, 1, 901, at(2), "d", "error", ""), (1, 77, None, None, "d", None, "")]
    runs = spark.createDataFrame([(0, 50), (1, 0), (2, 9), (7, 4)], "run_id long, total long")
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "marks"))
    frame = lambda rows: spark.createDataFrame([(*x[:3], x[3], *x[4:]) for x in rows], schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(0, len(log), 110):
        frame(log[i : i + 110]).coalesce(2).write.mode("append").parquet(source)
        live.live_summary(spark.readStream.schema(frame(log[:1]).schema).parquet(source), out, checkpoint, available_now=True).awaitTermination()
        state = ladder.latest_state(frame(log[: i + 110]))
        want = ladder.progress_summary(state, runs)
        assert sorted(map(tuple, live.read_live_summary(spark, out, runs).collect())) == sorted(map(tuple, want.collect()))
    # a batch that runs again finds the version before its own and writes the same
    versions = sorted(p.name for p in (tmp_path / "out").glob("version=*"))
    assert len(versions) == 2


def test_live_state_is_held_by_buckets(spark, tmp_path):
    """Python is called for each bucket of items, not for each item; the counts are those of all items."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "marks"))
    rows = spark.range(1200).selectExpr("id % 3 AS run_id", "id % 400 AS item", "id AS seq", "timestamp_seconds(id) AS ts", "'r' AS rung", "CASE id % 2 WHEN 0 THEN 'success' ELSE 'error' END AS status", "'' AS error")
    rows.repartition(2).write.parquet(source)
    q = live.live_summary(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source), out, checkpoint, available_now=True, buckets=8)
    q.awaitTermination()
    assert len(q.recentProgress) >= 2 and 0 < q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 8
    runs = spark.createDataFrame([(0, 900), (1, 0), (2, 9)], "run_id long, total long")
    want = ladder.progress_summary(ladder.latest_state(rows), runs)
    assert sorted(map(tuple, live.read_live_summary(spark, out, runs).collect())) == sorted(map(tuple, want.collect()))


def test_live_summary_of_nothing(spark, tmp_path):
    runs = spark.createDataFrame([(1, 5)], "run_id long, total long")
    r = live.read_live_summary(spark, str(tmp_path / "none"), runs).first()
    assert (r.total, r.entries, r.remaining, r.elapsed) == (5, 0, 5, None)


def test_nearest_keys_of_a_large_taxonomy(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 5)))
    keys = sorted({" ".join(word() for _ in range(r.randrange(1, 4))) for _ in range(400)})
    norms = sorted({" ".join(word() for _ in range(r.randrange(1, 5))) for _ in range(200)} | {"q", "a"} - set(keys))
    paths = spark.createDataFrame([(k, [k, "x"], (i * 37) % 1000) for i, k in enumerate(keys)], "key string, path array<string>, ord long")
    got = {x.norm: x.near_path[0] for x in labels.nearest_keys(spark.createDataFrame([(n,) for n in norms], "norm string"), paths).collect()}
    want = {}
    for n in norms:
        near = [(len(k), -((i * 37) % 1000), k) for i, k in enumerate(keys) if k in n or n in k]
        if near:
            want[n] = max(near)[2]
    assert got == want
    # more keys than any list that is broadcast, and no nested loop in the plan
    many = spark.range(100_000).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"), F.array(F.col("id").cast("string")).alias("path"), F.col("id").alias("ord"))
    rows = spark.createDataFrame([("all about key77777 and more",), ("y99999",)], "vertical string")
    out = labels.resolve_verticals(rows, "vertical", many)
    assert {x.vertical: x.tier1 for x in out.collect()} == {"all about key77777 and more": "77777", "y99999": "99999"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("n, offset", [(5000, 0), (5000, 2500), (5000, 4990), (5000, 5000), (0, 3)])
def test_deep_pages(spark, n, offset):
    seq = F.when(F.col("id") % 500 == 7, None).when(F.col("id") % 3 == 0, F.col("id") * F.col("id")).otherwise(-F.col("id"))
    rows = spark.range(n).select(seq.alias("seq"), F.col("id").cast("string").alias("Domain"), F.lit("Premium").alias("Quality")).repartition(4)
    got, total = queries.page(rows, offset, 20, columns=["Domain"], most=50)
    order = sorted((r.seq is not None, r.seq or 0) for r in rows.select("seq").collect())[offset : offset + 20]
    assert total == n and [(r.seq is not None, r.seq or 0) for r in got.collect()] == order
    if offset == 2500:
        assert "limit=25" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_partitions_tell_the_columns(spark, tmp_path):
    cells = [(f"site{i}.com" if i % 3 else "", "x", f"{i}" if i > 29_000 else "", None) for i in range(30_000)]
    rows = spark.createDataFrame(cells, "Address string, Note string, Rare string, Never string").coalesce(6).withColumn("row_no", F.monotonically_increasing_id())
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(identify.score_columns(rows, in_order=True)) == key(identify.score_columns(rows)) == key(identify.score_columns(rows, in_order=True, most=5000))
    assert identify.resolve_input_column(rows, in_order=True) == "Address"
    # nothing beyond the first of six partitions is looked at
    guarded = F.when(F.spark_partition_id() > 0, F.raise_error(F.lit("read"))).otherwise(F.col("Address"))
    assert [tuple(r)[:3] for r in identify.score_columns(rows.select("row_no", guarded.alias("Address")), in_order=True).collect()] == [("Address", 0, 200)]


def test_inputs_of_one_name(spark, tmp_path):
    for folder, text in (("a", "Domain\na.com\n"), ("b", "Domain\nb.com\n512001\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "list.csv").write_text(text)
    (tmp_path / "b" / "empty.csv").write_text("")
    read = queries.with_file(spark.read.option("header", True).option("recursiveFileLookup", True).csv(str(tmp_path)))
    tlds = spark.createDataFrame([("com",)], "tld string")
    got = queries.list_inputs(spark, str(tmp_path), identify.breakdown(read, "Domain", tlds)).collect()
    assert sorted((r.source_file[-10:], r.size, r.total, r.ios) for r in got) == [("a/list.csv", 13, 1, 0), ("b/list.csv", 20, 2, 1)]


def test_spec_of_a_folder(spark, tmp_path):
    spec = {"categories": [{"name": "A", "type": "boolean", "question": "?"}]}
    rows = spark.createDataFrame([("a",)], "Domain string")
    path = str(tmp_path / "r")
    for _ in range(2):
        labels.append_to(path, rows, spec)
    with pytest.raises(labels.SpecChanged):
        labels.append_to(path, rows, None)
    assert spark.read.parquet(path).count() == 2
    labels.append_to(path + "2", rows, None)
    labels.append_to(path + "2", rows, None)
    with pytest.raises(labels.SpecChanged):
        labels.append_to(path + "2", rows, spec)


def test_replies_without_labels_are_not_routed(spark):
    rows = spark.createDataFrame([(1, "not json", "CNN", "headlines news"), (2, '{"choices":[{"message":{"content":"{}"}}]}', "CNN", "headlines news"), (3, None, None, None)], "item long, json string, app_name string, research string")
    tax = spark.createDataFrame([], "line_no long, name string, tier1 string, tier2 string, tier3 string, tier4 string")
    got = {r.item: (r.vertical, r.tier1, r.political_leaning) for r in labels.decode_ctv_labels(labels.unwrap_replies(rows), labels.taxonomy_paths(tax)).collect()}
    assert got == {1: (None, None, None), 2: ("Politics > Civic affairs", "Politics", "Center"), 3: (None, None, None)}


def test_written_tables_are_released(spark):
    from stockyard import shipping

    held = shipping.stored(spark.range(3), "held")
    assert held.count() == 3 and shipping.children(spark, shipping.results_dir(spark))
    shipping.release(spark)
    assert shipping.children(spark, shipping.results_dir(spark)) == []
    assert shipping.stored(spark.range(3), "again").count() == 3


def test_headers_take_few_lines_to_the_driver(spark, tmp_path, monkeypatch):
    """Quoted cells that span lines behind a header of one line: nothing but that line is fetched. One that spans lines
    itself takes as many as it has, and texts with an odd quote where the lines end take no more."""
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("a;b\n" + f'"{i}\n";x\n' * 3000)
    fetched = []
    reader = tables.splits.texts

    class Fetched:
        def __init__(self, df):
            self.df = df

        def __getattr__(self, name):
            return getattr(self.df, name)

        def select(self, *c):
            return Fetched(self.df.select(*c))

        def limit(self, n):
            fetched.append(n)
            return self.df.limit(n)

    # lists of one file are what a header is fetched from
    monkeypatch.setattr(tables.splits, "texts", lambda s, path, *e: Fetched(reader(s, path, *e)) if isinstance(path, list) and len(path) == 1 else reader(s, path, *e))
    groups = tables._groups(spark, tables.files_of(spark, str(tmp_path)))
    assert [(g.sep, g.fields, len(g.files)) for g in groups] == [(";", ["a", "b"], 3)] and fetched == []
    head = tmp_path / "h"
    head.mkdir()
    (head / "f.csv").write_text('\n,\n"a\n\nb",c\n' + '"x\n",1\n' * 3000)
    monkeypatch.setattr(tables._Group, "join_lines", lambda *_: None)
    assert [(g.sep, g.fields) for g in tables._groups(spark, tables.files_of(spark, str(head)))] == [(",", ["a\n\nb", "c"])] and max(fetched) <= 16


def test_values_are_worked_out_once(spark):
    """A filter on the type goes below the projection of the value; it must not repeat that for each rule."""
    tlds = spark.createDataFrame([("com",)], "tld string")
    rows = spark.createDataFrame([(1, "moc.a"), (2, None), (3, "dlrow")], "row_no long, raw string").select("row_no", F.reverse("raw").alias("value"))
    out = evidence.expand_targets(identify.classify_identifiers(rows, "value", tlds).filter("type = 'website'"), "value")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("reverse(") <= 6
    assert sorted((r.row_no, r.target) for r in out.filter("value is not null").collect()) == [(1, "https://a.com"), (1, "https://www.a.com"), (3, "https://world")]
