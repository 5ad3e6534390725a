"""Small tables of cases per rule."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from stockyard.functions import cells, identifiers as ids
from stockyard.operators import evidence, identify, labels, ladder, queries, spend
from stockyard.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def mapped(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def tlds(spark):
    return spark.createDataFrame([("com",), ("tv",), ("app",), ("news",), ("free",), ("dev",)], "tld string")


TYPES = {
    "example.com": "website", "https://x.y/z": "website", "512001": "ios_app", "١٢٣": "ios_app", "com.foo.bar": "android_app", "gizmo.android": "android_app",
    "lamp.reader.free": "website", "q.w.z.lamp.free": "android_app", "my-app.tool": "website", "com.example.app": "android_app", "startup.app": "website", "co.firm.app": "android_app",
    "app.startup.dev": "website", "io.quarry.dev": "website", "com.quarry.io": "website", "me.example.me": "android_app", "1.2.3.4": "website", "localhost": "website", "": "website", "  ": "website",
    "www.x": "website", "x:8080": "website", "COM.Foo.Bar": "android_app", "com.1foo": "website", "cnn.tv": "website", "tv.foo.bar": "android_app",
}


def test_types(spark, tlds):
    df = spark.createDataFrame([(v,) for v in TYPES], "v string")
    got = {r.v: r.type for r in identify.classify_identifiers(df, "v", tlds).collect()}
    assert got == TYPES


def test_cells(spark):
    got = mapped(spark, [" a\x1c", "NA", "54092.0", "1.5", " None ", "<NA>", None, "nan", " x", "5.00"], cells.clean)
    assert got == ["a", "", "54092", "1.5", "", "", "", "", "x", "5.00"]
    assert mapped(spark, ["123456", "12345", "a.co/x", "Notes", "com.a.b", "x y", None], ids.looks_processable) == [True, False, True, False, True, False, False]
    assert mapped(spark, ["54092", "B091", "com.x", "VIZIO.a", "tv.q", "G0001", "9wz", "a.roku", "xbox.a", "playstation.a", "zz", "", "Gx"], ids.ctv_platform) == ["Roku", "Fire TV", "Android TV", "Vizio", "Apple TV", "Samsung TV", "Xbox", "Roku", "Xbox", "PlayStation", "Unknown", "Unknown", "Unknown"]


def test_header_names():
    assert tables.header_names(["Domain", "Domain", "url"]) == ["Domain", "Domain.1", "url"]
    assert tables.header_names(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]
    assert tables.header_names(["Domain", "", "", ""]) == ["Domain", "Unnamed: 1", "Unnamed: 2", "Unnamed: 3"]


INPUTS = {
    "bom.csv": ("﻿Domain\r\na.com\r\nb.com\r\n", ["Domain"], 2),
    "dup.csv": ("Domain,Domain,url\na.com,x,y\n", ["Domain", "Domain.1", "url"], 1),
    "quoted.csv": ('Domain,Notes\na.com,"one, two\nthree"\nb.com,"say ""hi"""\n', ["Domain", "Notes"], 2),
    "semicolon.csv": ("Domain;Tier;Notes\na.com;1;x\nb.com;2;y\n", ["Domain", "Tier", "Notes"], 2),
    "tab.csv": ("Site\tTier\na.com\t1\nb.com\t2\n", ["Site", "Tier"], 2),
    "trailing.csv": ("Domain,,,\na.com,,,\n", ["Domain", "Unnamed: 1", "Unnamed: 2", "Unnamed: 3"], 1),
    "ragged.csv": ("app_id\n123456789\n\n,\n   \n987654321,extra\n", ["app_id", "Unnamed: 1"], 2),
}


@pytest.mark.parametrize("name", sorted(INPUTS))
def test_read_inventory(spark, tmp_path, name):
    text, columns, n = INPUTS[name]
    (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    df = tables.read_inventory(spark, str(tmp_path / name))
    assert df.columns == [*columns, "row_no"]
    assert df.count() == n
    if name == "quoted.csv":
        assert {r.Notes for r in df.collect()} == {"one, two\nthree", 'say "hi"'}
    if name == "trailing.csv":
        assert tables.drop_artifact_columns(df).columns == ["Domain", "row_no"]


WORK = {  # text, identifier column, work list of (identifier, type)
    "bom": ("\ufeffDomain\r\none.com\r\ntwo.com\r\n", "Domain", {("one.com", "website"), ("two.com", "website")}),
    "repeated_header": ("Domain,Domain,url\none.com,x,y\n", "Domain", {("one.com", "website")}),
    "copies_and_blanks": ("Domain,Notes\n one.com ,a\none.com,b\nNA,c\nN/A,d\ntwo.com,\n", "Domain", {("one.com", "website"), ("two.com", "website")}),
    "headerless": ("one.com\ntwo.com\none.com\n", "Domain", {("one.com", "website"), ("two.com", "website")}),
    "headerless_mixed": ("512001\none.com\ncom.maker.game\n", "Domain", {("512001", "ios_app"), ("one.com", "website"), ("com.maker.game", "android_app")}),
    "by_content": ("thing\none.com\ntwo.com\nthree.com\n512001\ncom.maker.game\n", "thing", {("one.com", "website"), ("two.com", "website"), ("three.com", "website"), ("512001", "ios_app"), ("com.maker.game", "android_app")}),
    "page_url": ("pageURL\none.com\n512001\ncom.maker.game\n", "pageURL", {("one.com", "website"), ("512001", "ios_app"), ("com.maker.game", "android_app")}),
    "ragged": ("app_id\n512001\n\n,\n987654\n", "app_id", {("512001", "ios_app"), ("987654", "ios_app")}),
    "quoted": ('Domain,Notes\none.com,"a, b"\ntwo.com,"line\nline"\n', "Domain", {("one.com", "website"), ("two.com", "website")}),
    "ranked": ("Rank,Where\n1,one.com\n2,two.com\n3,three.com\n", "Where", {("one.com", "website"), ("two.com", "website"), ("three.com", "website")}),
    "semicolons": ("Domain;Tier;Notes\none.com;1;x, y\ntwo.com;2;z\n", "Domain", {("one.com", "website"), ("two.com", "website")}),
    "tabs": ("Site\tTier\none.com\t1\ntwo.com\t2\n", "Site", {("one.com", "website"), ("two.com", "website")}),
    "trailing": ("Domain,,,\none.com,,,\ntwo.com,,,\n", "Domain", {("one.com", "website"), ("two.com", "website")}),
    "typed": ("Domain,Type\none.com,web\ntwo.com,website\ncom.maker.game,ios\ncom.maker.chat,android\ncom.maker.mail,google play\n", "Domain", {("one.com", "website"), ("two.com", "website"), ("com.maker.game", "ios_app"), ("com.maker.chat", "android_app"), ("com.maker.mail", "android_app")}),
}


@pytest.mark.parametrize("name", sorted(WORK))
def test_work_list_of_a_file(spark, tlds, tmp_path, name):
    text, column, expected = WORK[name]
    (tmp_path / "in.csv").write_text(text, encoding="utf-8", newline="")
    rows = identify.recover_headerless(tables.drop_artifact_columns(tables.read_inventory(spark, str(tmp_path / "in.csv"))), tlds)
    assert identify.resolve_input_column(rows) == column
    assert {(r.identifier, r.type) for r in identify.build_work_items(rows, tlds).collect()} == expected


def test_files_with_headers_of_their_own(spark, tmp_path):
    for name, text in {"a.csv": "Domain,Type\na.com,web\n", "b.csv": "Type,Domain\nweb,b.com\n", "c.csv": "Domain;Note\nc.com;x,y\n", "d d.csv": 'Domain,Note\nd.com,"two\nlines"\n', "e.csv": "\n", "f.csv": ""}.items():
        (tmp_path / name).write_text(text, newline="")
    got = {r.Domain: (r.Type, r.Note) for r in tables.read_inventory(spark, str(tmp_path)).collect()}
    assert got == {"a.com": ("web", None), "b.com": ("web", None), "c.com": (None, "x,y"), "d.com": (None, "two\nlines")}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("")
    assert tables.read_inventory(spark, str(tmp_path / "none")).columns == ["row_no"]


def test_any_number_of_cells(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Domain\n" + ",".join(f"c{i}" for i in range(40)) + '\nb.com,"1,2,3,4"\n')
    df = tables.read_inventory(spark, str(tmp_path / "x.csv"))
    assert len(df.columns) == 41
    rows = {r.Domain: r for r in df.collect()}
    assert rows["c0"]["Unnamed: 39"] == "c39" and rows["b.com"]["Unnamed: 1"] == "1,2,3,4"


def test_taxonomy_by_name(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("About this list\r\nUnique ID\tParent\tName\tTier 1\tTier 2\r\n1\t\tAutos\tAutos\t\r\n2\t1\tVans\tAutos\tVans\r\n\r\n", newline="")
    got = [tuple(r)[1:] for r in tables.read_taxonomy(spark, str(tmp_path / "t.tsv")).orderBy("line_no").collect()]
    assert got == [("Autos", "Autos", "", "", ""), ("Vans", "Autos", "Vans", "", "")]


def test_results_end_in_crlf(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x", y'), ("b", "two\nlines"), ("c", None), (" d ", "")], "A string, B string").coalesce(1)
    tables.write_results(df, str(tmp_path / "out"), ["A", "C", "B"])
    part = next((tmp_path / "out").glob("part*"))
    assert part.read_bytes() == b'A,C,B\r\na,,"say ""x"", y"\r\nb,,"two\nlines"\r\nc,,\r\n d ,,\r\n'
    back = {r.A: r.B for r in tables.read_results(spark, str(tmp_path / "out")).collect()}
    assert back == {"a": 'say "x", y', "b": "two\nlines", "c": "", " d ": ""}


PAGES = {  # markup: (title, description, content)
    "<p>a &nosuch; b &amp c &lt &#x41; &#150; &copy 1</p>": ("", "", "a &nosuch b & c < A – © 1"),
    "<head><![CDATA[ kept ]]><template><i>not</i></template></head><rt>no</rt><rp>(</rp>yes": ("", "", "kept yes"),
    "</p></div><div><div><span>open<table><tr><td>one<td>two</table><br></br></br>end": ("", "", "open one two end"),
    "<TITLE>a &lt;b&gt; <i>c</i></TITLE>x": ("a <b> <i>c</i>", "", "a <b> <i>c</i> x"),
    "<title></title><meta name=Description content=no><meta name=description><meta name=description content=late>x": ("", "", "x"),
    "<p/>after<textarea> keep &amp;  this </textarea><b>bold <i>both</b> plain?</i>": ("", "", "after keep &  this bold both plain?"),
    "x<![odd thing]>y<!-- c -->z<?pi?>w<!doctype html>v": ("", "", "x y z w v"),
    "tail <a href='x": ("", "", "tail"),
    "<noscript><p>no</p><title>t</title></noscript><title>T</title><style>p{}</style>": ("T", "", "T"),
    "a<br>b</br>c": ("", "", "a bc"),
    "<title>unclosed": ("unclosed", "", "unclosed"),
}


@pytest.mark.parametrize("markup", sorted(PAGES))
def test_markup(markup):
    assert evidence.parse(markup).site() == PAGES[markup]


def test_store_page_fallbacks():
    field = lambda markup: evidence.play_fields(evidence.parse("<title>N - Apps on Google Play</title>" + markup))
    got = field("<div class=a>Maker Inc</div>\n<div class='app-Category'><span>Tools</span></div><b itemprop=genre>Tools</b><div> 3.5 </div><template><i aria-label='12 reviews'></i></template><i aria-label='5K+ installs'></i>")
    assert (got["app_name"], got["developer"], got["category"], got["rating"], got["rating_count"], got["downloads"]) == ("N", "Maker Inc", "Tools", 3.5, 12, "5K+")
    assert field("<div>Maker<div class=category>x</div></div>")["developer"] == ""  # inside, not next to it
    assert field("<div>" + "m" * 100 + "</div><p>category</p>")["developer"] == ""
    assert field("<a href='/store/apps/dev?id=1'></a><div>M</div><p>category</p>")["developer"] == ""


@pytest.mark.parametrize("make", [lambda n: "<p>x</p><script>s</script><br>" * n, lambda n: "<div><span>" * n + "x", lambda n: "<div>" * n + "</b>" * n, lambda n: "<div>1<span>" * n, lambda n: "<p>" + "1" * n + " x" + "&" * n])
def test_time_grows_with_the_markup(make):
    import time

    def seconds(n):
        markup, best = make(n), 99.0
        for _ in range(3):
            began = time.perf_counter()
            page = evidence.parse(markup)
            page.site(), evidence.play_fields(page)
            best = min(best, time.perf_counter() - began)
        return best

    small = seconds(5_000)
    assert min(seconds(20_000) / max(small, 1e-3) for _ in range(2)) < 10


def test_budget_after_many_replies(spark):
    rows = spark.range(200).selectExpr("1 item", "id seq", "'bad' parse_error")
    got = [(r.budget, r.step, r.next_budget) for r in labels.retry_budget(rows).orderBy("seq").collect()]
    assert got == [(2000, "retry", 4000), (4000, "retry", 8000)] + [(8000, "terminal", None)] * 198


def frame(spark, columns, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"`{c}` string" for c in columns) + ", row_no long")
    return df.repartition(3)


def test_work_items(spark, tlds):
    df = frame(spark, ["Domain", "Type"], [("a.com", "web"), (" a.com ", "ios"), ("N/A", ""), ("512001.0", "iPhone"), ("com.x.y", "ctv"), ("com.z.y", "google play")])
    got = {r.identifier: (r.type, r.hinted) for r in identify.build_work_items(df, tlds).collect()}
    assert got == {"a.com": ("website", True), "512001": ("ios_app", True), "com.x.y": ("android_app", False), "com.z.y": ("android_app", True)}
    with pytest.raises(identify.NoInputColumn):
        identify.build_work_items(frame(spark, ["Notes"], [("hello",)]), tlds)
    ranked = frame(spark, ["Position", "Address"], [("1", "a.com"), ("2", "b.org"), ("3", "c.net")])
    assert identify.resolve_input_column(ranked) == "Address"


def test_headerless(spark, tlds):
    sites = frame(spark, ["first.com"], [("a.com",), ("b.com",), ("a.com",)])
    out = identify.recover_headerless(sites, tlds)
    assert sorted(r.Domain for r in out.collect()) == ["a.com", "b.com", "first.com"]
    assert identify.recover_headerless(sites, tlds, keep_duplicates=True).count() == 4
    assert identify.recover_headerless(frame(spark, ["identifier"], [("512001",), ("com.x.y",)]), tlds).columns == ["identifier", "row_no"]
    assert identify.recover_headerless(frame(spark, ["Domain"], [("a.com",)]), tlds).columns == ["Domain", "row_no"]


def test_ctv(spark):
    df = frame(spark, ["SSP", "Publisher", "App, Account or Network Name", "Bundle ID"], [("s", "p", "Fox", "B012"), ("s", "p", "Fox", "B012"), ("s", "p", "nan", "x"), ("s", "p", "Zed", "")])
    assert identify.is_ctv_list(df.columns) and not identify.is_ctv_list(["Domain", "Type"])
    got = sorted((r.app_name, r.bundle_id, r.platform, r.key) for r in identify.build_ctv_items(df).collect())
    assert got == [("Fox", "B012", "Fire TV", "B012")] * 2 + [("Zed", "", "", "Zed")]
    assert identify.distinct_ctv_apps(identify.build_ctv_items(df)).count() == 2
    bundles = frame(spark, ["App Bundle"], [("54092",), ("com.x",)])
    assert {r.platform for r in identify.build_ctv_items(bundles).collect()} == {"Roku", "Android TV"}


def test_pages(spark):
    html = "<html><title> A &amp; B </title><meta name=description content=' d '><script>var x='<p>'</script><body><p>One<b> two </b><noscript>no</noscript><br>three</body>"
    rows = [("u", html), ("v", None), ("w", "<title>a<b>c</b></title>x"), ("y", "<p>" + "ab " * 3000)]
    got = {r.url: r for r in evidence.extract_pages(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert (got["u"].title, got["u"].meta_description, got["u"].content) == ("A & B", "d", "A & B One two three")
    assert got["v"].content == "" and len(got["y"].content) == 4003 and got["y"].content.endswith("...")


def test_play(spark):
    full = '<h1 itemprop="name"><span>My App</span></h1><a href="/store/apps/dev?id=1"><span>Acme</span></a><a href="/store/apps/category/GAME">Games</a><div aria-label="Rated 4.5 stars out of five stars"></div><span aria-label="12,487 reviews"></span><p>10,000+ downloads</p><div data-g-id="description">Nice <b>game</b></div><p>Updated on Mar 3, 2026</p><p>Everyone</p>'
    rows = [("p1", full), ("p2", "Please try again " + full), ("p3", "<p>nothing</p>"), ("p4", "<title>T - Apps on Google Play</title>"), ("p5", None)]
    got = {r.package: r for r in evidence.extract_play_pages(spark.createDataFrame(rows, "package string, html string")).collect()}
    r = got["p1"]
    assert (r.app_name, r.developer, r.category, r.rating, r.rating_count, r.downloads, r.description, r.last_updated, r.content_rating) == ("My App", "Acme", "Games", 4.5, 12487, "10,000+", "Nice game", "Mar 3, 2026", "Everyone")
    assert not got["p2"].success and not got["p3"].success and got["p4"].app_name == "T" and not got["p5"].success
    text = evidence.store_evidence(spark.createDataFrame([r]), "android").first().evidence
    assert text.splitlines()[:4] == ["App Name: My App", "Developer: Acme", "Category: Games", "Rating: 4.5/5.0 (12,487 reviews)"]


def test_bodies(spark):
    rows = [("grün".encode("latin-1"), "text/html; charset=ISO-8859-1"), ("grün".encode(), None), (b"a\xffb", "text/html"), ("привет".encode("cp1251"), 'text/html; charset="windows-1251"'), (None, ""), (b"x", "charset=bogus")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, body binary, ct string")
    assert [r.text for r in evidence.decode_bodies(df, "body", "ct").orderBy("i").collect()] == ["grün", "grün", "ab", "привет", None, "x"]


def test_redirects(spark):
    rows = [("http://example.com", "https://www.example.com/x"), ("http://example.com", "http://home.example.com"), ("http://a.co.uk", "http://co.uk"), ("http://[2001:db8::1]/", "http://[2001:4860::1]/"), ("http://m.x.org:80/", "http://X.org/")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, final_url string")
    got = [r.redirect_problem for r in evidence.audit_redirects(df).orderBy("i").collect()]
    assert [bool(x) for x in got] == [False, False, True, True, False]


@pytest.mark.parametrize("log,expected", [
    ([("direct", "success", "")], "None Detected"), ([("research", "success", "")], "Unknown"), ([("direct", "error", "timeout")], "Unknown"), ([("direct", "error", "Received HTTP status 403")], "Moderate"),
    ([("deep", "error", "anti-bot")], "Aggressive"), ([("deep", "error", "anti-bot"), ("direct", "success", "")], "Aggressive"), ([("direct", "error", "anti-bot"), ("research", "success", "")], "Moderate"),
    ([("direct", "error", "anti-bot"), ("direct", "success", ""), ("direct", "success", "")], "None Detected"), ([("research", "error", "http status 429")], "Moderate"),
])
def test_bot_protection(spark, log, expected):
    df = spark.createDataFrame([(1, 1, i, *x) for i, x in enumerate(log)], "run_id int, item int, seq int, rung string, status string, error string")
    assert ladder.bot_protection(df).orderBy(F.desc("seq")).first().bot_protection == expected


def test_best_row(spark):
    df = spark.createDataFrame([("a", "Failed", 1), ("a", "Failed", 2), ("b", "Premium", 3), ("b", "Failed", 4), ("c", "Premium", 5), ("c", "Standard", 6)], "Domain string, Quality string, seq int")
    assert {r.Domain: r.seq for r in ladder.best_per_identifier(df).collect()} == {"a": 2, "b": 3, "c": 6}


def test_costs(spark):
    assert [None if x is None else float(x) for x in mapped(spark, ["0.5", "-1", "NaN", "true", "1e-3", None, "x", "inf"], spend.parse_cost)] == [0.5, None, None, None, 0.001, None, None, None]


def test_markdown(spark):
    text = "# Head\n**bold** __b__ *it* _u_ `c` [l](http://x)[12]\n\n\n\n  indented **"
    assert mapped(spark, [text], labels.strip_markdown) == ["Head\nbold b it u c l\n\nindented **"]
    df = spark.createDataFrame([("One two. Three four five six seven",), ("no end at all in here",), ("short",)], "research string")
    assert [r.summary for r in labels.summarize_research(df, n=15).collect()] == ["One two.", "no end at all i...", "short"]


def test_markdown_as_in_sql(spark):
    """The SQL of d10 on signs that SQL must not strip: lone ones, pairs across others, runs, and those that it uses itself."""
    import duckdb

    from stockyard.plans import registry

    texts = ["a +** b *it* c", "ends. * lone", "*a* *b * c** *d", "***x*** y *z*", "\ue000*a*\ue001 0 \ue0011*b", "x\r# no head\r  no indent\n# head\n \t in", "# # t [12] *[3]*[a](b)c*", "", "it`s ` *", "b" * 200 + ".\u00a0" + "c * d " * 40, "b" * 149 + ".\u3000" + "c" * 200, " the the * the _ __u__ the", "***\n\n\n\n* **"]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source text, lang text, text text, n_chars bigint)")
    con.execute("create table labels (doc_id bigint, quality int, toxic int)")
    con.executemany("insert into documents values (?, 's', 'en', ?, 1)", list(enumerate(texts)))
    rows = spark.createDataFrame(list(enumerate(texts)), "seq long, Description string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(registry, "spark_view", lambda *_: rows)
        got = sorted(tuple(r) for r in registry.QUERIES["d10_summarize_research"](spark, "").collect())
    assert got == sorted(con.execute(registry.SQL["d10_summarize_research"]).fetchall())
    assert dict(got)[0] == "Title\nBold\n\na ++ b it c" and dict(got)[1].endswith("ends. * lone")


def test_specs():
    ok = {"categories": [{"name": "A", "type": "choice", "question": "?", "options": ["x", "y"]}]}
    assert labels.decision_columns(ok)[:5] == ["Custom: A", "P(yes/choice): A", "Confidence: A", "P: A / x", "P: A / y"]
    for bad in ({}, {"categories": []}, {"categories": [{"name": "A", "type": "boolean", "question": "?"}] * 2}, {"categories": [{"name": "A", "type": "choice", "question": "?", "options": ["x", "X"]}]}, {"categories": [{"name": "A", "type": "other", "question": "?"}]}):
        with pytest.raises(labels.BadSpec):
            labels.decision_columns(bad)


def test_spec_change(spark):
    spec = {"categories": [{"name": "A", "type": "boolean", "question": "?"}]}
    rows = spark.createDataFrame([("a", labels.spec_hash(None))], "Domain string, spec_hash string")
    with pytest.raises(labels.SpecChanged):
        labels.append_results(rows, rows.select("Domain"), spec)
    assert labels.append_results(rows, rows.select("Domain"), None).count() == 2


def test_page_of_unknown_column(spark):
    df = spark.createDataFrame([(1, "a", "Premium")], "seq int, Domain string, Quality string")
    with pytest.raises(queries.UnknownColumn):
        queries.page(df, columns=["Nope"])
    assert queries.page(df, limit=0)[1] == 1


def test_entry_without_the_subpackage(tmp_path):
    """The entry module works when llm and the pipeline are gone."""
    import shutil

    shutil.copytree(os.path.join(ROOT, "stockyard"), tmp_path / "stockyard", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=100)
