"""Registered queries of the inventory operators, each over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.functions import identifiers as ids
from stockyard.operators import evidence, identify, labels, ladder, queries as result_queries, spend
from stockyard.plans.views import duck_sql, spark_view
from stockyard.shipping import results_dir
from stockyard.sources import tables
from stockyard.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-02-01 00:00:00'"
SPEC = {"categories": [{"name": "Kids", "type": "boolean", "question": "For kids?"}, {"name": "Colour", "type": "choice", "question": "Which?", "options": ["Red", "Blue"]}]}


def query(name: str, views: list[str], sql: str | None = None):
    """Register fn(spark, sf_dir, *views) and its SQL over the same views."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, sf_dir, *[spark_view(spark, sf_dir, v) for v in views])
        if sql:
            SQL[name] = duck_sql(views, sql)
        return fn

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared folder of the session."""
    return f"{results_dir(spark)}/{uuid.uuid4().hex}"


def hundredths(name: str) -> Column:
    """A decimal with two places as a whole number, so that both engines give the same."""
    return (F.col(name) * 100).cast("long").alias(name)


def _percent_sql(part: str, whole: str) -> str:
    """Hundredths of a percent, half up."""
    return f"CAST((2 * {part} * 10000 + {whole}) // (2 * {whole}) AS BIGINT)"


# What the SQL of several queries shares: cleaned values and their types.
_MISSING = "('', '#N/A', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
CLEAN_SQL = f"""
cleaned AS (SELECT row_no, source_file, CASE WHEN value IN {_MISSING} OR lower(trim(value)) IN ('nan', 'none', '<na>', 'nat') THEN ''
  WHEN regexp_matches(trim(value), '^[0-9]+\\.0$') THEN replace(trim(value), '.0', '') ELSE trim(value) END AS v FROM identifiers),
parts AS (SELECT *, lower(v) AS low, regexp_extract(lower(v), '^({"|".join(ids.PACKAGE_FIRST)})\\.', 1) AS fst, regexp_extract(lower(v), '\\.({"|".join(ids.AMBIGUOUS)})$', 1) AS amb,
  regexp_extract(lower(v), '([^.]*)$', 1) AS leaf, regexp_matches(lower(v), '^[a-z][a-z0-9_]*(\\.[a-z][a-z0-9_]*)+$') AS pkg FROM cleaned),
typed AS (SELECT row_no, source_file, v, CASE
  WHEN v = '' OR v LIKE '%-%' OR low LIKE 'www.%' OR low LIKE 'localhost%' OR regexp_matches(v, '[/:?#&=@!$''()*+,;%]') OR regexp_matches(v, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') THEN 'website'
  WHEN regexp_matches(low, '\\.({"|".join((*ids.PRIMARY, *ids.COUNTRY, *ids.SEMI_PRIMARY))})$') THEN 'website'
  WHEN amb <> '' AND (fst = '' OR (fst NOT IN ('com', 'org', 'net') AND NOT (amb IN ('app', 'tech', 'ai') AND fst NOT IN ('app', 'dev')) AND fst <> amb)) THEN 'website'
  WHEN regexp_matches(v, '^[0-9]+$') THEN 'ios_app'
  WHEN pkg AND (fst <> '' OR leaf NOT IN (SELECT tld FROM tlds) OR length(low) - length(replace(low, '.', '')) >= 4) THEN 'android_app' ELSE 'website' END AS type FROM parts)"""


def _after(body: str) -> str:
    """Further common table expressions, and the query."""
    return "," + CLEAN_SQL.lstrip("\n") + "\n" + body


@query("i1_classify_identifiers", ["identifiers", "tlds"], _after("SELECT row_no, source_file, v, type FROM typed"))
def _(spark, sf, rows, tlds):
    rows = tables.clean_cells(rows, ["value"]).withColumnRenamed("value", "v")
    return identify.classify_identifiers(rows, "v", tlds).select("row_no", "source_file", "v", "type")


@query("i2_score_columns", ["ctv_list"], r"""
, long AS (SELECT row_no, 'app_name' AS "column", app_name AS v FROM ctv_list UNION ALL SELECT row_no, 'bundle_id', bundle_id FROM ctv_list UNION ALL SELECT row_no, 'ssp', ssp FROM ctv_list UNION ALL SELECT row_no, 'publisher', publisher FROM ctv_list),
kept AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_no) AS rn FROM long WHERE v NOT IN ('', 'nan'))
SELECT "column", count(*) AS sampled, count(*) FILTER (WHERE CASE WHEN regexp_matches(v, '^[0-9]+$') THEN length(v) >= 6 ELSE
  regexp_matches(v, '^(https?://)?[A-Za-z0-9][A-Za-z0-9._-]*\.[A-Za-z]{2,}([/:?#].*)?$') OR regexp_matches(v, '^(com|tv)\.[a-z][a-z0-9_]*$') END) AS hits FROM kept WHERE rn <= 200 GROUP BY "column" """)
def _(spark, sf, rows):
    return identify.score_columns(rows).select("column", "sampled", "hits")


@query("i3_work_items", ["identifiers", "tlds"], _after("SELECT min(row_no) AS row_no, v AS identifier, any_value(type) AS type FROM typed WHERE v <> '' GROUP BY v"))
def _(spark, sf, rows, tlds):
    return identify.build_work_items(rows.drop("source_file"), tlds, "value").select("row_no", "identifier", "type")


@query("i4_trusted_types", ["identifiers", "tlds"], _after("""
SELECT source_file, count(*) FILTER (WHERE t = 'website') AS websites, count(*) FILTER (WHERE t = 'ios_app') AS ios, count(*) FILTER (WHERE t = 'android_app') AS android, count(*) AS total
FROM (SELECT source_file, CASE row_no % 4 WHEN 0 THEN 'ios_app' WHEN 1 THEN 'android_app' ELSE type END AS t FROM typed WHERE v <> '') x GROUP BY source_file"""))
def _(spark, sf, rows, tlds):
    rows = rows.withColumn("Type", F.expr("CASE row_no % 4 WHEN 0 THEN ' iPhone ' WHEN 1 THEN 'google play' WHEN 2 THEN 'ctv' ELSE '' END"))
    column = identify.find_type_column(rows, "value")
    return identify.breakdown(rows, "value", tlds, type_col=column)


@query("i5_profile_batch", ["identifiers", "tlds"], _after("""
SELECT k.type, count(t.type) AS n, count(t.type) >= 0.9 * (SELECT count(*) FROM typed) AS dominant FROM (VALUES ('ios_app'), ('android_app'), ('website'), ('ctv_app')) AS k(type) LEFT JOIN typed t ON t.type = k.type GROUP BY k.type"""))
def _(spark, sf, rows, tlds):
    rows = tables.clean_cells(rows, ["value"])
    return identify.profile_batch(identify.classify_identifiers(rows, "value", tlds)).select("type", "n", "dominant")


_BREAKDOWN = "SELECT source_file, count(*) FILTER (WHERE type = 'website') AS websites, count(*) FILTER (WHERE type = 'ios_app') AS ios, count(*) FILTER (WHERE type = 'android_app') AS android, count(*) AS total FROM typed WHERE v <> '' GROUP BY source_file"


@query("i6_breakdown", ["identifiers", "tlds"], _after(_BREAKDOWN))
def _(spark, sf, rows, tlds):
    return identify.breakdown(rows, "value", tlds)


@query("i7_breakdown_shares", ["identifiers", "tlds"], _after(f"""
, b AS ({_BREAKDOWN}), u AS (SELECT source_file, total, 'websites' AS kind, websites AS n FROM b UNION ALL SELECT source_file, total, 'ios', ios FROM b UNION ALL SELECT source_file, total, 'android', android FROM b)
SELECT source_file, kind, n, {_percent_sql("n", "total")} AS percent, concat(CAST(n AS STRING), ' ', kind) AS label FROM u WHERE n > 0""".lstrip("\n")))
def _(spark, sf, rows, tlds):
    return identify.breakdown_shares(identify.breakdown(rows, "value", tlds)).select("source_file", "kind", "n", hundredths("percent"), "label")


@query("i6_ctv_breakdown", ["ctv_list"], "SELECT ssp, count(*) AS ctv, count(*) AS total FROM ctv_list WHERE bundle_id <> '' GROUP BY ssp")
def _(spark, sf, rows):
    return identify.ctv_breakdown(rows, by=("ssp",))


PLATFORM_SQL = """CASE WHEN b = '' THEN 'Unknown' WHEN regexp_matches(b, '^[0-9]+$') THEN 'Roku' WHEN upper(b) LIKE 'B0%' THEN 'Fire TV' WHEN lower(b) LIKE 'com.%' THEN 'Android TV' WHEN lower(b) LIKE 'vizio.%' THEN 'Vizio'
  WHEN lower(b) LIKE 'tv.%' THEN 'Apple TV' WHEN regexp_matches(upper(b), '^G[0-9]+$') THEN 'Samsung TV' WHEN regexp_matches(b, '^9[A-Za-z0-9]*$') THEN 'Xbox' WHEN lower(b) LIKE '%.roku' THEN 'Roku' ELSE 'Unknown' END"""


@query("i8_ctv_items", ["ctv_list"], f"""
SELECT row_no, app_name, bundle_id, ssp, publisher, CASE WHEN p = 'Unknown' THEN '' ELSE p END AS platform, CASE WHEN bundle_id <> '' THEN bundle_id ELSE app_name END AS key
FROM (SELECT *, {PLATFORM_SQL.replace("b ", "bundle_id ").replace("(b,", "(bundle_id,").replace("(b)", "(bundle_id)")} AS p FROM ctv_list) x WHERE app_name <> 'nan'""")
def _(spark, sf, rows):
    assert identify.is_ctv_list(rows.columns)
    return identify.build_ctv_items(rows).select("row_no", "app_name", "bundle_id", "ssp", "publisher", "platform", "key")


@query("i9_platform_mix", ["ctv_list"], f"SELECT {PLATFORM_SQL.replace('b ', 'bundle_id ').replace('(b,', '(bundle_id,').replace('(b)', '(bundle_id)')} AS platform, count(*) AS n FROM ctv_list GROUP BY 1")
def _(spark, sf, rows):
    return identify.platform_mix(rows, "bundle_id")


@query("i10_distinct_ctv_apps", ["ctv_list"], "SELECT app_name, min(row_no) AS row_no, arg_min(bundle_id, row_no) AS bundle_id FROM ctv_list WHERE app_name <> 'nan' GROUP BY app_name")
def _(spark, sf, rows):
    return identify.distinct_ctv_apps(rows).select("app_name", "row_no", "bundle_id")


@query("i11_route_by_type", ["identifiers", "tlds"], _after("SELECT min(row_no) AS row_no, v AS identifier FROM typed WHERE v <> '' AND type = 'android_app' GROUP BY v"))
def _(spark, sf, rows, tlds):
    items = identify.build_work_items(rows.drop("source_file"), tlds, "value")
    return identify.items_of_type(items, ids.ANDROID).select("row_no", "identifier")


# Sources, cleaning, sinks: written to the shared folder and read back.


@query("s1_inventory_round_trip", ["identifiers"], "SELECT source_file, count(*) AS n, count(DISTINCT value) AS kinds FROM identifiers GROUP BY source_file")
def _(spark, sf, rows):
    path = scratch(spark)
    rows.select(F.col("value").alias("pageURL"), F.col("source_file").alias("Domain"), F.col("value").alias("Domain,2")).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = tables.read_inventory(spark, path)
    return back.groupBy(F.col("Domain").alias("source_file")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pageURL").alias("kinds"))


@query("s1_quoted_files", ["results"], """SELECT seq, "Domain", t AS text, CASE seq % 2 WHEN 0 THEN 'first' ELSE 'second' END AS file
FROM (SELECT *, replace(replace(coalesce("Description", ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM results) x""")
def _(spark, sf, rows):
    """Texts with quotes, commas and line breaks in two files whose headers differ, read in the order given."""
    files = []
    for half, names in ((0, ["seq", "Domain", "text"]), (1, ["text", "seq", "Domain"])):
        files.append(scratch(spark))
        text = rows.filter(F.col("seq") % 2 == half).orderBy("seq").select(F.col("seq").cast("string").alias("seq"), "Domain", F.col("Description").alias("text"))
        text.select(*names).write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(files[-1])
    back = tables.read_inventory(spark, files).withColumn("seq", F.col("seq").try_cast("long"))
    second = back.filter("seq % 2 = 1").agg(F.min("row_no")).first()[0]
    return back.select("seq", "Domain", "text", F.when(F.col("row_no") < second, "first").otherwise("second").alias("file"))


@query("s2_null_missing", ["identifiers"], "SELECT source_file, count(*) AS n, count(*) FILTER (WHERE value = 'N/A') AS missing FROM identifiers GROUP BY source_file")
def _(spark, sf, rows):
    return tables.null_missing(rows).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("missing"))


@query("s3_clean_cells", ["identifiers", "tlds"], _after("SELECT row_no, v FROM cleaned"))
def _(spark, sf, rows, tlds):
    return tables.clean_cells(rows, ["value"]).select("row_no", F.col("value").alias("v"))


@query("s4_drop_artifact_columns", ["ctv_list"], """SELECT row_no, app_name, CASE WHEN row_no % 3 = 0 THEN 'x' ELSE '' END AS "Unnamed: 8" FROM ctv_list""")
def _(spark, sf, rows):
    rows = rows.select("row_no", "app_name", F.lit(" ").alias("Unnamed: 7"), F.when(F.col("row_no") % 3 == 0, "x").otherwise("").alias("Unnamed: 8"), F.lit(None).cast("string").alias(" "))
    return tables.drop_artifact_columns(rows)


@query("s5_recover_headerless", ["identifiers", "tlds"], "SELECT trim(value) AS \"Domain\", count(*) AS n FROM (SELECT value FROM identifiers WHERE value NOT IN ('', 'N/A') UNION ALL SELECT 'first.example.com') x GROUP BY trim(value)")
def _(spark, sf, rows, tlds):
    one = rows.select("row_no", F.col("value").alias("first.example.com"))
    return identify.recover_headerless(one, tlds, keep_duplicates=True).groupBy("Domain").agg(F.count(F.lit(1)).alias("n"))


@query("s6_normalize_items", ["identifiers"], "SELECT min(row_no) AS row_no, arg_min(trim(value), row_no) AS item FROM identifiers WHERE trim(value) <> '' GROUP BY lower(trim(value))")
def _(spark, sf, rows):
    return tables.normalize_items(rows, "value")[0]


_RESULT_ROWS = 'SELECT "Domain", "Quality", count(*) AS n, sum("Content_Length") AS chars, count(*) FILTER (WHERE "Bot_Protection" = \'\') AS blank FROM (SELECT *, \'\' AS "Bot_Protection" FROM results) x GROUP BY ALL'


@query("s7_s8_results_round_trip", ["results"], 'SELECT "Domain", "Quality", count(*) AS n, CAST(sum("Content_Length") AS BIGINT) AS chars, count(*) AS blank FROM results GROUP BY "Domain", "Quality"')
def _(spark, sf, rows):
    """Two files, the second with fewer columns and in another order."""
    files = [scratch(spark), scratch(spark)]
    tables.write_results(rows.filter("seq % 2 = 0"), files[0], list(labels.RESULT_COLUMNS))
    tables.write_results(rows.filter("seq % 2 = 1"), files[1], ["Content_Length", "Description", "Quality", "Domain"])
    back = tables.read_results(spark, files)
    return back.groupBy("Domain", "Quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("Content_Length").cast("long")).alias("chars"), F.count_if(F.col("Bot_Protection") == "").alias("blank"))


@query("s9_migrate_results", ["results"], 'SELECT "Domain", "Quality" AS "Decision_Status", \'new\' AS "Decision_Model", \'\' AS "Cost_USD" FROM results')
def _(spark, sf, rows):
    old = rows.select("Domain", F.col("Quality").alias("TypeSafe_Status"), F.lit("old").alias("TypeSafe_Model"), F.lit("new").alias("Decision_Model"), "Description")
    return tables.migrate_results(old, ["Domain", "Decision_Status", "Decision_Model", "Cost_USD"])


@query("s10_export_results", ["results"], 'SELECT "Domain", "Quality" FROM results')
def _(spark, sf, rows):
    return tables.export_results(rows.select("Domain", "Quality", F.lit("1").alias("Cost_USD")))


@query("s11_attempt_log", ["attempts"], "SELECT domain, count(*) AS n, count(*) FILTER (WHERE ok) AS ok, CAST(sum(code) AS BIGINT) AS codes FROM (SELECT CAST(item AS STRING) AS domain, status = 'success' AS ok, CASE WHEN error LIKE '%403' THEN 403 ELSE 200 END AS code FROM attempts) x GROUP BY domain")
def _(spark, sf, rows):
    path = scratch(spark)
    log = rows.select(F.col("ts").cast("string").alias("timestamp"), F.col("item").cast("string").alias("domain"), (F.col("status") == "success").alias("ok"), F.when(F.col("error").endswith("403"), 403).otherwise(200).alias("status_code"), "error", F.col("seconds").cast("double").alias("elapsed_sec"), F.lit(0).alias("retries_used"))
    tables.write_attempts(log, path)
    return tables.read_attempts(spark, path).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok"), F.sum("status_code").alias("codes"))


@query("s11_attempt_stream", ["attempts"], "SELECT CAST(item AS STRING) AS domain, count(*) AS n FROM attempts GROUP BY item")
def _(spark, sf, rows):
    log, out, marks = scratch(spark), scratch(spark), scratch(spark)
    tables.write_attempts(rows.select(F.col("ts").cast("string").alias("timestamp"), F.col("item").cast("string").alias("domain"), F.lit(True).alias("ok"), F.lit(200).alias("status_code"), "error", F.col("seconds").cast("double").alias("elapsed_sec"), F.lit(0).alias("retries_used")), log)
    tables.read_attempts(spark, log, stream=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("s12_progress_documents", ["attempts"], "SELECT run_id, CAST(item AS STRING) AS item, arg_max(status, seq) AS status, arg_max(error, seq) AS error, 9 AS total_domains, arg_max(rung, seq) AS mode FROM attempts GROUP BY run_id, item")
def _(spark, sf, rows):
    entry = F.struct(F.col("item").cast("string").alias("k"), F.struct("status", F.col("ts").cast("string").alias("timestamp"), F.col("seconds").cast("double").alias("processing_time"), "error", F.col("rung").alias("mode")).alias("v"))
    doc = ladder.latest_state(rows).withColumn("part", F.expr("item div 1000")).groupBy("run_id", "part").agg(F.map_from_entries(F.collect_list(entry)).alias("processed_domains"))
    path = scratch(spark)
    doc.select("run_id", F.to_json(F.struct(F.lit(9).alias("total_domains"), "processed_domains", F.lit("skip").alias("spend"))).alias("value")).write.partitionBy("run_id").text(path)
    return tables.read_progress(spark, path, whole=False).select("run_id", "item", "status", "error", F.col("total_domains").cast("int").alias("total_domains"), "mode")


@query("s12_progress_files", ["attempts"], "SELECT run_id, CAST(item AS STRING) AS item, arg_max(status, seq) AS status, concat(arg_max(error, seq), ' }{\" ') AS error, CAST(item % 5 AS INT) AS total_domains FROM attempts GROUP BY run_id, item")
def _(spark, sf, rows):
    """Documents of their own files, with braces and quotes in their texts, walked in splits."""
    entry = F.struct(F.col("item").cast("string").alias("k"), F.struct("status", F.col("ts").cast("string").alias("timestamp"), F.col("seconds").cast("double").alias("processing_time"), F.concat("error", F.lit(' }{" ')).alias("error"), F.col("rung").alias("mode")).alias("v"))
    doc = ladder.latest_state(rows).withColumn("part", F.expr("item % 5")).groupBy("run_id", "part").agg(F.map_from_entries(F.collect_list(entry)).alias("processed_domains"))
    text = doc.select("run_id", "part", F.to_json(F.struct(F.struct(F.lit(1).alias("usd")).alias("spend"), "processed_domains", F.col("part").alias("total_domains"))).alias("value"))
    path = scratch(spark)
    text.repartition("run_id", "part").write.partitionBy("run_id", "part").text(path)
    return tables.read_progress(spark, path).select("run_id", "item", "status", "error", F.col("total_domains").cast("int").alias("total_domains"))


@query("s13_reference_tables", ["catalog_taxonomy"], "SELECT name, tier1, tier2, tier3, tier4 FROM catalog_taxonomy")
def _(spark, sf, rows):
    path, parts = scratch(spark), 4
    body = rows.select(F.pmod(F.col("line_no"), F.lit(parts)).alias("k"), F.lit(2).alias("o"), F.concat_ws("\t", F.lit("9"), "tier1", "name", "tier2", "tier4", "tier3").alias("value"))
    head = spark.range(2 * parts).select((F.col("id") % parts).alias("k"), (F.col("id") >= parts).cast("int").alias("o"), F.when(F.col("id") < parts, "About").otherwise("Unique ID\tTier 1\tName\tTier 2\tTier 4\tTier 3").alias("value"))
    head.unionByName(body).repartition(parts, "k").sortWithinPartitions("k", "o").select("k", "value").write.partitionBy("k").text(path)
    return tables.read_taxonomy(spark, path).drop("line_no")


@query("s13_top_level_domains", ["catalog_taxonomy"], "SELECT DISTINCT lower(tier1) AS tld FROM catalog_taxonomy")
def _(spark, sf, rows):
    path = scratch(spark)
    rows.select(F.explode(F.array(F.concat(F.lit("  "), F.upper("tier1"), F.lit(" ")), F.concat(F.lit("# "), "name"), F.lit(""))).alias("value")).write.text(path)
    return tables.read_tlds(spark, path)


# Evidence.


def _pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


@query("e1_extract_pages", [])
def _(spark, sf):
    return evidence.extract_pages(_pages(spark, sf))


@query("e2_decode_bodies", [], "SELECT page_id, md5(html) AS digest FROM pages")
def _(spark, sf):
    body = F.when(F.col("page_id") % 2 == 0, F.encode("html", "UTF-8")).otherwise(F.encode("html", "UTF-16LE"))
    kind = F.when(F.col("page_id") % 2 == 0, "text/html").otherwise("text/html; charset=utf-16le")
    rows = _pages(spark, sf).select("page_id", body.alias("body"), kind.alias("content_type"))
    return evidence.decode_bodies(rows, "body", "content_type").select("page_id", F.md5("text").alias("digest"))


_PROBLEM = "CASE WHEN NOT success THEN CASE WHEN error <> '' THEN error ELSE 'Scraper reported failure' END WHEN status_code <> 0 AND (status_code < 200 OR status_code >= 400) THEN concat('Received HTTP status ', CAST(status_code AS STRING)) WHEN trim(content) = '' THEN 'Scraper returned empty content' WHEN length(content) < 500 THEN concat('Scraped content too short (', CAST(length(content) AS STRING), ' chars < 500)') "
_PROBLEM += " ".join(f"WHEN contains(lower(substring(content, 1, 512)), '{p}') THEN 'Potential block page detected (''{p}'')'" for p in evidence.BLOCK_PHRASES) + " ELSE '' END"
_ANTIBOT = "(" + " OR ".join(f"contains(lower(%s), '{m}')" for m in evidence.ANTIBOT) + ")"


def _antibot(c: str) -> str:
    return _ANTIBOT.replace("%s", c)


@query("e3_validate_content", ["fetches"], f"SELECT item, problem, {_antibot('problem')} AS antibot FROM (SELECT item, {_PROBLEM} AS problem FROM fetches) x")
def _(spark, sf, rows):
    return evidence.validate_content(rows).select("item", "problem", "antibot")


@query("e4_audit_redirects", ["fetches"], """SELECT item, CASE item % 4 WHEN 1 THEN 'URL redirected to different host: other.co.uk' WHEN 3 THEN 'URL redirected to different host: co.uk' ELSE '' END AS redirect_problem FROM fetches""")
def _(spark, sf, rows):
    return evidence.audit_redirects(rows).select("item", "redirect_problem")


@query("e5_expand_targets", ["identifiers", "tlds"], _after(r"""
, w AS (SELECT row_no, v FROM typed WHERE type = 'website' AND v <> '')
SELECT row_no, 0 AS attempt, concat('https://', v) AS target FROM w UNION ALL SELECT row_no, 1, concat('https://www.', v) FROM w WHERE v NOT LIKE 'www.%' AND length(v) - length(replace(v, '.', '')) = 1""".lstrip("\n")))
def _(spark, sf, rows, tlds):
    rows = identify.classify_identifiers(tables.clean_cells(rows, ["value"]), "value", tlds)
    return evidence.expand_targets(rows.filter("type = 'website' and value <> ''"), "value").select("row_no", "attempt", "target")


@query("e6_extract_play_pages", [])
def _(spark, sf):
    head = F.when(F.col("page_id") % 5 == 0, F.lit("<p>Unusual traffic</p>")).otherwise(F.lit('<a href="/store/apps/dev?id=1"><span>Dev</span></a><div aria-label="Rated 4.5 stars out of five stars"></div>'))
    rows = _pages(spark, sf).select(F.concat(F.lit("com.p"), F.col("page_id").cast("string")).alias("package"), F.concat(head, "html").alias("html"))
    return evidence.extract_play_pages(rows)


def _escaped(c: str) -> Column:
    return F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


_BODY = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"


@query("e1_extract_documents", [], f"""
SELECT CAST(doc_id AS STRING) AS url, concat('A & B ', lang) AS title, source AS meta_description, CASE WHEN length(c) > 4000 THEN concat(substring(c, 1, 4000), '...') ELSE c END AS content, CASE WHEN length(c) > 4000 THEN 4003 ELSE length(c) END AS content_length
FROM (SELECT *, concat('A & B ', lang, ' Head', CASE WHEN b <> '' THEN concat(' ', b) ELSE '' END, ' end') AS c FROM (SELECT *, {_BODY} AS b FROM documents) x) y""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    head = F.concat(F.lit("<html><head><title>A &amp; B "), "lang", F.lit("</title><meta name='description' content='"), "source", F.lit("'><script>var x = '<p>';</script></head><body><h1>Head</h1><template>no</template><div>"))
    pages = docs.select(F.col("doc_id").cast("string").alias("url"), F.concat(head, _escaped("text"), F.lit("</div><br><p>end")).alias("html"))
    return evidence.extract_pages(pages)


@query("e6_extract_play_documents", [], f"""
SELECT concat('com.d', CAST(doc_id AS STRING)) AS package, true AS success, '' AS error, concat('App ', CAST(doc_id AS STRING)) AS app_name, concat('Dev ', source) AS developer, 'Tools' AS category, 4.5 AS rating, 12000 + doc_id AS rating_count,
  '1,000+' AS downloads, {_BODY} AS description, 'Mar 3, 2024' AS last_updated, 'Teen' AS content_rating FROM documents""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = F.col("doc_id").cast("string")
    parts = ["<h1 itemprop='name'><span>App ", key, "</span></h1><div> 1,000+ downloads</div><div>Updated on Mar 3, 2024</div><div>Teen</div><div>Dev ", F.col("source"), "</div><div class='Category'></div><b itemprop=genre>Tools</b><i aria-label='Rated 4.5 stars'></i><i aria-label='", (F.col("doc_id") + 12000).cast("string"), " reviews'></i><div data-g-id='description'>", _escaped("text"), "</div>"]
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return evidence.extract_play_pages(docs.select(F.concat(F.lit("com.d"), key).alias("package"), html.alias("html")))


@query("e8_android_evidence", [], f"""
SELECT concat('com.d', CAST(doc_id AS STRING)) AS package, concat('App Name: A', chr(10), 'Developer: ', source, chr(10), 'Category: Tools', chr(10), 'Rating: 4.5/5.0', chr(10), 'Downloads: 5K+', CASE WHEN b <> '' THEN concat(chr(10), chr(10), 'Description:', chr(10), CASE WHEN length(b) > 2000 THEN concat(substring(b, 1, 2000), '...') ELSE b END) ELSE '' END) AS evidence
FROM (SELECT *, {_BODY} AS b FROM documents) x""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    rows = docs.select(F.concat(F.lit("com.d"), F.col("doc_id").cast("string")).alias("package"), F.lit("A").alias("app_name"), F.col("source").alias("developer"), F.lit("Tools").alias("category"), F.lit(4.5).alias("rating"), F.lit(0).alias("rating_count"), F.lit("5K+").alias("downloads"), F.lit("").alias("content_rating"), body.alias("description"))
    return evidence.store_evidence(rows, "android").select("package", "evidence")


@query("e7_decode_ios_lookup", ["store_lookups"], """
SELECT l.app_id, ok AS success, CASE WHEN ok THEN '' ELSE 'App not found in App Store' END AS error, '' AS bundle_id, CASE WHEN ok THEN p.p_name ELSE '' END AS app_name, CASE WHEN ok THEN p.p_brand ELSE '' END AS developer,
  CASE WHEN ok THEN 'Games' ELSE '' END AS primary_genre, CASE WHEN ok THEN concat('Games|', p.p_type) ELSE '' END AS genres, CASE WHEN ok THEN 4.5 ELSE 0.0 END AS rating, CASE WHEN ok THEN 4.5 ELSE 0.0 END AS raw_rating,
  CASE WHEN ok THEN l.app_id * 37 ELSE 0 END AS rating_count, '' AS description, '' AS content_rating, CASE WHEN ok THEN CAST(p.p_size AS DOUBLE) ELSE 0.0 END AS price, 'USD' AS currency, '' AS version, '' AS release_date, '' AS last_updated,
  '' AS app_store_url, '' AS icon_url, CASE WHEN ok THEN CAST(l.app_id AS DOUBLE) ELSE 0.0 END AS file_size_mb, '' AS supported_devices
FROM (SELECT *, app_id % 4 <> 0 AS ok FROM store_lookups) l JOIN part p ON p.p_partkey = l.app_id""")
def _(spark, sf, rows):
    return evidence.decode_ios_lookup(rows).withColumns({c: F.array_join(c, "|") for c in ("genres", "supported_devices")})


@query("e8_store_evidence", ["store_lookups"], """
SELECT p_partkey AS app_id, concat('App Name: ', p_name, chr(10), 'Developer: ', p_brand, chr(10), 'Primary Category: Games', chr(10), 'All Categories: Games, ', p_type, chr(10), 'Rating: 4.5/5.0 (', format('{:,}', p_partkey * 37), ' reviews)') AS evidence FROM part WHERE p_partkey % 4 <> 0""")
def _(spark, sf, rows):
    found = evidence.decode_ios_lookup(rows).filter("success")
    return evidence.store_evidence(found, "ios").select("app_id", "evidence")


@query("e9_fetch_stats", ["attempts"], f"""SELECT run_id, rung, requests, successes, requests - successes AS errors, {_percent_sql("successes", "requests")} AS success_percent
FROM (SELECT run_id, rung, count(*) AS requests, count(*) FILTER (WHERE status = 'success') AS successes FROM attempts GROUP BY run_id, rung) x""")
def _(spark, sf, rows):
    return evidence.fetch_stats(rows, ["run_id", "rung"]).withColumn("success_percent", hundredths("success_percent"))


# The attempt ladder. One run's log is what routing looks at: the last attempt over all runs of an item.

STATE_SQL = ", s AS (SELECT run_id, item, arg_max(type, seq) AS type, max(seq) AS seq, arg_max(ts, seq) AS ts, arg_max(rung, seq) AS rung, arg_max(status, seq) AS status, arg_max(error, seq) AS error, min(seq) AS first_seq FROM attempts GROUP BY run_id, item)"


def _state(attempts: DataFrame) -> DataFrame:
    return ladder.latest_state(attempts)


@query("l1_latest_state", ["attempts"], STATE_SQL + " SELECT run_id, item, seq, rung, status, error, first_seq FROM s")
def _(spark, sf, attempts):
    return _state(attempts).select("run_id", "item", "seq", "rung", "status", "error", "first_seq")


@query("l2_pending_items", ["work_items", "attempts"], STATE_SQL + " SELECT row_no, item, type FROM work_items w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.item = w.item AND s.status = 'success')")
def _(spark, sf, items, attempts):
    return ladder.pending_items(items, _state(attempts))


@query("l3_first_pass", ["work_items", "attempts"], STATE_SQL + " SELECT row_no, item, type FROM work_items w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.item = w.item AND s.status IN ('success', 'retry_pending'))")
def _(spark, sf, items, attempts):
    return ladder.first_pass(items, _state(attempts))


@query("l4_retry_set", ["work_items", "attempts"], STATE_SQL + " SELECT row_no, item, type FROM work_items w WHERE type = 'website' AND EXISTS (SELECT 1 FROM s WHERE s.item = w.item AND s.status IN ('error', 'retry_pending'))")
def _(spark, sf, items, attempts):
    return ladder.retry_set(items, _state(attempts))


@query("l5_deep_set", ["work_items", "attempts"], STATE_SQL + f" SELECT row_no, w.item, w.type, CASE WHEN {_antibot('s.error')} THEN 'blocked' ELSE 'deep' END AS route FROM work_items w JOIN s ON s.item = w.item WHERE w.type = 'website' AND (s.status = 'error' OR (s.status = 'retry_pending' AND s.rung <> 'deep'))")
def _(spark, sf, items, attempts):
    return ladder.deep_set(items, _state(attempts)).select("row_no", "item", "type", "route")


@query("l6_next_rung", ["work_items", "attempts"], STATE_SQL + f""" SELECT row_no, w.item, w.type, CASE WHEN s.status = 'success' THEN 'done' WHEN s.status IS NULL OR (w.type <> 'website' AND s.status = 'retry_pending') THEN 'first_pass'
  WHEN w.type = 'website' AND NOT (s.status = 'retry_pending' AND s.rung = 'deep') AND NOT {_antibot('s.error')} AND s.rung <> 'research' THEN 'deep' WHEN w.type = 'website' AND NOT (s.status = 'error' AND s.rung = 'research') THEN 'research' ELSE 'failed' END AS route
FROM work_items w LEFT JOIN s ON s.item = w.item""")
def _(spark, sf, items, attempts):
    return ladder.next_rung(items, _state(attempts)).select("row_no", "item", "type", "route")


@query("l7_finalize_pending", ["attempts"], STATE_SQL + " SELECT run_id, item, CASE WHEN status = 'retry_pending' THEN 'error' ELSE status END AS status, status = 'retry_pending' AS finalized FROM s")
def _(spark, sf, attempts):
    return ladder.finalize_pending(_state(attempts)).select("run_id", "item", "status", "finalized")


@query("l8_reset_failed", ["attempts"], STATE_SQL + " SELECT run_id, item, status FROM s WHERE status <> 'error'")
def _(spark, sf, attempts):
    return ladder.reset_failed(_state(attempts)).select("run_id", "item", "status")


@query("l9_bot_protection", ["attempts"], f"""
, p AS (SELECT *, coalesce(lag(error) OVER w, '') AS pe, coalesce(lag(rung) OVER w, '') AS pr FROM attempts WINDOW w AS (PARTITION BY run_id, item ORDER BY seq)),
q AS (SELECT *, status <> 'success' AND {_antibot('error')} AS hit, {_antibot('pe')} AS before, CASE WHEN pr = '' THEN 'direct' ELSE pr END AS r FROM p)
SELECT seq, CASE WHEN hit AND rung <> 'research' THEN CASE WHEN rung = 'deep' THEN 'Aggressive' ELSE 'Moderate' END WHEN before OR hit THEN CASE WHEN r = 'deep' THEN 'Aggressive' ELSE 'Moderate' END
  WHEN status <> 'success' OR rung = 'research' THEN 'Unknown' ELSE 'None Detected' END AS bot_protection FROM q""")
def _(spark, sf, attempts):
    return ladder.bot_protection(attempts).select("seq", "bot_protection")


@query("l10_best_per_identifier", ["results"], """SELECT "Domain", coalesce(max(CASE WHEN "Quality" <> 'Failed' THEN seq END), max(seq)) AS seq, min(seq) AS first_seq FROM results GROUP BY "Domain" """)
def _(spark, sf, results):
    return ladder.best_per_identifier(results).select("Domain", "seq", "first_seq")


@query("l11_chain_errors", ["attempts"], """SELECT seq, CASE WHEN rung = 'research' AND status <> 'success' AND prior <> '' THEN concat(prior, '; research fallback: ', error) ELSE error END AS message
FROM (SELECT *, coalesce(lag(error) OVER (PARTITION BY run_id, item ORDER BY seq), '') AS prior FROM attempts) x""")
def _(spark, sf, attempts):
    return ladder.chain_errors(attempts).select("seq", "message")


SUMMARY_SQL = STATE_SQL + """, m AS (SELECT r.run_id, r.status, r.started_at, r.created_at, r.total, count(s.item) AS entries, count(*) FILTER (WHERE s.status = 'success') AS successful, count(*) FILTER (WHERE s.status = 'error') AS errors,
  count(*) FILTER (WHERE s.status = 'retry_pending') AS retrying, CAST(floor(epoch(max(s.ts))) AS BIGINT) - CAST(floor(epoch(min(s.ts))) AS BIGINT) AS elapsed FROM runs r LEFT JOIN s ON s.run_id = r.run_id GROUP BY r.run_id, r.status, r.started_at, r.created_at, r.total)"""


@query("l1_ids_by_status", ["attempts"], STATE_SQL + " SELECT run_id, item FROM s WHERE status = 'retry_pending'")
def _(spark, sf, attempts):
    return ladder.ids_by_status(_state(attempts), ladder.PENDING)


@query("l12_progress_summary", ["attempts", "runs"], SUMMARY_SQL + f""", d AS (SELECT *, entries - retrying AS processed, greatest(total - entries + retrying, 0) AS remaining FROM m)
SELECT run_id, total, entries, successful, errors, retrying, processed, remaining, elapsed, {_percent_sql("processed", "total")} AS completion, CASE WHEN processed > 0 AND elapsed > 0 THEN elapsed * remaining // processed END AS eta_seconds FROM d""")
def _(spark, sf, attempts, runs):
    return ladder.progress_summary(_state(attempts), runs).withColumn("completion", hundredths("completion"))


@query("l13_eta", ["attempts", "runs"], SUMMARY_SQL + " SELECT run_id, CASE WHEN status = 'running' AND entries > 0 THEN CAST(round(greatest(total - entries, 0) * 2682000.0 / entries + retrying * 15.0) AS BIGINT) END AS eta FROM m")
def _(spark, sf, attempts, runs):
    return ladder.eta(ladder.progress_summary(_state(attempts), runs), runs, F.expr(NOW) - F.expr("INTERVAL '0' DAY"))


@query("l14_progress_shares", ["attempts", "runs"], SUMMARY_SQL + f""" SELECT run_id, {_percent_sql("successful", "total")} AS ok, {_percent_sql("retrying", "total")} AS retry, {_percent_sql("errors", "total")} AS fail,
  CASE WHEN status = 'completed' THEN 10000 ELSE least({_percent_sql("(entries - retrying)", "total")}, 10000) END AS overall FROM m""")
def _(spark, sf, attempts, runs):
    shares = ladder.progress_shares(ladder.progress_summary(_state(attempts), runs), runs)
    return shares.select("run_id", *[hundredths(c) for c in ("ok", "retry", "fail", "overall")])


@query("l15_outcome_counts", ["attempts"], STATE_SQL + f""" SELECT run_id, items, ok, items - ok AS failed, {_percent_sql("(items - ok)", "items")} AS failure_rate FROM (SELECT run_id, count(*) AS items, count(*) FILTER (WHERE status = 'success') AS ok FROM s GROUP BY run_id) x""")
def _(spark, sf, attempts):
    return ladder.outcome_counts(attempts).withColumn("failure_rate", hundredths("failure_rate"))


@query("l16_failure_digest", ["attempts"], STATE_SQL + """, f AS (SELECT *, CASE WHEN error LIKE 'Connection%' THEN 'Connection reset' ELSE error END AS short FROM s WHERE status = 'error'),
g AS (SELECT *, row_number() OVER (PARTITION BY run_id, short ORDER BY first_seq, item) AS rn FROM f)
SELECT run_id, short, count(*) AS n, string_agg(CASE WHEN rn <= 5 THEN CAST(item AS STRING) END, ',' ORDER BY rn) AS sample, greatest(count(*) - 5, 0) AS more FROM g GROUP BY run_id, short""")
def _(spark, sf, attempts):
    return ladder.failure_digest(_state(attempts))


@query("l17_recent_activity", ["attempts"], STATE_SQL + " SELECT run_id, item, first_seq, status FROM s ORDER BY first_seq DESC LIMIT 10")
def _(spark, sf, attempts):
    return ladder.recent_activity(attempts).select("run_id", "item", "first_seq", "status")


@query("l18_live_progress", ["attempts"], STATE_SQL + " SELECT run_id, item, seq, rung, status, error FROM s")
def _(spark, sf, attempts):
    source, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    attempts.write.parquet(source)
    stream = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 2).parquet(source)
    live.live_progress(stream, out, checkpoint, available_now=True).awaitTermination()
    return live.read_live_state(spark, out).select("run_id", "item", "seq", "rung", "status", "error")


_L12_SQL = SUMMARY_SQL + f""", d AS (SELECT *, entries - retrying AS processed, greatest(total - entries + retrying, 0) AS remaining FROM m)
SELECT run_id, total, entries, successful, errors, retrying, processed, remaining, elapsed, {_percent_sql("processed", "total")} AS completion, CASE WHEN processed > 0 AND elapsed > 0 THEN elapsed * remaining // processed END AS eta_seconds FROM d"""


@query("l18_live_summary", ["attempts", "runs"], _L12_SQL)
def _(spark, sf, attempts, runs):
    """The log in files of any order, a third of it twice."""
    source, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    attempts.union(attempts.filter("seq % 3 = 0")).repartition(6).write.parquet(source)
    stream = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 2).parquet(source)
    live.live_summary(stream, out, checkpoint, available_now=True).awaitTermination()
    return live.read_live_summary(spark, out, runs).withColumn("completion", hundredths("completion"))


# Labels.

REPLY_SQL = """
SELECT item, CASE item % 8 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 3 THEN '' WHEN 5 THEN '' WHEN 2 THEN 'Response missing choices[0].message' WHEN 6 THEN 'Response missing choices[0].message'
  ELSE 'Unparseable classification response: Response does not contain function call or parseable content' END AS parse_error,"""


@query("d1_unwrap_replies", ["replies"], REPLY_SQL + """ CASE item % 8 WHEN 0 THEN item % 500 WHEN 3 THEN 77 ELSE 0 END AS tokens, CASE item % 8 WHEN 0 THEN 'stop' WHEN 1 THEN 'stop' WHEN 4 THEN 'length' WHEN 5 THEN 'tool_calls' WHEN 7 THEN 'stop' ELSE 'None' END AS finish_reason,
  CASE item % 8 WHEN 0 THEN '{"quality":"Premium","vertical":"Sports","confidence":"High"}' WHEN 1 THEN '{"quality":"Long Tail","language":"French"}' WHEN 3 THEN '{"quality":"Superb","confidence":"Sky","description":"N/A"}' WHEN 5 THEN '{"quality":"Standard","justification":""}' END AS args FROM replies""")
def _(spark, sf, replies):
    return labels.unwrap_replies(replies).select("item", "parse_error", "tokens", "finish_reason", "args")


@query("d2_decode_labels", ["replies", "taxonomy"], """
SELECT item, CASE item % 8 WHEN 0 THEN 'Premium' WHEN 1 THEN 'Long Tail' WHEN 3 THEN 'Standard' WHEN 5 THEN 'Standard' END AS quality, CASE item % 8 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 3 THEN 'Medium' WHEN 5 THEN 'Medium' END AS confidence,
  CASE item % 8 WHEN 0 THEN 'Sports' WHEN 1 THEN 'Unknown' WHEN 3 THEN 'Unknown' WHEN 5 THEN 'Unknown' END AS vertical, CASE item % 8 WHEN 0 THEN 'English' WHEN 1 THEN 'French' WHEN 3 THEN 'English' WHEN 5 THEN 'English' END AS language,
  CASE item % 8 WHEN 3 THEN 'Not provided' WHEN 0 THEN 'No description provided' WHEN 1 THEN 'No description provided' WHEN 5 THEN 'No description provided' END AS description,
  CASE item % 8 WHEN 5 THEN 'Not provided' WHEN 0 THEN 'No justification provided' WHEN 1 THEN 'No justification provided' WHEN 3 THEN 'No justification provided' END AS justification FROM replies""")
def _(spark, sf, replies, tax):
    return labels.decode_labels(labels.unwrap_replies(replies), labels.taxonomy_paths(tax)).select("item", "quality", "confidence", "vertical", "language", "description", "justification")


@query("d4_retry_budget", ["attempts"], """
SELECT item, seq, CAST(2000 * pow(2, least(n - 1, 2)) AS BIGINT) AS budget, step, CASE WHEN step = 'retry' THEN CAST(4000 * pow(2, n - 1) AS BIGINT) END AS next_budget
FROM (SELECT *, CASE WHEN status = 'success' THEN 'done' WHEN n <= 2 THEN 'retry' ELSE 'terminal' END AS step FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY seq) AS n FROM attempts) x) y""")
def _(spark, sf, attempts):
    replies = attempts.select("item", "seq", F.when(F.col("status") == "success", "").otherwise("bad").alias("parse_error"))
    return labels.retry_budget(replies).select("item", "seq", "budget", "step", "next_budget")


@query("d5_taxonomy_paths", ["catalog_taxonomy"], r"""
, w AS (SELECT line_no, [x for x in [tier1, tier2, tier3, CASE WHEN name NOT IN (tier1, tier2, tier3) THEN name ELSE '' END] if x <> ''] AS path FROM catalog_taxonomy),
t AS (SELECT line_no, i, path[i] AS tier, path[1:i] AS path FROM (SELECT line_no, path, unnest(range(1, len(path) + 1)) AS i FROM w) x),
k AS (SELECT trim(regexp_replace(replace(lower(tier), '&', 'and'), '[^a-z0-9]+', ' ', 'g')) AS key, path, line_no * 10 + i - 1 AS ord FROM t),
r AS (SELECT key, array_to_string(path, ' > ') AS path, min(ord) OVER (PARTITION BY key) AS ord, row_number() OVER (PARTITION BY key ORDER BY len(path) DESC, ord) AS rn FROM k)
SELECT key, path, ord FROM r WHERE rn = 1""")
def _(spark, sf, tax):
    return labels.taxonomy_paths(tax).select("key", F.array_join("path", " > ").alias("path"), "ord")


@query("d6_resolve_verticals", ["vertical_labels", "taxonomy"], """
SELECT item, CASE item % 12 WHEN 0 THEN 'Automotive' WHEN 1 THEN 'Food > Dining Out > Bars & Restaurants' WHEN 2 THEN 'Food > Dining Out > Bars & Restaurants' WHEN 3 THEN 'Sports > Soccer > Cups' WHEN 4 THEN 'Automotive'
  WHEN 7 THEN 'Games > Video Games > Soccer' WHEN 8 THEN 'Zebra > Yak' WHEN 9 THEN 'Games > Video Games > Soccer' WHEN 11 THEN CASE item % 40 WHEN 7 THEN 'Misc > Label 7' WHEN 8 THEN 'Misc > Label 8' ELSE 'News' END ELSE '' END AS tiers FROM vertical_labels""")
def _(spark, sf, rows, tax):
    out = labels.resolve_verticals(rows, "vertical", labels.taxonomy_paths(tax))
    return out.select("item", F.array_join(F.filter(F.array("tier1", "tier2", "tier3"), lambda t: t != ""), " > ").alias("tiers"))


def _hits(c: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{w}') AS INT)" for w in words) + ")"


NEWS_SQL = f""", t AS (SELECT item, turn, lower(research) AS r, lower(app_name) AS a, content_type FROM research),
n AS (SELECT *, {_hits('r', labels.ENTERTAINMENT)} > 2 * {_hits('r', labels.ENTERTAINMENT_NEWS)} AS fun FROM t),
c AS (SELECT *, (content_type = 'News' OR {_hits('r', labels.NEWS_PHRASES)} >= 2 OR {_hits('a', labels.NEWS_NETWORKS)} > 0) AND NOT fun AS news, {_hits('r', labels.GENERAL_NEWS)} < 3 AS few FROM n)"""


@query("d7_news_signals", ["research"], NEWS_SQL + " SELECT item, turn, fun AS primarily_entertainment, news AS is_ctv_news FROM c")
def _(spark, sf, rows):
    return labels.news_signals(rows).select("item", "turn", "primarily_entertainment", "is_ctv_news")


@query("d5_taxonomy_outline", ["catalog_taxonomy"], "SELECT DISTINCT tier1, tier2, tier3 FROM catalog_taxonomy WHERE tier1 <> ''")
def _(spark, sf, tax):
    return labels.taxonomy_outline(tax)


@query("d8_route_ctv_news", ["research"], NEWS_SQL + f""", r AS (SELECT *, CASE WHEN NOT news THEN 'none' WHEN few AND {_hits('a', labels.WEATHER_APPS)} > 0 THEN 'weather' WHEN few AND {_hits('a', labels.CRIME_APPS)} > 0 THEN 'crime'
  WHEN few AND {_hits('a', labels.DISASTER_APPS)} > 0 THEN 'disaster' WHEN {_hits('r', labels.ELECTION_SIGNALS)} >= 2 OR {_hits('a', labels.ELECTION_APPS)} > 0 THEN 'election' ELSE 'news' END AS route FROM c)
SELECT item, turn, CASE route WHEN 'none' THEN 'Old' WHEN 'weather' THEN 'Science > Weather' WHEN 'crime' THEN 'Crime' WHEN 'disaster' THEN 'Disasters' WHEN 'election' THEN 'Politics > Elections' ELSE 'Politics > Civic affairs' END AS vertical,
  CASE WHEN route IN ('news', 'election') THEN 'Center' ELSE 'Non-Political' END AS political_leaning,
  concat('J', CASE route WHEN 'none' THEN '' WHEN 'news' THEN ' (post-routed for CTV news)' WHEN 'election' THEN ' (post-routed for CTV election news)' ELSE concat(' (post-routed for CTV ', route, ' app)') END,
    CASE WHEN route IN ('news', 'election') THEN ' Political_Leaning set to Center due to Politics vertical.' ELSE '' END) AS justification FROM r""")
def _(spark, sf, rows):
    rows = rows.withColumns({"tier1": F.lit("Old"), "tier2": F.lit(""), "tier3": F.lit(""), "vertical": F.lit("Old"), "justification": F.lit("J"), "political_leaning": F.lit("Non-Political")})
    return labels.route_ctv_news(rows).select("item", "turn", "vertical", "political_leaning", "justification")


ROUTED_SQL = f"""r AS (SELECT *, CASE WHEN NOT news THEN 'none' WHEN few AND {_hits('a', labels.WEATHER_APPS)} > 0 THEN 'weather' WHEN few AND {_hits('a', labels.CRIME_APPS)} > 0 THEN 'crime'
  WHEN few AND {_hits('a', labels.DISASTER_APPS)} > 0 THEN 'disaster' WHEN {_hits('r', labels.ELECTION_SIGNALS)} >= 2 OR {_hits('a', labels.ELECTION_APPS)} > 0 THEN 'election' ELSE 'news' END AS route FROM c)"""
#: An app name and a research text for each reply.
_APP = "concat(CASE item % 7 WHEN 0 THEN 'Local Weather Now ' WHEN 1 THEN 'CNN ' WHEN 2 THEN 'Court TV News ' WHEN 3 THEN 'Ballot Watch News ' WHEN 4 THEN 'Emergency Alert News ' ELSE 'Box ' END, CAST(item AS STRING))"
_TOLD = "CASE item % 4 WHEN 0 THEN 'Movies and scripted series, a streaming service' WHEN 1 THEN 'Headlines, current events, national news and politics' WHEN 2 THEN 'election results on election night' ELSE coalesce(text, '') END"


@query("d3_decode_ctv_labels", ["replies", "taxonomy"], f"""
, research AS (SELECT item, 0 AS turn, {_TOLD} AS research, {_APP} AS app_name, 'Mixed Content' AS content_type FROM replies LEFT JOIN documents ON doc_id = item)""" + NEWS_SQL + ", " + ROUTED_SQL + """,
b AS (SELECT *, item % 8 IN (0, 1, 3, 5) AS ok, CASE item % 8 WHEN 0 THEN 'Sports' ELSE '' END AS base FROM r)
SELECT item, CASE item % 8 WHEN 0 THEN 'Premium' WHEN 1 THEN 'Long Tail' WHEN 3 THEN 'Standard' WHEN 5 THEN 'Standard' END AS quality, CASE WHEN ok THEN 'Mixed Content' END AS content_type, CASE WHEN ok THEN 'General audience' END AS target_audience,
  CASE WHEN ok THEN '' END AS network_affiliation, CASE WHEN ok THEN 'S' END AS audience_size, CASE WHEN ok THEN CASE item % 8 WHEN 0 THEN 'High' ELSE 'Medium' END END AS confidence, CASE WHEN ok THEN CASE item % 8 WHEN 1 THEN 'French' ELSE 'English' END END AS language,
  CASE WHEN ok THEN CASE item % 8 WHEN 3 THEN 'N/A' ELSE 'No description provided' END END AS description,
  CASE WHEN ok THEN CASE route WHEN 'none' THEN CASE WHEN base = '' THEN 'Unknown' ELSE base END WHEN 'weather' THEN 'Science > Weather' WHEN 'crime' THEN 'Crime' WHEN 'disaster' THEN 'Disasters' WHEN 'election' THEN 'Politics > Elections' ELSE 'Politics > Civic affairs' END END AS vertical,
  CASE WHEN ok THEN CASE route WHEN 'none' THEN base WHEN 'weather' THEN 'Science' WHEN 'crime' THEN 'Crime' WHEN 'disaster' THEN 'Disasters' ELSE 'Politics' END END AS tier1,
  CASE WHEN ok THEN CASE route WHEN 'weather' THEN 'Weather' WHEN 'election' THEN 'Elections' WHEN 'news' THEN 'Civic affairs' ELSE '' END END AS tier2, CASE WHEN ok THEN '' END AS tier3,
  CASE WHEN ok THEN CASE WHEN route IN ('news', 'election') THEN 'Center' ELSE 'Non-Political' END END AS political_leaning,
  CASE WHEN ok THEN concat(CASE item % 8 WHEN 5 THEN '' ELSE 'No justification provided' END, CASE route WHEN 'none' THEN '' WHEN 'news' THEN ' (post-routed for CTV news)' WHEN 'election' THEN ' (post-routed for CTV election news)' ELSE concat(' (post-routed for CTV ', route, ' app)') END,
    CASE WHEN route IN ('news', 'election') THEN ' Political_Leaning set to Center due to Politics vertical.' ELSE '' END) END AS justification FROM b""")
def _(spark, sf, replies, tax):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("d"), "text")
    told = replies.join(docs, F.col("d") == F.col("item"), "left").withColumns({"app_name": F.expr(_APP), "research": F.expr(_TOLD)}).drop("d", "text")
    columns = ("quality", "content_type", "target_audience", "network_affiliation", "audience_size", "confidence", "language", "description", "vertical", "tier1", "tier2", "tier3", "political_leaning", "justification")
    return labels.decode_ctv_labels(labels.unwrap_replies(told), labels.taxonomy_paths(tax)).select("item", *columns)


@query("d9_gate_research", ["research"], "SELECT item, turn, trim(research) = '' OR upper(trim(research)) = 'INSUFFICIENT INFORMATION' OR length(trim(research)) < 100 AS insufficient FROM research")
def _(spark, sf, rows):
    return labels.gate_research(rows, least=100).select("item", "turn", "insufficient")


#: Marks put around words of whole texts, and what is left of them: Markdown that SQL has no rules for.
MARKED = ((" of ", " **of** ", " of "), (" and ", " [and](http://x/y)[12] ", " and "), (" the ", " *the* ", " the "), (" on ", " __on__ _on_ ", " on on "), (" was ", " `was` ", " was "))


def _marked_sql(c: str, to: int) -> str:
    for m in MARKED:
        c = f"replace({c}, '{m[0]}', '{m[to]}')"
    return c


_BLANK = r"[\t\n\x0b\f\r \x1c-\x1f\x85\p{Z}]"


def _strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _single_sql(c: str, m: str) -> str:
    """Pairs of the sign m go where neither touches another one. Runs of it are hidden behind chr(57344) meanwhile, which
    with chr(57345) is escaped in the text before, as DuckDB's patterns cannot look around."""
    run, esc = "chr(57344)", "chr(57345)"
    c = f"replace(replace({c}, {esc}, {esc} || '0'), {run}, {esc} || '1')"
    c = f"replace(replace({c}, '{m}{m}', {run} || {run}), {run} || '{m}', {run} || {run})"
    c = rf"regexp_replace({c}, '[{m}]([^{m}\x{{e000}}]+)[{m}]', '\1', 'g')"
    return f"replace(replace(replace({c}, {run}, '{m}'), {esc} || '1', {run}), {esc} || '0', {esc})"


@query("d10_summarize_research", ["results"], rf"""
, t AS (SELECT seq, concat('# Title', chr(10), '**Bold**', chr(10), chr(10), chr(10), '  ', {_marked_sql("replace(replace(coalesce(\"Description\", ''), '**', '+'), '_', '-')", 1)}) AS raw FROM results),
u AS (SELECT seq, regexp_replace(regexp_replace(regexp_replace(raw, '(?m)^#{{1,6}}{_BLANK}+', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\[\p{{Nd}}+\]', '', 'g') AS text FROM t),
b AS (SELECT seq, regexp_replace(regexp_replace(text, '\*\*([^*]+)\*\*', '\1', 'g'), '__([^_]+)__', '\1', 'g') AS text FROM u),
i AS (SELECT seq, {_single_sql("text", "*")} AS text FROM b),
j AS (SELECT seq, {_single_sql("text", "_")} AS text FROM i),
c AS (SELECT seq, regexp_replace(regexp_replace(regexp_replace(text, '`([^`]+)`', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^[ \t]+', '', 'g') AS text FROM j),
v AS (SELECT seq, {_strip_sql("text")} AS text FROM c),
w AS (SELECT seq, text, substring(text, 1, 300) AS head, regexp_extract(substring(text, 1, 300), '(?s)^(.*[.!?])({_BLANK}|$)', 1) AS cut FROM v)
SELECT seq, CASE WHEN length(text) <= 300 THEN text WHEN length(cut) * 2 >= 300 THEN {_strip_sql("cut")} ELSE concat({_strip_sql("head")}, '...') END AS summary FROM w""")
def _(spark, sf, rows):
    """Whole texts with their punctuation, lines and signs; signs of the texts themselves stand single, underscores are dashes."""
    text = F.replace(F.replace(F.coalesce("Description", F.lit("")), F.lit("**"), F.lit("+")), F.lit("_"), F.lit("-"))
    for plain, marked, _ in MARKED:
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return labels.summarize_research(rows.select("seq", F.concat(F.lit("# Title\n**Bold**\n\n\n  "), text).alias("research")), n=300).select("seq", "summary")


@query("d11_decode_decisions", ["decision_replies"], """
SELECT item, CASE item % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS "Custom: Kids", CASE item % 6 WHEN 0 THEN 'Red' WHEN 1 THEN 'Blue' END AS "Custom: Colour", CASE item % 6 WHEN 0 THEN 0.5 END AS "P: Colour / Blue",
  CASE WHEN item % 6 < 2 THEN 'success' ELSE 'error' END AS "Decision_Status", CASE item % 6 WHEN 0 THEN 'Prov' ELSE '' END AS "Decision_Provider" FROM decision_replies""")
def _(spark, sf, rows):
    return labels.decode_decisions(rows, SPEC).select("item", "Custom: Kids", "Custom: Colour", "P: Colour / Blue", "Decision_Status", "Decision_Provider")


@query("d12_fill_decision_status", ["results"], """SELECT seq, CASE WHEN "Quality" = 'Failed' OR trim("Description") = '' THEN 'skipped' ELSE '' END AS "Decision_Status", CASE WHEN "Quality" = 'Failed' THEN 'Primary analysis failed; custom categories not evaluated' WHEN trim("Description") = '' THEN 'No source content available' ELSE '' END AS "Decision_Error" FROM results""")
def _(spark, sf, rows):
    none = F.lit(None).cast("string")
    return labels.fill_decision_status(rows.select("seq", "Quality", F.col("Description").alias("content"), none.alias("Decision_Status"), none.alias("Decision_Error"))).select("seq", "Decision_Status", "Decision_Error")


@query("d13_bound_evidence", [], "SELECT doc_id, length(substring(text, 1, 24000)) AS n_bound, length(text) > 24000 AS truncated, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN length(text) > 3000 THEN concat(substring(text, 1, 3000), '...') ELSE text END ELSE CASE WHEN length(text) > 2000 THEN concat(substring(text, 1, 2000), '...') ELSE text END END AS prompt_content FROM documents")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"), F.when(F.col("doc_id") % 2 == 0, "research").otherwise("direct").alias("mode"))
    return labels.bound_evidence(rows).select("doc_id", F.length("content_bound").alias("n_bound"), "truncated", "prompt_content")


@query("d14_append_results", ["results"], 'SELECT seq, "Domain" FROM results UNION ALL SELECT seq, "Domain" FROM results WHERE seq % 5 = 0')
def _(spark, sf, rows):
    path = scratch(spark)
    labels.append_to(path, rows.select("seq", "Domain"), SPEC)
    labels.append_to(path, rows.filter("seq % 5 = 0").select("seq", "Domain"), SPEC)
    return spark.read.parquet(path).select("seq", "Domain")


def _one_run(attempts: DataFrame) -> DataFrame:
    """The log as that of one run, so that an item has one state."""
    return attempts.withColumn("run_id", F.lit(0))


@query("d15_assemble_results", ["work_items", "attempts", "model_calls", "results"], rf"""
, p AS (SELECT *, coalesce(lag(error) OVER w, '') AS pe, coalesce(lag(rung) OVER w, '') AS pr FROM attempts WINDOW w AS (PARTITION BY item ORDER BY seq)),
q AS (SELECT *, status <> 'success' AND {_antibot('error')} AS hit, {_antibot('pe')} AS before, CASE WHEN pr = '' THEN 'direct' ELSE pr END AS r FROM p),
b AS (SELECT *, CASE WHEN hit AND rung <> 'research' THEN CASE WHEN rung = 'deep' THEN 'Aggressive' ELSE 'Moderate' END WHEN before OR hit THEN CASE WHEN r = 'deep' THEN 'Aggressive' ELSE 'Moderate' END
  WHEN status <> 'success' OR rung = 'research' THEN 'Unknown' ELSE 'None Detected' END AS bot FROM q),
s AS (SELECT item, max(seq) AS seq, arg_max(rung, seq) AS rung, arg_max(status, seq) AS status, arg_max(error, seq) AS error, arg_max(seconds, seq) AS seconds, arg_max(bot, seq) AS bot FROM b GROUP BY item),
c AS (SELECT w.item, CASE WHEN count(m.seq) = 0 THEN '0.000000' WHEN count(m.usage_cost) = 0 THEN '' ELSE CAST(CAST(round(sum(CAST(m.usage_cost AS DECIMAL(18,9))), 6) AS DECIMAL(28,6)) AS STRING) END AS cost FROM work_items w LEFT JOIN model_calls m ON m.item = w.item GROUP BY w.item),
j AS (SELECT w.item, w.type = 'website' AS site, s.*, d."Quality" AS q, d."Content_Length" AS len, d."IAB Tier 1" AS t1, d.seq AS known, c.cost, s.status = 'success' AND d.seq IS NOT NULL AND d."Quality" <> 'Failed' AS good
  FROM work_items w JOIN s ON s.item = w.item LEFT JOIN results d ON d.seq = w.item LEFT JOIN c ON c.item = w.item)
SELECT CAST(item AS STRING) AS "Domain", CASE WHEN site THEN 'WEBSITE' ELSE 'IOS' END AS "Type", CASE WHEN site OR known IS NULL THEN '' ELSE concat('App ', CAST(known AS STRING)) END AS "App_Name", CASE WHEN site OR known IS NULL THEN '' ELSE 'Dev' END AS "Developer",
  CASE WHEN site OR known IS NULL THEN '' ELSE t1 END AS "Store_Category", CASE WHEN site OR known IS NULL THEN '' ELSE '4.5' END AS "Rating", CASE WHEN site OR known IS NULL THEN '' ELSE CAST(known * 3 AS STRING) END AS "Rating_Count", CASE WHEN site OR known IS NULL THEN '' ELSE '10+' END AS "Downloads",
  CASE WHEN good THEN q ELSE 'Failed' END AS "Quality", CASE WHEN good THEN concat('Why ', CAST(known AS STRING)) ELSE concat('Processing failed: ', error) END AS "Justification",
  CASE WHEN good THEN t1 ELSE 'N/A' END AS "IAB Tier 1", CASE WHEN good THEN 'Two' ELSE 'N/A' END AS "IAB Tier 2", CASE WHEN good THEN '' ELSE 'N/A' END AS "IAB Tier 3", CASE WHEN good THEN 'D' ELSE 'N/A' END AS "Description",
  CASE WHEN good AND known % 2 = 0 THEN 'English' ELSE 'Unknown' END AS "Language", CASE WHEN good AND known % 3 = 0 THEN 'Center' ELSE 'Non-Political' END AS "Political_Leaning", CASE WHEN good AND known % 5 = 0 THEN 'M' ELSE 'Unknown' END AS "Audience_Size",
  CASE WHEN site THEN bot ELSE '' END AS "Bot_Protection", coalesce(CAST(len AS STRING), '0') AS "Content_Length", coalesce(CAST(seconds AS STRING), '') AS "Processing_Time", CASE WHEN site THEN rung ELSE 'ios_api' END AS "Scrape_Mode", 'openrouter' AS "Classifier_Mode",
  CASE WHEN known IS NULL THEN '' ELSE 'now' END AS "Scraped_At", cost AS "Cost_USD" FROM j""")
def _(spark, sf, items, attempts, calls, results):
    """All columns, of apps and websites, successes and failures, with and without evidence and labels."""
    seq = F.col("seq")
    text = lambda v, name: F.lit(v).alias(name)
    some = lambda n, v, name: F.when(seq % n == 0, v).otherwise("").alias(name)
    found = results.select(seq.alias("item"), F.concat(F.lit("App "), seq.cast("string")).alias("app_name"), text("Dev", "developer"), F.col("IAB Tier 1").alias("store_category"), text("4.5", "rating"), (seq * 3).alias("rating_count"), text("10+", "downloads"), F.col("Content_Length").alias("content_length"), text("now", "scraped_at"))
    given = results.filter("Quality <> 'Failed'").select(seq.alias("item"), F.col("Quality").alias("quality"), F.concat(F.lit("Why "), seq.cast("string")).alias("justification"), F.col("IAB Tier 1").alias("tier1"), text("Two", "tier2"), text("", "tier3"), text("D", "description"), some(2, "English", "language"), some(3, "Center", "political_leaning"), some(5, "M", "audience_size"))
    return labels.assemble_results(items, found, given, _one_run(attempts), spend.parse_costs(calls))


@query("d16_assemble_ctv_results", ["ctv_list", "model_calls"], f"""
, c AS (SELECT w.row_no, CASE WHEN count(m.seq) = 0 THEN '0.000000' WHEN count(m.usage_cost) = 0 THEN '' ELSE CAST(CAST(round(sum(CAST(m.usage_cost AS DECIMAL(18,9))), 6) AS DECIMAL(28,6)) AS STRING) END AS cost FROM ctv_list w LEFT JOIN model_calls m ON m.item = w.row_no GROUP BY w.row_no),
j AS (SELECT l.*, row_no % 5 IN (1, 2) AS good, row_no % 5 <> 4 AS told, {PLATFORM_SQL.replace('b ', 'bundle_id ').replace('(b,', '(bundle_id,').replace('(b)', '(bundle_id)')} AS p, cost FROM ctv_list l JOIN c USING (row_no))
SELECT app_name AS "App_Name", 'CTV' AS "Type", bundle_id AS "Bundle_ID", ssp AS "SSP", publisher AS "Publisher", p AS "Platform", concat('http://u/', CAST(row_no AS STRING)) AS "URL", CASE WHEN good THEN 'Standard' ELSE 'Failed' END AS "Quality",
  CASE WHEN good THEN 'Why' WHEN row_no % 5 = 3 THEN 'Classification failed: {labels.NO_ARGUMENTS}' ELSE 'Research failed: No meaningful research evidence available' END AS "Justification", CASE WHEN good THEN concat('One ', CAST(row_no AS STRING)) ELSE 'N/A' END AS "IAB Tier 1",
  CASE WHEN good THEN 'Two' ELSE 'N/A' END AS "IAB Tier 2", CASE WHEN good THEN '' ELSE 'N/A' END AS "IAB Tier 3", CASE WHEN good THEN 'Said' ELSE 'N/A' END AS "Description", CASE WHEN good THEN 'All' ELSE 'N/A' END AS "Target_Audience", CASE WHEN good THEN 'News' ELSE 'N/A' END AS "Content_Type",
  CASE WHEN good THEN 'English' ELSE 'Unknown' END AS "Language", CASE WHEN good THEN 'Left' ELSE 'Non-Political' END AS "Political_Leaning", CASE WHEN good THEN 'Net' ELSE 'N/A' END AS "Network_Affiliation", CASE WHEN good THEN 'L' ELSE 'Unknown' END AS "Audience_Size",
  CASE row_no % 5 WHEN 0 THEN 'Insufficient information' WHEN 4 THEN '' ELSE 'All is well.' END AS "Research_Summary", CASE WHEN told THEN '1.50' ELSE '' END AS "Processing_Time", CASE WHEN told THEN 'm' ELSE '' END AS "Research_Model", CASE WHEN good THEN 'c' ELSE '' END AS "Classification_Model", CASE WHEN told THEN 'now' ELSE '' END AS "Processed_At", cost AS "Cost_USD" FROM j""")
def _(spark, sf, rows, calls):
    items = rows.withColumn("key", F.col("row_no").cast("string")).withColumn("platform", ids.ctv_platform(F.col("bundle_id"))).withColumn("url", F.concat(F.lit("http://u/"), F.col("row_no").cast("string")))
    told = items.filter("row_no % 5 <> 4").select("key", F.when(F.col("row_no") % 5 == 0, "Insufficient information").otherwise("**All** is well.").alias("research"), F.lit("m").alias("research_model"), F.lit(1.5).alias("seconds"), F.lit("now").alias("processed_at"))
    values = {"quality": "Standard", "justification": "Why", "tier2": "Two", "tier3": "", "description": "Said", "target_audience": "All", "content_type": "News", "language": "English", "political_leaning": "Left", "network_affiliation": "Net", "audience_size": "L", "classification_model": "c"}
    given = items.filter("row_no % 5 in (1, 2)").select("key", F.concat(F.lit("One "), "key").alias("tier1"), *[F.lit(v).alias(c) for c, v in values.items()])
    return labels.assemble_ctv_results(items, told, given, spend.parse_costs(calls).withColumn("key", F.col("item").cast("string")))


@query("d17_score", [], "SELECT source, count(*) AS n, count(*) FILTER (WHERE length(text) > 1000) AS premium FROM documents GROUP BY source")
def _(spark, sf):
    import pandas as pd

    def longest(batches):
        for pdf in batches:
            tier = pdf["text"].str.len().gt(1000).map({True: "Premium", False: "Standard"})
            yield pd.DataFrame({"item": pdf["source"], "json": '{"choices":[{"message":{"content":"{\\"quality\\":\\"' + tier + '\\"}"}}]}'})

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("source", F.coalesce("text", F.lit("")).alias("text"))
    out = labels.decode_labels(labels.unwrap_replies(labels.score(docs, longest)))
    return out.groupBy(F.col("item").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == "Premium").alias("premium"))


# Spend. Sums are compared in whole units of 10^-9.

COST_SQL = ", c AS (SELECT *, CAST(usage_cost AS DECIMAL(18,9)) AS cost FROM model_calls)"


def _units(c: str):
    return (F.col(c) * 1000000000).cast("long")


@query("c1_parse_costs", ["model_calls"], COST_SQL + " SELECT seq, CAST(cost * 1000000000 AS BIGINT) AS units FROM c")
def _(spark, sf, calls):
    return spend.parse_costs(calls).select("seq", _units("cost").alias("units"))


@query("c2_run_cost", ["model_calls"], COST_SQL + " SELECT run_id, CAST(sum(cost) * 1000000000 AS BIGINT) AS units, count(*) AS calls, count(*) FILTER (WHERE cost IS NULL) AS unpriced_calls FROM c GROUP BY run_id")
def _(spark, sf, calls):
    return spend.run_cost(spend.parse_costs(calls)).select("run_id", _units("usd").alias("units"), "calls", "unpriced_calls")


@query("c3_model_cost", ["model_calls"], COST_SQL + """, m AS (SELECT run_id, CASE WHEN model = '' THEN 'unknown' ELSE model END AS model, cost FROM c)
SELECT run_id, model, CAST(round(sum(cost), 6) * 1000000 AS BIGINT) AS micro FROM m GROUP BY run_id, model UNION ALL SELECT run_id, NULL, CAST(round(sum(cost), 6) * 1000000 AS BIGINT) FROM m GROUP BY run_id UNION ALL SELECT NULL, NULL, CAST(round(sum(cost), 6) * 1000000 AS BIGINT) FROM m""")
def _(spark, sf, calls):
    return spend.model_cost(spend.parse_costs(calls)).select("run_id", "model", (F.col("usd") * 1000000).cast("long").alias("micro"))


@query("c4_item_cost", ["work_items", "model_calls"], COST_SQL + """ SELECT w.item, CASE WHEN count(c.seq) = 0 THEN '0.000000' WHEN count(c.cost) = 0 THEN '' ELSE CAST(CAST(round(sum(c.cost), 6) AS DECIMAL(28,6)) AS STRING) END AS "Cost_USD" FROM work_items w LEFT JOIN c ON c.item = w.item GROUP BY w.item""")
def _(spark, sf, items, calls):
    return spend.item_cost(items, spend.parse_costs(calls))


@query("c5_resume_cost", ["model_calls"], COST_SQL + " SELECT run_id, CAST(2 * sum(cost) * 1000000000 AS BIGINT) AS units, 2 * count(*) AS calls, count(DISTINCT CASE WHEN cost IS NOT NULL THEN model END) AS models FROM c GROUP BY run_id")
def _(spark, sf, calls):
    calls = spend.parse_costs(calls)
    by = calls.filter("cost is not null").groupBy("run_id", "model").agg(F.sum("cost").cast("decimal(28,9)").alias("usd")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "usd"))).alias("by_model"))
    saved = spend.run_cost(calls).join(by, "run_id", "left")
    return spend.resume_cost(saved, calls).select("run_id", _units("usd").alias("units"), "calls", F.size("by_model").cast("long").alias("models"))


@query("c6_token_usage", ["model_calls"], "SELECT model, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM model_calls GROUP BY model")
def _(spark, sf, calls):
    return spend.token_usage(calls).drop("mean_tokens")


# Results and runs.

_V = "CASE WHEN trim(coalesce({c}, '')) = '' THEN '(blank)' ELSE trim({c}) END"


@query("q1_summarize", ["results"], " UNION ALL ".join(f"""SELECT '{c}' AS dimension, {_V.replace('{c}', '"' + c + '"')} AS value, count(*) AS n FROM results GROUP BY 2""" for c in ("Quality", "Type", "IAB Tier 1")))
def _(spark, sf, results):
    return result_queries.summarize(results)


@query("q2_top_categories", ["results"], f"""SELECT value, n FROM (SELECT {_V.replace('{c}', '"IAB Tier 1"')} AS value, count(*) AS n, min(seq) AS f FROM results GROUP BY 1 ORDER BY n DESC, f LIMIT 15) x""")
def _(spark, sf, results):
    return result_queries.top_categories(results)


@query("q3_page", ["results"], """SELECT seq, "Domain", CASE WHEN length("Description") > 600 THEN concat(substring("Description", 1, 600), '…') ELSE "Description" END AS "Description", (SELECT count(*) FROM results WHERE lower("Quality") = 'premium') AS matching FROM results WHERE lower("Quality") = 'premium' ORDER BY seq LIMIT 100 OFFSET 20""")
def _(spark, sf, results):
    rows, n = result_queries.page(results, 20, 100, " PREMIUM ", ["Domain", "Description"])
    return rows.withColumn("matching", F.lit(n).cast("long"))


@query("q4_list_runs", ["many_runs"], "SELECT run_id, status, created_at, (SELECT count(*) FROM many_runs WHERE status = 'failed') AS matching FROM many_runs WHERE status = 'failed' ORDER BY created_at DESC, run_id DESC LIMIT 20")
def _(spark, sf, runs):
    return result_queries.list_runs(runs, "failed")


@query("q5_run_view", ["attempts", "runs", "model_calls"], SUMMARY_SQL + """, c AS (SELECT run_id AS rid, CAST(sum(CAST(usage_cost AS DECIMAL(18,9))) * 1000000000 AS BIGINT) AS units, count(*) AS calls FROM model_calls GROUP BY run_id),
d AS (SELECT *, entries - retrying AS processed, (entries - retrying) * 1000 // total AS q, (entries - retrying) * 1000 % total AS r FROM m)
SELECT run_id, status, created_at, total, processed, successful, errors, retrying, CAST(q + CASE WHEN 2 * r > total OR (2 * r = total AND q % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) AS percent, units, calls,
  CASE WHEN status = 'running' AND entries > 0 THEN CAST(round(greatest(total - entries, 0) * 2682000.0 / entries + retrying * 15.0) AS BIGINT) END AS eta FROM d LEFT JOIN c ON c.rid = d.run_id""")
def _(spark, sf, attempts, runs, calls):
    out = result_queries.run_view(runs, attempts, spend.parse_costs(calls), F.expr(NOW))
    return out.withColumn("percent", (F.col("percent") * 10).cast("long")).withColumn("units", _units("usd")).drop("usd")


@query("q6_merge_runs", ["many_runs", "attempts"], """SELECT run_id, status, created_at FROM many_runs UNION ALL SELECT run_id, 'archived', created_at FROM (SELECT seq + 1000000000 * (item % 2) AS run_id, min(ts) AS created_at FROM attempts GROUP BY 1) a WHERE run_id NOT IN (SELECT run_id FROM many_runs)""")
def _(spark, sf, runs, attempts):
    return result_queries.merge_runs(runs, attempts.select((F.col("seq") + 1000000000 * (F.col("item") % 2)).alias("run_id"), F.col("ts").alias("created_at")))


@query("q7_list_inputs", ["identifiers", "tlds"], _after(_BREAKDOWN.replace("SELECT source_file,", "SELECT source_file AS folder, true AS sized,")))
def _(spark, sf, rows, tlds):
    """Folders with files of the same names."""
    folder = scratch(spark)
    rows.withColumn("source", F.col("source_file")).repartition(3).write.partitionBy("source").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    back = spark.read.option("header", True).option("recursiveFileLookup", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    listed = result_queries.list_inputs(spark, folder, identify.breakdown(result_queries.with_file(back), "value", tlds))
    per = listed.groupBy(F.regexp_extract("source_file", "source=([a-z]+)/", 1).alias("folder"))
    return per.agg((F.min("size") > 0).alias("sized"), *[F.sum(c).alias(c) for c in ("websites", "ios", "android", "total")])


@query("q3_deep_page", ["results"], """SELECT seq, "Domain", (SELECT count(*) FROM results) AS matching FROM results ORDER BY seq LIMIT 50 OFFSET (SELECT CAST(count(*) AS BIGINT) // 2 FROM results)""")
def _(spark, sf, results):
    rows, n = result_queries.page(results, results.count() // 2, 50, columns=["Domain"], most=20)
    return rows.withColumn("matching", F.lit(n).cast("long"))
