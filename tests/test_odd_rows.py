"""Every core operator on nulls in any column, empty tables, ties, repeated rows and extra columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from stockyard.operators import evidence, identify, labels, ladder, queries, spend
from stockyard.sources import tables

LOG = "run_id long, item long, type string, seq long, ts timestamp, rung string, status string, error string, seconds decimal(18,2)"
TS = "2024-01-01 00:00:00"
TABLES = {
    "attempts": (LOG, [(1, 1, "website", 1, TS, "direct", "error", "http status 403", "1.0"), (1, 1, "website", 2, TS, "deep", "success", None, None), (1, 2, "ios_app", 3, TS, None, "retry_pending", None, None), (None, None, None, 4, None, None, None, None, None), (None, None, None, 4, None, None, None, None, None), (2, 3, "website", 5, TS, "research", "error", "x" * 500, "2.0")]),
    "items": ("row_no long, item long, type string", [(1, 1, "website"), (2, 2, "ios_app"), (2, 2, "ios_app"), (3, None, None), (None, 9, "website")]),
    "runs": ("run_id long, status string, created_at timestamp, started_at timestamp, total long", [(1, "running", TS, TS, 5), (1, "running", TS, TS, 5), (2, "completed", TS, None, 0), (None, None, None, None, None)]),
    "results": ("seq long, Domain string, Quality string, Type string, `IAB Tier 1` string, Description string", [(1, "a", "Premium", "WEBSITE", "T", "d"), (2, "a", "Failed", None, None, None), (3, None, None, " ", "", "z" * 5000), (3, None, None, " ", "", "z" * 5000)]),
    "calls": ("run_id long, item long, model string, usage_cost string, tokens long, seq long", [(1, 1, "m", "0.5", 3, 1), (1, 1, None, None, None, 2), (None, None, "", "x", -1, 3), (None, None, "", "x", -1, 3)]),
    "replies": ("item long, seq long, json string", [(1, 1, None), (1, 1, None), (2, 2, ""), (3, 3, "[]"), (None, 4, '{"choices":[{"message":{"content":"{}"}}]}')]),
    "research": ("key string, item long, research string, app_name string, content_type string", [("a", 1, None, None, None), ("a", 1, None, None, None), ("b", 2, "news " * 500, "CNN", "News"), (None, 3, "", "", "")]),
    "taxonomy": ("line_no long, name string, tier1 string, tier2 string, tier3 string, tier4 string", [(1, "A", "A", None, None, None), (2, None, "A", None, None, None), (3, "B", "A", "B", "", None), (3, "B", "A", "B", "", None)]),
    "list": ("row_no long, Domain string, `App Name` string, `Bundle ID` string, SSP string, Type string, source_file string", [(1, "a.com", "App", "B01", "s", "web", "f"), (2, None, None, None, None, None, None), (3, "", "nan", "", "", "", "f"), (3, "", "nan", "", "", "", "f"), (4, "com.x.y", "App", None, None, "ios", None)]),
    "fetches": ("item long, success boolean, error string, status_code int, content string, content_length long, url string, final_url string", [(1, True, None, 200, "c" * 900, None, "http://a.com", "http://b.com"), (2, None, None, None, None, None, None, None), (2, None, None, None, None, None, None, None), (3, True, "", 0, "", 0, "not a url", "")]),
    "tlds": ("tld string", [("com",), ("com",), (None,)]),
}
CLASHES = ("id", "n", "r", "s", "k", "v", "o", "t", "key_", "label", "path", "hit", "first", "place", "value", "kind", "pos", "__x", "total_", "level")


def state(t):
    return ladder.latest_state(t["attempts"])


def paths(t):
    return labels.taxonomy_paths(t["taxonomy"])


def decisions(t):
    return labels.decode_decisions(t["replies"], {"categories": [{"name": "A", "type": "boolean", "question": "?"}]})


OPERATORS = {
    "S2": lambda t: tables.null_missing(t["list"]), "S3": lambda t: tables.clean_cells(t["list"], ["Domain"]), "S4": lambda t: tables.drop_artifact_columns(t["list"]), "S6": lambda t: tables.normalize_items(t["list"], "Domain")[0],
    "S9": lambda t: tables.migrate_results(t["results"], ["Domain", "Nope"]), "S10": lambda t: tables.export_results(t["results"]), "S12": lambda t: tables.explode_progress(t["replies"].select("json"), "json"),
    "I1": lambda t: identify.classify_identifiers(t["list"], "Domain", t["tlds"]), "I2": lambda t: identify.score_columns(t["list"]), "I3": lambda t: identify.build_work_items(t["list"], t["tlds"]), "I6": lambda t: identify.breakdown(t["list"], "Domain", t["tlds"]),
    "I5": lambda t: identify.profile_batch(identify.classify_identifiers(t["list"].drop("Type"), "Domain", t["tlds"])), "I7": lambda t: identify.breakdown_shares(identify.breakdown(t["list"], "Domain", t["tlds"])), "I6c": lambda t: identify.ctv_breakdown(t["list"]),
    "I8": lambda t: identify.build_ctv_items(t["list"]), "I9": lambda t: identify.platform_mix(t["list"], "Bundle ID"), "I10": lambda t: identify.distinct_ctv_apps(t["list"], "App Name"), "I11": lambda t: identify.items_of_type(identify.build_work_items(t["list"], t["tlds"]), "website"),
    "E1": lambda t: evidence.extract_pages(t["fetches"], "url", "content"), "E2": lambda t: evidence.decode_bodies(t["fetches"].withColumn("body", F.col("content").cast("binary")), "body", "error"), "E3": lambda t: evidence.validate_content(t["fetches"]),
    "E4": lambda t: evidence.audit_redirects(t["fetches"]), "E5": lambda t: evidence.expand_targets(t["fetches"], "url"), "E6": lambda t: evidence.extract_play_pages(t["fetches"], "url", "content"), "E7": lambda t: evidence.decode_ios_lookup(t["replies"], "item", "json"),
    "E8": lambda t: evidence.store_evidence(evidence.decode_ios_lookup(t["replies"], "item", "json"), "ios"), "E9": lambda t: evidence.fetch_stats(t["attempts"], ["run_id"]),
    "L1": state, "L1i": lambda t: ladder.ids_by_status(state(t), "error"), "L2": lambda t: ladder.pending_items(t["items"], state(t)), "L3": lambda t: ladder.first_pass(t["items"], state(t)), "L4": lambda t: ladder.retry_set(t["items"], state(t)), "L5": lambda t: ladder.deep_set(t["items"], state(t)),
    "L6": lambda t: ladder.next_rung(t["items"], state(t)), "L7": lambda t: ladder.finalize_pending(state(t)), "L8": lambda t: ladder.reset_failed(state(t)), "L9": lambda t: ladder.bot_protection(t["attempts"]), "L10": lambda t: ladder.best_per_identifier(t["results"]),
    "L11": lambda t: ladder.chain_errors(t["attempts"]), "L12": lambda t: ladder.progress_summary(state(t), t["runs"]), "L13": lambda t: ladder.eta(ladder.progress_summary(state(t), t["runs"]), t["runs"], F.current_timestamp()), "L14": lambda t: ladder.progress_shares(ladder.progress_summary(state(t), t["runs"]), t["runs"]),
    "L15": lambda t: ladder.outcome_counts(t["attempts"]), "L16": lambda t: ladder.failure_digest(state(t)), "L17": lambda t: ladder.recent_activity(t["attempts"]),
    "D1": lambda t: labels.unwrap_replies(t["replies"]), "D2": lambda t: labels.decode_labels(labels.unwrap_replies(t["replies"].select("item", "json")), paths(t)), "D3": lambda t: labels.decode_ctv_labels(labels.unwrap_replies(t["replies"].select("item", "json")), paths(t)),
    "D4": lambda t: labels.retry_budget(t["replies"].withColumn("parse_error", F.col("json"))), "D5": paths, "D5o": lambda t: labels.taxonomy_outline(t["taxonomy"]), "D6": lambda t: labels.resolve_verticals(t["research"].select("item", "research"), "research", paths(t)),
    "D7": lambda t: labels.news_signals(t["research"]), "D9": lambda t: labels.gate_research(t["research"]), "D10": lambda t: labels.summarize_research(t["research"]), "D11": decisions,
    "D12": lambda t: labels.fill_decision_status(t["results"].selectExpr("seq", "Quality", "Description content", "cast(null as string) Decision_Status", "cast(null as string) Decision_Error")), "D13": lambda t: labels.bound_evidence(t["results"].selectExpr("seq", "Description content", "Domain title", "Type mode")),
    "C1": lambda t: spend.parse_costs(t["calls"]), "C2": lambda t: spend.run_cost(spend.parse_costs(t["calls"])), "C3": lambda t: spend.model_cost(spend.parse_costs(t["calls"])), "C4": lambda t: spend.item_cost(t["items"], spend.parse_costs(t["calls"])), "C6": lambda t: spend.token_usage(t["calls"]),
    "Q1": lambda t: queries.summarize(t["results"]), "Q2": lambda t: queries.top_categories(t["results"]), "Q3": lambda t: queries.page(t["results"])[0], "Q4": lambda t: queries.list_runs(t["runs"]), "Q5": lambda t: queries.run_view(t["runs"], t["attempts"], spend.parse_costs(t["calls"]), F.current_timestamp()), "D8": lambda t: labels.route_ctv_news(t["research"].withColumns({c: F.lit(None).cast("string") for c in ("tier1", "tier2", "tier3", "vertical", "justification", "political_leaning")})), "D14": lambda t: labels.append_results(t["results"].withColumn("spec_hash", F.lit(None).cast("string")), t["results"], None),
    "S5": lambda t: identify.recover_headerless(t["list"].select("row_no", F.col("Domain").alias("first.com")), t["tlds"]), "I4": lambda t: t["list"].select(F.lit(identify.find_type_column(t["list"], "Domain") or "none").alias("column")), "D17": lambda t: labels.score(t["replies"].select(F.col("item").cast("string").alias("item"), "json"), lambda it: it), "C5": lambda t: spend.resume_cost(spend.run_cost(spend.parse_costs(t["calls"])).withColumn("by_model", F.lit(None).cast("map<string,decimal(28,9)>")), spend.parse_costs(t["calls"])),
    "Q6": lambda t: queries.merge_runs(t["runs"], t["attempts"].selectExpr("run_id", "ts created_at")),
}
#: Rows out for every row in, whatever the row holds.
ROW_BY_ROW = {"S2": "list", "S3": "list", "S4": "list", "S9": "results", "S10": "results", "I1": "list", "E1": "fetches", "E2": "fetches", "E3": "fetches", "E4": "fetches", "E6": "fetches", "E7": "replies", "L9": "attempts", "L11": "attempts", "D1": "replies", "D2": "replies", "D3": "replies", "D4": "replies", "D6": "research", "D7": "research", "D9": "research", "D10": "research", "D11": "replies", "D12": "results", "D13": "results", "C1": "calls", "C4": "items", "Q3": "results"}


@pytest.fixture(scope="module")
def odd(spark):
    out = {}
    for name, (schema, rows) in TABLES.items():
        text = ", ".join(" ".join([c.strip().rpartition(" ")[0], "string" if c.strip().endswith(("timestamp", ",2)")) or "decimal" in c else c.strip().rpartition(" ")[2]]) for c in schema.replace("(18,2)", "").split(", "))
        df = spark.createDataFrame(rows, text)
        kinds = {c.strip().rpartition(" ")[0].strip("`"): c.strip().rpartition(" ")[2] for c in schema.replace("(18,2)", "").split(", ")}
        df = df.withColumns({c: F.col(c).cast("decimal(18,2)" if k == "decimal" else k) for c, k in kinds.items() if k in ("timestamp", "decimal")})
        if name != "tlds":
            df = df.withColumns({c: F.lit(1) for c in CLASHES if c not in df.columns})
        out[name] = df.repartition(2)
    return out


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd, name):
    out = OPERATORS[name](odd)
    rows = out.collect()
    if name in ROW_BY_ROW:
        assert len(rows) == odd[ROW_BY_ROW[name]].count()
    assert len(rows) < 60


def told(df, *columns):
    return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))


#: What operators give for the odd rows, by the columns named.
ANSWERS = {
    "S3": (("row_no", "Domain"), [("1", "a.com"), ("2", ""), ("3", ""), ("3", ""), ("4", "com.x.y")]),
    "S6": (("row_no", "item"), [("1", "a.com"), ("4", "com.x.y")]),
    "I1": (("row_no", "type"), [("1", "website"), ("2", "website"), ("3", "website"), ("3", "website"), ("4", "android_app")]),
    "I3": (("identifier", "type"), [("a.com", "website"), ("com.x.y", "ios_app")]),
    "I4": (("column",), [("Type",)] * 5),
    "I6": (("source_file", "websites", "ios", "android", "total"), [("None", "0", "0", "1", "1"), ("f", "1", "0", "0", "1")]),
    "I9": (("platform", "n"), [("Fire TV", "1"), ("Unknown", "4")]),
    "L1": (("run_id", "item", "status"), [("1", "1", "success"), ("1", "2", "retry_pending"), ("2", "3", "error"), ("None", "None", "None")]),
    "L1i": (("run_id", "item"), [("2", "3")]),
    "L3": (("row_no", "item"), [("3", "None"), ("None", "9")]),
    "L8": (("item", "status"), [("1", "success"), ("2", "retry_pending")]),
    "L9": (("seq", "bot_protection"), [("1", "Moderate"), ("2", "Moderate"), ("3", "Unknown"), ("4", "None Detected"), ("4", "None Detected"), ("5", "Unknown")]),
    "L10": (("Domain", "seq"), [("None", "3"), ("a", "1")]),
    "L15": (("run_id", "items", "ok"), [("1", "2", "1"), ("2", "1", "0"), ("None", "1", "0")]),
    "E9": (("run_id", "requests", "successes"), [("1", "3", "1"), ("2", "1", "0"), ("None", "2", "0")]),
    "D5o": (("tier1", "tier2", "tier3"), [("A", "B", ""), ("A", "None", "None")]),
    "D9": (("key", "insufficient"), [("None", "True"), ("a", "True"), ("a", "True"), ("b", "False")]),
    "C1": (("seq", "cost"), [("1", "0.500000000"), ("2", "None"), ("3", "None"), ("3", "None")]),
    "C2": (("run_id", "calls", "unpriced_calls"), [("1", "2", "1"), ("None", "2", "2")]),
    "C6": (("model", "requests", "total_tokens"), [("", "2", "-2"), ("None", "1", "0"), ("m", "1", "3")]),
    "Q1": (("dimension", "value", "n"), [("IAB Tier 1", "(blank)", "3"), ("IAB Tier 1", "T", "1"), ("Quality", "(blank)", "2"), ("Quality", "Failed", "1"), ("Quality", "Premium", "1"), ("Type", "(blank)", "3"), ("Type", "WEBSITE", "1")]),
    "Q2": (("value", "n"), [("(blank)", "3"), ("T", "1")]),
}


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_answers_on_odd_rows(odd, name):
    columns, want = ANSWERS[name]
    assert told(OPERATORS[name](odd), *columns) == sorted(want)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(odd, name):
    if name == "I3" or name == "I11":
        with pytest.raises(identify.NoInputColumn):
            identify.build_work_items(odd["list"].select("row_no").limit(0), odd["tlds"])
    out = OPERATORS[name]({k: t.limit(0) for k, t in odd.items()})
    rows = out.collect()
    assert len(rows) == {"I5": 4, "S5": 1}.get(name, 0)  # a list without rows has its header as an item
