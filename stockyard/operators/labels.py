"""Model replies into labels: unwrapping, decoding, taxonomy tiers, news routing, decisions, result rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.functions.cells import contains_any, hits, shortened, strip
from stockyard.operators import ladder, spend
from stockyard.operators.carry import HOT, with_place
from stockyard.shipping import children, ship, stored

# Fixed values of labels.
QUALITIES = ("Premium", "Standard", "Long Tail")
CONFIDENCES = ("High", "Medium", "Low")
LEANINGS = ("Far Left", "Left", "Center-Left", "Center", "Center-Right", "Right", "Far Right", "Non-Political")
CONTENT_TYPES = ("Live TV", "On-Demand Streaming", "Live Sports", "News", "Music/Audio", "Kids Content", "Fitness", "Educational", "Gaming", "Mixed Content")
# What stands for an absent key of a reply.
DEFAULTS = {"quality": "Standard", "justification": "No justification provided", "vertical": "Unknown", "description": "No description provided", "confidence": "Medium", "language": "English", "political_leaning": "Non-Political", "audience_size": "S"}
CTV_DEFAULTS = DEFAULTS | {"target_audience": "General audience", "content_type": "Mixed Content", "network_affiliation": ""}
NO_MESSAGE = "Response missing choices[0].message"
NO_ARGUMENTS = "Unparseable classification response: Response does not contain function call or parseable content"
INSUFFICIENT = "INSUFFICIENT INFORMATION"
_REPLY = "choices array<struct<message:struct<content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>,finish_reason:string>>, usage struct<total_tokens:long,cost:string>"


def _is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def unwrap_replies(df: DataFrame, col: str = "json") -> DataFrame:
    """Adds args (JSON object text), finish_reason, tokens and parse_error ("" if none)."""
    doc = F.from_json(F.col(col), _REPLY)
    rows = df.withColumn("__c", F.get(doc["choices"], F.lit(0))).withColumn("__u", doc["usage"]["total_tokens"])
    message = F.col("__c.message")
    call = F.get(message["tool_calls"], F.lit(0))["function"]["arguments"]
    inline = F.regexp_extract(F.coalesce(message["content"], F.lit("")), r"(?s)\{.*\}", 0)
    args = F.when(_is_object(call), call).when(_is_object(inline), inline)
    rows = rows.withColumn("args", args)
    error = F.when(message.isNull(), NO_MESSAGE).when(F.col("args").isNull(), NO_ARGUMENTS).otherwise("")
    tokens = F.when(F.col("__u").between(0, 2**31 - 1), F.col("__u")).otherwise(0).cast("long")
    return rows.withColumn("parse_error", error).withColumn("finish_reason", F.coalesce("__c.finish_reason", F.lit("None"))).withColumn("tokens", tokens).drop("__c", "__u")


def _values(m: Column, defaults: dict[str, str]) -> dict[str, Column]:
    """Absent keys take their default, JSON null is blank."""
    return {k: F.when(~F.coalesce(F.map_contains_key(m, F.lit(k)), F.lit(False)), d).otherwise(F.coalesce(F.element_at(m, k), F.lit(""))) for k, d in defaults.items()}


def _one_of(c: Column, valid: tuple, default: str) -> Column:
    return F.when(c.isin(*valid), c).otherwise(default)


def _decoded(df: DataFrame, defaults: dict[str, str], paths: DataFrame | None) -> DataFrame:
    ok = F.col("parse_error") == ""
    # a column of its own, so that the JSON text is parsed once and not for each label
    df = df.withColumn("__args", F.from_json(F.col("args"), "map<string,string>"))
    values = _values(F.col("__args"), defaults)
    values["quality"] = _one_of(values["quality"], QUALITIES, "Standard")
    values["confidence"] = _one_of(values["confidence"], CONFIDENCES, "Medium")
    values["political_leaning"] = _one_of(values["political_leaning"], LEANINGS, "Non-Political")
    if "content_type" in values:
        values["content_type"] = _one_of(values["content_type"], CONTENT_TYPES, "Mixed Content")
    out = df.withColumns({k: F.when(ok, v) for k, v in values.items()}).drop("__args")
    if paths is not None:
        out = resolve_verticals(out, "vertical", paths)
        found = F.filter(F.array("tier1", "tier2", "tier3"), lambda t: t != "")
        out = out.withColumn("vertical", F.when(F.col("tier1") != "", F.array_join(found, " > ")).otherwise(F.col("vertical")))
    return out


def decode_labels(df: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Website and app labels of unwrapped replies; rows that did not parse have no label."""
    out = _decoded(df, DEFAULTS, paths)
    low = F.lower("vertical")
    untiered = (F.col("tier1") == "") if paths is not None else F.lit(True)
    out = out.withColumn("vertical", F.when(untiered & low.isin("", "unknown", "n/a"), "Unknown").otherwise(F.col("vertical")))
    given = lambda c: F.when(F.col(c).isin("", "N/A"), "Not provided").otherwise(F.col(c))
    return out.withColumns({c: given(c) for c in ("quality", "justification", "vertical", "description", "confidence")})


def decode_ctv_labels(df: DataFrame, paths: DataFrame | None = None, route: bool = True) -> DataFrame:
    """CTV labels; with app_name and research in the rows, news apps are routed. Rows that did not parse have no label."""
    out = _decoded(df, CTV_DEFAULTS, paths)
    if not route or paths is None or not {"app_name", "research"} <= set(df.columns):
        return out
    ok = F.col("parse_error") == ""
    return route_ctv_news(out).withColumns({c: F.when(ok, F.col(c)) for c in ("vertical", "tier1", "tier2", "tier3", "justification", "political_leaning")})


def retry_budget(replies: DataFrame, first: int = 2000, retries: int = 2, hot: int = HOT) -> DataFrame:
    """Per reply (item, seq, parse_error): its budget, and what follows: done, retry with next_budget, or terminal.

    The budget doubles with each retry and stays at that of the last one for replies beyond it. Items with over `hot`
    replies are worked on in ranges."""
    out = with_place(replies, ["item"], "seq", "attempt", hot).withColumn("budget", (F.lit(first) * F.pow(F.lit(2.0), F.least(F.col("attempt") - 1, F.lit(retries)))).cast("long"))
    step = F.when(F.col("parse_error") == "", "done").when(F.col("attempt") <= retries, "retry").otherwise("terminal")
    return out.withColumn("step", step).withColumn("next_budget", F.when(F.col("step") == "retry", F.col("budget") * 2))


def normal_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "&", "and"), "[^a-z0-9]+", " "))


def taxonomy_paths(tax: DataFrame) -> DataFrame:
    """(key, path, ord): each tier and leaf with its longest path; ord is the place of its first mention."""
    tiers = F.array_distinct(F.filter(F.array("tier1", "tier2", "tier3", "tier4"), lambda t: F.coalesce(t, F.lit("")) != ""))
    whole = F.when(F.array_contains(tiers, F.col("name")), tiers).otherwise(F.array_append(tiers, F.col("name")))
    rows = tax.filter(F.coalesce("name", F.lit("")) != "").select("line_no", whole.alias("tiers")).select("line_no", "tiers", F.posexplode("tiers").alias("i", "tier"))
    rows = rows.select(normal_label(F.col("tier")).alias("key"), F.slice("tiers", 1, F.col("i") + 1).alias("path"), (F.col("line_no") * 10 + F.col("i")).alias("ord")).filter("key <> ''")
    return rows.groupBy("key").agg(F.max_by("path", F.struct(F.size("path"), -F.col("ord"))).alias("path"), F.min("ord").alias("ord"))


def taxonomy_outline(tax: DataFrame) -> DataFrame:
    """The distinct first three tiers, sorted; rows without a first tier are left out, null lower tiers stay null."""
    return tax.filter("tier1 <> ''").select("tier1", "tier2", "tier3").distinct().orderBy("tier1", "tier2", "tier3")


def _pieces(rows: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """The rows once for each piece of `text` (ASCII) that has one of the lengths, as column `piece`."""
    rows = rows.withColumn("__len", F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(text))))
    rows = rows.withColumn("__at", F.explode(F.sequence(F.lit(1), F.length(text) - F.col("__len") + 1)))
    piece = F.substring(F.col(text).cast("binary"), F.col("__at"), F.col("__len")).cast("string")
    return rows.withColumn("piece", piece).drop("__len", "__at")


def _lengths(rows: DataFrame, text: str) -> list[int]:
    """The lengths that occur, as many as the longest text has characters at most."""
    return sorted(r[0] for r in rows.select(F.length(text)).distinct().collect())


def nearest_keys(norms: DataFrame, paths: DataFrame) -> DataFrame:
    """(norm, near_path): for each label the path of the longest key that it contains or that contains it, the first of
    equally long ones.

    Both are equi-joins on pieces of text: pieces of labels that are as long as some key with the keys, and pieces of
    keys that are as long as some label with the labels. A text of n characters has at most n pieces of a length, so
    work grows with the texts, not with the product of labels and keys, and neither side has to fit a broadcast."""
    keys = paths.select("key", "path", "ord")
    best = F.struct(F.length("key").alias("n"), (-F.col("ord")).alias("o"), F.col("path").alias("path"))
    inside = _pieces(norms, "norm", _lengths(keys, "key")).join(keys, F.col("piece") == F.col("key")).select("norm", best.alias("b"))
    whole = norms.select(F.col("norm").alias("w"))
    around = _pieces(keys, "key", _lengths(norms, "norm")).join(whole, F.col("piece") == F.col("w")).select(F.col("w").alias("norm"), best.alias("b"))
    return inside.union(around).groupBy("norm").agg(F.max("b").alias("b")).select("norm", F.col("b.path").alias("near_path"))


def resolve_verticals(df: DataFrame, col: str, paths: DataFrame) -> DataFrame:
    """Adds tier1..tier3, blank where a label is null, void or unknown. Each distinct label is resolved once; they are
    written to the shared folder first, so that the rows they come from are read once, not by each step."""
    v = F.coalesce(F.col(col), F.lit(""))
    labels = stored(df.select(v.alias("label")).distinct(), "labels")
    first = F.trim(F.get(F.split("label", r"[\n\r\x0b\f\x1c-\x1e\x85  ]"), F.lit(0)))
    parts = lambda sep: F.filter(F.transform(F.split("first", sep), lambda t: F.trim(t)), lambda t: t != "")
    void = F.lower(F.trim("label")).isin("", "unknown", "n/a", "not provided") | contains_any(F.lower("label"), ("description:", "confidence:", "quality:", "justification:"))
    rows = labels.withColumn("first", first).withColumn("void", void | (F.col("first") == "")).withColumn("given", parts("[>|/]+")).withColumn("own", parts("[>|/,;]+"))
    rows = rows.withColumn("spelled", F.col("first").rlike("[>|/]") & (F.size("given") > 1))
    open_ = rows.filter("not void and not spelled").select("label", F.posexplode(F.array_distinct(F.concat(F.array("first"), F.col("own"), parts("[()]")))).alias("pos", "cand")).withColumn("norm", normal_label(F.col("cand"))).filter("norm <> ''")
    exact = stored(open_.join(paths, open_.norm == paths.key, "left").select("label", "pos", "norm", "path"), "label-parts")
    close = nearest_keys(exact.filter("path is null").select("norm").distinct(), paths)
    best = exact.join(close, "norm", "left").withColumn("hit", F.coalesce("path", "near_path")).filter("hit is not null").groupBy("label").agg(F.min_by("hit", "pos").alias("hit"))
    tiers = F.when(F.col("void"), F.array().cast("array<string>")).when(F.col("spelled"), F.col("given")).otherwise(F.coalesce("hit", "own"))
    done = rows.join(best, "label", "left").select("label", tiers.alias("tiers"))
    tier = lambda i: F.coalesce(F.get("tiers", F.lit(i)), F.lit("")).alias(f"tier{i + 1}")
    done = done.select(F.col("label").alias("__label"), *[tier(i) for i in range(3)])
    return df.withColumn("__v", v).join(done, F.col("__v") == F.col("__label"), "left").drop("__v", "__label")


# Phrases that tell news apps from others.
GENERAL_NEWS = ("news", "breaking news", "headlines", "current events", "local news", "national news", "world news", "politics", "election", "newscast")
WEATHER_APPS = ("weather channel", "accuweather", "weather underground", "weather.com", "weather bug", "weatherbug", "weather network", "weather nation", "local weather", "storm tracker", "radar", "wunderground")
CRIME_APPS = ("crime watch", "true crime", "crime tv", "court tv", "crime stories", "crime investigation", "unsolved mysteries", "dateline", "48 hours")
DISASTER_APPS = ("emergency alert", "fema", "red cross", "disaster", "emergency management", "emergency preparedness", "alert", "warning system")
ELECTION_SIGNALS = ("election coverage", "election results", "election night", "vote count", "ballot", "electoral college", "midterm election", "presidential election", "senate race", "house race", "gubernatorial", "primary election")
ELECTION_APPS = ("election", "vote", "ballot", "c-span", "cspan")
NEWS_PHRASES = ("news", "breaking news", "live news", "local news", "national news", "headlines", "current events", "news channel", "news network", "24/7 news", "weather forecast", "election coverage", "news station", "news broadcast", "news programming", "newscast")
NEWS_NETWORKS = ("news", "nbc news", "abc news", "cbs news", "fox news", "cnn", "bbc", "al jazeera", "msnbc", "cnbc", "c-span", "pbs newshour", "reuters", "associated press", "ap news", "npr", "bloomberg news", "sky news", "newsmax", "oan", "newsy", "local", "weather")
ENTERTAINMENT = ("movies", "scripted series", "television series", "streaming service", "original programming", "entertainment platform", "tv shows", "drama series", "comedy series", "reality shows", "on-demand movies", "movie streaming", "binge watch", "netflix original", "amazon original", "hulu original", "streaming content", "video on demand")
ENTERTAINMENT_NEWS = ("news", "headlines", "breaking news", "current events", "journalism", "newscast", "news programming", "news coverage")


def news_signals(df: DataFrame) -> DataFrame:
    """Adds primarily_entertainment, is_ctv_news and few_news of (app_name, research, content_type)."""
    text, name = F.lower(F.coalesce("research", F.lit(""))), F.lower(F.coalesce("app_name", F.lit("")))
    fun = hits(text, ENTERTAINMENT) > hits(text, ENTERTAINMENT_NEWS) * 2
    news = (F.col("content_type") == "News") | (hits(text, NEWS_PHRASES) >= 2) | contains_any(name, NEWS_NETWORKS)
    return df.withColumn("primarily_entertainment", fun).withColumn("is_ctv_news", F.coalesce(news, F.lit(False)) & ~fun).withColumn("few_news", hits(text, GENERAL_NEWS) < 3)


def route_ctv_news(df: DataFrame) -> DataFrame:
    """News apps get the tiers of weather, crime, disasters, elections or civic affairs, with a note."""
    rows = news_signals(df)
    text, name = F.lower(F.coalesce("research", F.lit(""))), F.lower(F.coalesce("app_name", F.lit("")))
    special = lambda names: F.col("few_news") & contains_any(name, names)
    elections = (hits(text, ELECTION_SIGNALS) >= 2) | contains_any(name, ELECTION_APPS)
    route = F.when(~F.col("is_ctv_news"), "none").when(special(WEATHER_APPS), "weather").when(special(CRIME_APPS), "crime").when(special(DISASTER_APPS), "disaster").when(elections, "election").otherwise("news")
    rows = rows.withColumn("route", route)
    r = F.col("route")
    tier1 = F.when(r == "weather", "Science").when(r == "crime", "Crime").when(r == "disaster", "Disasters").when(r.isin("election", "news"), "Politics").otherwise(F.col("tier1"))
    tier2 = F.when(r == "weather", "Weather").when(r.isin("crime", "disaster"), "").when(r == "election", "Elections").when(r == "news", "Civic affairs").otherwise(F.col("tier2"))
    note = F.when(r == "news", " (post-routed for CTV news)").when(r == "election", " (post-routed for CTV election news)").when(r != "none", F.concat(F.lit(" (post-routed for CTV "), r, F.lit(" app)"))).otherwise("")
    centred = r.isin("election", "news") & (F.col("political_leaning") == "Non-Political")
    rows = rows.withColumn("justification", F.concat(F.col("justification"), note, F.when(centred, " Political_Leaning set to Center due to Politics vertical.").otherwise("")))
    rows = rows.withColumn("political_leaning", F.when(centred, "Center").otherwise(F.col("political_leaning")))
    rows = rows.withColumn("tier1", tier1).withColumn("tier2", tier2).withColumn("tier3", F.when(r == "none", F.col("tier3")).otherwise(""))
    both = F.when(F.col("tier2") == "", F.col("tier1")).otherwise(F.concat(F.col("tier1"), F.lit(" > "), F.col("tier2")))
    return rows.withColumn("vertical", F.when(r == "none", F.col("vertical")).otherwise(both)).drop("few_news", "route")


def gate_research(df: DataFrame, col: str = "research", least: int = 0) -> DataFrame:
    """Adds `insufficient`: blank, the sentinel, or (websites: least=100) too short."""
    s = strip(F.coalesce(F.col(col), F.lit("")))
    return df.withColumn("insufficient", (s == "") | (F.upper(s) == INSUFFICIENT) | (F.length(s) < least))


def strip_markdown(c: Column) -> Column:
    """Text without Markdown's signs, trimmed. A rule runs only where its sign occurs; most texts have few of them."""
    rules = (
        ("#", r"(?dm)^#{1,6}[\s\x1c-\x1f\x85\p{Z}]+", ""),
        ("](", r"\[([^\]]+)\]\([^)]+\)", "$1"),
        ("[", r"\[\p{Nd}+\]", ""),
        ("**", r"\*\*([^*]+)\*\*", "$1"),
        ("__", r"__([^_]+)__", "$1"),
        ("*", r"(?<!\*)\*([^*]+)\*(?!\*)", "$1"),
        ("_", r"(?<!_)_([^_]+)_(?!_)", "$1"),
        ("`", r"`([^`]+)`", "$1"),
        ("\n\n\n", r"\n{3,}", "\n\n"),
    )

    def rule(sign: str, pattern: str, to: str):
        return lambda x: F.when(x.contains(sign), F.regexp_replace(x, pattern, to)).otherwise(x)

    for r in rules:
        # a lambda's variable is worked out once, where a column would be for each time that it is named
        c = F.get(F.transform(F.array(c), rule(*r)), F.lit(0))
    return strip(F.regexp_replace(c, r"(?dm)^[ \t]+", ""))


def summarize_research(df: DataFrame, col: str = "research", n: int = 1000) -> DataFrame:
    """Adds `summary`: plain text of at most n characters, at the last sentence end if that keeps half."""
    text = strip_markdown(F.coalesce(F.col(col), F.lit("")))
    rows = df.withColumn("__t", text)
    head = F.left("__t", F.lit(n))
    cut = F.regexp_extract(head, r"(?sU)\A(.*[.!?])(?=[\s\x1c-\x1f]|\z)", 1)
    short = F.when(F.length(cut) * 2 >= n, strip(cut)).otherwise(F.concat(strip(head), F.lit("...")))
    return rows.withColumn("summary", F.when(F.length("__t") <= n, F.col("__t")).otherwise(short)).drop("__t")


class BadSpec(ValueError):
    """A category spec that cannot be asked."""


def checked_spec(spec: dict) -> list[dict]:
    """1 to 12 categories with distinct names; choices have 2 to 12 distinct options."""
    found = spec.get("categories")
    if not isinstance(found, list) or not 1 <= len(found) <= 12:
        raise BadSpec("between 1 and 12 categories are needed")
    out, names = [], set()
    for c in found:
        name, kind = str(c.get("name", "")).strip(), c.get("type")
        if not name or name.casefold() in names or kind not in ("boolean", "choice") or not str(c.get("question", "")).strip():
            raise BadSpec(f"category {name!r}: a distinct name, a question and the type boolean or choice are needed")
        names.add(name.casefold())
        options = [str(o).strip() for o in c.get("options", [])]
        if kind == "choice" and (not 2 <= len(options) <= 12 or len({o.casefold() for o in options}) < len(options) or not all(options)):
            raise BadSpec(f"category {name!r}: 2 to 12 distinct options are needed")
        if kind == "boolean" and options:
            raise BadSpec(f"category {name!r}: a boolean has no options")
        out.append({"name": name, "type": kind, "question": str(c["question"]).strip(), "options": options})
    return out


def decision_columns(spec: dict) -> list[str]:
    out = []
    for c in checked_spec(spec):
        out += [f"Custom: {c['name']}", f"P(yes/choice): {c['name']}"]
        if c["type"] == "choice":
            out += [f"Confidence: {c['name']}", *[f"P: {c['name']} / {o}" for o in c["options"]]]
    return [*out, "Decision_Status", "Decision_Error", "Decision_Model", "Decision_Provider", "Decision_Answers"]


def decode_decisions(df: DataFrame, spec: dict, col: str = "json") -> DataFrame:
    """Adds the decision columns of a spec. Any violation makes the whole row an error without labels."""
    found = checked_spec(spec)
    answer = "struct<type:string,noul:double,choice:string,probabilities:map<string,double>,confidence:double>"
    schema = "struct<model:string,provider:string,answers:struct<" + ",".join(f"c{i}:{answer}" for i in range(len(found))) + ">>"
    rows = df.withColumn("__d", F.from_json(F.col(col), schema)).withColumn("__v", F.try_parse_json(col))
    share = lambda p: p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1)
    model = F.col("__d.model")
    valid, labels = F.coalesce(model.rlike(r"^[~A-Za-z0-9/._:-]{1,100}$"), F.lit(False)), {}
    for i, c in enumerate(found):
        a, name = F.col(f"__d.answers.c{i}"), c["name"]
        present = lambda k, i=i: F.try_variant_get("__v", f"$.answers.c{i}.{k}", "variant").isNotNull() & ~F.coalesce(F.is_variant_null(F.try_variant_get("__v", f"$.answers.c{i}.{k}", "variant")), F.lit(False))
        if c["type"] == "boolean":
            valid = valid & (a["type"] == "noul") & share(a["noul"])
            labels[f"Custom: {name}"] = F.when(a["noul"] >= 0.5, "Yes").otherwise("No")
            labels[f"P(yes/choice): {name}"] = a["noul"]
            continue
        options, dist = F.array(*[F.lit(o) for o in c["options"]]), a["probabilities"]
        keys = F.map_keys(dist)
        total = F.aggregate(F.map_values(dist), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(-9.0)))
        fine = (F.size(keys) == len(c["options"])) & (F.size(F.array_except(keys, options)) == 0) & F.forall(F.map_values(dist), lambda x: share(x)) & (F.abs(total - 1) <= 0.02)
        valid = valid & (a["type"] == "choice") & a["choice"].isin(*c["options"]) & F.when(present("probabilities"), F.coalesce(fine, F.lit(False))).otherwise(True) & F.when(present("confidence"), share(a["confidence"])).otherwise(True)
        labels[f"Custom: {name}"] = a["choice"]
        labels[f"P(yes/choice): {name}"] = F.try_element_at(dist, a["choice"])
        labels[f"Confidence: {name}"] = a["confidence"]
        for o in c["options"]:
            labels[f"P: {name} / {o}"] = F.try_element_at(dist, F.lit(o))
    rows = rows.withColumn("__ok", F.coalesce(valid, F.lit(False)))
    ok = F.col("__ok")
    out = rows.withColumns({k: F.when(ok, v) for k, v in labels.items()})
    answers = F.to_json(F.struct(*[F.col(f"`Custom: {c['name']}`").alias(c["name"]) for c in found]))
    provider = F.when(F.col("__d.provider").rlike(r"^[A-Za-z0-9 ()._-]{1,60}$"), F.col("__d.provider")).otherwise("")
    last = {"Decision_Status": F.when(ok, "success").otherwise("error"), "Decision_Error": F.when(ok, "").otherwise("Invalid decision response"), "Decision_Model": F.when(ok, model).otherwise(""), "Decision_Provider": F.when(ok, F.coalesce(provider, F.lit(""))).otherwise(""), "Decision_Answers": F.when(ok, answers).otherwise("")}
    return out.withColumns(last).drop("__d", "__v", "__ok")


def fill_decision_status(df: DataFrame) -> DataFrame:
    """Rows without content, or whose primary analysis failed, were skipped."""
    blank = F.coalesce(F.trim("content"), F.lit("")) == ""
    failed = F.col("Quality") == "Failed"
    status = F.when(failed | blank, "skipped").otherwise(F.coalesce("Decision_Status", F.lit("")))
    error = F.when(failed, "Primary analysis failed; custom categories not evaluated").when(blank, "No source content available").otherwise(F.coalesce("Decision_Error", F.lit("")))
    return df.withColumn("Decision_Status", status).withColumn("Decision_Error", error)


def bound_evidence(df: DataFrame) -> DataFrame:
    """Adds title_bound, content_bound with its flag, and the prompt content of a page or of research."""
    text = F.coalesce("content", F.lit(""))
    prompt = F.when(F.col("mode") == "research", shortened(text, 3000)).otherwise(shortened(text, 2000))
    return df.withColumn("title_bound", F.left(F.coalesce("title", F.lit("")), F.lit(500))).withColumn("content_bound", F.left(text, F.lit(24_000))).withColumn("truncated", F.length(text) > 24_000).withColumn("prompt_content", prompt)


def spec_hash(spec: dict | None) -> str:
    return "" if spec is None else hashlib.sha256(json.dumps(checked_spec(spec), sort_keys=True).encode()).hexdigest()


class SpecChanged(ValueError):
    """Results of one category spec would be mixed with those of another."""


def append_results(existing: DataFrame, new: DataFrame, spec: dict | None) -> DataFrame:
    """Both, if the existing rows carry this spec; `spec_hash` is the column that tells, null counts as no spec."""
    mark = spec_hash(spec)
    if existing.filter(F.coalesce("spec_hash", F.lit("")) != mark).limit(1).count():
        raise SpecChanged("Custom categories changed: results carry another specification")
    return existing.unionByName(new.withColumn("spec_hash", F.lit(mark)), allowMissingColumns=True)


def append_to(path: str, new: DataFrame, spec: dict | None) -> None:
    """Append rows to the results at a path, a folder for each spec; another spec's folder there is an error.

    The check lists folders and reads no rows, so it costs the same whatever is there."""
    mark, name = spec_hash(spec), "spec_hash="
    there = {f.removeprefix(name) for f in children(new.sparkSession, path) if f.startswith(name)}
    if there - {mark or "__HIVE_DEFAULT_PARTITION__"}:
        raise SpecChanged("Custom categories changed: results carry another specification")
    new.withColumn("spec_hash", F.lit(mark or None).cast("string")).write.mode("append").partitionBy("spec_hash").parquet(path)


# Columns of result tables, in order.
RESULT_COLUMNS = ("Domain", "Type", "App_Name", "Developer", "Store_Category", "Rating", "Rating_Count", "Downloads", "Quality", "Justification", "IAB Tier 1", "IAB Tier 2", "IAB Tier 3", "Description", "Language", "Political_Leaning", "Audience_Size", "Bot_Protection", "Content_Length", "Processing_Time", "Scrape_Mode", "Classifier_Mode", "Scraped_At", "Cost_USD")
CTV_RESULT_COLUMNS = ("App_Name", "Type", "Bundle_ID", "SSP", "Publisher", "Platform", "URL", "Quality", "Justification", "IAB Tier 1", "IAB Tier 2", "IAB Tier 3", "Description", "Target_Audience", "Content_Type", "Language", "Political_Leaning", "Network_Affiliation", "Audience_Size", "Research_Summary", "Processing_Time", "Research_Model", "Classification_Model", "Processed_At", "Cost_USD")


def _or(c: str, default: str) -> Column:
    v = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.when(v == "", default).otherwise(v)


def assemble_results(items: DataFrame, evidence: DataFrame, labels: DataFrame, attempts: DataFrame, calls: DataFrame) -> DataFrame:
    """The 24-column result row of every work item that was tried.

    items (item, type); evidence (item, app_name, developer, store_category, rating, rating_count,
    downloads, content_length, scraped_at); labels (item, quality, ..., tier1..tier3); one run's attempts.
    """
    state = ladder.latest_state(ladder.bot_protection(attempts)).select("item", "status", "rung", "error", "seconds", "bot_protection")
    rows = items.select("item", "type").join(state, "item").join(evidence, "item", "left").join(labels, "item", "left").join(spend.item_cost(items, calls), "item", "left")
    site = F.col("type") == "website"
    good = (F.col("status") == ladder.SUCCESS) & F.coalesce(F.col("quality"), F.lit("")).isin(*QUALITIES, "Not provided")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    app = lambda c: F.when(site, "").otherwise(text(c))
    pick = lambda c, failed: F.when(good, text(c)).otherwise(failed)
    values = {
        "Domain": text("item"), "Type": F.when(site, "WEBSITE").when(F.col("type") == "ios_app", "IOS").otherwise("ANDROID"),
        "App_Name": app("app_name"), "Developer": app("developer"), "Store_Category": app("store_category"), "Rating": app("rating"), "Rating_Count": app("rating_count"), "Downloads": app("downloads"),
        "Quality": pick("quality", F.lit("Failed")), "Justification": pick("justification", F.concat(F.lit("Processing failed: "), text("error"))),
        "IAB Tier 1": pick("tier1", F.lit("N/A")), "IAB Tier 2": pick("tier2", F.lit("N/A")), "IAB Tier 3": pick("tier3", F.lit("N/A")), "Description": pick("description", F.lit("N/A")),
        "Language": F.when(good, _or("language", "Unknown")).otherwise("Unknown"), "Political_Leaning": F.when(good, _or("political_leaning", "Non-Political")).otherwise("Non-Political"), "Audience_Size": F.when(good, _or("audience_size", "Unknown")).otherwise("Unknown"),
        "Bot_Protection": F.when(site, F.col("bot_protection")).otherwise(""), "Content_Length": _or("content_length", "0"), "Processing_Time": F.coalesce(F.col("seconds").cast("decimal(18,2)").cast("string"), F.lit("")),
        "Scrape_Mode": F.when(site, text("rung")).when(F.col("type") == "ios_app", "ios_api").otherwise("android_scrape"), "Classifier_Mode": F.lit("openrouter"), "Scraped_At": text("scraped_at"), "Cost_USD": text("Cost_USD"),
    }
    return rows.select(*[values[c].alias(c) for c in RESULT_COLUMNS])


def assemble_ctv_results(items: DataFrame, research: DataFrame, labels: DataFrame, calls: DataFrame, n: int = 1000) -> DataFrame:
    """The 25-column result row of every CTV item (key, app_name, bundle_id, ssp, publisher, platform, url).

    research (key, research, research_model, seconds, processed_at); labels (key, quality, ..., tier1..tier3).
    """
    told = summarize_research(gate_research(research), "research", n)
    rows = items.join(told, "key", "left").join(labels, "key", "left").join(spend.item_cost(items, calls, "key"), "key", "left")
    enough = ~F.coalesce(F.col("insufficient"), F.lit(True))
    good = enough & F.coalesce(F.col("quality"), F.lit("")).isin(*QUALITIES)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pick = lambda c, failed: F.when(good, text(c)).otherwise(failed)
    reason = F.when(~enough, "Research failed: No meaningful research evidence available").otherwise(f"Classification failed: {NO_ARGUMENTS}")
    values = {
        "App_Name": text("app_name"), "Type": F.lit("CTV"), "Bundle_ID": text("bundle_id"), "SSP": text("ssp"), "Publisher": text("publisher"), "Platform": _or("platform", "Unknown"), "URL": text("url"),
        "Quality": pick("quality", F.lit("Failed")), "Justification": pick("justification", reason), "IAB Tier 1": pick("tier1", F.lit("N/A")), "IAB Tier 2": pick("tier2", F.lit("N/A")), "IAB Tier 3": pick("tier3", F.lit("N/A")), "Description": pick("description", F.lit("N/A")),
        "Target_Audience": pick("target_audience", F.lit("N/A")), "Content_Type": pick("content_type", F.lit("N/A")), "Language": pick("language", F.lit("Unknown")), "Political_Leaning": pick("political_leaning", F.lit("Non-Political")), "Network_Affiliation": pick("network_affiliation", F.lit("N/A")), "Audience_Size": pick("audience_size", F.lit("Unknown")),
        "Research_Summary": text("summary"), "Processing_Time": F.coalesce(F.col("seconds").cast("decimal(18,2)").cast("string"), F.lit("")), "Research_Model": text("research_model"), "Classification_Model": text("classification_model"), "Processed_At": text("processed_at"), "Cost_USD": text("Cost_USD"),
    }
    return rows.select(*[values[c].alias(c) for c in CTV_RESULT_COLUMNS])


def score(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str = "item string, json string") -> DataFrame:
    """A scorer of one's own over evidence rows; its replies go to `unwrap_replies`. Parallel by partition."""
    ship(df.sparkSession)
    return df.mapInPandas(fn, schema)
