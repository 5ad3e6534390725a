"""What an inventory list holds: identifier column, types, work lists, composition, CTV items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.functions import cells, identifiers as ids
from stockyard.sources.tables import ROW

# Names of identifier columns, in order of preference.
CANDIDATES = ("pageURL", "pageurl", "page_url", "domain", "Domain", "url", "URL", "Url", "website", "Website", "site", "Site", "app_id", "appId", "app", "bundle_id", "bundleId", "package", "package_name")
# Parts of names that identifier columns have.
PARTIAL = ("url", "domain", "site", "app", "package")
# Names of type columns.
TYPE_COLUMNS = ("type", "content_type", "content type", "contenttype", "media_type", "media type", "platform")
# Parts of names that only CTV lists have.
CTV_MARKS = ("bundle_id", "bundleid", "bundle id", "ssp", "ctv_app", "ctvapp", "ctv app", "channel_name", "channelname", "channel name", "roku_id", "rokuid", "fire_tv_id", "firetvid", "apple_tv_id", "appletvid", "app, account or network name")
# Names of CTV fields, in order of preference.
CTV_FIELDS = {
    "app_name": ("app_name", "appname", "app name", "app", "name", "channel_name", "channelname", "channel name", "ctv_app", "ctvapp", "ctv app", "app, account or network name"),
    "bundle_id": ("bundle_id", "bundleid", "bundle id", "bundle", "app_id", "appid", "app id", "roku_id", "rokuid", "fire_tv_id", "firetvid", "apple_tv_id", "appletvid"),
    "ssp": ("ssp", "supply_side_platform", "supply side platform"),
    "publisher": ("publisher", "pub", "publisher_name", "publisher name"),
    "platform": ("platform", "ctv_platform", "streaming_platform", "device", "device_type"),
    "url": ("url", "website", "site", "link", "homepage"),
}
TYPES = (ids.IOS, ids.ANDROID, ids.WEBSITE, ids.CTV)


class NoInputColumn(ValueError):
    """No column holds identifiers."""


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "string" and c not in (ROW, "source_file")]


def with_type(df: DataFrame, value: Column, tlds: DataFrame, out: str = "type") -> DataFrame:
    """The type of each value. Spark broadcasts the list of top-level domains if its measured size allows it."""
    known = tlds.select(F.col("tld").alias("__tld")).distinct()
    joined = df.withColumn("__leaf", ids.leaf(cells.strip(value))).join(known, F.col("__leaf") == F.col("__tld"), "left")
    return joined.withColumn(out, ids.typed(value, F.col("__tld").isNotNull())).drop("__leaf", "__tld")


def classify_identifiers(df: DataFrame, col: str, tlds: DataFrame) -> DataFrame:
    """Adds `type` to every row; blank and null values are websites."""
    return with_type(df, _c(col), tlds)


def score_columns(df: DataFrame, sample: int = 200, in_order: bool = False, most: int = 100_000) -> DataFrame:
    """(column, position, sampled, hits, ratio) over the first `sample` filled values of each column, by `row_no`;
    columns without any are left out.

    in_order: the rows come in the order of `row_no`, as from `read_inventory`. Then only the first partitions are
    read: ever more rows, up to `most`, of the columns that still lack values. What is rarer than that, and tables in no
    order, are sampled by a window over all rows."""
    names = _data_columns(df)
    found: dict[str, tuple[int, int]] = {}
    lacking, n = list(names), 8 * sample
    while in_order and lacking and n <= most:
        told = [F.when(cells.strip(cells.null_if_missing(_c(c))) != "", ids.looks_processable(cells.strip(_c(c)))).alias(f"x{i}") for i, c in enumerate(lacking)]
        rows = df.select(*told).limit(n).collect()
        for i, c in enumerate(lacking):
            first = [r[i] for r in rows if r[i] is not None][:sample]
            found[c] = (len(first), sum(first))
        lacking = [c for c in lacking if found[c][0] < sample] if len(rows) == n else []
        n *= 8
    schema = "column string, position int, sampled long, hits long, ratio double"
    known = [(c, i, *found[c], found[c][1] / found[c][0]) for i, c in enumerate(names) if c not in lacking and found[c][0]]
    out = df.sparkSession.createDataFrame(known, schema)
    if not lacking:
        return out
    long_ = df.select(ROW, F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), cells.strip(cells.null_if_missing(_c(c))).alias("v")) for i, c in enumerate(names) if c in lacking])).alias("x")).select(ROW, "x.*")
    first = F.row_number().over(Window.partitionBy("position", "column").orderBy(ROW))
    taken = long_.filter("v is not null and v <> ''").withColumn("rn", first).filter(F.col("rn") <= sample)
    scored = taken.groupBy("column", "position").agg(F.count(F.lit(1)).alias("sampled"), F.count_if(ids.looks_processable(F.col("v"))).alias("hits")).withColumn("ratio", F.col("hits") / F.col("sampled"))
    return out.unionByName(scored) if known else scored


def named_input_column(columns: list[str]) -> str | None:
    for c in CANDIDATES:
        if c in columns:
            return c
    low = {c.lower(): c for c in columns}
    for c in CANDIDATES:
        if c.lower() in low:
            return low[c.lower()]
    return next((c for c in columns if any(p in c.lower() for p in PARTIAL)), None)


def resolve_input_column(df: DataFrame, least: float = 0.6, in_order: bool = False) -> str | None:
    """By name, else the column with the largest share of processable values, the first of equals."""
    found = named_input_column(_data_columns(df))
    if found:
        return found
    best = score_columns(df, in_order=in_order).filter(F.col("ratio") >= least).orderBy(F.desc("ratio"), "position").limit(1).collect()
    return best[0]["column"] if best else None


def find_type_column(df: DataFrame, input_col: str | None, least: float = 0.5) -> str | None:
    """The first column of a known name whose filled values are mostly spellings of types."""
    skip = (input_col or "").strip().lower()
    names = [c for c in _data_columns(df) if c.strip().lower() in TYPE_COLUMNS and c.strip().lower() != skip]
    if not names:
        return None
    filled = lambda c: cells.strip(cells.null_if_missing(_c(c))) != ""
    shares = df.agg(*[F.avg(F.when(filled(c), ids.stated_type(_c(c)).isNotNull().cast("double"))).alias(f"s{i}") for i, c in enumerate(names)]).first()
    return next((c for i, c in enumerate(names) if shares[f"s{i}"] is not None and shares[f"s{i}"] >= least), None)


def recover_headerless(df: DataFrame, tlds: DataFrame, keep_duplicates: bool = False, share: float = 0.8) -> DataFrame:
    """A one-column list whose header is its first value, as column `Domain`; other tables unchanged."""
    names = _data_columns(df)
    if len(names) != 1 or cells.is_artifact_name(names[0]) or names[0].strip().lower() in {c.lower() for c in CANDIDATES}:
        return df
    spark, header = df.sparkSession, names[0].strip()
    values = df.select(cells.strip(cells.null_if_missing(_c(names[0]))).alias("Domain"), ROW).filter("Domain is not null and Domain <> ''")
    first = spark.range(1).select(F.lit(header).alias("Domain"), F.lit(-1).cast("long").alias(ROW))
    is_data = first.select(ids.looks_processable(F.col("Domain")).alias("x")).first().x
    if not is_data and not keep_duplicates:
        got = with_type(values, F.col("Domain"), tlds).agg(F.avg((F.col("type") == ids.WEBSITE).cast("double")).alias("s")).first().s
        is_data = got is not None and got >= share
    if not is_data:
        return df
    out = first.unionByName(values)
    return out if keep_duplicates else out.groupBy("Domain").agg(F.min(ROW).alias(ROW))


def build_work_items(df: DataFrame, tlds: DataFrame, input_col: str | None = None, in_order: bool = False) -> DataFrame:
    """(row_no, identifier, type, original_value, hinted): distinct cleaned identifiers, first row of each."""
    column = input_col or resolve_input_column(df, in_order=in_order)
    if column is None:
        # Fixed value: the message that callers look for.
        raise NoInputColumn("Input file must contain a recognizable column (pageURL, domain, url, etc.) or a 'Domain' column")
    names = _data_columns(df)
    rows = df.select(ROW, cells.clean(_c(column)).alias("identifier"), *[_c(c).alias(f"__{i}") for i, c in enumerate(names)]).filter("identifier <> ''")
    first = rows.groupBy("identifier").agg(F.min_by(F.struct(*rows.columns), ROW).alias("r")).select("r.*")
    back = first.select(ROW, "identifier", *[F.col(f"__{i}").alias(c) for i, c in enumerate(names) if c not in ("identifier",)])
    hint = find_type_column(back, column)
    stated = ids.stated_type(_c(hint)) if hint else F.lit(None).cast("string")
    out = with_type(back.select(ROW, "identifier", stated.alias("stated")), F.col("identifier"), tlds, "detected")
    return out.select(ROW, "identifier", F.coalesce("stated", "detected").alias("type"), F.col("identifier").alias("original_value"), F.col("stated").isNotNull().alias("hinted"))


def profile_batch(items: DataFrame, dominant: float = 0.9) -> DataFrame:
    """(type, n, share, dominant): all four types, and the one that prevails, if any."""
    kinds = items.sparkSession.createDataFrame([(i, t) for i, t in enumerate(TYPES)], "place int, type string")
    counts = items.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    out = F.broadcast(kinds).join(counts, "type", "left").select("place", "type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = out.agg(F.sum("n").alias("t")).first().t or 0
    share = F.col("n") / F.lit(float(max(total, 1)))
    return out.select("type", "n", share.alias("share"), (share >= dominant).alias("dominant"))


def breakdown(df: DataFrame, col: str, tlds: DataFrame, by: tuple[str, ...] = ("source_file",), type_col: str | None = None) -> DataFrame:
    """websites, ios, android and total per group; rows with blank cells do not count."""
    rows = df.select(*by, cells.clean(_c(col)).alias("__v"), (ids.stated_type(_c(type_col)) if type_col else F.lit(None).cast("string")).alias("__s")).filter("__v <> ''")
    rows = with_type(rows, F.col("__v"), tlds, "__t").withColumn("t", F.coalesce("__s", "__t"))
    count = lambda t: F.count_if(F.col("t") == t)
    return rows.groupBy(*by).agg(count(ids.WEBSITE).alias("websites"), count(ids.IOS).alias("ios"), count(ids.ANDROID).alias("android"), F.count(F.lit(1)).alias("total"))


def ctv_breakdown(df: DataFrame, by: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """ctv and total per group: rows with a bundle id (without such a column: an app name); no dedupe."""
    fields = ctv_columns(_data_columns(df))
    column = fields["bundle_id"] or fields["app_name"] or _data_columns(df)[0]
    return df.filter(cells.clean(_c(column)) != "").groupBy(*by).agg(F.count(F.lit(1)).alias("ctv")).withColumn("total", F.col("ctv"))


def breakdown_shares(counts: DataFrame, by: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """Non-zero types in fixed order with their share in percent (2 places) and a label."""
    kinds = [k for k in ("websites", "ios", "android", "ctv") if k in counts.columns]
    parts = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("n")) for k in kinds]), lambda x: x["n"] > 0)
    share = lambda n: F.round(n.cast("decimal(20,0)") * 100 / F.col("total").cast("decimal(20,0)"), 2).cast("decimal(5,2)")
    rows = counts.select(*by, "total", F.posexplode(parts).alias("place", "p")).select(*by, "place", "p.kind", "p.n", share(F.col("p.n")).alias("percent"))
    return rows.withColumn("label", F.concat(F.col("n").cast("string"), F.lit(" "), F.col("kind")))


def is_ctv_list(columns: list[str]) -> bool:
    low = [c.lower().strip() for c in columns]
    has = lambda *parts: any(all(p in c for p in parts) for c in low)
    return any(has(m) for m in CTV_MARKS) or has("ctv") or has("connected") or any(" ".join(c.lower().replace("_", " ").split()) == "app bundle" for c in columns) or (has("ssp") and has("bundle", "id") and has("app", "network"))


def ctv_columns(columns: list[str]) -> dict[str, str | None]:
    """The column of each CTV field; of names equal in lower case the last one counts."""
    low = {c.lower().strip(): c for c in columns}
    out = {f: next((low[n] for n in names if n in low), None) for f, names in CTV_FIELDS.items()}
    out["app_name"] = out["app_name"] or next((c for k, c in low.items() if "app" in k and "name" in k and "id" not in k), None)
    out["bundle_id"] = out["bundle_id"] or next((c for c in columns if " ".join(c.lower().replace("_", " ").split()) == "app bundle"), None)
    return out


def build_ctv_items(df: DataFrame) -> DataFrame:
    """One row per row with an app name: the CTV fields, platform stated or inferred, and the row as a map."""
    names = _data_columns(df)
    f = ctv_columns(names)
    f["app_name"] = f["app_name"] or names[0]
    value = lambda k: cells.clean(_c(f[k])) if f[k] else F.lit("")
    bundle = value("bundle_id")
    app = F.when(bundle != "", bundle).otherwise(value("app_name")) if f["app_name"] == f["bundle_id"] else value("app_name")
    inferred = ids.ctv_platform(bundle)
    platform = F.when(value("platform") != "", value("platform")).when((bundle != "") & (inferred != "Unknown"), inferred).otherwise("")
    row = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.coalesce(_c(c), F.lit("")) for c in names]))
    out = df.select(ROW, app.alias("app_name"), bundle.alias("bundle_id"), value("ssp").alias("ssp"), value("publisher").alias("publisher"), platform.alias("platform"), value("url").alias("url"), row.alias("original_row"))
    return out.filter("app_name <> ''").withColumn("key", F.when(F.col("bundle_id") != "", F.col("bundle_id")).otherwise(F.col("app_name")))


def infer_ctv_platform(df: DataFrame, col: str) -> DataFrame:
    """Adds `platform` by the form of the bundle id; Unknown for nulls, blanks and other forms."""
    return df.withColumn("platform", ids.ctv_platform(_c(col)))


def platform_mix(df: DataFrame, col: str) -> DataFrame:
    """(platform, n) over all rows, repeated ones too."""
    return infer_ctv_platform(df, col).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


def distinct_ctv_apps(df: DataFrame, col: str = "app_name") -> DataFrame:
    """One row per app name, the first; blank words left out."""
    rows = df.withColumn("__app", cells.clean(_c(col))).filter("__app <> ''")
    inner = [c for c in df.columns if c != col]
    return rows.groupBy(F.col("__app").alias(col)).agg(F.min_by(F.struct(*[_c(c) for c in inner]), ROW).alias("__r")).select(col, "__r.*")


def items_of_type(items: DataFrame, kind: str) -> DataFrame:
    """The items of one type; those without a type are of none."""
    return items.filter(F.col("type") == kind)
