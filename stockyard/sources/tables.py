"""Reading and writing inventory, results, logs and reference tables."""

from __future__ import annotations

import csv
import io
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.functions.cells import is_artifact_name, is_missing, null_if_missing, strip
from stockyard.functions import cells
from stockyard.shipping import files_of, stored
from stockyard.sources import splits

ROW = "row_no"


def header_names(fields: list[str]) -> list[str]:
    """Names of a header line: blanks are "Unnamed: i"; repeats get .1, .2, ... past names in use, named fields first."""
    out = [name if name else f"Unnamed: {i}" for i, name in enumerate(fields)]
    order = [i for i, f in enumerate(fields) if f] + [i for i, f in enumerate(fields) if not f]
    left = list(out)
    taken: set[str] = set()
    for i in order:
        name, k = out[i], 0
        while name in taken or (k and name in left):
            k += 1
            name = f"{out[i]}.{k}"
        left[i] = None
        out[i] = name
        taken.add(name)
    return out


def _first_record(text: str, sep: str) -> list[str]:
    for record in csv.reader(io.StringIO(text, newline=""), delimiter=sep):
        if any(x.strip() for x in record):
            return record
    return []


def separator(head: str) -> str:
    """A comma, unless the first record has one cell by commas and more by semicolons or tabs."""
    if len(_first_record(head, ",")) != 1:
        return ","
    line = next((x for x in head.splitlines() if x.strip()), "")
    best = max((";", "\t"), key=lambda s: (line.count(s), s == "\t"))
    return best if line.count(best) else ","


def _heads(spark: SparkSession, files: list[str]) -> list:
    """For each distinct head (first line, and whether a quoted cell may span lines): its files, and the most cells in a
    line of them by each separator. One pass over lines, summed per task."""
    text = F.regexp_replace("value", "^\ufeff", "")
    lines = splits.texts(spark, files).withColumn("value", text)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1
    head = F.min(F.when(strip(F.col("value")) != "", F.struct("block", "at", "value"))).alias("head")
    found = lines.groupBy("file").agg(head, F.max(odd).alias("spans"), *(F.max(splits.cells(F.col("value"), c)).alias(n) for n, c in (("commas", ","), ("semicolons", ";"), ("tabs", "\t"))))
    found = found.filter("head is not null")
    return found.groupBy("head.value", "spans").agg(F.sort_array(F.collect_list("file")).alias("files"), F.max("commas").alias(","), F.max("semicolons").alias(";"), F.max("tabs").alias("\t")).collect()


def _header(text: str, whole: bool = False) -> tuple[str, list[str]] | None:
    """(separator, first record) of a file that begins with the text; None if more of it may change them."""
    sep = separator(text)
    for s in {",", sep}:
        reader = csv.reader([*(x + "\n" for x in text.split("\n")), "\n"], delimiter=s)
        record = next((r for r in reader if any(x.strip() for x in r)), [])
        if not whole and (not record or reader.line_num > text.count("\n") + 1):
            return None
    return sep, _first_record(text, sep)


def _read_header(spark: SparkSession, file: str, least: int = 2) -> tuple[str, list[str]]:
    """The header of a file, if it spans lines; as many lines as it takes come to the driver, up to eight times too many."""
    while True:
        lines = [r.value for r in splits.texts(spark, [file]).select("value").limit(least).collect()]
        found = _header("\n".join(lines).removeprefix("\ufeff"), len(lines) < least or least > 1 << 16)
        if found:
            return found
        least *= 8


class _Group:
    """Files of one header: where they are, and their shape."""

    def __init__(self, sep: str, fields: list[str], spans: bool):
        self.sep, self.fields, self.spans = sep, fields, spans
        self.files: list[str] = []
        self.width = len(fields)
        self.records: DataFrame | None = None

    def rows(self, spark: SparkSession) -> DataFrame:
        """(file, place, c0, c1, ...): the records behind the header; `place` rises within a file. Cells are valid UTF-8,
        absent ones are blank, blank records are left out."""
        cells_ = [f"c{i}" for i in range(self.width)]
        options = {"sep": self.sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0000", "emptyValue": "", "maxColumns": str(max(20480, self.width + 1))}
        place = F.col("block") + F.col("at")
        if self.spans:
            raw = self.records.select("file", place.alias("place"), F.from_csv("text", ", ".join(f"{c} string" for c in cells_), options).alias("r")).select("file", "place", "r.*")
        else:
            schema = T.StructType([T.StructField(c, T.StringType()) for c in cells_])
            raw = spark.read.schema(schema).options(**options).csv(self.files, header=True, enforceSchema=True)
            at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
            raw = raw.select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + at).alias("place"), *cells_)
        # the filter comes first and has other terms than the cells, as Spark infers a constraint for each set of equal terms
        raw = raw.filter(F.length(strip(F.concat_ws("", *cells_))) > 0)
        return raw.select("file", "place", *[F.coalesce(F.make_valid_utf8(c), F.lit("")).alias(c) for c in cells_])

    def join_lines(self, spark: SparkSession) -> None:
        """Writes the records behind the header (file, text, block, at) and finds the most cells of one. Lines are joined
        where a quoted cell goes on; files are read in splits all the same."""
        lines = splits.texts(spark, self.files)
        lines = lines.withColumn("value", F.when((F.col("block") == 0) & F.col("value").startswith("\ufeff"), F.substring("value", 2, 1 << 30)).otherwise(F.col("value")))
        lines = splits.with_state(lines, splits.state_behind(F.col("value"), self.sep, False), splits.state_behind(F.col("value"), self.sep, True))
        lines = splits.with_sum(lines, F.col("inside") == 0, "before")
        records = splits.joined(lines.withColumn("record", F.col("before") + (F.col("inside") == 0).cast("int")), "record", "\n")
        records = records.filter(F.length(strip(F.col("text"))) > 0)
        first = records.groupBy(F.col("file").alias("__f")).agg(F.min("record").alias("__head"))
        self.records = stored(records.join(first, F.col("file") == F.col("__f")).filter("record > __head").select("file", "text", "block", "at"), "records")
        self.width = max(self.width, self.records.agg(F.max(splits.cells(F.col("text"), self.sep))).first()[0] or 0)


def _groups(spark: SparkSession, files: list[str]) -> list[_Group]:
    """Files by header, in the order of the first file of each."""
    found: dict[tuple, _Group] = {}
    real = {quote_path(f): f for f in files}

    def add(sep: str, fields: list[str], spans: bool, of: list[str], width: int) -> None:
        fields = [f.removeprefix("\ufeff") for f in fields]
        held = found.setdefault((sep, tuple(fields), spans), _Group(sep, fields, spans))
        held.files += of
        held.width = max(held.width, width)

    for r in _heads(spark, files) if files else ():
        named = [real.get(quote_path(unquote(f)), unquote(f)) for f in r.files]
        if r.spans:
            found_here = _header(r.value)  # mostly the first line says all
            for f in [None] if found_here else named:
                add(*(found_here or _read_header(spark, f)), True, named if found_here else [f], 0)
        else:
            sep = separator(r.value)
            add(sep, _first_record(r.value, sep), False, named, r[sep])
    place = {quote_path(f): i for i, f in enumerate(files)}
    for g in found.values():
        g.files.sort(key=lambda f: place.get(quote_path(f), len(place)))
        if g.spans:
            g.join_lines(spark)
    return sorted(found.values(), key=lambda g: place.get(quote_path(g.files[0]), len(place)))


def quote_path(file: str) -> str:
    """One spelling of a file's path, whatever the slashes behind its scheme."""
    scheme, colon, rest = file.partition(":/")
    return f"{scheme}:/{rest.lstrip('/')}" if colon else file


def _file_numbers(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.createDataFrame([(quote_path(f), i) for i, f in enumerate(files)], "n_file string, file_no long")


def _numbered_rows(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """`row_no` from the number of the file and the place in it: 2 M files of 4 TB."""
    path = F.concat(F.regexp_extract("file", "^([^:]*):/+", 1), F.lit(":/"), F.regexp_replace("file", "^[^:]*:/+", ""))
    joined = rows.join(numbers, F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) == F.col("n_file"), "left")
    return joined.withColumn(ROW, F.shiftleft(F.coalesce("file_no", F.lit((1 << 21) - 1)).cast("long"), 42) + F.col("place")).drop("n_file", "file_no")


def read_inventory(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """An all-text table of delimited files, each read by its own header, and `row_no`, rising with the files in the
    order given (those of a folder by name) and with the rows of each; it is not gapless.

    Files that share a header are read together and the tables joined by column name; a column that a file
    lacks is null in its rows. Blank records are left out. Cells beyond the header come in "Unnamed: i"
    columns, as many as any record has; those without any value at the end are dropped. Files are split
    among tasks, those with cells that span lines too. Without any line there are no columns but `row_no`."""
    files = files_of(spark, path)
    numbers, found = _file_numbers(spark, files), []
    for g in _groups(spark, files):
        rows = _numbered_rows(g.rows(spark), numbers)
        names = header_names([*g.fields, *[""] * (g.width - len(g.fields))])
        beyond = [f"c{i}" for i in range(len(g.fields), g.width)]
        used = rows.agg(*[F.max(F.col(c) != "").alias(c) for c in beyond]).first() if beyond else None
        last = max((i for i, c in enumerate(beyond) if used[c]), default=-1)
        found.append(rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names[: len(g.fields) + last + 1])], ROW))
    if not found:
        return spark.createDataFrame([], f"{ROW} long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.select(*[f"`{c}`" for c in out.columns if c != ROW], ROW)


def null_missing(df: DataFrame) -> DataFrame:
    """NULL for the texts that count as missing, in every text column."""
    kinds = dict(df.dtypes)
    return df.select(*[null_if_missing(F.col(f"`{c}`")).alias(c) if kinds[c] == "string" else F.col(f"`{c}`") for c in df.columns])


def clean_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns given with trimmed cells, "" for nulls and missing values, whole numbers without ".0"."""
    return df.withColumns({c: cells.clean(F.col(f"`{c}`")) for c in cols})


def drop_artifact_columns(df: DataFrame) -> DataFrame:
    """Without columns whose name is blank or "Unnamed: i" and that hold no value."""
    named = [c for c in df.columns if is_artifact_name(c)]
    if not named:
        return df
    counts = df.agg(*[F.count_if(~is_missing(F.col(f"`{c}`")) & (strip(F.col(f"`{c}`")) != "")).alias(f"n{i}") for i, c in enumerate(named)]).first()
    empty = {c for i, c in enumerate(named) if not counts[f"n{i}"]}
    return df.select(*[f"`{c}`" for c in df.columns if c not in empty])


def normalize_items(df: DataFrame, col: str, longest: int = 512) -> tuple[DataFrame, DataFrame]:
    """Trimmed items without blanks, first spelling of each; and the rejected ones (too long, line breaks)."""
    rows = df.select(ROW, strip(F.col(col)).alias("item")).filter("item is not null and item <> ''")
    bad = (F.length("item") > longest) | F.col("item").rlike(r"[\r\n]")
    good = rows.filter(~bad).groupBy(F.lower("item").alias("k")).agg(F.min(F.struct(ROW, "item")).alias("first"))
    return good.select("first.*"), rows.filter(bad)


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A result table, each file read by its own header; cells are found by name, whatever their order there.

    The columns are those of the files in order of appearance, "" where a file or a short row lacks one; of a name
    that a header repeats the first column counts. Cells beyond the header and blank records are left out, a record
    broken off at the end has what it has, broken UTF-8 is replaced. Without any line there are no columns."""
    files, found, names = files_of(spark, path), [], {}
    for g in _groups(spark, files):
        first = {name: i for i, name in reversed(list(enumerate(g.fields)))}
        names |= dict.fromkeys(name for name in g.fields if name not in names)
        found.append(g.rows(spark).select(*[F.col(f"c{i}").alias(name) for name, i in first.items()]))
    if not found:
        return spark.createDataFrame([], T.StructType([]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])


def write_results(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns given, in that order; absent ones blank, others left out. Records end in CRLF, each file begins with
    the header; a table without rows is a file with nothing else.

    Spark's writer ends records with one character, so each record's last cell brings the carriage return and
    cells are quoted here: those with a quote, separator or line break, and a lone empty cell."""
    def cell(c: Column) -> Column:
        special = c.rlike('[",\\r\\n]') | ((c == "") & F.lit(len(columns) == 1))
        return F.when(special, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    def record(cells: list[Column]) -> Column:
        return F.concat(F.concat_ws(",", *cells), F.lit("\r"))

    out = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in columns]
    head = record([cell(F.lit(c)) for c in columns])
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    line = record([cell(c) for c in out])
    lines = df.select(F.when(first, F.concat(head, F.lit("\n"), line)).otherwise(line).alias("line"))
    if not df.limit(1).count():
        lines = df.sparkSession.range(0, 1, 1, 1).select(head.alias("line"))
    lines.write.mode("overwrite").text(path)


def migrate_results(df: DataFrame, columns: list[str]) -> DataFrame:
    """To the columns given: old decision names renamed unless the new one is there, absent ones blank."""
    old = {c: "Decision_" + c.removeprefix("TypeSafe_") for c in df.columns if c.startswith("TypeSafe_")}
    df = df.withColumnsRenamed({a: b for a, b in old.items() if b not in df.columns})
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])


def export_results(df: DataFrame) -> DataFrame:
    """The results without what they cost; all rows and other columns stay."""
    return df.drop("Cost_USD")


ATTEMPT_LOG = "timestamp string, domain string, ok boolean, status_code int, error string, elapsed_sec double, retries_used int"


def read_attempts(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The attempt log, one JSON object a line; absent and wrong values are null, a broken line is a row of nulls."""
    return (spark.readStream if stream else spark.read).schema(ATTEMPT_LOG).json(path)


def write_attempts(df: DataFrame, path: str) -> None:
    """Append attempts to the log; nulls are left out of a line, other columns of the log."""
    df.select(*[f.split()[0] for f in ATTEMPT_LOG.split(", ")]).write.mode("append").json(path)


PROGRESS = "total_domains long, start_time string, last_updated string, processed_domains map<string,struct<status:string,timestamp:string,processing_time:double,error:string,mode:string>>"


def explode_progress(df: DataFrame, col: str = "value") -> DataFrame:
    """One row per item of progress documents, with the document's totals and the other columns of `df`."""
    kept = [c for c in df.columns if c != col]
    doc = F.from_json(F.col(col), PROGRESS)
    totals = ["total_domains", "start_time", "last_updated"]
    return df.select(*kept, doc.alias("d")).select(*kept, *[f"d.{c}" for c in totals], F.explode_outer("d.processed_domains").alias("item", "entry")).select(*kept, *totals, "item", "entry.*")


def read_progress(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """The items of every progress document (one a file, or one a line), with the columns that its folders name.

    A document of its own file is walked in splits and never held whole: see `walk_progress`. A document without
    items is one row without an item; what is no document has no totals either."""
    return walk_progress(spark, path) if whole else explode_progress(spark.read.text(path))


def walk_progress(spark: SparkSession, path: str) -> DataFrame:
    """`explode_progress` of files with one document each.

    Files are cut behind every brace that closes. Quotes and depth carry over cuts and splits, so cuts within texts
    are known, and a piece that ends at depth 2 or less ends an entry, a section or the document. Such units, an entry
    each, are parsed on their own, in the section that they lie in."""
    rows = splits.texts(spark, path, "}")
    named = [c for c in rows.columns if c not in ("file", "block", "at", "value")]
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    odd = (F.length(plain) - F.length(F.replace(plain, F.lit('"')))) % 2
    rows = splits.with_state(rows, odd, 1 - odd)
    bare = F.regexp_replace(F.when(F.col("inside") == 1, F.concat(F.lit('"'), plain)).otherwise(plain), '"[^"]*("|$)', "")
    # outside quotes behind the piece; the last piece of a file has no brace, but ends no unit that is needed
    rows = rows.withColumn("closes", F.col("inside") == odd)
    rows = rows.withColumn("step", F.length(bare) - F.length(F.replace(bare, F.lit("{"))) - F.col("closes").cast("int"))
    rows = stored(splits.with_sum(rows, F.col("step"), "depth"), "pieces")
    ends = F.col("closes") & (F.col("depth") + F.col("step") <= 2)
    rows = splits.with_sum(rows.withColumn("ends", ends), ends, "unit")
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value", "depth", "step", "ends")))
    units = rows.groupBy("file", "unit").agg(parts.alias("p"))
    first, end = F.get("p", F.lit(0)), F.element_at("p", -1)
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    text = F.regexp_replace(text, r"^[\s,\ufeff]+", "")
    units = units.filter(end["ends"]).select("file", "unit", first["depth"].alias("from"), (end["depth"] + end["step"]).alias("to"), text.alias("text"))
    closed = F.concat(F.col("text"), F.repeat(F.lit("}"), F.col("to").cast("int")))
    units = units.withColumn("doc", F.when(F.col("from") <= 0, closed).when(F.col("from") == 1, F.concat(F.lit("{"), closed)))
    opened = units.filter("`from` < 2 and `to` = 2").select("file", "unit", F.element_at(F.json_object_keys("doc"), -1).alias("name"))
    opened = opened.groupBy(F.col("file").alias("o_file")).agg(F.array_sort(F.collect_list(F.struct("unit", "name"))).alias("sections"))
    units = units.join(opened, F.col("file") == F.col("o_file"), "left")
    section = F.element_at(F.filter("sections", lambda s: s["unit"] < F.col("unit")), -1)["name"]
    doc = F.coalesce("doc", F.when(section == "processed_domains", F.concat(F.lit('{"processed_domains":{'), "text", F.repeat(F.lit("}"), F.col("to").cast("int")))))
    found = stored(units.select("file", F.from_json(doc, PROGRESS).alias("d")), "units")
    totals = ["total_domains", "start_time", "last_updated"]
    files = splits.texts(spark, path).groupBy("file").agg(*[F.any_value(c).alias(c) for c in named])
    per = found.groupBy(F.col("file").alias("t_file")).agg(*[F.max(f"d.{c}").alias(c) for c in totals])
    entries = found.select(F.col("file").alias("e_file"), F.explode("d.processed_domains").alias("item", "entry"))
    out = files.join(per, F.col("file") == F.col("t_file"), "left").join(entries, F.col("file") == F.col("e_file"), "left")
    return out.select(*named, *totals, "item", "entry.*")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, name, tier1..tier4) of tab-separated files: a description line, a header line, then rows.

    Cells are found by the header's names; a column that a file lacks is "". `line_no` rises with the lines of
    a file, without being gapless."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("file").agg(F.min("at").alias("first"))
    placed = lines.join(first, "file")
    header = placed.filter("at = first + 1").select("file", F.transform(F.split(strip(F.col("value")), "\t"), strip).alias("names"))
    parts = placed.filter("at > first + 1 and value <> ''").join(header, "file").select(F.col("at").alias("line_no"), F.split("value", "\t").alias("p"), "names")
    cell = lambda n: F.coalesce(strip(F.get("p", (F.array_position("names", F.lit(n)) - 1).cast("int"))), F.lit(""))
    return parts.select("line_no", cell("Name").alias("name"), *[cell(f"Tier {i}").alias(f"tier{i}") for i in range(1, 5)])


def read_tlds(spark: SparkSession, path: str) -> DataFrame:
    """(tld) of a list with # comments."""
    return spark.read.text(path).select(F.lower(strip(F.col("value"))).alias("tld")).filter("tld <> '' and not startswith(tld, '#')").distinct()
