"""Evidence out of landed payloads: pages, store pages, store JSON, validation, redirects."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from contextlib import suppress
from html.entities import html5
from html.parser import HTMLParser
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.functions.cells import once, shortened, strip
from stockyard.shipping import ship

# Phrases of block pages, markers of anti-bot failures.
BLOCK_PHRASES = ("access denied", "attention required", "captcha", "forbidden", "just a moment", "service unavailable", "temporarily unavailable")
ANTIBOT = ("anti-bot", "document_antibot", "block page detected", "http status 401", "http status 403", "http status 429")
PLAY_BLOCKED = ("captcha", "unusual traffic", "automated queries", "please try again", "access denied", "we're sorry")
# Second-level labels that are public suffixes.
PUBLIC_SECOND = ("co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "go")
# Names of the charsets that the JVM decodes; any other goes through Python.
UTF_8, LATIN_1, ASCII = ("", "utf-8", "utf8", "utf_8"), ("iso-8859-1", "iso8859-1", "iso_8859-1", "latin-1", "latin1", "latin_1", "l1"), ("us-ascii", "ascii", "646")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that a page's content leaves out; elements whose text is not part of any text; elements
# that hold plain text, with and without character references.
NOISE = frozenset(("script", "style", "noscript"))
QUIET = frozenset(("script", "style", "template", "rt", "rp"))
RAW_TEXT = frozenset(("xmp", "iframe", "noembed", "noframes"))
ESCAPABLE = frozenset(("title", "textarea"))
_REFERENCE = re.compile(r"&#([0-9]+|[xX][0-9a-fA-F]+);?|&([a-zA-Z][-.a-zA-Z0-9]*);?")
_UNFINISHED = re.compile(r"</?[a-zA-Z]|<!|<\?")


def numeric_reference(name: str) -> str:
    n = int(name[1:], 16) if name[0] in "xX" else int(name)
    if not n or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
        return "\ufffd"
    return bytes([n]).decode("cp1252", "ignore") or chr(n) if 0x80 <= n <= 0x9F else chr(n)


def named_reference(name: str) -> str:
    """A known reference with or without its semicolon; an unknown one loses the semicolon."""
    return html5.get(name) or html5.get(name + ";") or "&" + name


class Element:
    """One element: places of its texts, descendants and marks in the page's lists, from its start to its end."""

    __slots__ = ("tag", "attrs", "noise", "text", "text_end", "place", "inner_end", "mark", "mark_end", "last", "after")

    def __init__(self, tag: str, attrs: dict[str, str], noise: bool, text: int, place: int, mark: int):
        self.tag, self.attrs, self.noise = tag, attrs, noise
        self.text, self.place, self.mark = text, place, mark
        self.text_end = self.inner_end = self.mark_end = -1
        self.last: Element | None = None
        self.after: Element | None = None


class Page(HTMLParser):
    """Flat lists of one document's elements and texts, made in one pass: time grows with the markup alone.

    Open elements are counted by name, so an end tag that closes nothing costs one look; each element is
    pushed and popped once, and knows where its texts and descendants end and which element follows it."""

    def __init__(self, markup: str = "", marked: str = "category") -> None:
        super().__init__(convert_charrefs=False)
        self.marked, self.marks, self.mark = marked, [], 0  # events that mention the marked word
        self.texts: list[str] = []
        self.shown: list[bool] = []  # is the text part of the page's text?
        self.plain: list[bool] = []  # and not inside an element that content leaves out?
        self.elements: list[Element] = []
        self.stack: list[Element] = [Element("", {}, False, 0, -1, 0)]
        self.opened: Counter[str] = Counter()
        self.closed_voids: Counter[str] = Counter()
        self.noise = self.quiet = 0
        self.buffer: list[str] = []
        self.feed(markup)
        self.close()
        self.flush()
        while len(self.stack) > 1:
            self.pop()
        lengths = (len(t.strip()) * s for t, s in zip(self.texts, self.shown))
        self.before = [0, *accumulate(lengths)]

    def noted(self, *strings: str) -> None:
        self.mark += 1
        if any(self.marked in x.lower() for x in strings):
            self.marks.append(self.mark)

    def flush(self, shown: bool | None = None) -> None:
        if not self.buffer:
            return
        text = "".join(self.buffer)
        self.buffer = []
        self.noted(text)
        self.texts.append(text if text.strip(" \n\t\f\r") else "\n" if "\n" in text else " ")
        self.shown.append(not self.quiet if shown is None else shown)
        self.plain.append(self.shown[-1] and not self.noise)

    def pop(self) -> None:
        e = self.stack.pop()
        self.opened[e.tag] -= 1
        self.noise -= e.tag in NOISE
        self.quiet -= e.tag in QUIET
        e.text_end, e.inner_end, e.mark_end = len(self.texts), len(self.elements), self.mark

    def begin(self, tag: str, attrs: list) -> None:
        self.flush()
        found: dict[str, str] = {}
        for k, v in attrs:
            found[k] = v or ""
        self.noted(tag, *found, *found.values())
        e = Element(tag, found, bool(self.noise), len(self.texts), len(self.elements), self.mark)
        top = self.stack[-1]
        if top.last is not None:
            top.last.after = e
        top.last = e
        self.elements.append(e)
        self.stack.append(e)
        self.opened[tag] += 1
        self.noise += tag in NOISE
        self.quiet += tag in QUIET

    def finish(self, tag: str) -> None:
        self.flush()
        if self.opened[tag]:
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.begin(tag, attrs)
        if tag in VOID:  # closed at once; an end tag of it later is swallowed
            self.finish(tag)
            self.closed_voids[tag] += 1
        elif tag in RAW_TEXT or tag in ESCAPABLE:
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.begin(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.closed_voids[tag]:
            self.closed_voids[tag] -= 1
        else:
            self.finish(tag)

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag in ESCAPABLE and "&" in data:
            data = _REFERENCE.sub(lambda m: numeric_reference(m[1]) if m[1] else named_reference(m[2]), data)
        self.buffer.append(data)

    def handle_charref(self, name: str) -> None:
        self.buffer.append(numeric_reference(name))

    def handle_entityref(self, name: str) -> None:
        self.buffer.append(named_reference(name))

    def handle_comment(self, data: str) -> None:
        self.flush()
        self.noted(data)

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data: str) -> None:
        self.flush()
        if data[:6].lower() == "cdata[":
            self.buffer.append(data[6:])
            self.flush(shown=True)
        else:
            self.noted(data)

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections end where they first can, whatever their keyword."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        close = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        j = self.rawdata.find(close, i + 3)
        if j >= 0:
            self.unknown_decl(self.rawdata[i + 3 : j])
            return j + len(close)
        return -1

    def close(self) -> None:
        """What the last tag or comment leaves open is dropped with the rest; open text elements and CDATA end here."""
        rest = self.rawdata
        if self.cdata_elem or rest.startswith("<![CDATA["):
            self.rawdata = ""
            self.handle_data(rest) if self.cdata_elem else self.unknown_decl(rest[3:])
            self.clear_cdata_mode()
        elif _UNFINISHED.match(rest):
            self.rawdata = ""
        super().close()

    def text_of(self, e: Element, sep: str = "") -> str:
        parts = (t.strip() for t, s in zip(self.texts[e.text : e.text_end], self.shown[e.text : e.text_end]) if s)
        return sep.join(p for p in parts if p)

    def length_of(self, e: Element) -> int:
        """Length of `text_of`, without making it."""
        return self.before[e.text_end] - self.before[e.text]

    def mentions(self, e: Element) -> bool:
        """Does the element's markup, inside or in its own tag, hold the marked word?"""
        at = bisect_left(self.marks, e.mark)
        return at < len(self.marks) and self.marks[at] <= e.mark_end

    def inside(self, e: Element, tag: str) -> Element | None:
        return next((x for x in islice(self.elements, e.place + 1, e.inner_end) if x.tag == tag), None)

    def find(self, tag: str | None = None, **attrs: str) -> Element | None:
        want = {k.replace("_", "-"): v for k, v in attrs.items()}
        return next((e for e in self.elements if (tag is None or e.tag == tag) and all(e.attrs.get(k) == v for k, v in want.items())), None)

    def site(self) -> tuple[str, str, str]:
        """Title, meta description and content; scripts, styles and noscript take no part."""
        title = next((e for e in self.elements if e.tag == "title" and not e.noise), None)
        own = self.texts[title.text : title.text_end] if title else []
        meta = next((e for e in self.elements if e.tag == "meta" and not e.noise and e.attrs.get("name") == "description"), None)
        content = (t.strip() for t, p in zip(self.texts, self.plain) if p)
        return own[0].strip() if len(own) == 1 else "", (meta.attrs.get("content", "") if meta else "").strip(), " ".join(t for t in content if t)


def parse(markup: str | None) -> Page:
    return Page(markup or "")


def extract_pages(df: DataFrame, url: str = "url", html: str = "html", longest: int = 4000) -> DataFrame:
    """(url, title, meta_description, content, content_length) of page payloads.

    Only key and markup go to Python; cutting the text happens after it. Null markup is an empty page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [parse(h).site() for h in pdf["html"]]
            yield pd.DataFrame({"url": pdf["url"], **{n: [x[i] for x in found] for i, n in enumerate(("title", "meta_description", "content"))}})

    ship(df.sparkSession)
    out = df.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, "url string, title string, meta_description string, content string")
    return out.withColumn("content", shortened(F.col("content"), longest)).withColumn("content_length", F.length("content"))


def decode_bodies(df: DataFrame, body: str, content_type: str, out: str = "text") -> DataFrame:
    """Text of response bodies by the charset of their content type; undecodable bytes are dropped.

    Valid UTF-8, Latin-1 and ASCII are decoded by the JVM; only other charsets and broken UTF-8 go through Python.
    """
    ship(df.sparkSession)
    charset = F.lower(F.regexp_extract(F.coalesce(F.col(content_type), F.lit("")), r"""(?i)charset\s*=\s*["']?([^\s;"']+)""", 1))

    @F.pandas_udf("string")
    def decoded(raw: pd.Series, name: pd.Series) -> pd.Series:
        def one(b, c):
            if b is None:
                return None
            try:
                return bytes(b).decode(c or "utf-8", "ignore")
            except LookupError:
                return bytes(b).decode("utf-8", "ignore")

        return pd.Series([one(b, c) for b, c in zip(raw, name)])

    plain, single = F.col(body).cast("string"), F.decode(F.col(body), "ISO-8859-1")
    name = F.col("__charset")
    rows = df.withColumn("__charset", charset)
    valid = F.is_valid_utf8(plain) & name.isin(*UTF_8)
    other = ~valid & ~name.isin(*LATIN_1, *ASCII)
    text = F.when(valid, plain).when(name.isin(*LATIN_1), single).when(name.isin(*ASCII), F.regexp_replace(single, r"[^\x00-\x7F]", ""))
    return rows.withColumn(out, text.otherwise(decoded(F.when(other, F.col(body)), name))).drop("__charset")


def is_antibot(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return low.rlike("|".join(re.escape(m) for m in ANTIBOT))


def validate_content(df: DataFrame, min_len: int = 500) -> DataFrame:
    """Adds `problem` ("" if none; the first failing rule) and `antibot`.

    Reads success, error, status_code, content, content_length.
    """
    text = F.coalesce(F.col("content"), F.lit(""))
    length = F.when(F.coalesce(F.col("content_length"), F.lit(0)) == 0, F.length(text)).otherwise(F.col("content_length"))
    head = F.lower(F.left(text, F.lit(512)))
    status = F.coalesce(F.col("status_code"), F.lit(0))
    problem = (
        F.when(~F.coalesce(F.col("success"), F.lit(False)), F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.col("error")).otherwise("Scraper reported failure"))
        .when((status != 0) & ((status < 200) | (status >= 400)), F.concat(F.lit("Received HTTP status "), status.cast("string")))
        .when(strip(text) == "", "Scraper returned empty content")
        .when(length < min_len, F.concat(F.lit("Scraped content too short ("), length.cast("string"), F.lit(f" chars < {min_len})")))
    )
    for phrase in BLOCK_PHRASES:
        problem = problem.when(head.contains(phrase), f"Potential block page detected ('{phrase}')")
    return df.withColumn("problem", problem.otherwise("")).withColumn("antibot", is_antibot(F.col("problem")))


def host_key(url: Column) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.regexp_replace(host, r"^www\.", "")


def audit_redirects(df: DataFrame, url: str = "url", final_url: str = "final_url") -> DataFrame:
    """Adds `redirect_problem`: the other host, unless one is a subdomain of the other; else ""."""
    a, b = host_key(F.col(url)), host_key(F.col(final_url))
    parent = F.when(F.length(a) > F.length(b), b).otherwise(a)
    child = F.when(F.length(a) > F.length(b), a).otherwise(b)
    labels = F.split(parent, r"\.")
    same = child.endswith(F.concat(F.lit("."), parent)) & (F.size(labels) >= 2) & ~((F.size(labels) == 2) & labels[0].isin(*PUBLIC_SECOND))
    return df.withColumn("redirect_problem", F.when((a != b) & ~same, F.concat(F.lit("URL redirected to different host: "), b)).otherwise(""))


def expand_targets(df: DataFrame, col: str) -> DataFrame:
    """One row per URL to try: with a scheme, then the www. host of plain two-label hosts."""

    def www(x: Column) -> Column:
        authority = x["authority"]
        plain = ~authority.startswith("www.") & ~authority.rlike("[:@]") & (F.size(F.split(authority, r"\.")) == 2) & (authority != "")
        other = F.when(plain, F.regexp_replace(x["target"], "^(https?://)", "$1www."))
        return F.filter(F.array(x["target"], other), lambda t: t.isNotNull())

    target = once(F.col(col), lambda v: F.when(v.startswith("http://") | v.startswith("https://"), v).otherwise(F.concat(F.lit("https://"), v)))
    targets = once(target, lambda t: once(F.struct(t.alias("target"), F.coalesce(F.try_parse_url(t, F.lit("AUTHORITY")), F.lit("")).alias("authority")), www))
    return df.withColumn("__t", targets).select(*df.columns, F.posexplode("__t").alias("attempt", "target"))


# Patterns of store pages. A number is only tried from its first digit on, so long ones cost no more.
_S = r"[\s\x1c-\x1f\x85]"
_DOWNLOADS = tuple(re.compile(p + _S + "+" + w, re.I) for p in (r"(?<![\d,])([\d,]+\+?)", r"(?<!\d)(\d+[KMB]?\+?)") for w in ("downloads", "installs"))
_UPDATED = (re.compile(rf"Updated{_S}+on?{_S}*(\w+{_S}+\d+,?{_S}+\d+)", re.I), re.compile(rf"Last updated:?{_S}*(\w+{_S}+\d+,?{_S}+\d+)", re.I))
_RATED = (re.compile(r"(Everyone|Teen|Mature|Adults Only)", re.I), re.compile(rf"Rated for{_S}+(\d+\+?)", re.I), re.compile(rf"Content rating:?{_S}*(\w+)", re.I))
PLAY = "package string, success boolean, error string, app_name string, developer string, category string, rating double, rating_count long, downloads string, description string, last_updated string, content_rating string"


def play_fields(page: Page) -> dict:
    """Name, developer and the rest of a store page, each by the first source that has it."""

    def linked(part: str) -> str | None:
        link = next((e for e in page.elements if e.tag == "a" and part in e.attrs.get("href", "")), None)
        return page.text_of(page.inside(link, "span") or link) if link else None

    def first(patterns, text: str) -> str:
        return next((m[1] for m in (p.search(text) for p in patterns) if m), "")

    def meta(**a: str) -> str:
        found = page.find("meta", **a)
        return found.attrs.get("content", "") if found else ""

    h1, title = page.find("h1", itemprop="name"), page.find("title")
    if h1:
        name = page.text_of(page.inside(h1, "span") or h1)
    elif title:
        name = page.text_of(title).replace(" - Apps on Google Play", "").strip()
    else:
        name = meta(property="og:title")
    if not name:
        # Fixed value: the message that callers look for.
        return {"success": False, "error": "Could not extract app name - page might be blocked or app not found"}
    labels = [e.attrs["aria-label"] for e in page.elements if "aria-label" in e.attrs]
    rating, count = 0.0, 0
    for label in labels:
        if m := re.search(rf"[Rr]ated{_S}+([\d.]+){_S}+stars", label):
            with suppress(ValueError):
                rating = float(m[1])
        if m := re.search(rf"(?<![\d,])([\d,]+){_S}+reviews", label):
            digits = m[1].replace(",", "")
            count = int(digits) if digits else count
    divs = [e for e in page.elements if e.tag == "div"]
    if not rating:
        # a number of more than 100 characters is no rating; so nested text is not read over and over
        texts = (page.text_of(e) for e in divs if 0 < page.length_of(e) <= 100)
        numbers = (float(t) for t in texts if re.fullmatch(r"\d+(?:\.\d*)?|\.\d+", t))
        rating = next((x for x in numbers if 1 <= x <= 5), 0.0)
    developer = linked("/store/apps/dev")
    if developer is None:  # a short div before an element that mentions a category
        developer = next((page.text_of(e) for e in divs if e.after is not None and 0 < page.length_of(e) < 100 and page.mentions(e.after)), "")
    category, genre = linked("/store/apps/category"), page.find(None, itemprop="genre")
    text = "".join(t for t, s in zip(page.texts, page.shown) if s)
    box = page.find(None, data_g_id="description")
    prop = page.find(None, itemprop="description")
    description = page.text_of(box, " ") if box else (prop.attrs.get("content") or page.text_of(prop, " ")) if prop else meta(property="og:description") or meta(name="description")
    return {
        "success": True,
        "error": "",
        "app_name": name,
        "developer": developer,
        "category": category if category is not None else page.text_of(genre) if genre else "",
        "rating": rating,
        "rating_count": count,
        "downloads": first(_DOWNLOADS, text) or next((x for x in (first(_DOWNLOADS, a) for a in labels) if x), ""),
        "description": description,
        "last_updated": first(_UPDATED, text),
        "content_rating": first(_RATED, text),
    }


def extract_play_pages(df: DataFrame, package: str = "package", html: str = "html") -> DataFrame:
    """Store fields of Play pages; block pages are told apart before any markup is parsed."""
    names = [f.split()[0] for f in PLAY.split(", ")]
    head = F.lower(F.left(F.coalesce(F.col("html"), F.lit("")), F.lit(1000)))
    rows = df.select(F.col(package).alias("package"), F.col(html).alias("html")).withColumn("blocked", head.rlike("|".join(re.escape(p) for p in PLAY_BLOCKED)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [{"app_name": "", "rating": 0.0, "rating_count": 0, "package": p, **play_fields(parse(h))} for p, h in zip(pdf["package"], pdf["html"])]
            yield pd.DataFrame({n: [x.get(n, "") for x in found] for n in names})

    ship(df.sparkSession)
    parsed = rows.filter(~F.col("blocked")).select("package", "html").mapInPandas(run, PLAY)
    kinds = {f.split()[0]: f.split()[1] for f in PLAY.split(", ")}
    # Fixed value: the message that callers look for.
    fixed = {"success": F.lit(False), "error": F.lit("Blocked by Google Play Store"), "package": F.col("package")}
    blocked = rows.filter("blocked").select(*[fixed.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names])
    return parsed.unionByName(blocked)


_LOOKUP = (
    "resultCount double, results array<struct<bundleId:string,trackName:string,artistName:string,primaryGenreName:string,genres:array<string>,averageUserRating:string,userRatingCount:string,"
    "description:string,contentAdvisoryRating:string,price:string,currency:string,version:string,releaseDate:string,currentVersionReleaseDate:string,trackViewUrl:string,artworkUrl512:string,"
    "artworkUrl100:string,fileSizeBytes:string,supportedDevices:array<string>>>"
)


def decode_ios_lookup(df: DataFrame, app_id: str = "app_id", json: str = "json") -> DataFrame:
    """Store fields out of lookup replies; a reply without results is an error row."""
    doc = F.from_json(F.col(json), _LOOKUP)
    rows = df.select(F.col(app_id).alias("app_id"), F.col(json).alias("json"), doc.alias("d"), F.get(doc["results"], F.lit(0)).alias("r"))
    text = lambda n: F.coalesce(F.col(f"r.{n}"), F.lit(""))
    number = lambda n: F.coalesce(F.expr(f"try_cast(r.{n} as double)"), F.lit(0.0))
    place = lambda c: F.floor(F.abs(c) * 100 + 0.5) / 100 * F.signum(c)
    error = F.when(F.col("d").isNull() | F.try_parse_json("json").isNull(), "Unexpected error: invalid JSON").when(F.coalesce("d.resultCount", F.lit(0.0)) == 0, "App not found in App Store").when(F.col("r").isNull(), "Unexpected error: list index out of range").otherwise("")
    names = {"bundle_id": "bundleId", "app_name": "trackName", "developer": "artistName", "primary_genre": "primaryGenreName", "description": "description", "content_rating": "contentAdvisoryRating", "version": "version", "release_date": "releaseDate", "last_updated": "currentVersionReleaseDate", "app_store_url": "trackViewUrl"}
    return rows.select(
        "app_id",
        (error == "").alias("success"),
        error.alias("error"),
        *[text(n).alias(out) for out, n in names.items()],
        F.coalesce("r.genres", F.array().cast("array<string>")).alias("genres"),
        place(number("averageUserRating")).alias("rating"),
        number("averageUserRating").alias("raw_rating"),
        number("userRatingCount").cast("long").alias("rating_count"),
        number("price").alias("price"),
        F.coalesce("r.currency", F.lit("USD")).alias("currency"),
        F.coalesce("r.artworkUrl512", text("artworkUrl100")).alias("icon_url"),
        place(F.coalesce(F.expr("try_cast(trim(r.fileSizeBytes) as bigint)"), F.lit(0)) / (1024 * 1024)).alias("file_size_mb"),
        F.coalesce("r.supportedDevices", F.array().cast("array<string>")).alias("supported_devices"),
    )


def store_evidence(df: DataFrame, platform: str, longest: int = 2000) -> DataFrame:
    """Adds `evidence`: labelled lines of the store fields that are there."""
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    always = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit("")))
    score = F.col("raw_rating") if "raw_rating" in df.columns else F.col("rating")
    rated, counted = F.coalesce(score, F.lit(0.0)) != 0, F.coalesce(F.col("rating_count"), F.lit(0)) != 0
    stars = F.concat(F.lit("Rating: "), F.format_string("%.1f", score), F.lit("/5.0"))
    full = F.concat(stars, F.lit(" ("), F.format_number("rating_count", 0), F.lit(" reviews)"))
    about = F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.concat(F.lit("\nDescription:\n"), shortened(F.col("description"), longest)))
    if platform == "ios":
        genres = F.when(F.size("genres") > 0, F.concat(F.lit("All Categories: "), F.array_join("genres", ", ")))
        parts = [always("App Name", "app_name"), always("Developer", "developer"), always("Primary Category", "primary_genre"), genres, F.when(rated & counted, full), line("Content Rating", "content_rating"), about]
    else:
        parts = [always("App Name", "app_name"), always("Developer", "developer"), line("Category", "category"), F.when(rated & counted, full).when(rated, stars), line("Downloads", "downloads"), line("Content Rating", "content_rating"), about]
    return df.withColumn("evidence", F.concat_ws("\n", *parts))


def fetch_stats(attempts: DataFrame, by: list[str], ok: Column | None = None) -> DataFrame:
    """Requests, successes, errors and percent of successes (2 places) by the columns given; a null status is an error."""
    ok = F.col("status") == "success" if ok is None else ok
    n = F.count(F.lit(1))
    good = F.count_if(ok)
    return attempts.groupBy(*by).agg(n.alias("requests"), good.alias("successes"), (n - good).alias("errors"), (good.cast("decimal(20,0)") * 100 / n).cast("decimal(7,2)").alias("success_percent"))
