"""WARC archives: write, normalise monolithic gzip, read back by offset.

`write_archives` turns pages into WARC records, response or revisit, and packs a few MB of them at a time
into one whole-file gzip stream. `normalise` inflates each stream once, rewrites every record as a gzip
member of its own and notes offset and length of each. `sidecar` is that index as a table of its own, one
row per record, keyed by the archive's digest; `read_records` joins it to the archives and takes each record
by its index entry alone, inflating nothing else.

Archives are rows (archive binary), so Spark reads and writes them wherever the shared folder is, and a
lost executor's archives are made again; a folder of .warc.gz files is read by Spark's `binaryFile`.
Archives hold at most `archive_bytes` of payload, or one record that is longer.

Of equal payloads of at least 100 bytes the smallest id is the response, the others revisit it; shorter
ones are all responses. Null payloads are empty. Rows that repeat an id with the same payload are all
responses if the id is the smallest, else revisits. Rows without an id revisit like others and are the
response only if no row of the group has an id. An empty table gives no archive. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import ship, stored

ARCHIVES = "archive binary"
NORMALISED = "archive_sha256 string, archive binary, records array<struct<offset:long,length:long,record_id:string>>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
#: A fixed date keeps archives reproducible; crawls bring their own.
DATE = "2024-01-01T00:00:00Z"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def records_of(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int, few: int = 200_000) -> DataFrame:
    """id, url, payload (null for revisits), n_bytes, digest, refers_to."""
    body = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    # who revisits whom is found on digests alone; payloads are shuffled only if that list is too long to broadcast
    brief = rows.filter(F.col("n_bytes") >= least).select("id", "digest")
    groups = brief.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("g_digest"), "first")
    again = brief.join(groups, F.col("digest") == F.col("g_digest")).filter("not (id <=> first)").select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "first").distinct()
    again = stored(again, "revisits")
    again = F.broadcast(again) if again.count() <= few else again
    joined = rows.join(again, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    revisit = F.col("first").isNotNull()
    return joined.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "n_bytes", "digest", F.col("first").alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page/{page_id}')}>"


def pack(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    out, held = zlib.compressobj(1, zlib.DEFLATED, 31), 0
    blocks: list[bytes] = []

    def close():
        return pa.RecordBatch.from_arrays([pa.array([b"".join(blocks) + out.flush()], type=pa.binary())], names=["archive"])

    for batch in batches:
        for page, url, payload, n, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
            kind, body = ("response", payload) if refers is None else ("revisit", b"")
            head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page is None else page}", f"X-Payload-Length: {n}"]
            if url is not None:
                head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
            if refers is not None:
                head += [f"WARC-Refers-To: {record_id(refers)}", f"X-Refers-To-Page-ID: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
            blocks.append(out.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"))
            held += len(body) + 512
            if held >= archive_bytes:
                yield close()
                out, held, blocks = zlib.compressobj(1, zlib.DEFLATED, 31), 0, []
    if held:
        yield close()


def split_records(data: bytes) -> Iterator[bytes]:
    """The records of inflated WARC data, each with its closing blank lines."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at) + 4
        end = head_end + int(headers(data[at:head_end])["content-length"]) + 4
        yield data[at:end]
        at = end


def headers(head: bytes) -> dict[str, str]:
    """Names in lower case; of a value only the one blank after the colon is cut, so outer blanks survive."""
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines if x)}


def members(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for stream in batch.column(0):
            inflate = zlib.decompressobj(31)
            data = inflate.decompress(stream.as_py())
            while inflate.unused_data:  # already in members: the same records come out
                rest = inflate.unused_data
                inflate = zlib.decompressobj(31)
                data += inflate.decompress(rest)
            parts, index, at = [], [], 0
            for record in split_records(data):
                member = gzip.compress(record, level, mtime=0)
                head = headers(record[: record.index(b"\r\n\r\n") + 4])
                index.append({"offset": at, "length": len(member), "record_id": head["warc-record-id"]})
                parts.append(member)
                at += len(member)
            whole = b"".join(parts)
            entries = pa.array([index], type=pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(whole).hexdigest()]), pa.array([whole], type=pa.binary()), entries], names=["archive_sha256", "archive", "records"])


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
    for batch in batches:
        for archive, index in zip(batch.column(0), batch.column(1)):
            whole = memoryview(archive.as_buffer())
            rows = []
            for entry in index.as_py():
                record = gzip.decompress(whole[entry["offset"] : entry["offset"] + entry["length"]])
                cut = record.index(b"\r\n\r\n") + 4
                h = headers(record[:cut])
                body = record[cut : cut + int(h["content-length"])]
                digest, n = h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"])
                if h["warc-type"] == "response":
                    n, made = len(body), hashlib.sha256(body).hexdigest()
                    if made != digest:
                        raise ValueError(f"payload of {h['warc-record-id']} does not have its digest")
                refers = h.get("x-refers-to-page-id")
                rows.append({"page_id": int(h["x-page-id"]) if h["x-page-id"] else None, "payload_bytes": n, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": int(refers) if refers else None, "url": h.get("warc-target-uri")})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, archive_bytes: int = 4 << 20) -> DataFrame:
    """Rows (archive): monolithic gzip streams of WARC records."""
    ship(pages.sparkSession)
    return records_of(pages, id_col, url_col, payload_col, least).mapInArrow(lambda it: pack(it, archive_bytes), ARCHIVES)


def normalise(archives: DataFrame, level: int = 6) -> DataFrame:
    """Rows (archive_sha256, archive, records): one gzip member per record, and where each of them lies."""
    ship(archives.sparkSession)
    return archives.select("archive").mapInArrow(lambda it: members(it, level), NORMALISED)


def sidecar(normalised: DataFrame) -> DataFrame:
    """The offset index: archive_sha256, offset, length, record_id of every record."""
    return normalised.select("archive_sha256", F.inline("records"))


def read_records(archives: DataFrame, index: DataFrame) -> DataFrame:
    """One row per entry of the index, each record inflated by its offset; payload digests of responses are
    recomputed. Equal archives are one; an archive's entries are as many as `archive_bytes` bounds."""
    ship(archives.sparkSession)
    entries = index.groupBy("archive_sha256").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "record_id"))).alias("records"))
    return archives.select("archive_sha256", "archive").join(entries, "archive_sha256").select("archive", "records").mapInArrow(parsed, RECORDS)
