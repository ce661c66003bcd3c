"""WARC [6]: archives written by Spark, and a reader that salvages what damaged ones still hold.

Records end with two line breaks, which is just what Spark's text writer puts between rows, so each file it
writes is a WARC file and no byte passes the driver. Payload copies are found by their SHA-1 before anything
is written; a copy becomes a revisit record.

The reader checks version line, header, length, closing line breaks and digest of each record. After a
failed check it searches for the next version line (or gzip member) that starts a sound record, goes on
from there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import common

#: Fixed values of the format.
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"

#: Records of at most so many bytes, and how many of them a file has; beyond the last size a record has its own file.
FILE_SIZES = [(64 << 10, 1_000), (1 << 20, 64), (0, 1)]
#: More than a record's headers add to its payload and its url, whose line breaks become three letters each.
HEAD_BYTES = 4 << 10
#: Payloads with copies that are broadcast to tell copies; with more, rows are joined by shuffling.
BROADCAST_DIGESTS = 50_000


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: every five hex digits are four base32 digits."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One record a page, in the column value, without its closing line breaks.

    Null html is an empty payload. Of equal payloads the one with the largest id is the response; further
    rows with that id are responses too. Ids of null come before all others. A url loses its line breaks.
    """
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    df = pages.select(pages[id_col].cast("long").alias("id"), F.regexp_replace(F.coalesce(pages[url_col].cast("string"), F.lit("")), r"[\r\n]+", "%0A").alias("url"), html.alias("html"))
    df = df.withColumn("digest", base32_sha1(F.col("html"))).withColumn("size", F.octet_length("html").cast("long"))
    copies, _ = common.written(df.groupBy("digest", "size").agg(F.max("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "copies")
    if copies.count() <= BROADCAST_DIGESTS:
        copies = F.broadcast(copies)
    df = df.join(copies, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    name = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", name(F.col("first"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    return df.withColumn("block", block).select(F.concat(head, "block").alias("value"))


def write(pages: DataFrame, path: str, compression: str = "none", html_col: str = "html", url_col: str = "url", **columns) -> None:
    """Writes the archives of pages as files in the folder path. An empty table gives no records.

    A file has as many records as FILE_SIZES allows their size, so it holds about 64 MB at most, or one record.
    """
    made = records(pages, html_col=html_col, url_col=url_col, **columns)
    length = lambda c: F.coalesce(F.octet_length(pages[c].cast("string")), F.lit(0)).cast("long")
    largest = pages.agg(F.coalesce(F.max(length(html_col) + 3 * length(url_col)), F.lit(0))).first()[0]
    size, least = F.octet_length("value"), 0
    for most, per_file in FILE_SIZES:
        if least == 0 or largest + HEAD_BYTES > least:
            own = made.where((size > least) & (size <= most)) if most else made.where(size > least)
            own.write.mode("append").option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)
        least = most


VERSION = re.compile(rb"WARC/1\.[01]\r\n")


class Broken(ValueError):
    pass


def one_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at a place, and where it ends. Raises Broken, with the end where its length can be trusted."""
    if not VERSION.match(data, at):
        raise Broken("no version line")
    fields: dict = {}
    head_end = data.find(b"\r\n", at)
    while not data.startswith(b"\r\n", head_end + 2):
        begin, head_end = head_end + 2, data.find(b"\r\n", head_end + 2)
        if head_end < 0:
            raise Broken("header without end")
        key, colon, value = data[begin:head_end].partition(b":")
        if not colon:
            raise Broken("header line without colon")
        fields[key.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit():
        raise Broken("no content length")
    begin = head_end + 4
    end = begin + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Broken("length does not lead to the record's end")
    block = data[begin:end]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length: *(\d+)", http)
    fields["payload"], fields["payload_length"] = payload, int(size[1]) if size else len(payload)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("warc-type") == "response" and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise Broken("digest differs")
    return fields, end + 4


def members(data: bytes) -> Iterator[tuple[int, int, bytes, str]]:
    """The gzip members of data: begin, end, content, and for a broken one the reason; its content is what came out before the damage.

    A broken member ends where the next one begins that is whole or whose content begins as an archive.
    """
    at = 0
    while at < len(data):
        content, end, whole = _inflate(data, at)
        if whole:
            yield at, end, content, ""
            at = end
            continue
        then = at
        while True:
            then = data.find(b"\x1f\x8b\x08", then + 1)
            if then < 0:
                break
            head, _, sound = _inflate(data, then)
            if sound or VERSION.match(head):
                break
        then = len(data) if then < 0 else then
        yield at, then, content, "broken gzip member"
        at = then


def _inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, bool]:
    """What a gzip member holds, up to its damage if it has some; where it ends; whether it is whole."""
    d, out = zlib.decompressobj(31), []
    while at < len(data):
        before = d.copy() if step > 1 else None
        try:
            out.append(d.decompress(data[at : at + step]))
        except zlib.error:
            if step == 1:
                break
            d, step = before, max(1, step // 16)
            continue
        if d.eof:
            return b"".join(out), min(len(data), at + step) - len(d.unused_data), True
        at += step
    return b"".join(out), at, False


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """Sound records and quarantined gaps of an archive, in order: begin, end, fields (None for a gap), reason.

    For a compressed archive, places are those of the member that holds the record; a gap inside a member's content
    is reported at that member. Of a damaged member the records before the damage are recovered, and the rest is one gap.
    """
    if data[:2] == b"\x1f\x8b" or (data[:5] != b"WARC/" and b"\x1f\x8b\x08" in data and not VERSION.search(data)):
        for begin, end, content, why in members(data):
            for _, _, fields, reason in salvage(content):
                if fields or not why:
                    yield begin, end, fields, reason
            if why:
                yield begin, end, None, why
        return
    at = 0
    while at < len(data):
        try:
            fields, end = one_record(data, at)
            yield at, end, fields, ""
            at = end
            continue
        except Broken as e:
            why = str(e)
        then = at
        while True:
            found = VERSION.search(data, then + 1)
            if not found:
                then = len(data)
                break
            then = found.start()
            try:
                one_record(data, then)
                break
            except Broken:
                continue
        yield at, then, None, why
        at = then


SCHEMA = "path string, begin long, end long, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, gap string"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each sound record and each gap (its reason in gap, else null) of the archives in a folder."""
    common.ship(spark)
    schema = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), *[(c, pa.string()) for c in ("warc_type", "record_id", "target_uri", "refers_to", "payload_digest")], ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("gap", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                out, held = [], 0
                for begin, end, r, why in salvage(data):
                    if r is None:
                        out.append((file, begin, end, *[None] * 7, why))
                    else:
                        out.append((file, begin, end, r.get("warc-type"), r.get("warc-record-id", "").strip("<>"), r.get("warc-target-uri"), r.get("warc-refers-to", "").strip("<>") or None, r.get("warc-payload-digest", "").removeprefix("sha1:"), r["payload_length"], r["payload"] if payloads else None, None))
                        held += len(r["payload"]) if payloads else 100
                    if held > common.SLICE_BYTES:
                        yield common.rows(schema, *zip(*out, strict=True))
                        out, held = [], 0
                if out:
                    yield common.rows(schema, *zip(*out, strict=True))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def archived(pages: DataFrame, **columns) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back, without payloads."""
    import atexit

    spark = pages.sparkSession
    path = common.new_path(spark, "archives")
    write(pages, path, **columns)
    atexit.register(common.remove, spark, path)
    return read(spark, path, payloads=False)
