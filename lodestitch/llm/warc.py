"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a request, a response (or a revisit that names the response with the same
payload in ``WARC-Refers-To``) and a metadata record, tied by ``WARC-Concurrent-To``.
Spark's own text writer makes the files: a record is one value and the line separator is
the CRLF CRLF that ends a WARC record, so archives can be written to any store Spark
knows, as gzip files.  A file is closed after so many records that their mean size makes
about ``FILE_BYTES``.  Files are read back as binary files and parsed by
``Content-Length``, one member and one record at a time.

Reading yields one row per record.  A record may be concurrent to several others, and
to one that is itself concurrent to a third.  Assembly therefore looks for the records
whose target is no response, joins them with the records they name until all have
reached a response or the end of their chain, and then folds the records of a response
into one nested row, with one shuffle and partial aggregation.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.llm.base import arrow_ready
from lodestitch.operators.scratch import Scratch

#: Bytes of one archive file before compression, about, and records at most; bound what a reader holds.
FILE_BYTES, RECORDS_PER_FILE = 64 << 20, 30_000
#: Bytes of headers and small records of a capture besides its payload, about.
_CAPTURE_BYTES = 2_000
#: Steps of concurrent-to that assembly follows from a record; longer chains and rings end there.
MAX_CHAIN = 8
# Fixed value: the base-32 alphabet of RFC 4648.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, payload_bytes long, payload_digest string, fields map<string,string>"


def base32_sha1(data: Column) -> Column:
    """Upper-case base-32 SHA-1 of a string or binary column."""
    digest = F.sha1(data)
    letters = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(_BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _roles(rows: DataFrame, min_bytes: int, store: Scratch) -> DataFrame:
    """Adds ``top`` to rows of ``(row, page_id, size, digest)``: the page_id and row of the response that a row revisits.

    That is the row of the same payload with the largest page_id, the first of several.
    Only payloads of ``min_bytes`` or more are shared.
    """
    first = F.max(F.struct("page_id", (-F.col("row")).alias("before"))).alias("top")
    last = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1 and top.page_id is not null")
    # Written, so that a very common payload meets a plain table and Spark can split the join.
    last = store.write(last.select("digest", F.struct("top.page_id", (-F.col("top.before")).alias("row")).alias("top")))
    other = (F.col("size") >= min_bytes) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top.page_id")))
    return rows.join(last, "digest", "left").withColumn("top", F.when(other, F.col("top")))


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), record_id, F.lit(">"))]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a capture per row of ``pages`` below ``path``.

    Of equal payloads of ``min_bytes`` or more, the page with the largest id is a
    response and the others revisit it.  A null payload is empty.  Rows with the same
    id and payload get the same role; a row without an id revisits a page that has one.
    """
    store = Scratch(pages.sparkSession, "warc-roles")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    # Written once, with the digests and a number for each row, so that a row keeps the id that others name it by.
    rows = store.write(rows.select("*", F.octet_length("payload").alias("size"), base32_sha1(F.col("payload")).alias("digest"), F.monotonically_increasing_id().alias("row")))
    mean = rows.agg(F.avg("size")).first()[0] or 0
    per_file = int(max(3, min(RECORDS_PER_FILE, 3 * FILE_BYTES / (mean + _CAPTURE_BYTES))))
    rows = _roles(rows, min_bytes, store)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))

    def uid(kind: str, row: str = "row") -> Column:
        return F.regexp_replace(F.md5(F.concat_ws("|", F.lit(kind), F.col(row).cast("string"), "digest")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")

    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), page)), r"[\x00-\x20\x7f]", "%20")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    concurrent = ("WARC-Concurrent-To", F.concat(F.lit("<urn:uuid:"), uid("response"), F.lit(">")))
    refers = ("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), uid("response", "top.row"), F.lit(">")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    fields = F.concat(F.lit("page-id: "), page, F.lit("\r\n"))
    request = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n"))
    records = [
        _record("request", uid("request"), [*common, concurrent, ("Content-Type", F.lit("application/http; msgtype=request"))], request),
        F.when(F.col("top").isNull(), _record("response", uid("response"), [*common, digest, http], F.concat(head, "payload"))).otherwise(_record("revisit", uid("response"), [*common, refers, digest, profile, http], head)),
        _record("metadata", uid("metadata"), [*common, concurrent, ("Content-Type", F.lit("application/warc-fields"))], fields),
    ]
    out = rows.select(F.explode(F.array(*records)).alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Headers by lower-case name; the values of one that comes again are joined by a space."""
    found: dict[str, str] = {}
    for name, _, value in (line.decode("utf-8", "replace").partition(":") for line in lines):
        name = name.strip().lower()
        if name:
            found[name] = f"{found[name]} {value.strip()}" if name == "warc-concurrent-to" and name in found else value.strip()
    return found


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a WARC file, gzipped or not."""
    raw = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line)
        headers = _headers(lines)
        size = int(headers.get("content-length", 0))
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("truncated WARC record")
        yield headers, block


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind, payload, size, digest, fields = headers.get("warc-type"), None, None, None, None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            if stated and stated != digest:
                raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
        else:
            stated = _headers(head.split(b"\r\n")[1:]).get("content-length")
            size, digest, payload = int(stated) if stated else None, headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    elif kind == "metadata":
        fields = _headers(block.split(b"\r\n"))
    return headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to", "").split(), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"), size, digest, list(fields.items()) if fields is not None else None, payload


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; payloads are bytes."""
    schema = _RECORD + ", payload binary" * with_payload
    types = [pa.string()] * 2 + [pa.list_(pa.string())] + [pa.string()] * 3 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * with_payload
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0

                def flush() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)

                for headers, block in parse_archive(content.as_py()):
                    held.append(_row(headers, block))
                    size += 500 + len(block) * with_payload
                    if size > 8 << 20:
                        yield flush()
                        held, size = [], 0
                if held:
                    yield flush()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return arrow_ready(files).mapInArrow(rows, schema)


def _captures(records: DataFrame, store: Scratch) -> DataFrame:
    """``(n, capture_id)`` for rows of ``(n, record_id, type, concurrent_to)``: the response that each record belongs to.

    Only records whose first target is no response need the joins below; in a plain archive there are none.
    """
    is_response = F.col("type").isin("response", "revisit")
    ends = store.write(records.where(is_response & F.col("record_id").isNotNull()).select("record_id").distinct())
    rest = records.where(~F.coalesce(is_response, F.lit(False)))
    first = F.coalesce(F.get("concurrent_to", F.lit(0)), F.col("record_id"))
    arrow = rest.select("n", F.explode("concurrent_to").alias("target"))
    direct = arrow.join(ends, F.col("target") == F.col("record_id")).groupBy("n").agg(F.min("target").alias("capture_id"))
    found = [store.write(direct)]
    open_ = store.write(rest.join(found[0], "n", "left_anti").select("n", "record_id", "concurrent_to", first.alias("fallback")))
    # Arrows between records that are no responses, followed both ways: a record that only another one names belongs with it.
    if not open_.isEmpty():
        links = rest.where("record_id is not null").select("n", "record_id", F.explode("concurrent_to").alias("target"))
        known = links.join(found[0], "n").select("record_id", "capture_id").groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
        known = store.write(known)
        for _ in range(MAX_CHAIN):
            steps = open_.select("n", "record_id", "fallback", F.explode("concurrent_to").alias("target"))
            here = store.write(steps.join(known.withColumnRenamed("record_id", "target"), "target").groupBy("n", "record_id").agg(F.min("capture_id").alias("capture_id")))
            if here.isEmpty():
                break
            found.append(here.select("n", "capture_id"))
            known = here.where("record_id is not null").groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
            open_ = store.write(open_.join(here, "n", "left_anti"))
        # A response's own arrow to a record that names nothing ties that record to it.
        back = records.where(is_response & F.col("record_id").isNotNull()).select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id"))
        tied = store.write(open_.join(back, "record_id").groupBy("n").agg(F.min("capture_id").alias("capture_id")))
        found += [tied, open_.join(tied, "n", "left_anti").select("n", F.coalesce("fallback", F.concat(F.lit("record "), F.col("n").cast("string"))).alias("capture_id"))]
    out = records.where(is_response).select("n", F.coalesce("record_id", F.concat(F.lit("record "), F.col("n").cast("string"))).alias("capture_id"))
    for more in found:
        out = out.unionAll(more)
    return out


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``(capture_id, response, request, metadata, n_requests, n_metadata)``.

    Records meet through ``WARC-Concurrent-To``.  A record belongs to the response it
    names, of several the one with the smallest id; one that names other records belongs
    where they do, along ``MAX_CHAIN`` steps; one that names nothing belongs to a response
    that names it.  Of several requests, metadata or response records of one capture the
    one with the smallest id stands in the row, and the counts tell how many there were.

    * Records whose response is missing make a capture with a null response, under the
      id they are concurrent to, or their own.
    * A record with neither id nor concurrent-to is a capture of its own.
    * An empty table gives an empty result; columns of other names travel along in the
      nested rows.
    """
    store = Scratch(records.sparkSession, "captures")
    numbered = store.write(records.select(F.struct(*[F.col(c) for c in records.columns if c != "concurrent_to"]).alias("whole"), F.coalesce("concurrent_to", F.array().cast("array<string>")).alias("concurrent_to"), F.monotonically_increasing_id().alias("n")))
    kind = F.col("whole.type")
    keys = _captures(numbered.select("n", "whole.record_id", "whole.type", "concurrent_to"), store)

    def pick(test: Column) -> Column:
        return F.min_by(F.when(test, F.col("whole")), F.when(test, F.coalesce("whole.record_id", F.lit(""))))

    return numbered.join(keys, "n").groupBy("capture_id").agg(
        pick(kind.isin("response", "revisit")).alias("response"),
        pick(kind == "request").alias("request"),
        pick(kind == "metadata").alias("metadata"),
        F.count_if(kind == "request").alias("n_requests"),
        F.count_if(kind == "metadata").alias("n_metadata"),
    )


def captured_pages(captures: DataFrame) -> DataFrame:
    """Page-level view of captures that ``write_archive`` made.

    ``refers_to`` is the page of the response that a revisit names in ``WARC-Refers-To``.
    """
    store = Scratch(captures.sparkSession, "captured")
    page = F.nullif(F.element_at("metadata.fields", "page-id"), F.lit("")).cast("long")
    flat = store.write(captures.select(page.alias("page_id"), "capture_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"), F.col("response.uri").alias("uri"), "n_requests"))
    named = flat.where("record_type = 'response'").groupBy(F.col("capture_id").alias("target")).agg(F.min("page_id").alias("refers_to"))
    named = store.write(named.join(flat.where("target is not null").select("target").distinct(), "target", "left_semi"))
    return flat.join(named, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "n_requests")
