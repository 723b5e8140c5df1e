"""WARC transactions: request, response and metadata records joined into one nested row for each capture.

Records that name each other in WARC-Concurrent-To, directly or through others, are one transaction: a connected
component of the graph of record ids (an id that is named but absent still connects those that name it). The graph holds
ids only. Each transaction belongs to its first response-like record, and every other record carries that one's id into a
single full outer join, so a response's payload is shuffled once.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialize, scratch, ship
from .common import need
from .near_dedup import components

COLUMNS = ("record_id", "type", "date", "target_uri", "concurrent_to", "payload")
RECORD = "record_id string, type string, date timestamp, target_uri string, concurrent_to array<string>, payload binary"
CAPTURES = ("response", "revisit", "resource", "conversion")
"""Types of which each record is a capture."""


def _record(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in COLUMNS if c != "concurrent_to"])


def assemble(records: DataFrame) -> DataFrame:
    """A row for each capture: capture_id, target_uri, date, response, requests, metadata, others.

    response is a struct (record_id, type, date, target_uri, payload); requests, metadata and others (any other type) are arrays
    of the same, in order of record_id. A transaction without a response-like record (see CAPTURES) is a capture too: response is
    null, capture_id the least id in it, target_uri and date the least of its records. If it has several, the first by (date, id)
    has the other records and each of the rest is a capture of its own without any.

    Records with a null id are left out; a null or unknown type goes to others; null, empty or dangling concurrent_to is no link, as is
    one to the record itself. Records that share an id are one: the first by (date, type, payload, target_uri), with the links of all. Other
    columns play no part. payload may be binary or a string. An empty table gives no rows.
    """
    with scratch(records.sparkSession):
        base = need(records, COLUMNS).where("record_id is not null")
        heads = base.select("record_id", "type", "date")
        links = base.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).where("b is not null and a <> b")
        graph = materialize(components(links, "warc-graph"), "warc-components")
        ids = materialize(heads.groupBy("record_id").agg(F.min(F.struct(F.coalesce("date", F.lit(0).cast("timestamp")).alias("date"), F.coalesce("type", F.lit("")).alias("type"))).alias("x"), F.count("*").alias("copies")).select("record_id", "x.date", "x.type", "copies"), "warc-ids")
        repeated = ids.where("copies > 1").limit(1).count() > 0
        placed = ids.join(graph.toDF("record_id", "root"), "record_id", "left").withColumn("root", F.coalesce("root", "record_id"))
        answer = F.col("type").isin(*CAPTURES)
        placed = materialize(placed, "warc-rooted")
        heads = placed.groupBy("root").agg(F.min(F.when(answer, F.struct("date", "record_id"))).alias("first"), F.min("record_id").alias("least"))
        owner = heads.select("root", F.coalesce("first.record_id", "least").alias("owner"))
        placed = placed.join(owner, "root").select("record_id", F.when(answer, F.col("record_id")).otherwise(F.col("owner")).alias("capture_id"), answer.alias("answer"))
        placed = materialize(placed, "warc-placed", keep=True)
    if repeated:
        own = F.struct("date", "type", "payload", "target_uri", "concurrent_to")
        base = base.groupBy("record_id").agg(F.min(own).alias("x")).select("record_id", *[F.col(f"x.{c}").alias(c) for c in COLUMNS if c != "record_id"])
    # A null date counts as the least, as above.
    answers = base.where(answer).select(F.col("record_id").alias("capture_id"), _record().alias("response"))
    rest = base.where(~F.coalesce(answer, F.lit(False))).select("record_id", "type", _record().alias("record")).join(placed.where("not answer").select("record_id", "capture_id"), "record_id")
    of = lambda test: F.array_sort(F.filter(F.collect_list("record"), test))
    kind = lambda x: F.coalesce(x["type"], F.lit(""))
    rest = rest.groupBy("capture_id").agg(of(lambda x: kind(x) == "request").alias("requests"), of(lambda x: kind(x) == "metadata").alias("metadata"), of(lambda x: ~kind(x).isin("request", "metadata")).alias("others"))
    both = answers.join(rest, "capture_id", "full_outer")
    none = F.array().cast(f"array<struct<record_id:string,type:string,date:timestamp,target_uri:string,payload:{records.schema['payload'].dataType.simpleString()}>>")
    lists = [F.coalesce(c, none).alias(c) for c in ("requests", "metadata", "others")]
    both = both.select("capture_id", "response", *lists)
    all_of = F.concat("requests", "metadata", "others")
    lowest = lambda c: F.array_min(F.transform(all_of, lambda x: x[c]))
    own = lambda c: F.when(F.col("response").isNotNull(), F.col("response")[c]).otherwise(lowest(c)).alias(c)
    return both.select("capture_id", own("target_uri"), own("date"), "response", "requests", "metadata", "others")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as WARC records: a response, a request concurrent to it and metadata concurrent to the request."""
    base = need(pages, ("page_id", "url", "html")).where("page_id is not null")
    name = lambda kind: F.concat(F.lit("<urn:uuid:"), F.md5(F.concat_ws("/", F.col("page_id").cast("string"), F.lit(kind))), F.lit(">"))
    date = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id").cast("long"))
    path = F.regexp_replace("url", r"^[a-zA-Z]+://[^/]*", "")

    def kind(what: str, payload: Column, to: str | None) -> DataFrame:
        named = F.array(name(to)) if to else F.array().cast("array<string>")
        return base.select(name(what).alias("record_id"), F.lit(what).alias("type"), date.alias("date"), F.col("url").alias("target_uri"), named.alias("concurrent_to"), payload.alias("payload"))

    return (
        kind("response", F.col("html"), None)
        .unionByName(kind("request", F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1")), "response"))
        .unionByName(kind("metadata", F.concat(F.lit("pageid: "), F.col("page_id").cast("string")), "request"))
    )


def http_parts(payload: Column) -> Column:
    """struct(status, head, body) of an HTTP message: the number in its first line, its lines before the first empty one, and the bytes
    after that. A payload that doesn't begin with a request or status line is body as a whole; null gives null."""
    raw = payload.cast("binary")
    text = F.decode(raw, "ISO-8859-1")  # a character a byte, so places agree
    mark = F.instr(text, "\r\n\r\n")
    http = text.rlike(r"^(?:HTTP/[0-9.]+ [0-9]{3}|[A-Z]+ [^ \r\n]+ HTTP/[0-9.]+)")
    at = F.when(mark > 0, mark).otherwise(F.length(text) + 1)
    status = F.nullif(F.regexp_extract(text, "^HTTP/[0-9.]+ ([0-9]{3})", 1), F.lit("")).cast("int")
    parts = F.struct(F.when(http, status).alias("status"), F.when(http, F.substr(text, F.lit(1), at - 1)).alias("head"), F.when(http, F.substr(raw, at + 4)).otherwise(raw).alias("body"))
    return F.when(payload.isNotNull(), parts)


_READ, _BATCH = 1 << 20, 8 << 20


class _Members(io.RawIOBase):
    """The content of a stream of gzip members end to end, or of a stream that isn't zipped, a block at a time. A broken member ends the stream."""

    def __init__(self, stream):
        self.stream, self.left, self.ready = stream, stream.read(_READ), b""
        self.zipped = self.left[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.zipped else None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ready and self.left:
            if not self.zipped:
                self.ready, self.left = self.left, b""
            else:
                try:
                    self.ready = self.inflate.decompress(self.left, _READ)
                except zlib.error:
                    self.left = b""
                    break
                self.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
            if not self.left:
                self.left = self.stream.read(_READ)
        n = min(len(buffer), len(self.ready))
        buffer[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def _parse(stream: io.BufferedIOBase) -> Iterator[tuple]:
    while line := stream.readline():
        if not re.match(rb"WARC/\d", line):
            continue
        fields: list[tuple[str, str]] = []
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and fields:
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip().decode('utf-8', 'replace')}")
            else:
                key, _, value = line.decode("utf-8", "replace").partition(":")
                fields.append((key.strip().lower(), value.strip()))
        head = dict(fields)
        size = head.get("content-length", "0")
        body = stream.read(int(size) if size.isdigit() else 0)
        links = [v for k, v in fields if k == "warc-concurrent-to"]
        date = pd.to_datetime(head.get("warc-date"), utc=True, errors="coerce")
        yield head.get("warc-record-id"), head.get("warc-type"), None if date is pd.NaT or date is None else date.tz_localize(None), head.get("warc-target-uri"), links, body


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("date", pa.timestamp("us", "UTC")), ("target_uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("payload", pa.binary())])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_stream(name, compression=None) as stream:
                rows, size = [], 0
                for record in _parse(io.BufferedReader(_Members(stream), _READ)):
                    rows.append(dict(zip(COLUMNS, record)))
                    size += len(record[-1])
                    if size > _BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc and .warc.gz files, a task for each file, which is read and inflated a block at a time.

    payload is binary, as recorded; `http_parts` parts it. A record cut short has what there is; a bad length counts as 0, a bad
    date as null; bytes of a header that aren't UTF-8 are replaced. Files may lie wherever pyarrow finds them by their URI.
    """
    files = ship(spark).read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    return files.mapInArrow(_read, RECORD)


def write_record(record_id: str, kind: str, date: str, uri: str, concurrent_to: list[str], payload: bytes | str) -> bytes:
    """One record in WARC 1.1 form."""
    body = payload.encode() if isinstance(payload, str) else payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", *(f"WARC-Concurrent-To: {c}" for c in concurrent_to), f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"
