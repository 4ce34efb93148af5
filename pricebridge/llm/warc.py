"""WARC: write captures as request, response or revisit, and metadata records; read archives; assemble transactions.

Archives are written and read by Spark's own text source, with the two line ends that close a WARC record as the line
separator, so any store that Spark reaches will do. An archive is one gzip stream, which Spark does not split; a reader
task therefore sees an archive's records in order and holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebridge.llm.common import batches, limit_batches, texts

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, headers map<string,string>, payload_bytes long, payload_digest string, block binary, payload binary"


def sha1_base32(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def digested(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest of every row; a null payload is empty."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw = texts(batch, "payload")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array([sha1_base32(b) for b in raw])], names=["page_id", "payload_bytes", "payload_digest"])

    limit_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(payload_col).cast("string").alias("payload")).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string")


def revisits(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_digest, response_id of the rows that revisit an equal payload with a smaller id."""
    first = digests.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = digests.filter(F.col("payload_bytes") >= least_bytes).join(first, "payload_digest")
    return rows.filter(~F.col("page_id").eqNullSafe(F.col("response_id"))).select("page_id", "payload_digest", "response_id").distinct()


def _urn(kind: str, page: int | None, digest: str) -> str:
    h = hashlib.md5(f"{kind} {page} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block


def _clean(s: str | None) -> str | None:
    """A header's value may not hold line ends."""
    return None if s is None else " ".join(s.split())


def records_of(page: int | None, uri: str | None, payload: bytes, response: int | None, is_revisit: bool, date: str) -> list[bytes]:
    """The three records of a capture: response or revisit, request, metadata."""
    digest, uri = sha1_base32(payload), _clean(uri) or None
    main = _urn("main", page, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    common = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    head = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    head.append(("X-Page-ID", None if page is None else str(page)))
    if is_revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn("main", response, digest)), ("X-Refers-To-Page-ID", str(response))]
    head.append(("Content-Type", "application/http;msgtype=response"))
    if is_revisit:  # the payload is that of the record it refers to
        block = http + b"\r\n"
    else:
        block = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    path = (uri or "/").split("//", 1)[-1]
    ask = f"GET /{path.partition('/')[2]} HTTP/1.1\r\nHost: {path.partition('/')[0]}\r\n\r\n".encode()
    note = f"fetchTimeMs: 0\r\npayloadBytes: {len(payload)}\r\n".encode()
    return [
        _record(head, block),
        _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", page, digest)), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")], ask),
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", page, digest)), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], note),
    ]


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2025-01-01T00:00:00Z", records_per_file: int = 60_000) -> None:
    """Write the captures of pages under path.

    Of equal payloads of at least least_bytes bytes the row with the smallest id is a response, the others revisit it;
    null ids never come first while an id is there. Rows that repeat id and payload are alike. Null payloads are empty;
    null URIs leave out their header; other columns are ignored; an empty table writes no record.
    """
    table = digested(pages, id_col, payload_col)
    later = revisits(table, least_bytes)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).cast("string").alias("payload"))
    # by id alone: which of an id's payloads is meant, the digest tells
    held = later.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("payload_digest", "response_id"))).alias("later"))
    rows = rows.alias("r").join(held.alias("h"), F.col("r.page_id").eqNullSafe(F.col("h.page_id")), "left").select("r.page_id", "uri", "payload", "later")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[bytes]]:
            for batch in it:
                for page, uri, later, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), texts(batch, "payload"), strict=True):
                    known = dict(later) if later else {}
                    digest = sha1_base32(payload) if known else ""
                    for rec in records_of(page, uri, payload, known.get(digest), digest in known, date):
                        yield (rec,)

        yield from batches(each(), pa.schema([("value", pa.binary())]), weigh=lambda r: len(r[0]))

    out = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, from what stands between double line ends. Bytes outside a record are skipped.

    A block that itself ends in a line end is cut two bytes early, so chunks are put together again before records are
    cut out of them by their stated lengths; no more than a record and a chunk are held.
    """
    held = b""
    while True:
        held = held.lstrip(b"\r\n")
        while END not in held:
            more = next(chunks, None)
            if more is None:
                return
            held = (held + more + END).lstrip(b"\r\n")
        top, _, held = held.partition(END)
        if not top.startswith(b"WARC/"):
            continue
        head = {}
        for line in top.split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
        want = int(head.get("content-length", "0"))
        parts, have = [held], len(held)
        while have < want:
            more = next(chunks, None)
            if more is None:
                break
            parts += [more, END]
            have += len(more) + len(END)
        held = b"".join(parts)
        yield head, held[:want]
        held = held[want:]


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records under path (RECORDS). payload_bytes and payload_digest are measured from the payload; for revisits,
    which have none, they are what the record says. payload=False leaves block and payload null."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[bytes]:
            for batch in it:
                yield from texts(batch, "value")

        def rows() -> Iterator[tuple]:
            for head, block in _parse(chunks()):
                kind = head.get("warc-type", "")
                told = head.get("warc-payload-digest", "").rpartition(":")[2] or None
                body, n, digest = None, None, told
                if "msgtype=response" in head.get("content-type", "") and kind == "response":
                    body = block.partition(END)[2]
                    n, digest = len(body), sha1_base32(body)
                    if told and told != digest:
                        raise ValueError(f"{head.get('warc-record-id')}: payload digest {digest}, its header says {told}")
                elif kind == "revisit":
                    n = int(head["warc-payload-length"]) if "warc-payload-length" in head else None
                yield (kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), list(head.items()), n, digest, block if payload else None, body if payload else None)

        s = pa.string()
        schema = pa.schema([("type", s), ("record_id", s), ("concurrent_to", s), ("refers_to", s), ("uri", s), ("date", s), ("headers", pa.map_(s, s)), ("payload_bytes", pa.int64()), ("payload_digest", s), ("block", pa.binary()), ("payload", pa.binary())])
        yield from batches(rows(), schema, size=2048, weigh=lambda r: len(r[9] or b"") + len(r[10] or b""))

    limit_batches(spark)
    return spark.read.schema("value string").option("lineSep", END.decode()).text(path).mapInArrow(run, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, uri, date, response, request, metadata (structs; the last two null if absent).

    Requests and metadata records find their response or revisit through WARC-Concurrent-To. Of several requests or
    metadata records of a capture the one with the smallest record id is taken, so a capture gives one row; records
    that stand for no capture are left out here.
    """
    fields = [F.col(c) for c in records.columns]
    main = records.filter(F.col("type").isin("response", "revisit") & F.col("record_id").isNotNull()).select(F.col("record_id").alias("capture_id"), "uri", "date", F.struct(*fields).alias("response"))
    # a record that repeats under one id, as copies of a page do, is as often a capture
    def side(kind: str) -> DataFrame:
        own = records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return own.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min_by(F.struct(*fields), "record_id").alias(kind))

    return main.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")


def captures(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every assembled capture of write_warc()."""
    head = lambda k: F.col("response.headers")[k]
    return transactions(records).select(
        head("x-page-id").cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), head("x-refers-to-page-id").cast("long").alias("refers_to"),
        F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"),
    )
