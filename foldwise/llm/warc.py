"""WARC archives: write captures, read records, assemble transactions.

Writing: each page becomes three records, a request, a response or revisit,
and a metadata record; request and metadata name the capture in
WARC-Concurrent-To. Spark's text writer puts the records into gzip files, with
the record end as line separator, so the files are ordinary archives.

Reading: each archive is parsed record by record by its Content-Length.

Assembly: request and metadata records are joined to their capture through the
concurrent-to identifiers, in either direction and over one record between
them, and each capture becomes one nested row.

Defined results: a null payload is empty; a null url writes no target;
line ends inside a url are escaped. Of equal payloads of at least ``min_bytes`` the
largest page id is the response (null ids are smaller than all others; rows
that repeat this id are responses too). Repeated rows share their record ids,
and each of them lists all requests and metadata of that id. Records without
a capture are returned as rows without one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foldwise.llm.words import quoted
from foldwise.session import settle, shared_folder

CRLF = "\r\n"
# fixed values: the record types that are captures, and the alphabet of RFC 4648 base 32
CAPTURES = ["response", "revisit", "resource"]
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# records in one archive file
FILE_RECORDS = 20_000
# payload bytes that a reading task hands over at a time
BATCH_BYTES = 8 << 20

RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "content_type string, payload_digest string, payload_bytes long, computed_digest string, fields map<string,string>"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1, eight characters from each five bytes."""
    digest = F.sha1(payload)
    letters = []
    for group in range(4):
        number = F.conv(F.substring(digest, 10 * group + 1, 10), 16, 10).cast("long")
        for k in range(8):
            index = F.shiftright(number, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(BASE32), index.cast("int"), F.lit(1)))
    return F.concat(*letters)


def _record_id(kind: str, page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def decide_types(pages: DataFrame, page: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """Page id, url, payload, digest, and the page that a revisit refers to."""
    p = pages.select(
        F.col(quoted(page)).alias("page"),
        F.regexp_replace(F.regexp_replace(F.col(quoted(url)).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(quoted(payload)).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    heads = (
        p.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page").alias("head"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    # computed once: a join side of its own, whose partner Spark may split where a payload is common
    joined = p.join(settle(heads).withColumn("many", F.lit(True)), "digest", "left")
    return joined.withColumn("revisit", F.coalesce("many", F.lit(False)) & ~F.col("page").eqNullSafe(F.col("head")))


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column, date: str):
    lines = [
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "),
        record_id,
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}"),
    ]
    for name, value in headers:  # a header without a value is left out
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    lines += [
        F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF),
        block,
    ]
    return F.concat(*lines)


def write_warc(
    pages: DataFrame,
    path: str,
    page: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes request, response or revisit, and metadata of every row into gzip archives under ``path``."""
    p = decide_types(pages, page, url, payload, min_bytes)
    capture = _record_id("capture", F.col("page"), F.col("digest"))
    target = ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(CRLF + CRLF),
    )
    response = _record(
        "response", capture, [target, digest], "application/http; msgtype=response", F.concat(http, "payload"), date
    )
    refers = [
        target,
        digest,
        ("WARC-Refers-To", _record_id("capture", F.col("head"), F.col("digest"))),
        ("WARC-Profile", F.lit(PROFILE)),
    ]
    revisit = _record("revisit", capture, refers, "application/http; msgtype=response", http, date)
    path_of = F.coalesce(F.regexp_extract("url", r"^\w+://[^/]*(/.*)$", 1), F.lit(""))
    host = F.coalesce(F.regexp_extract("url", r"^\w+://([^/]*)", 1), F.lit(""))
    request = _record(
        "request",
        _record_id("request", F.col("page"), F.col("digest")),
        [target, ("WARC-Concurrent-To", capture)],
        "application/http; msgtype=request",
        F.concat(
            F.lit("GET "), F.when(path_of == "", "/").otherwise(path_of), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)
        ),
        date,
    )
    metadata = _record(
        "metadata",
        _record_id("metadata", F.col("page"), F.col("digest")),
        [target, ("WARC-Concurrent-To", capture)],
        "application/warc-fields",
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(CRLF)),
        date,
    )
    records = p.select(F.explode(F.array(request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names) and block of every record of one archive, gzip or plain."""
    stream: io.BufferedIOBase = io.BytesIO(raw)
    if raw[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        yield headers, stream.read(int(headers["content-length"][0]))


def _payload(headers: dict[str, list[str]], block: bytes) -> bytes:
    if headers.get("content-type", [""])[0].startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _fields(headers: dict[str, list[str]], block: bytes) -> list[tuple[str, str]]:
    if headers.get("content-type", [""])[0] != "application/warc-fields":
        return []
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").splitlines() if ":" in line)
    return list({name.strip(): value.strip() for name, _, value in pairs}.items())


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; digest and size are computed from what was read."""
    schema = RECORD + (", payload binary" if payload else "")
    types = {
        "concurrent_to": pa.list_(pa.string()),
        "payload_bytes": pa.int64(),
        "fields": pa.map_(pa.string(), pa.string()),
        "payload": pa.binary(),
    }
    names = [part.split()[0] for part in RECORD.split(", ")] + ["payload"] * payload

    def emit(rows):
        columns = list(zip(*rows))
        arrays = [pa.array(c, types.get(n, pa.string())) for n, c in zip(names, columns)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                for headers, block in parse_records(batch.column(0)[k].as_py()):
                    one = lambda name: headers.get(name, [None])[0]
                    body = _payload(headers, block)
                    row = (
                        one("warc-record-id"),
                        one("warc-type"),
                        one("warc-target-uri"),
                        one("warc-date"),
                        headers.get("warc-concurrent-to", []),
                        one("warc-refers-to"),
                        one("content-type"),
                        (one("warc-payload-digest") or "").removeprefix("sha1:") or None,
                        len(body),
                        base64.b32encode(hashlib.sha1(body).digest()).decode(),
                        _fields(headers, block),
                    )
                    rows.append((*row, body) if payload else row)
                    size += 500 + len(body) * payload
                    if size > BATCH_BYTES:
                        yield emit(rows)
                        rows, size = [], 0
        if rows:
            yield emit(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture``, ``requests`` and ``metadata``, each record whole.

    Read several times: pass a table that is written or cheap to read.
    """
    row = F.struct(*[F.col(quoted(c)) for c in records.columns])
    is_capture = F.coalesce(F.col("type").isin(CAPTURES), F.lit(False))
    captures = records.filter(is_capture)
    others = records.filter(~is_capture)
    anchors = captures.select(F.col("record_id").alias("anchor")).distinct()
    named = others.select("record_id", F.explode("concurrent_to").alias("target")).distinct()
    forward = named.join(anchors, F.col("target") == F.col("anchor")).select("record_id", "anchor")
    backward = captures.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("anchor"))
    direct = forward.union(backward).distinct()
    between = direct.select(F.col("record_id").alias("target"), "anchor")
    second = (
        named.join(between, "target").select("record_id", "anchor").join(direct.select("record_id"), "record_id", "left_anti")
    )
    links = direct.union(second).distinct()
    tied = others.select("record_id", "type", row.alias("record")).join(links, "record_id", "left")
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type").eqNullSafe(kind), F.col("record"))))
    by_anchor = (
        tied.filter("anchor is not null")
        .withColumn("record", F.col("record").dropFields("fields").withField("fields", F.map_entries("record.fields")))
        .groupBy("anchor")
        .agg(pick("request").alias("requests"), pick("metadata").alias("metadata"))
    )
    whole = captures.select(F.col("record_id").alias("anchor"), row.alias("capture")).join(by_anchor, "anchor", "left")
    return whole.drop("anchor").unionByName(
        tied.filter("anchor is null").select(
            F.lit(None).alias("capture"),
            *[
                F.when(
                    F.col("type").eqNullSafe(kind),
                    F.array(F.col("record").dropFields("fields").withField("fields", F.map_entries("record.fields"))),
                ).alias(name)
                for kind, name in (("request", "requests"), ("metadata", "metadata"))
            ],
        )
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Gives every capture the size, digest and page of the full payload; a revisit takes them from its response.

    ``captures`` has record_id, refers_to, type, page, payload_bytes and computed_digest.
    """
    full = (
        captures.filter(F.col("type") != "revisit")
        .groupBy(F.col("record_id").alias("refers_to"))
        .agg(
            F.max("payload_bytes").alias("full_bytes"),
            F.max("computed_digest").alias("full_digest"),
            F.max("page").alias("full_page"),
        )
    )
    wanted = captures.filter("type = 'revisit'").select("refers_to").distinct()
    full = settle(full.join(wanted, "refers_to"))
    joined = captures.join(full, "refers_to", "left")
    revisit = F.col("type") == "revisit"
    return joined.select(
        "page",
        F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("full_digest")).otherwise(F.col("computed_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, F.col("full_page")).alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads them back, and describes each page's capture."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_warc(pages, path)
    records = settle(read_warc(spark, path, payload=False))
    page = F.element_at(F.element_at("metadata", 1)["fields"].getField("value"), 1)
    captures = assemble(records).filter("capture is not null").select("capture.*", page.try_cast("long").alias("page"))
    return resolve_revisits(settle(captures.select("record_id", "refers_to", "type", "page", "payload_bytes", "computed_digest"))).select(
        F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
