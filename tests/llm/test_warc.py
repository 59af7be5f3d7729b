"""Archives: round trip, assembly and the rule for revisits."""

import base64
import gzip
import hashlib

import pytest

from foldwise.llm import warc
from foldwise.session import shared_folder

PAGES = [
    (1, "http://a.example/x?y=1", "<html>é one</html>", "clash"),
    (2, "http://a.example/2", "<html>é one</html>", None),
    (3, None, "<html>é one</html>", None),
    (4, "http://b.example", "tail\r\n\r\nWARC/1.1\r\n\r\n", None),
    (5, "http://c.example/\r\nX: y", "", None),
    (6, "", None, None),
    (7, "http://d.example/", "z" * 300_000, None),
    (8, "http://d.example/", "only", None),
    (8, "http://d.example/", "only", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string")


def expected(rows):
    out, heads = [], {}
    for page, _, html, *_ in rows:
        heads[html or ""] = max(page, heads.get(html or "", page))
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        head = heads[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "response" if page == head else "revisit", None if page == head else head))
    return sorted(out, key=str)


def test_round_trip(pages):
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == expected(PAGES)


def test_round_trip_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = sorted(map(tuple, warc.round_trip(table).collect()), key=str)
    assert got == expected([(r["page_id"], r["url"], r["html"]) for r in table.collect()])


def test_empty(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_payloads_are_responses(spark, pages):
    path = shared_folder(spark, "warc-test")
    warc.write_warc(pages, path, min_bytes=10)
    rows = warc.read_warc(spark, path).filter("type = 'revisit'").collect()
    assert len(rows) == 2 and all(r["payload"] == b"" for r in rows)


def test_records_keep_payload_and_headers(spark, pages):
    path = shared_folder(spark, "warc-test")
    warc.write_warc(pages.filter("page_id in (4, 5)"), path)
    rows = {r["target_uri"]: r for r in warc.read_warc(spark, path).filter("type = 'response'").collect()}
    assert rows["http://b.example"]["payload"] == PAGES[3][2].encode()
    assert rows["http://c.example/%0D%0AX: y"]["payload"] == b""
    assert all(r["payload_digest"] == r["computed_digest"] for r in rows.values())


def test_reads_one_member_per_record():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    blocks = [b for _, b in warc.parse_records(gzip.compress(record) * 3)]
    assert blocks == [b"abc"] * 3


def test_assembly_through_either_direction_and_a_record_between(spark):
    def record(rid, kind, to=()):
        return (rid, kind, None, None, list(to), None, None, None, 0, None, {})

    rows = [
        record("c1", "response"),
        record("q1", "request", ["c1"]),
        record("m1", "metadata", ["q1"]),
        record("c2", "revisit", ["q2"]),
        record("q2", "request"),
        record("q3", "request", ["nowhere"]),
        record("c3", "resource"),
    ]
    out = warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()
    ids = lambda rs: sorted(r["record_id"] for r in rs or [])
    got = {(r["capture"] or {"record_id": None})["record_id"]: (ids(r["requests"]), ids(r["metadata"])) for r in out}
    assert got == {"c1": (["q1"], ["m1"]), "c2": (["q2"], []), "c3": ([], []), None: (["q3"], [])}
