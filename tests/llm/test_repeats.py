"""Repeated passages against plain Python."""

import hashlib
import random
import re

import numpy as np

from foldwise.llm import exchange, repeated_bytes, repeated_passages
from foldwise.llm.suffix_groups import suffix_array

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def passages(spark, docs):
    """Documents that share passages at odd places, copies, a common passage, rows with one id."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}é"
    shared = [[word() for _ in range(n)] for n in (12, 13, 14, 40, 90)]
    rows = []
    for k in range(80):
        words = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        rows.append((40_000 + rng.randrange(10**6), " ".join(words), "", "", 0))
    rows += [(5, rows[0][1] + " end", "", "", 0), (5, rows[1][1], "", "", 0), rows[3]]
    rows.append((60_000_000, "again and again " * 200, "", "", 0))
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def plain(rows, width=13):
    seen = {}
    split = [(d, BLANK.findall(t or "")) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            seen[key] = min(d, seen.get(key, d))
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - width + 1):
            if seen[tuple(words[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def check(table):
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = repeated_passages.remove_repeats(table).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == plain(rows)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert sum(r["n_removed"] > 0 for r in got) > 10


def test_repeats(spark, docs):
    check(passages(spark, docs))


def test_repeats_in_small_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(repeated_passages, "PART_CHARS", 50_000)
    monkeypatch.setattr(exchange, "BLOCK", 20_000)
    check(passages(spark, docs))


def test_empty(docs):
    assert repeated_passages.remove_repeats(docs.limit(0)).count() == 0


def test_gaps():
    places = np.array([0, 3, 70_000, 70_001, 400_000])
    gaps, real = exchange.pack_gaps(places)
    assert (exchange.unpack_gaps(gaps)[real] == places).all() and len(gaps) > 5


def plain_bytes(rows, width=100):
    first = {}
    split = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in split:
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w not in first or (d, i) < first[w]:
                first[w] = (d, i)
    out = []
    for d, raw in split:
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if first[raw[i : i + width]] < (d, i):
                gone[i : i + width] = b"\1" * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def byte_rows(spark, docs):
    rng = random.Random(4)
    line = "Shared line of a licence, é and more of it. " * 3
    rows = [(70_000 + k, f"{rng.random()}\n{line[: rng.randrange(90, 130)]}\n{rng.random()}" * 2, "", "", 0) for k in range(300)]
    rows += [(71_000, "ab" * 400, "", "", 0), (71_001, "x" * 99 + "ab" * 90, "", "", 0)]
    return passages(spark, docs).filter("length(text) < 9000 or text is null").unionByName(spark.createDataFrame(rows, docs.schema))


def check_bytes(table):
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = repeated_bytes.remove_repeats(table).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_bytes(rows)
    assert sum(r["n_removed"] > 0 for r in got) > 100


def test_bytes(spark, docs):
    check_bytes(byte_rows(spark, docs))


def test_bytes_empty(docs):
    assert repeated_bytes.remove_repeats(docs.limit(0)).count() == 0


def test_crowded_anchors_in_one_process():
    """Both ways of comparing contexts, without Spark."""
    import pyarrow as pa

    rng = random.Random(9)
    line = "".join(chr(97 + rng.randrange(26)) for _ in range(130))
    texts = [f"{rng.random():.9f}{line}{rng.random():.9f}" for _ in range(200)]
    table = pa.table({"d": list(range(200)), "h": [b"0" * 16] * 200, "t": texts}).combine_chunks().to_batches()[0]
    for limit in (10, 10_000):
        repeated_bytes.MANY_IN_BLOCK, before = limit, repeated_bytes.MANY_IN_BLOCK
        try:
            _, records, places, told, first = repeated_bytes._anchored(table)
        finally:
            repeated_bytes.MANY_IN_BLOCK = before
        assert (len(told[4][0]) > 0) == (limit == 10)
        assert (records["many"].sum() > 0) == (limit == 10)


def test_repeated_rows_told_different_things(spark):
    """One document in two blocks: what either was told counts."""
    table = np.array([(7, b"h" * 16, 300)], np.dtype([("d", "<i8"), ("h", "S16"), ("end", "<i8")])).tobytes()
    body = lambda *pairs: np.array(pairs, "<i4").tobytes()
    found, single = exchange.FOUND, repeated_bytes.SINGLE
    rows = [(0, exchange.TABLE, table), (0, found, body((100, 150))), (0, single, body((0, 50)))]
    rows += [(1, exchange.TABLE, table), (1, found, body((0, 50))), (1, single, body((100, 150)))]
    got = exchange.places_by_document(spark.createDataFrame(rows, exchange.ANSWER), (found, single)).collect()
    spans = {r["kind"]: sorted(map(tuple, np.frombuffer(r["spans"], "<i4").reshape(-1, 2).tolist())) for r in got}
    assert spans == {found: [(0, 50), (100, 150)], single: [(0, 50), (100, 150)]}


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        text = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_contexts_without_a_common_window_are_not_sorted(monkeypatch):
    """op6: only the contexts that agree in 100 bytes around their anchor go into suffix arrays; all repeats are found."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz \0"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    short, long = text(60), text(130)
    texts = [f"{text(90)}{short}{text(90)}" for _ in range(20)] + [f"{text(40)}{long}{text(n)}" for n in (0, 50, 200)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    starts, sizes, anchors, places = repeated_bytes.contexts(data, offsets)
    records = np.zeros(len(starts), repeated_bytes._TEXT)
    records["anchor"], records["n"], records["place"] = anchors, sizes, places - starts
    raw = data.tobytes()
    for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        records["text"][i] = raw[a : a + n + repeated_bytes.WINDOW - 1].ljust(168, b"\0")
    row = np.searchsorted(offsets, starts, "right") - 1
    seen = {}
    sort = repeated_bytes.equal_windows
    monkeypatch.setattr(repeated_bytes, "equal_windows", lambda some: seen.setdefault("texts", some) and sort(some))
    got = [("b", records.view("u1").reshape(len(records), -1), starts, row, starts - offsets[row])]
    found = {int(a) for *_, spans in repeated_bytes._sort_answer(got) for a, _ in spans}
    windows, later = {}, set()
    for r, (a, b) in enumerate(zip(offsets, offsets[1:])):
        for s in range(a, b - 99):
            if windows.setdefault(raw[s : s + 100], r) < r:
                later.add(int(s))
    assert found == later and len(later) == 62
    assert all(long.encode()[15:115] in t or long.encode()[:100] in t or long.encode()[30:] in t for t in seen["texts"])
