"""Quality and contamination against plain Python."""

import hashlib
import re
from collections import Counter

from foldwise.llm import decontaminate, quality

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_quality(text):
    text = text or ""
    words = BLANK.findall(text)
    n = len(words)
    seen = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    hit = set()
    for i in range(n - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            hit.update(range(i, i + 3))
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    m = quality.MIN_REPEAT
    at = {}
    for i in range(n - m + 1):
        at.setdefault(tuple(words[i : i + m]), []).append(i)
    covered, longest = set(), 0
    for places in at.values():
        for i in places:
            for j in places:
                if i != j:
                    k = m
                    while i + k < n and j + k < n and words[i + k] == words[j + k]:
                        k += 1
                    longest = max(longest, k)
                    covered.update(range(i, i + k))
    return (
        n,
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(hit),
        len(covered),
        longest,
    )


def test_quality_counts(docs):
    rows = quality.measure(docs, keep=["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        q = r["quality"]
        if len(r["text"] or "") < 20000:
            assert plain_quality(r["text"]) == tuple(q[f] for f in quality.FIELDS[:-1]), r["doc_id"]
            assert (q["n_repeats"] > 0) == (q["longest_repeat"] > 0)


def test_quality_keeps_columns_and_empty(docs):
    kept = quality.apply_rules(docs.withColumnRenamed("lang", "quality"))
    assert kept.columns == ["doc_id", "text", "quality", "source", "n_chars"]
    assert kept.filter("doc_id >= 9000").count() == 0
    assert quality.apply_rules(docs.limit(0)).count() == 0


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_contamination(text, items, width=13):
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, item_text in items:
        own = ALNUM.findall(lower(item_text))
        size = min(width, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item)
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


def items_of(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    some = [r["text"] for r in documents.filter("doc_id in (3, 5, 8, 13)").collect()]
    own = [
        (500, " ".join(some[0].split()[3:25])),
        (501, "One"),
        (502, " ".join(some[1].split()[2:9])),
        (503, None),
        (504, "!!"),
        (505, " ".join(some[0].split()[3:25])),
        (500, " ".join(some[2].split()[:40])),
        (506, "the lazy dog"),
    ]
    return bench.unionByName(spark.createDataFrame(own, bench.schema))


def check_contamination(spark, docs):
    items = items_of(spark, docs)
    plain = [(str(r["item_id"]), r["text"]) for r in items.collect()]
    rows = decontaminate.digest(
        decontaminate.find_contamination(docs, items, keep=["doc_id", "text"])
    ).collect()
    texts = sorted((r["doc_id"], *plain_contamination(r["text"], plain)) for r in docs.collect())
    assert sorted(map(tuple, rows)) == texts
    assert any(r["contaminated"] for r in rows)


def test_contamination(spark, docs):
    check_contamination(spark, docs)


def test_contamination_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_CHARS", 3000)
    check_contamination(spark, docs)


def test_contamination_filter(spark, docs):
    items = items_of(spark, docs)
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert 0 < left.count() < docs.count()
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
