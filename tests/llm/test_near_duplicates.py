"""Near duplicates: estimates, verification, and classes against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foldwise.llm import near_duplicates as nd
from foldwise.llm.components import components, merged

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    words = ALNUM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return Counter()
    width = min(5, len(words))
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def jaccard(a, b):
    out = 0.0
    for i in a.keys() & b.keys():
        out += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return out


def plain_heads(rows):
    """The row with the smallest id of each class, null texts as they are."""
    where, _ = linked(rows)
    head = {}
    for d, t in rows:
        c = where[t or ""]
        head[c] = min((d, t or ""), head.get(c, (d, t or "")))
    return sorted(head.values())


def plain_classes(rows):
    where, _ = linked(rows)
    head = {}
    for d, t in rows:
        c = where[t or ""]
        head[c] = min(d, head.get(c, d))
    return sorted((d, head[where[t or ""]]) for d, t in rows)


def linked(rows):
    """The class of each text over all pairs, and the classes."""
    texts = sorted({t or "" for _, t in rows})
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            small, large = sorted((len(bags[i]), len(bags[j])))
            if small and (bags[i].keys() & bags[j].keys()) and jaccard(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    where = {t: find(k) for k, t in enumerate(texts)}
    return where, set(where.values())


def near_copies(spark, docs):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(150)) for _ in range(12)]
    rows = []
    for k, text in enumerate(base):
        for c in range(6 if k else 60):
            words = text.split()
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((20_000 + 100 * k + c, " ".join(words), "", "", 0))
    rows += [(30_000, "a a a a a a a a b", "", "", 0), (30_001, "A a a a a a a a b!", "", "", 0), (30_002, "one two", "", "", 0)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def test_classes(spark, docs):
    table = near_copies(spark, docs)
    got = sorted((r["doc_id"], r["class_id"]) for r in nd.classes(table).collect())
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    assert got == plain_classes(rows)


def test_keep_one(spark, docs):
    table = near_copies(spark, docs).union(docs.limit(3)).withColumnRenamed("lang", "node")
    kept = nd.keep_one(table)
    assert kept.columns == table.columns
    heads = plain_heads([(r["doc_id"], r["text"]) for r in table.collect()])
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == heads
    assert nd.keep_one(docs.limit(0)).count() == 0


def test_keep_one_with_null_and_shared_ids(spark):
    """Unrelated texts under a null or shared id are classes of their own."""
    rng = random.Random(6)
    a, b, c, d, e, f = (" ".join(f"v{rng.randrange(10**6)}" for _ in range(80)) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c), (3, c + " end"), (5, d), (7, d), (5, e), (9, e + " end"), (None, f), (4, f)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in nd.keep_one(table).collect())
    assert kept == sorted([(0, a), (0, b), (3, c + " end"), (5, d), (5, e), (4, f)])
    labels = {(r["doc_id"], bytes(r["label"])) for r in nd.classes(table).collect()}
    assert len({x for _, x in labels}) == 6


def test_small_chunks_give_the_same(spark, docs, monkeypatch):
    table = near_copies(spark, docs.limit(20))
    whole = sorted(map(str, nd.classes(table).collect()))
    monkeypatch.setattr(nd, "CHUNK", 2)
    assert sorted(map(str, nd.classes(table).collect())) == whole


def test_crowd_around_the_threshold(spark, monkeypatch):
    """All links found inside the buckets alone, in parts bounded by bytes: texts of repeated and of single shingles."""
    rng = random.Random(9)
    rows = []
    for base in ([f"w{i}" for i in range(120)], [f"v{i % 40}" for i in range(120)]):
        for _ in range(30):
            words = base[:]
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    monkeypatch.setattr(nd, "ROUNDS", 0)
    monkeypatch.setattr(nd, "PART_BYTES", 8000)
    got = sorted((r["doc_id"], r["class_id"]) for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_classes(rows)
    assert 2 < len({c for _, c in got}) < 60


def test_probability_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(50):
        va = np.unique(rng.integers(0, 30, 20)).astype(np.uint64)
        vb = np.unique(rng.integers(0, 30, 20)).astype(np.uint64)
        ca, cb = rng.integers(1, 5, len(va)), rng.integers(1, 5, len(vb))
        a, b = Counter(dict(zip(va.tolist(), ca.tolist()))), Counter(dict(zip(vb.tolist(), cb.tolist())))
        assert nd.probability_jaccard(va, ca, vb, cb) == pytest.approx(jaccard(a, b))


def test_registers_estimate_it():
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    other = words[:]
    for i in (50, 150, 250):
        other[i] = "z"
    texts = [" ".join(words), " ".join(other), " ".join(words + words[:100]), None, "one"]
    held = nd.prob_minhash(*nd.shingles(pa.array(texts))[:2], nd.shingles(pa.array(texts))[2].astype(float), 5, 4000)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert abs((held[i] == held[j]).mean() - jaccard(bag(texts[i]), bag(texts[j]))) < 0.03
    assert (held[3] == 0).all() and len(set(held[4].tolist())) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_merged_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    read = lambda labels: {r["node"]: r["label"] for r in labels.collect()}
    labels = components(table(edges[:40]))
    for part in (edges[40:60], [], edges[:10], edges[60:]):
        labels = merged(labels, table(part))
    assert read(labels) == read(components(table(edges)))


def test_only_what_may_have_a_partner_is_sent(spark, docs, monkeypatch):
    """Texts, registers and bands pass the bitmap before they are sent to a join."""
    plans, real = [], nd.settle

    def seen(df):
        plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df)

    monkeypatch.setattr(nd, "settle", seen)
    nd.classes(docs.limit(50))
    for columns in (["node", "text"], ["node", "rep", "bands", "registers"]):
        plan = [p for c, p in plans if c == columns][-1]
        assert "_bitmap" in plan and "LeftSemi" not in plan
