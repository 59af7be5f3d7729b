"""Packing: every id once, full sequences, ids as the tokenizer gives them, order along the curve."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foldwise.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, with_ids=False):
    tok = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for d, t in docs:
        want[d].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        if len(want[d]) > 1:  # repeated rows: only the total can be told
            assert sum(p["length"] for p in pieces) == sum(map(len, want[d]))
            continue
        ids, at = want[d][0], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            raw = np.array(ids[at : at + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(raw)
            assert not with_ids or p["ids"] == raw
            at += p["length"]
        assert at == len(ids)
    short = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.LENGTH
        assert all(p["padded_length"] == packing.padded(at, packing.LENGTH) for p in pieces)
        short += at < packing.LENGTH
    return short


def test_pack(spark, docs):
    odd = [(7001, "tab\there nbsp\x1cfs ls don't I'LL é <|endoftext|>x 12345 İΣ é., ×. a,b. x.. ÷, y,"), (7002, "́start " * 3000)]
    table = docs.unionByName(spark.createDataFrame([(i, t, "", "", 0) for i, t in odd], docs.schema))
    rows = packing.pack(table, PATH, with_ids=True).collect()
    assert check(rows, [(r["doc_id"], r["text"]) for r in table.collect()], True) <= 1


def test_pack_in_ranges(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_CHARS", 40_000)
    many = docs.unionByName(spark.createDataFrame([(8000 + i, "same text", "", "", 0) for i in range(300)], docs.schema))
    rows = packing.pack(many, PATH).collect()
    ranges = {r["sequence_id"] >> 40 for r in rows}
    assert check(rows, [(r["doc_id"], r["text"]) for r in many.collect()]) <= len(ranges)
    assert len(ranges) > 5


def test_repeated_rows_in_ranges(spark, docs, monkeypatch):
    """Rows of three documents, repeated: the same ranges as for other documents, every row packed once."""
    monkeypatch.setattr(packing, "RANGE_CHARS", 5_000)
    rows = [(8000 + i % 3, f"same text {i % 3} " * 12, "", "", 0) for i in range(600)]
    table = spark.createDataFrame(rows, docs.schema).repartition(6)
    got = packing.pack(table, PATH, with_ids=True).collect()
    assert len({r["sequence_id"] >> 40 for r in got}) > 12
    want = np.concatenate([Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids + [1] for _, t, *_ in rows])
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    assert np.array_equal(np.sort(ids), np.sort(want))
    assert sum(r["start"] == 0 for r in got) == 600


def test_full_memory(docs, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "MEMORY_BYTES", 3_000)
    tok, pieces = Tokenizer.from_file(PATH), packing.Pieces(PATH)
    most = 0
    for r in docs.limit(80).collect():
        (raw,) = pieces.tokens(pa.array([r["text"]]))
        assert np.frombuffer(raw, np.uint16).tolist() == tok.encode(r["text"] or "", add_special_tokens=False).ids
        most = max(most, len(pieces.keys))
    assert most > len(pieces.keys) > 0


def test_pack_empty(docs):
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_hilbert_visits_neighbours():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_similar_texts_are_near(spark):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    vocab = [[f"{p}{chr(97 + i)}" for i in range(15)] for p in ("x", "y", "z")]
    texts = [" ".join(rng.choice(vocab[k % 3], 400)) for k in range(90)]
    _, _, _, hashes, _, first = packing.stems(pa.array(texts))
    key = packing.curve_places(hashes, first, packing.projection())
    order = np.argsort(key) % 3
    assert (order[1:] == order[:-1]).mean() > 0.8
