"""Token files: ids as the tokenizer gives them, places from prefix sums, mapped access."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldwise.llm import token_files
from foldwise.session import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    "tab\there nbsp\x1cfs ls don't I'LL we've é <|endoftext|>x 12345 İΣ é., ×. a,b. x.. ÷, y,",
    "a  b   c \n\n d\n\n\ne   f g   h ...  'tis 's 's' x's x'sy é's Ω1 1Ω é1 ×1 1× a× ×a",
    " lead", "trail ", "\n", " ", "  ", "a  b", "  b", "é. é . ’s it’s «a» ", "\x00\x01 \x02", "日本語 text 123 日本",
    "é" * 300_000,
    "word " * 70_000,
    "x" * 70_000 + " y",
]


def expected(rows):
    """{doc_id: list of id lists} in plain Python, and all ids by (doc_id) order."""
    tok = Tokenizer.from_file(PATH)
    out = defaultdict(list)
    for d, t in rows:
        out[d].append(tok.encode(t or "", add_special_tokens=False).ids + [0])
    return out


def check(spark, table, **kw):
    root = shared_folder(spark, "tokens-test")
    index = token_files.write_files(table, PATH, root, **kw)
    want = expected([(r["doc_id"], r["text"]) for r in table.collect()])
    got = token_files.read_files(spark, root, with_ids=True).collect()
    got.sort(key=lambda r: r["start"])
    at, seen = 0, defaultdict(list)
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
        seen[r["doc_id"]].append(np.frombuffer(r["ids"], "<u4").tolist())
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    assert {d: sorted(v) for d, v in seen.items()} == {d: sorted(v) for d, v in want.items()}
    files = token_files.TokenFiles(root)
    assert len(files) == len(got) and files.n_tokens == at
    for k in (0, len(got) // 2, len(got) - 1):
        assert files.document(k).tolist() == np.frombuffer(got[k]["ids"], "<u4").tolist()
    all_ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    for start in range(0, at, max(1, at // 7)):
        assert files.window(start, 5000).tolist() == all_ids[start : start + 5000].tolist()
    return index.count(), root


def odd_table(spark, docs):
    rows = [(7000 + k, t, "", "", 0) for k, t in enumerate(ODD)] + [(None, "no id", "", "", 0), (None, None, "", "", 0)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def test_ids_and_places(spark, docs):
    table = odd_table(spark, docs).withColumnRenamed("lang", "part").withColumnRenamed("source", "name")
    assert check(spark, table)[0] == 1


def test_many_shards_and_repeated_rows(spark, docs):
    many = spark.createDataFrame([(42, "one row many times", "", "", 0)] * 600, docs.schema)
    shards, _ = check(spark, odd_table(spark, docs).unionByName(many), shard_chars=20_000)
    assert shards > 20


def test_repeated_rows_are_split(spark, docs):
    rows = spark.createDataFrame([(42, "one row many times", "", "", 0)] * 600, docs.schema).repartition(6)
    assert check(spark, rows, shard_chars=1_000)[0] > 4


def test_full_memory(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY_BYTES", 2_000)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 3_000)
    encoder = token_files.Encoder(PATH)
    import pyarrow as pa

    tok = Tokenizer.from_file(PATH)
    for text in [r["text"] for r in docs.limit(60).collect()] + ODD[:12]:
        ids, bounds = encoder.encode(pa.array([text, None]))
        assert ids.tolist() == tok.encode(text or "", add_special_tokens=False).ids and bounds[-1] == bounds[1] == len(ids)


def test_text_ids_and_empty_table(spark, docs):
    check(spark, docs.limit(50).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
    root = shared_folder(spark, "tokens-test")
    assert token_files.write_files(docs.limit(0), PATH, root).count() == 0
    assert token_files.read_files(spark, root).count() == 0
    assert len(token_files.TokenFiles(root)) == 0


def test_prefix_sums_over_groups_of_shards(spark):
    sizes = [(p, (p * 37) % 11) for p in range(50)]
    shards = spark.createDataFrame(sizes, "part long, n_tokens long")
    got = {r["part"]: r["base"] for r in token_files.with_bases(shards, 7).collect()}
    assert got == {p: sum(s for _, s in sizes[:p]) for p, _ in sizes}


def test_distinct_hashes_are_those_of_a_sort():
    from foldwise.llm.token_files import distinct

    for hashes in (np.random.default_rng(7).integers(0, 40, 300).astype(np.uint64) << np.uint64(58), np.zeros(0, np.uint64)):
        want = np.unique(hashes, return_index=True, return_inverse=True)
        assert all(a.tolist() == b.tolist() for a, b in zip(distinct(hashes), want))
