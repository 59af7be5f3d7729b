"""Conversation tries against plain Python, whatever is heavy, sharded or split."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import prefix_trie


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    built = {}
    for c, ts in own.items():
        base = c - c % 100
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(base, [])[:h] + ts[h:] if base != c else ts
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        path = tuple(built[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    below = defaultdict(lambda: [0, 0, 0])  # children, leaves, saved
    for path in sorted(members, key=len, reverse=True):
        mine = below[path]
        mine[1] += mine[0] == 0
        mine[2] += (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        if path:
            up = below[path[:-1]]
            up[0], up[1], up[2] = up[0] + 1, up[1] + mine[1], up[2] + mine[2]
    return sorted(
        (
            m[0], len(path), members[path[:-1]][0] if path else -1, len(m), *below[path],
            hashlib.sha256(",".join(map(str, ends.get(path, []))).encode()).hexdigest(),
        )
        for path, m in members.items()
    )


SCHEMA = "conv_id long, turn long, role string, text string, depth string, top int"


def some_conversations():
    rng = random.Random(3)
    rows = []
    for c in range(0, 700):
        if c % 97 == 3 or c == 300:  # some are missing, a shared one too
            continue
        for k in range(rng.choice([0, 1, 2, 3, 6, 9])):
            text = rng.choice([None, "", "hello", "é" * rng.randrange(4), f"text {rng.randrange(30)}"])
            rows.append((c, k if k else None, rng.choice([None, "user", "assistant"]), text, "x", 1))
    rows += [(c, k, "user", "the same", None, 2) for c in range(1000, 1400) for k in range(7)]  # copies
    rows += [(5000, k, "user", "long" * 20, "x", 1) for k in range(900)]  # one long conversation
    rows += [(5001, k, "assistant", "x" * 300_000, "x", 1) for k in range(7)]
    rows += [(None, k, "user", "nobody's", "x", 1) for k in range(9)] + [(2**40, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"heavy_floor": 5, "shard_nodes": 300}, {"heavy_floor": 40, "heavy_rows": 100}])
def test_nodes(spark, limits):
    rows = some_conversations()
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **limits).collect()
    want = plain([r[:4] for r in rows])
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == want


def test_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(5)
    k0, k1 = rng.integers(-(2**63), 2**63 - 1, (2, 50_000))
    k0[:1000] = 7  # equal halves
    table = prefix_trie.NodeTable(k0, k1)
    assert sorted(table.slots) == list(range(50_000))
    assert (table.find(k0, k1) == table.slots).all()
    assert (table.find(k1, k0) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.NodeTable(np.array([1, 1]), np.array([2, 2]))
    assert len(prefix_trie.NodeTable(k0[:0], k1[:0]).slots) == 0


def test_two_prefixes_of_one_digest_are_noticed(spark):
    paths = spark.createDataFrame([(1, 1, 5, 6, 0, 0, 3), (2, 1, 5, 6, 0, 0, 4)], "c long, depth long, k0 long, k1 long, p0 long, p1 long, chars long")
    with pytest.raises(Exception, match="share a digest"):
        prefix_trie.enumerate_nodes(paths).agg(F.sum("n")).collect()
