"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foldwise.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows):
    counts = Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(words):
    near = {w: [] for w in words}
    names = sorted(words)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def some_words():
    rng = random.Random(8)
    letters = "abcdeéèzÿ×"
    words = {}
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 12)))
        for _ in range(12):
            words[w] = rng.choice([2, 3, 30, 400, 5000])
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]])
            if len(w) < 7:
                break
    words |= {"common" + "".join(rng.choice("xyz") for _ in range(6)): rng.randrange(2, 90) for _ in range(300)}  # one half
    words |= {"aaaaaaa" + "a" * k: 2 + 20**k for k in range(4)} | {"z" * 5000: 2, "z" * 4999 + "y": 50, "z" * 5001: 3}
    return {w: n for w, n in words.items() if len(w) >= 7}


@pytest.mark.parametrize("tile", [2048, 20])
def test_groups(spark, tile):
    words = some_words()
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(map(tuple, spelling.group_variants(table, tile).collect()), key=lambda r: r[0])
    assert got == plain_groups(words)


def test_words_of_texts(spark, docs):
    odd = [(7000 + k, t, "", "", 0) for k, t in enumerate(["ABCDEFGÉ abcdefgÉ " * 40, "x" * 300_000 + " " + "x" * 300_000, "naïve×÷ naïve×÷"])]
    odd += [(None, "without identifier " * 2, "", "", 0)] * 2
    table = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    got = {r["word"]: r["n"] for r in spelling.vocabulary(table).collect()}
    assert got == plain_words([(r["doc_id"], r["text"]) for r in table.collect()])
    assert len(got) > 1000


def test_documents_to_groups(spark, docs):
    small = docs.filter("doc_id % 9 = 0").union(docs.filter("doc_id >= 9000"))
    got = sorted(map(tuple, spelling.group_variants(spelling.vocabulary(small)).collect()), key=lambda r: r[0])
    assert got == plain_groups(plain_words([(r["doc_id"], r["text"]) for r in small.collect()]))


def test_empty(spark, docs):
    assert spelling.group_variants(spelling.vocabulary(docs.limit(0))).count() == 0


def test_gram_distances():
    words = ["abcdefg", "abcdefgh", "gfedcba", "aaaaaaa", "éééééééé"]
    points, _ = spelling._points(words, 8)
    counts = spelling.letter_counts(points)
    want = ((counts[:, None] - counts[None]) ** 2).sum(2)
    assert np.array_equal(spelling.squared_distances(counts, counts), want) and want[0, 1] == 1 and want[0, 2] == 0
