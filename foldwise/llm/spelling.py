"""Spelling variants in a vocabulary, by Gram matrices of letter counts.

Two words are near if one code point inserted, deleted or replaced makes one
the other. Words lie in blocks of one length or of two lengths that follow
each other, and a block is cut by the half of the word that an edit leaves as
it is: for a shorter length L the first ``L // 2`` code points, or else the
last ``L - L // 2``. Every near pair is therefore in exactly one block of its
first halves, or, if those differ, in exactly one block of its last halves.

In a task the letter counts of a run of blocks are one matrix, and a NumPy
product gives all squared distances of its rows. One edit moves the counts by
a squared distance of at most two; pairs that pass and share a block are
compared code point by code point.

A block with more than ``TILE`` words is cut into parts by a hash, and each
pair of parts is a block of its own, so no task holds more than two parts.

Each block gives one row per word that has a near word: how many, and the most
frequent. Their sums and maxima are the result; no list of pairs is written.

Defined results: null texts have no words; a null document id is an empty
string in the hashed key; repeated rows count each time; a word of any length
is compared in smaller matrices; an empty table gives no words. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldwise.llm.words import quoted
from foldwise.session import settle

# words of a block that are compared in one piece
TILE = 2048
# words up to that length take the same room
USUAL_LENGTH = 64
# rows of a matrix of several small blocks
ROWS = 384
# numbers in a matrix of code points at most
CELLS = 4_000_000
# counts are kept for a-z and for the remainders of other code points
LETTERS = 26 + 14
FORM_FACTOR = 10
LEAST_LENGTH = 7
LEAST_COUNT = 2
# fixed values: which runs lose a code point
RUN = r"[A-Za-zÀ-ÿ]"
LOSES = 31


def vocabulary(documents: DataFrame, text: str = "text", doc: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the runs of letters, some without one code point, with at least that length and number.

    A run loses code point ``h % length`` if 31 divides h, the CRC-32 of
    ``<doc_id>:<run>``. Shorter runs cannot become long enough, so the pattern
    skips them.
    """
    lower = F.translate(F.col(quoted(text)).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = F.regexp_extract_all(lower, F.lit(f"({RUN}{{{least_length},}})"), F.lit(1))
    name = F.concat(F.coalesce(F.col(quoted(doc)).cast("string"), F.lit("")), F.lit(":"))
    rows = documents.select(name.alias("d"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("d", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % LOSES == 0, less).otherwise(F.col("run")).alias("word")
    counts = rows.select(word).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def blocks(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(block, first, part, left, right, word, n): the words of each block, cut into pairs of parts.

    ``block`` is the shorter length and the half; ``first`` tells which half it
    is. Parts ``left`` and ``right`` of a block meet in one task; ``part`` is
    the word's own.
    """
    size = F.length("word")
    made = []
    for less in (0, 1):  # as the shorter or equal word, and as the longer one
        length = size - less
        head = F.floor(length / 2).cast("int")
        made.append(F.struct(length.alias("length"), F.lit(True).alias("first"), F.substring("word", F.lit(1), head).alias("half")))
        made.append(F.struct(length.alias("length"), F.lit(False).alias("first"), F.substring("word", size - (length - head) + 1, size).alias("half")))
    rows = words.select("word", "n", F.explode(F.array(*made)).alias("b")).select("word", "n", "b.*")
    key = ["length", "first", "half"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    # very long words count for as many as fill the same matrix
    parts = F.ceil(F.col("size") * F.greatest(F.lit(1.0), F.col("length") / USUAL_LENGTH) / tile)
    large = settle(sizes.filter("size > 1").select(*key, F.least(parts, "size").alias("parts")).filter("parts > 1"))
    cut = rows.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    cut = cut.select(*key, "word", "n", "part", other.alias("other"))
    return cut.select(*key, F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", "word", "n")


def _points(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words from the left and from the right, filled with zeros."""
    n = len(words)
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(n, width)
    back = np.frombuffer("".join(w[::-1].ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(n, width)
    return flat, back


def letter_counts(points: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each row, exact in a product; letters outside a-z share columns."""
    n, width = points.shape
    column = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % (LETTERS - 26))
    slot = column.astype(np.int64) + np.arange(n)[:, None] * LETTERS
    return np.bincount(slot[points > 0], minlength=n * LETTERS).reshape(n, LETTERS).astype(np.float32 if width < 4000 else np.float64)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two matrices, from their product."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def near_pairs(words: list[str], group: np.ndarray, first: np.ndarray, shorter: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers i < j of near words of one group, for groups of whole blocks.

    ``part`` is 0 for words that only meet the others of their group, 1 for
    those on the left and 2 for those on the right of a pair of parts, which
    meet across only.
    """
    size = np.array(list(map(len, words)))
    width = int(size.max())
    step = max(1, CELLS // max(width, len(words)))
    points, back = _points(words, width)
    counts = letter_counts(points)
    found_i, found_j = [], []
    for a in range(0, len(words), step):
        b = min(a + step, len(words))
        close = squared_distances(counts[a:b], counts) < 2.5
        close &= group[a:b, None] == group[None, :]
        i, j = np.nonzero(close)
        i += a
        keep = (i < j) & ((part[i] == 0) | (part[i] != part[j])) & ((size[i] == shorter[i]) | (size[j] == shorter[i]))
        i, j = i[keep], j[keep]
        for c in range(0, len(i), step):
            p, q = i[c : c + step], j[c : c + step]
            swap = size[p] > size[q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)  # p is not longer
            low = size[p]
            head = np.argmin(np.append(points[p] == points[q], np.zeros((len(p), 1), bool), 1), 1)
            tail = np.argmin(np.append(back[p] == back[q], np.zeros((len(p), 1), bool), 1), 1)
            head, tail = np.minimum(head, low), np.minimum(tail, low)
            one = np.where(size[q] == low, head + tail == low - 1, head + tail >= low)
            # a pair that shares its first half is found there
            one &= first[p] | (head < low // 2)
            found_i.append(p[one])
            found_j.append(q[one])
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _partial(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
    """One row per word with near words: their number, the largest count and its smallest word."""
    if not len(i):
        return None
    here, there = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), np.int64)  # code-point order
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[there], -n[there], here))
    here, there = here[order], there[order]
    start = np.flatnonzero(np.append(True, np.diff(here) != 0))
    count = np.diff(np.append(start, len(here)))
    own, best = here[start].tolist(), there[start].tolist()
    columns = [pa.array([words[k] for k in own]), pa.array(count.astype(np.int64)), pa.array(n[best]), pa.array([words[k] for k in best])]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def _whole_blocks(batches, rows: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole blocks with at least ``rows`` rows (the last may have fewer)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < rows:
            continue
        bounds = _bounds(held)
        length = held.column("length").to_numpy()
        at = 0
        for b, width in zip(bounds[1:].tolist(), length[bounds[:-1]].tolist()):
            if b - at >= rows or (b - at) * width >= CELLS:
                yield held.slice(at, b - at)
                at = b
        held = held.slice(at).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _bounds(table: pa.Table) -> np.ndarray:
    """First rows of the blocks of a sorted table."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for name in ("length", "first", "half", "left", "right"):
        code = table.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
        change[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(change)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best): words with near words, their number and the most frequent one."""
    key = ["length", "first", "half", "left", "right"]

    def run(batches):
        for table in _whole_blocks(batches, ROWS):
            bounds = _bounds(table)
            group = np.repeat(np.arange(len(bounds)), np.diff(np.append(bounds, table.num_rows)))
            text = table.column("word").to_pylist()
            n = table.column("n").to_numpy()
            first = table.column("first").combine_chunks().to_numpy(zero_copy_only=False)
            left, right, own = (table.column(c).to_numpy() for c in ("left", "right", "part"))
            part = np.where(left == right, 0, np.where(own == left, 1, 2))
            made = _partial(text, n, *near_pairs(text, group, first, table.column("length").to_numpy(), part))
            if made is not None:
                yield made

    rows = blocks(words, tile)
    ranged = rows.repartition(*key).sortWithinPartitions(*key)
    found = ranged.mapInArrow(run, "word string, n_near long, best_n long, best string")
    # the largest count, then the smallest word
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    done = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return done.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow each other from a word; each round doubles the steps."""
    links = settle(links.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = settle(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = stepped.select("word", "root")
        if not stepped.filter("moved").head(1):
            return links


def group_variants(words: DataFrame, tile: int = TILE, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    A form is the near word of largest n, if that is at least ``factor`` times
    the word's; a root is reached by following forms.
    """
    words = settle(words)
    found = words.join(near_words(words, tile), "word", "left")
    enough = F.col("best_n") >= F.lit(factor) * F.col("n")
    found = settle(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"),
        )
    )
    last = roots(found.filter("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL for the same rows: near words meet through what is left of them without one code point."""
    from foldwise.llm.prefix_trie import crc32_sql

    return f"""
WITH texts AS (SELECT doc_id, translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
runs AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-zÀ-ÿ]{{{{{LEAST_LENGTH},}}}}')) AS run FROM texts),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, run, count(*) AS k FROM runs GROUP BY 1, 2),
hashed AS (SELECT run, k, {crc32_sql("d || ':' || run")} AS h FROM counted),
made AS (
  SELECT k, CASE WHEN h % {LOSES} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM made GROUP BY word HAVING sum(k) >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}),
less AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, encode(b)) AS form, max(w.n) AS form_n
  FROM pairs JOIN words w ON w.word = b GROUP BY a),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {FORM_FACTOR} * w.n THEN form END AS form,
    CASE WHEN form_n >= {FORM_FACTOR} * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
steps AS (
  WITH RECURSIVE s AS (
    SELECT word, word AS at FROM forms UNION ALL SELECT s.word, f.form FROM s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL)
  SELECT s.word, s.at AS root FROM s JOIN forms f ON f.word = s.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN steps USING (word)
""".replace("{{", "{").replace("}}", "}")
