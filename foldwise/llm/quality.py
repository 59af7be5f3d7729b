"""Quality rules: counts of words, symbols and lines, and repetition inside a text by suffix array.

The suffixes of all texts of a block are sorted together over word numbers
that are distinct for each text, by doubling the compared length and sorting
again only the suffixes that are still equal. The ranks of each length give
the longest common prefix of neighbours. An interval of neighbours that share
at least ``min_words`` words is a repeated passage; each member covers as many
words as it shares with a neighbour, and the union of these spans is the
repeated part of the text.

Defined results: a null or empty text has no words, and fails; repeated rows
are judged one by one; a text of any length is judged as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foldwise.llm.words import (
    BLANK_WORDS,
    cover,
    map_text,
    quoted,
    row_sums,
    text_buffer,
    word_hashes,
    word_spans,
)

MIN_WORDS = 50
MIN_REPEAT = 8
MAX_COVERED = 0.5
MAX_LONGEST = 100

# fixed values: the characters that count as symbols
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
CONTINUES = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)
BLANKS = b" \t\n\x0b\x0c\r"

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_repeats"]
RESULT = T.StructType([T.StructField(name, T.LongType()) for name in FIELDS])


def suffix_array(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the word suffixes of all rows, and the words each shares with the one before it.

    Suffixes of different rows share nothing. The order of single words is
    that of their hashes; any fixed order serves to find repeats.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][row]
    order = np.lexsort((hashes, row))
    new = np.ones(n, bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    heads = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    levels = [rank.astype(np.int32)]
    sizes = np.diff(np.append(heads, n))
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the order that are not settled
    width = 1
    while len(slots):
        suffix = order[slots]
        own, after = rank[suffix], suffix + width
        second = np.where(after < end[suffix], rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, own))
        suffix, second, own = suffix[by], second[by], own[by]
        order[slots] = suffix
        new = np.ones(len(suffix), bool)
        new[1:] = (second[1:] != second[:-1]) | (own[1:] != own[:-1])
        inner = np.flatnonzero(new)
        sizes = np.diff(np.append(inner, len(suffix)))
        rank[suffix] = np.repeat(slots[inner], sizes)
        levels.append(rank.astype(np.int32))
        slots = slots[np.repeat(sizes > 1, sizes)]
        width *= 2
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    pairs = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pairs], b[pairs]
    total = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(pairs), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same * (1 << k)
        total += step
        a, b = a + step, b + step
    shared[pairs + 1] = total
    return order, shared


def _counts(texts: pa.Array) -> list[pa.Array]:
    data, offsets = text_buffer(texts)
    starts, ends, first = word_spans(data, offsets, BLANK_WORDS)
    hashes = word_hashes(data, starts, ends)
    n, n_rows = len(hashes), len(first) - 1
    order, shared = suffix_array(hashes, first)
    # the longest match of each suffix is with a neighbour in the order
    longest = np.zeros(n, np.int64)
    if n:
        longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    places = np.arange(n)
    twice = longest >= 3
    repeat = cover(places[twice], places[twice] + 3, n)
    member = longest >= MIN_REPEAT
    covered = cover(places[member], places[member] + longest[member], n)
    top = np.zeros(n_rows, np.int64)
    rows = np.repeat(np.arange(n_rows), np.diff(first))
    np.maximum.at(top, rows[member], longest[member])
    # an interval opens where the order leaves a passage; it is maximal if different words come before its members
    opens = np.flatnonzero((shared < MIN_REPEAT) & (np.append(shared[1:], 0) >= MIN_REPEAT))
    n_repeats = np.zeros(n_rows, np.int64)
    if len(opens):
        before = np.where(order > first[:-1][rows[order]], hashes[np.maximum(order - 1, 0)], np.uint64(0))
        differs = np.zeros(n + 1, np.int64)
        differs[2:] = np.cumsum((before[1:] != before[:-1]) & (shared[1:] >= MIN_REPEAT))
        inside = np.flatnonzero(np.append(shared[1:], 0) < MIN_REPEAT)
        closes = inside[np.searchsorted(inside, opens)]
        maximal = differs[closes + 1] > differs[opens + 1]
        n_repeats = np.bincount(rows[order[opens[maximal]]], minlength=n_rows)
    points = row_sums(~CONTINUES[data] & BLANK_WORDS[data], offsets)
    symbols = row_sums(SYMBOLS[data], offsets)
    lines = []
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = [line for line in raw[a:b].split(b"\n") if line.strip(BLANKS)]
        lines.append(len(own) - len(set(own)))
    out = [np.diff(first), points, symbols, lines, row_sums(repeat, first), row_sums(covered, first), top, n_repeats]
    return [pa.array(x, pa.int64()) for x in out]


def measure(df: DataFrame, text: str = "text", out: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """Adds the struct ``out`` of counts; a column already named ``out`` is replaced."""
    return map_text(df, text, out, RESULT, lambda: lambda block, texts: _counts(texts), keep=keep)


def base_failed(out: str = "quality"):
    c = quoted(out)
    return (F.col(f"{c}.n_words") < MIN_WORDS) | (100 * F.col(f"{c}.n_repeat_words") > 50 * F.col(f"{c}.n_words"))


def kept(out: str = "quality", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST):
    """Passes the base rules, and neither the repeated part nor the longest repeat is too large."""
    c = quoted(out)
    return (
        ~base_failed(out)
        & (F.col(f"{c}.covered_words") <= F.lit(max_covered) * F.col(f"{c}.n_words"))
        & (F.col(f"{c}.longest_repeat") <= max_longest)
    )


def apply_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes all rules, with their own columns."""
    out = "__quality__"
    return measure(df, text, out).filter(kept(out)).drop(out)
