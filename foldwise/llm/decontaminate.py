"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of consecutive item words is a pattern. A block of two words that
ends ``d`` words before the end of some pattern may be shifted by ``d``; a
block that no pattern holds is skipped as far as a pattern is long. Blocks
with shift 0 select, by their hash, the bucket of patterns that end with them,
and a direct comparison confirms each occurrence. Many texts are searched in
step: each lane is a stretch of one text, and one numpy step moves all lanes.

The benchmark is a stated query set. It is cut into parts of bounded size;
each part is sent to the tasks and all documents pass it, in one narrow stage.

Defined results: a null text has no words; an item without words is no
pattern; a null item id counts under the empty string; items with the same id
count once; repeated documents are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foldwise.llm.words import (
    ALNUM_WORDS,
    LOWER,
    cover,
    map_text,
    mix,
    quoted,
    row_sums,
    runs,
    text_buffer,
    word_hashes,
    word_spans,
)
from foldwise.session import settle

# words of benchmark items that are searched for in one pass, about 20 bytes a word in each task
PART_CHARS = 8_000_000
# words of a text that one lane of the search covers
LANE = 256
TABLE_BITS = 20
BEFORE = "__before__"

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hits", T.ArrayType(T.IntegerType())),  # first and behind-last word of each hit stretch
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class Patterns:
    """Shift table and buckets of the patterns of one length."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, length: int, items: np.ndarray):
        self.length = length
        self.block = min(2, length)
        self.hashes = hashes
        # equal windows are one pattern with several items
        grid = hashes[at[:, None] + np.arange(length)]
        _, first, inverse = np.unique(grid, axis=0, return_index=True, return_inverse=True)
        inverse = inverse.ravel()
        self.at = at[first]
        order = np.argsort(inverse, kind="stable")
        self.item_list = items[order]
        self.item_from = np.searchsorted(inverse[order], np.arange(len(first) + 1))
        most = length - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, most, np.int64)
        blocks = self.blocks(hashes)
        for j in range(most):
            slots = (blocks[self.at + j] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            np.minimum.at(self.shift, slots, most - 1 - j)
        suffix = blocks[self.at + most - 1]
        by_suffix = np.argsort(suffix, kind="stable")
        self.at, self.suffix = self.at[by_suffix], suffix[by_suffix]
        self.number = by_suffix

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        if self.block == 1:
            return mix(hashes)
        out = np.zeros(len(hashes), np.uint64)
        out[:-1] = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
        return out

    def search(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and pattern numbers of all occurrences inside the rows given by ``first``."""
        last = first[1:] - self.length  # last place a pattern can start at
        rows = np.flatnonzero(last >= first[:-1])
        lanes = (last[rows] - first[rows]) // LANE + 1
        which = np.repeat(rows, lanes)
        step = np.arange(len(which)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        place = first[which] + step * LANE
        stop = np.minimum(place + LANE - 1, last[which])
        blocks = self.blocks(hashes)
        slots = (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        behind = self.length - self.block
        found = []
        while len(place):
            shift = self.shift[slots[place + behind]]
            zero = shift == 0
            if zero.any():
                found.append(place[zero])
            place = place + np.maximum(shift, 1)
            live = place <= stop
            place, stop = place[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places = np.concatenate(found)
        low = np.searchsorted(self.suffix, blocks[places + behind], "left")
        high = np.searchsorted(self.suffix, blocks[places + behind], "right")
        out_place, out_pattern = [], []
        while True:  # one candidate of each bucket at a time
            live = low < high
            if not live.any():
                break
            places, low, high = places[live], low[live], high[live]
            same = np.ones(len(places), bool)
            for j in range(self.length):
                same &= hashes[places + j] == self.hashes[self.at[low] + j]
            out_place.append(places[same])
            out_pattern.append(low[same])
            low = low + 1
        if not out_place:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_place), np.concatenate(out_pattern)


class Part:
    """The patterns of one part of the benchmark."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int):
        data, offsets = text_buffer(pa.array(texts, pa.string()))
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, ALNUM_WORDS)
        hashes = word_hashes(data, starts, ends)
        self.ids = ids
        self.data, self.starts, self.ends = data, starts, ends
        sizes = np.diff(first)
        self.groups = []
        for length in np.unique(np.minimum(sizes[sizes > 0], width)):
            rows = np.flatnonzero(np.minimum(sizes, width) == length)
            counts = sizes[rows] - length + 1 if length == width else np.ones(len(rows), np.int64)
            items = np.repeat(rows, counts)
            at = first[items] + np.arange(len(items)) - np.repeat(np.cumsum(counts) - counts, counts)
            self.groups.append(Patterns(hashes, at, int(length), items))


def benchmark_parts(benchmark: DataFrame, item: str, text: str, width: int) -> Iterator[Part]:
    """The benchmark in parts whose size is bounded (by one item, if that is larger)."""
    rows = benchmark.select(
        F.coalesce(F.col(quoted(item)).cast("string"), F.lit("")).alias("i"), F.col(quoted(text)).cast("string").alias("t")
    )
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-chars // PART_CHARS)
    part = F.pmod(F.xxhash64("i", "t"), F.lit(max(n, 1)))
    for k in range(n):
        some = rows.filter(part == k).collect()
        yield Part([r["i"] for r in some], [r["t"] for r in some], width)


def _found(part: Part, texts, width: int, before) -> list[pa.Array]:
    data, offsets = text_buffer(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, ALNUM_WORDS)
    hashes = word_hashes(data, starts, ends)
    n_rows = len(first) - 1
    from_, to = [], []
    items: list[set[str]] = [set() for _ in range(n_rows)]
    for group in part.groups:
        places, patterns = group.search(hashes, first)
        if not len(places):
            continue
        rows = np.searchsorted(first, places, "right") - 1
        same = np.zeros(len(places), bool)
        for k, (p, q) in enumerate(zip(places, group.at[patterns])):  # the words themselves
            same[k] = all(
                data[starts[p + j] : ends[p + j]].tobytes() == part.data[part.starts[q + j] : part.ends[q + j]].tobytes()
                for j in range(group.length)
            )
        places, patterns, rows = places[same], patterns[same], rows[same]
        from_.append(places)
        to.append(places + group.length)
        for r, p in set(zip(rows.tolist(), group.number[patterns].tolist())):
            items[r].update(part.ids[i] for i in group.item_list[group.item_from[p] : group.item_from[p + 1]].tolist())
    if before is not None:
        old = before.field("hits")
        flat = old.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.diff(old.offsets.to_numpy()) // 2
        base = np.repeat(first[:-1], lengths)
        from_.append(flat[0::2] + base)
        to.append(flat[1::2] + base)
        for r, names in enumerate(before.field("items").to_pylist()):
            items[r].update(names)
    join = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
    hit = cover(join(from_), join(to), len(starts))
    run_from, run_to, bounds = runs(hit, first)
    base = np.repeat(first[:-1], np.diff(bounds))
    pairs = np.stack([run_from - base, run_to - base], 1).astype(np.int32).ravel()
    return [
        pa.array(np.diff(first), pa.int64()),
        pa.array(row_sums(hit, first), pa.int64()),
        pa.ListArray.from_arrays(pa.array(2 * bounds, pa.int32()), pa.array(pairs, pa.int32())),
        pa.array([sorted(names) for names in items], pa.list_(pa.string())),
    ]


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = 13,
    out: str = "contamination",
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds ``out``: number of words, hit words, hit stretches and sorted ids of the items found in each text.

    A column already named ``out`` is replaced; ``keep`` names the columns to return besides it.
    A benchmark of several parts takes one pass for each, written in the shared folder before the next: a task
    holds one part, the driver two.
    """
    context = documents.sparkSession.sparkContext
    keep = [c for c in (documents.columns if keep is None else keep) if c != out]
    done = documents.select(*[F.col(quoted(c)) for c in dict.fromkeys([*keep, text])])
    parts = benchmark_parts(benchmark, item, item_text, width)
    part, later = next(parts, None) or Part([], [], width), False
    while part is not None:
        sent = context.broadcast(part)
        part = next(parts, None)
        carried = keep if part is None else list(dict.fromkeys([*keep, text]))
        if later:  # what the parts before found rides along
            done = done.withColumnRenamed(out, BEFORE)
        done = map_text(done, text, out, RESULT, _searcher(sent, width, later), keep=[*carried, *[BEFORE] * later])
        done = done.drop(BEFORE)
        if part is not None:
            done = settle(done)
            sent.destroy()
        later = True
    return done


def _searcher(sent, width: int, later: bool):
    def make():
        def fn(block, texts):
            before = block.column(block.schema.get_field_index(BEFORE)) if later else None
            return _found(sent.value, texts, width, before)

        return fn

    return make


def contaminated(out: str = "contamination"):
    """True where at least a twentieth of the words is hit."""
    n_hit, n_words = F.col(f"{quoted(out)}.n_hit"), F.col(f"{quoted(out)}.n_words")
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    out = "__contamination__"
    found = find_contamination(documents, benchmark, out=out, **options)
    return found.filter(~contaminated(out)).drop(out)


def digest(found: DataFrame, doc: str = "doc_id", out: str = "contamination") -> DataFrame:
    c = quoted(out)
    return found.select(
        F.col(quoted(doc)).alias("doc_id"),
        F.col(f"{c}.n_words").alias("n_words"),
        F.col(f"{c}.n_hit").alias("n_hit"),
        F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f"{c}.items"), 256).alias("items_sha256"),
        contaminated(out).alias("contaminated"),
    )
