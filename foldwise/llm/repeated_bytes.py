"""Removal of bytes that an earlier 100-byte string covers, by suffix sorting with linear grouping.

Each window of 100 bytes has an anchor, the place inside it whose 32 bytes
have the least hash; equal windows have the same anchor. Neighbouring windows
with one anchor form a context, the stretch of text they cover. Contexts meet
by the hash of their anchor:

* of contexts that are equal as a whole (128-bit hash) all but the first are repeats;
* if an anchor has only one context, its windows occur nowhere else;
* contexts that share their anchor and differ are sorted together: their
  suffixes are brought into order by the linear grouping construction, and
  windows that begin neighbouring suffixes and are equal form a class, of which all but
  the first are repeats; a context that agrees with no other of its anchor in 100 bytes
  around it has no window in common with them and is not sorted;
* an anchor with so many different contexts that one task should not sort them
  (a short line that very many texts share) has its windows compared one by one, by a 128-bit hash.

Windows that are known to be repeats are not looked at again, and equal
contexts inside a block of texts are combined before they are sent.

Defined results: a null text is empty; a text shorter than 100 bytes stays whole; rows with
the same id count as one document, in which the smaller start is the earlier
one; a null id is smaller than all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from foldwise.llm import words
from foldwise.llm.exchange import FOUND, keyed, parts_for, per_hash, places_by_document, send, shifted, spans_of
from foldwise.llm.suffix_groups import suffix_array
from foldwise.llm.words import cover, map_text, mix, row_sums, runs, text_buffer
from foldwise.session import settle

WINDOW = 100
GRAM = 32
REACH = WINDOW - GRAM  # places of a window's anchor behind its start, at most
# bytes looked at in one step; places in it fit the low bits of a number
STEP = 1 << 18
_LOW = np.uint64((1 << 20) - 1)
# bytes of text in one block
BLOCK = 3 << 20
# characters of text whose anchors meet in one partition
PART_CHARS = 30_000_000
# different contexts of one anchor that are sorted together, and those that one block sends
MANY = 2_000
MANY_IN_BLOCK = 48
# bytes of contexts in one suffix array
SORT_BYTES = 16_000
# kinds of places: contexts to be sorted, windows to be compared one by one
SORTED, SINGLE = 3, 4

_CONTEXT = np.dtype([("anchor", "<u4"), ("low", "<u8"), ("high", "<u8"), ("n", "u1"), ("many", "u1")])


def contexts(data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray | None = None):
    """Starts, numbers of windows, anchor hashes and anchor places of the contexts of all rows, in order.

    ``allowed`` marks the windows (by their start) to look at; a context has only neighbouring ones.
    """
    n = len(data)
    good = np.zeros(n, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= WINDOW:
            good[a : b - WINDOW + 1] = True
    if allowed is not None:
        good &= allowed
    power, inverse = words._powers()
    starts, sizes, anchors, places = [], [], [], []
    for base in range(0, n, STEP - WINDOW):
        stop = min(base + STEP, n)
        own = good[base : min(base + STEP - WINDOW, n)]
        if stop - base < WINDOW or not own.any():
            continue
        piece = data[base:stop].astype(np.uint64)
        piece += np.uint64(1)
        piece *= power[: len(piece)]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece, out=total[1:])
        m = len(piece) - GRAM + 1
        gram = mix((total[GRAM:] - total[:m]) * inverse[:m])
        least = (gram & ~_LOW) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= REACH + 1:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        if rest:
            least = np.minimum(least[: len(least) - rest], least[rest:])
        at = np.flatnonzero(own[: len(least)])
        anchor = (least[at] & _LOW).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        starts.append(at[heads] + base)
        sizes.append(np.diff(np.append(heads, len(at))))
        anchors.append(gram[anchor[heads]])
        places.append(anchor[heads] + base)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(anchors), np.concatenate(places)


def _digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    joined = b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(joined, np.dtype([("low", "<u8"), ("high", "<u8")]))


def _firsts(keys: list[np.ndarray], ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys: which are later than the first by (id, place), and the group of each, numbered."""
    order = np.lexsort((at, ids, *keys))
    new = np.ones(len(order), bool)
    for k in keys:
        new[1:] &= k[order][1:] == k[order][:-1]
    new[1:] = ~new[1:]
    group = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)][group]
    later = np.zeros(len(order), bool)
    later[order] = (ids[order] > ids[lead]) | (at[order] > at[lead])
    number = np.empty(len(order), np.int64)
    number[order] = group
    return later, number


def _pairs(places, sizes):
    return places, places + sizes


def _anchored(part: pa.RecordBatch):
    data, offsets = text_buffer(part.column(2))
    starts, sizes, anchors, _ = contexts(data, offsets)
    found = _digests(data.tobytes(), starts, starts + sizes + WINDOW - 1)
    row = np.searchsorted(offsets, starts, "right") - 1
    ids = part.column(0).to_numpy()[row]
    later, _ = _firsts([found["low"], found["high"]], ids, starts - offsets[row])
    keep = np.flatnonzero(~later)
    # an anchor with very many contexts in this block sends one of them, which tells the others so
    order, group = per_hash(anchors[keep])
    count = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    many = np.zeros(len(keep), bool)
    many[order] = count[group] > MANY_IN_BLOCK
    first = np.zeros(len(keep), bool)
    first[order[np.flatnonzero(np.diff(group, prepend=-1))]] = True
    sent = keep[~many | first]
    records = np.zeros(len(sent), _CONTEXT)
    records["anchor"] = anchors[sent] & np.uint64(0xFFFFFFFF)
    records["low"], records["high"] = found["low"][sent], found["high"][sent]
    records["n"], records["many"] = sizes[sent], many[~many | first]
    told = {FOUND: _pairs(starts[later], sizes[later]), SINGLE: _pairs(starts[keep[many]], sizes[keep[many]])}
    return anchors[sent], records, starts[sent], told, offsets


def _joined(got, kind):
    records = np.concatenate([r for _, r, *_ in got]).view(kind).ravel()
    ids = np.concatenate([d for *_, d, _ in got])
    at = np.concatenate([a for *_, a in got])
    return records, ids, at


def _resolve(got):
    """Repeats among equal contexts, and what is left to be sorted or compared."""
    records, ids, at = _joined(got, _CONTEXT)
    later, same = _firsts([records["low"], records["high"]], ids, at)
    alone = ~later
    order, group = per_hash(records["anchor"])
    n = int(group[-1]) + 1
    different = np.bincount(group, alone[order] & ~_repeated_same(same, later, alone)[order], n)
    many = (different > MANY) | (np.bincount(group, records["many"][order], n) > 0)
    several = np.zeros(len(records), bool)
    crowded = np.zeros(len(records), bool)
    several[order] = (different > 1)[group]
    crowded[order] = many[group]
    kinds = np.where(later, FOUND, np.where(crowded, SINGLE, np.where(several, SORTED, -1)))
    i = 0
    for block, r, places, *_ in got:
        own, sizes = kinds[i : i + len(r)], records["n"][i : i + len(r)].astype(np.int64)
        for kind in (FOUND, SORTED, SINGLE):
            if (own == kind).any():
                yield block, kind, np.stack(_pairs(places[own == kind], sizes[own == kind]), 1)
        i += len(r)


def _repeated_same(same, later, alone):
    """Firsts beyond one of the same context (rows with equal id and place)."""
    _, lead = np.unique(np.where(alone, same, -1), return_index=True)
    first = np.zeros(len(same), bool)
    first[lead] = True
    return alone & ~first


_WINDOW = np.dtype([("low", "<u8"), ("high", "<u8")])


def _single(part: pa.RecordBatch):
    """The windows of crowded anchors one by one."""
    data, offsets = text_buffer(part.column(2))
    spans = shifted(spans_of(part.column(3)), offsets)
    starts = np.flatnonzero(cover(spans[:, 0], spans[:, 1], len(data)))
    found = _digests(data.tobytes(), starts, starts + WINDOW)
    row = np.searchsorted(offsets, starts, "right") - 1
    later, _ = _firsts([found["low"], found["high"]], part.column(0).to_numpy()[row], starts - offsets[row])
    keep = ~later
    return found["low"][keep], found[keep].astype(_WINDOW), starts[keep], {FOUND: _pairs(starts[later], 1)}, offsets


def _single_answer(got):
    records, ids, at = _joined(got, _WINDOW)
    later, _ = _firsts([records["low"], records["high"]], ids, at)
    i = 0
    for block, r, places, *_ in got:
        own = places[later[i : i + len(r)]]
        yield block, FOUND, np.stack(_pairs(own, 1), 1)
        i += len(r)


_TEXT = np.dtype([("anchor", "<u8"), ("n", "u1"), ("place", "u1"), ("text", f"V{REACH + WINDOW}")])


def _to_sort(part: pa.RecordBatch):
    """Contexts with their text."""
    data, offsets = text_buffer(part.column(2))
    spans = shifted(spans_of(part.column(3)), offsets)
    allowed = cover(spans[:, 0], spans[:, 1], len(data))
    starts, sizes, anchors, places = contexts(data, offsets, allowed)
    records = np.zeros(len(starts), _TEXT)
    records["anchor"], records["n"], records["place"] = anchors, sizes, places - starts
    padded = np.append(data, np.zeros(REACH + WINDOW, np.uint8))
    grid = padded[starts[:, None] + np.arange(REACH + WINDOW)]
    grid[np.arange(REACH + WINDOW) >= (sizes + WINDOW - 1)[:, None]] = 0
    records["text"] = np.ascontiguousarray(grid).view(f"V{REACH + WINDOW}").ravel()
    return anchors, records, starts, {}, offsets


def _may_share(records: np.ndarray) -> np.ndarray:
    """Which contexts agree with others of their anchor in 100 bytes around it; without that no window is equal.

    Equal windows have their anchor at the same place. What a context has in common with any other, to the left
    and to the right of the anchor, it has in common with a neighbour in the order of that side.
    """
    n = len(records)
    text = np.frombuffer(records["text"].tobytes(), np.uint8).reshape(n, REACH + WINDOW)
    place = records["place"].astype(np.int64)[:, None]
    size = records["n"].astype(np.int64)[:, None] + WINDOW - 1
    anchor = records["anchor"].astype(">u8").view(np.uint8).reshape(n, 8)
    common = np.full(n, GRAM)
    for at in (place - 1 - np.arange(REACH), place + GRAM + np.arange(REACH)):
        inside = (at >= 0) & (at < size)
        side = np.where(inside, np.take_along_axis(text, np.where(inside, at, 0), 1), np.uint8(0xFF))
        key = np.concatenate([anchor, side], axis=1)
        order = np.argsort(key.view(f"S{key.shape[1]}").ravel(), kind="stable")
        differ = key[order[1:]] != key[order[:-1]]
        equal = np.where(differ.any(axis=1), differ.argmax(axis=1), key.shape[1]) - 8
        longest = np.zeros(n, np.int64)
        longest[order[1:]] = np.maximum(equal, 0)
        longest[order[:-1]] = np.maximum(longest[order[:-1]], equal)
        common += np.minimum(longest, inside.sum(axis=1))
    return common >= WINDOW


def equal_windows(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Classes of equal windows of several texts, as (text, start), by one suffix array."""
    raw = b"\0".join(texts)
    buffer = np.frombuffer(raw, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = ends - [len(t) + 1 for t in texts]
    own = cover(begins, np.maximum(ends - WINDOW, begins), len(raw))
    # bytes are one higher than in the texts, so that the marks between texts are smaller than all
    symbols = buffer.astype(np.int64) + 1
    symbols[ends[:-1] - 1] = 0
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    order = order[own[order]]
    windows = buffer[order[:, None] + np.arange(WINDOW)]
    same = (windows[1:] == windows[:-1]).all(axis=1)
    text = np.searchsorted(ends, order, "right")
    places = list(zip(text.tolist(), (order - begins[text]).tolist()))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]]).astype(np.int8)))
    return [places[a : b + 1] for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist())]


def _sort_answer(got):
    """Repeats among the windows of contexts that share an anchor."""
    records, ids, at = _joined(got, _TEXT)
    block = np.repeat(np.arange(len(got)), [len(r) for _, r, *_ in got])
    place = np.concatenate([p for _, _, p, *_ in got])
    order, group = per_hash(records["anchor"])
    raw = records["text"]
    repeats: list[tuple[int, int]] = []

    def sort(numbers: list[int]):
        texts = [raw[i].tobytes()[: int(records["n"][i]) + WINDOW - 1] for i in numbers]
        for same in equal_windows(texts):
            keys = [(int(ids[numbers[k]]), int(at[numbers[k]]) + s) for k, s in same]
            first = min(keys)
            repeats.extend((numbers[k], s) for (k, s), key in zip(same, keys) if key > first)

    shares = _may_share(records)[order]
    order, group = order[shares], group[shares]
    bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(order)).tolist()
    held, size = [], 0
    for a, b in zip(bounds, bounds[1:]):  # whole anchors, several to a suffix array
        if b - a > 1:
            held += order[a:b].tolist()
            size += (b - a) * (REACH + WINDOW)
            if size > SORT_BYTES:
                sort(held)
                held, size = [], 0
    if held:
        sort(held)
    if repeats:
        number, shift = (np.array(x) for x in zip(*repeats))
        for k, (name, *_) in enumerate(got):
            own = block[number] == k
            yield name, FOUND, np.stack(_pairs(place[number[own]] + shift[own], 1), 1)


RESULT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def _cut_out(block, texts, with_text: bool):
    data, offsets = text_buffer(texts)
    gone = np.zeros(len(data), bool)
    for name in ("spans", "more"):
        spans = shifted(spans_of(block.column(block.schema.get_field_index(name))), offsets)
        gone |= cover(spans[:, 0], spans[:, 1] + WINDOW - 1, len(data))
    stay = ~gone
    raw = data[stay].tobytes()
    left = row_sums(stay, offsets)
    ends = np.cumsum(left)
    _, _, bounds = runs(gone, offsets)
    kept = [raw[a:b] for a, b in zip((ends - left).tolist(), ends.tolist())]
    return [
        pa.array(np.diff(offsets), pa.int64()),
        pa.array(row_sums(gone, offsets), pa.int64()),
        pa.array(np.diff(bounds), pa.int64()),
        pa.array(kept if with_text else [None] * len(kept), pa.binary()),
        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    ]


def remove_repeats(df: DataFrame, doc: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_removed, n_spans, the remaining bytes and their SHA-256."""
    docs = keyed(df, doc, text)
    parts = parts_for(df, text, PART_CHARS)
    told = settle(
        places_by_document(send(docs, _anchored, parts, _resolve, BLOCK), (FOUND, SORTED, SINGLE))
    )
    # only the texts with something left to look at, computed once for both ways
    open_ = told.filter(F.col("kind") != FOUND).groupBy("d", "h").agg(
        *[F.first(F.when(F.col("kind") == k, F.col("spans")), ignorenulls=True).alias(n) for k, n in ((SORTED, "to_sort"), (SINGLE, "single"))]
    )
    marked = settle(docs.join(open_, ["d", "h"]).select("d", "h", "t", "to_sort", "single"))
    one = lambda name: marked.filter(F.col(name).isNotNull()).select("d", "h", "t", name)
    by_sorting = send(one("to_sort"), _to_sort, 4 * parts, _sort_answer, BLOCK)
    one_by_one = send(one("single"), _single, parts, _single_answer, BLOCK)
    more = (
        places_by_document(by_sorting)
        .union(places_by_document(one_by_one))
        .groupBy("d", "h")
        .agg(F.collect_list("spans").alias("lists"))
        .select("d", "h", F.concat(F.coalesce(F.element_at("lists", 1)), F.coalesce(F.try_element_at("lists", F.lit(2)), F.lit(b""))).alias("more"))
    )
    whole = told.filter(F.col("kind") == FOUND).select("d", "h", "spans")
    final = docs.join(settle(whole.join(more, ["d", "h"], "full")), ["d", "h"], "left")
    out = map_text(
        final, "t", "r", RESULT, lambda: lambda block, texts: _cut_out(block, texts, with_text), keep=["d", "spans", "more"]
    )
    doc_id = F.when(F.col("d") != -(1 << 63), F.col("d")).alias("doc_id")
    return out.select(doc_id, "r.*")
