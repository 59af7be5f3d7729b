"""Removal of repeated passages by fixed-block anchors.

A window of 13 words always holds one whole block of seven words of any cut of
its text into consecutive blocks. The blocks of every document, cut from its
first word, are the index; every rolling window of seven words of every document is a
probe. Probes and blocks meet by hash; where a block meets another place, both are
anchors. The matches are extended from the anchors: all windows of 13 words
around an anchor are compared by a hash of 96 bits, and a
window that starts in a document with a smaller id too is part of a repeat. The union
of these windows are the maximal repeats, which are removed.

Blocks of texts combine equal hashes before they send them, so the copies of a
passage inside a block count once.

Defined results: a null text has no words; a null id is smaller than all
others; rows with the same id are one document, each with its own text; a text with fewer than 13 words
keeps all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foldwise.llm.exchange import FOUND, keyed, parts_for, per_hash, places_by_document, send, shifted, spans_of
from foldwise.llm.words import (
    BLANK_WORDS,
    cover,
    map_text,
    row_sums,
    runs,
    text_buffer,
    whole_windows,
    window_hashes,
    word_hashes,
    word_spans,
)
from foldwise.session import settle

WINDOW = 13
BLOCK = 7  # the longest block of which every window holds a whole one
# characters of text whose records meet in one partition
PART_CHARS = 20_000_000

_ANCHOR = np.dtype([("hash", "<u4"), ("indexed", "u1")])
_REPEAT = np.dtype([("low", "<u8"), ("high", "<u4")])


def _words(texts):
    data, offsets = text_buffer(texts)
    starts, ends, first = word_spans(data, offsets, BLANK_WORDS)
    return data, starts, ends, first


def _anchors(part: pa.RecordBatch):
    """Rolling windows of seven words, one record for each distinct one of the block."""
    data, starts, ends, first = _words(part.column(2))
    at = whole_windows(first, WINDOW)  # places where a window of 13 starts
    at = np.unique(np.concatenate([at + j for j in range(WINDOW - BLOCK + 1)])) if len(at) else at
    hashes = window_hashes(word_hashes(data, starts, ends), BLOCK)[at] if len(at) else np.zeros(0, np.uint64)
    row = np.searchsorted(first, at, "right") - 1
    indexed = (at - first[row]) % BLOCK == 0
    order, group = per_hash(hashes)
    n = int(group[-1]) + 1 if len(group) else 0
    size = np.bincount(group, minlength=n)
    again = order[size[group] > 1]
    lead = np.full(n, len(at))
    np.minimum.at(lead, group, order)
    any_indexed = np.bincount(group, indexed[order], n) > 0
    by_place = np.argsort(lead, kind="stable")
    lead, any_indexed = lead[by_place], any_indexed[by_place]
    records = np.zeros(n, _ANCHOR)
    records["hash"], records["indexed"] = hashes[lead] & np.uint64(0xFFFFFFFF), any_indexed
    return hashes[lead], records, at[lead], {FOUND: (at[again], at[again] + 1)}, first


def _meet(got):
    """Places whose hash came from several blocks, at least one of them an index block."""
    records = np.concatenate([r for _, r, *_ in got]).view(_ANCHOR).ravel()
    order, group = per_hash(records["hash"])
    n = int(group[-1]) + 1
    hit = (np.bincount(group, minlength=n) > 1) & (np.bincount(group, records["indexed"][order], n) > 0)
    found = np.zeros(len(records), bool)
    found[order] = hit[group]
    at = 0
    for block, r, places, *_ in got:
        own = places[found[at : at + len(r)]]
        yield block, FOUND, np.stack([own, own + 1], 1)
        at += len(r)


def _repeats(part: pa.RecordBatch, spans_at: int):
    """The windows of 13 words around anchors: repeats inside the block, and one record for each other one."""
    data, starts, ends, first = _words(part.column(2))
    spans = shifted(spans_of(part.column(spans_at)), first)
    around = cover(np.maximum(spans[:, 0] - (WINDOW - BLOCK), 0), spans[:, 1], len(starts))
    at = whole_windows(first, WINDOW)
    at = at[around[at]]
    words = word_hashes(data, starts, ends)
    low = window_hashes(words, WINDOW)[at] if len(at) else np.zeros(0, np.uint64)
    high = window_hashes(words, WINDOW, 0x9FB21C651E98DF25)[at] if len(at) else np.zeros(0, np.uint64)
    ids = part.column(0).to_numpy()[np.searchsorted(first, at, "right") - 1]
    order, group = per_hash(low ^ (high << np.uint64(1)))
    n = int(group[-1]) + 1 if len(group) else 0
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids[order])
    later = np.zeros(len(at), bool)
    later[order] = ids[order] > least[group]
    records = np.zeros(int((~later).sum()), _REPEAT)
    records["low"], records["high"] = low[~later], high[~later] & np.uint64(0xFFFFFFFF)
    return low[~later], records, at[~later], {FOUND: (at[later], at[later] + 1)}, first


def _earlier(got):
    """Places whose window came from a document with a smaller id too."""
    records = np.concatenate([r for _, r, *_ in got]).view(_REPEAT).ravel()
    ids = np.concatenate([d for _, _, _, d, _ in got])
    order = np.lexsort((records["high"], records["low"]))
    new = np.ones(len(order), bool)
    new[1:] = (records["low"][order][1:] != records["low"][order][:-1]) | (
        records["high"][order][1:] != records["high"][order][:-1]
    )
    group = np.cumsum(new) - 1
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids[order])
    later = np.zeros(len(order), bool)
    later[order] = ids[order] > least[group]
    at = 0
    for block, r, places, *_ in got:
        own = places[later[at : at + len(r)]]
        yield block, FOUND, np.stack([own, own + 1], 1)
        at += len(r)


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("removed", T.ArrayType(T.IntegerType())),  # first and behind-last word of each stretch
    ]
)


def _cut_out(block, texts, with_text: bool):
    data, starts, ends, first = _words(texts)
    spans = shifted(spans_of(block.column(block.schema.get_field_index("spans"))), first)
    gone = cover(spans[:, 0], spans[:, 1] + WINDOW - 1, len(starts))
    raw = data.tobytes()
    kept, digests = [], []
    stay = np.flatnonzero(~gone)
    bounds = np.searchsorted(stay, first)
    s, e = starts[stay].tolist(), ends[stay].tolist()
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        text = b" ".join([raw[x:y] for x, y in zip(s[a:b], e[a:b])])
        kept.append(text.decode("utf-8", "replace") if with_text else None)
        digests.append(hashlib.sha256(text).hexdigest())
    f, t, edges = runs(gone, first)
    base = np.repeat(first[:-1], np.diff(edges))
    pairs = np.stack([f - base, t - base], 1).astype(np.int32).ravel()
    return [
        pa.array(np.diff(first), pa.int64()),
        pa.array(row_sums(gone, first), pa.int64()),
        pa.array(kept, pa.string()),
        pa.array(digests, pa.string()),
        pa.ListArray.from_arrays(pa.array(2 * edges, pa.int32()), pa.array(pairs)),
    ]


def remove_repeats(df: DataFrame, doc: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, the kept words, their SHA-256, and the removed stretches."""
    docs = keyed(df, doc, text)
    parts = parts_for(df, text, PART_CHARS)
    anchors = settle(places_by_document(send(docs, _anchors, parts, _meet)))
    some = docs.join(anchors.drop("kind"), ["d", "h"])
    marked = some.select("d", "h", "t", "spans")
    repeats = settle(places_by_document(_send_repeats(marked, parts)))
    final = docs.join(repeats.drop("kind"), ["d", "h"], "left")
    out = map_text(final, "t", "r", RESULT, lambda: lambda block, texts: _cut_out(block, texts, with_text), keep=["d", "spans"])
    doc_id = F.when(F.col("d") != -(1 << 63), F.col("d")).alias("doc_id")
    return out.select(doc_id, "r.*")


def _send_repeats(marked: DataFrame, parts: int) -> DataFrame:
    return send(marked, lambda part: _repeats(part, 3), parts, _earlier)
