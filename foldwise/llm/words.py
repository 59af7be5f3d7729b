"""Words of whole text columns as numpy arrays.

A text column of an Arrow batch is one byte buffer with offsets. The helpers
here find the words of all its rows at once and give each word a 64-bit hash,
without a Python object per word. Bytes above 0x7F belong to characters
outside ASCII, so classes that only name ASCII separators work on UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

# bytes of text that one step of a task works on at a time; a longer text is one step
BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 4096
# a stretch of bytes that is hashed with one table of powers
SPAN = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def class_table(separator: Callable[[int], bool]) -> np.ndarray:
    """True for the bytes that belong to words."""
    return np.array([not separator(b) for b in range(256)])


# [^\x20\x09-\x0D]+
BLANK_WORDS = class_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z
ALNUM_WORDS = class_table(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)
# ASCII letters and everything outside ASCII
LETTER_WORDS = class_table(lambda b: b < 0x80 and not chr(b).isalpha())
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def give_back() -> None:
    """Returns memory that a finished task has freed to the system; its Python process stays for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n+1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def series(base):
        out = np.full(SPAN, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return series(_BASE), series(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the number of its first word (n+1 numbers)."""
    inside = table[data]
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1]
    before[edges[edges < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word that depends on the bytes of the word alone."""
    power, inverse = _powers()
    n = len(starts)
    out = np.empty(n, np.uint64)
    at = 0
    while at < n:
        base = starts[at]
        to = int(np.searchsorted(ends, base + SPAN, "left"))
        if to <= at:  # one word longer than a stretch
            out[at] = xxhash.xxh3_64_intdigest(data[base : ends[at]].tobytes())
            at += 1
            continue
        piece = data[base : ends[to - 1]].astype(np.uint64)
        piece += np.uint64(1)
        piece *= power[: len(piece)]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece, out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * inverse[s]
        at = to
    return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of the ``width`` words that start at each word, for words with that many after them."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(width):
        factor = factor * seed & _MASK
        out += hashes[j : j + n] * np.uint64(factor)
    return mix(out)


def whole_windows(first: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the words at which a window of ``width`` words starts that stays in its row."""
    total = int(first[-1])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return np.flatnonzero(room >= width)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, rows given by n+1 boundaries (empty rows give 0)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True for the places that any of the ranges covers."""
    if not len(starts):
        return np.zeros(n, bool)
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True inside each row, and the row boundaries of that list."""
    starts, ends, bounds = word_spans(mask.view(np.uint8), first, np.array([False, True] + [False] * 254))
    return starts, ends, bounds


def cut(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of at most ``limit`` bytes of text and ``BLOCK_ROWS`` rows, or one row."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, min(at + BLOCK_ROWS, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def map_text(
    df: DataFrame,
    text: str,
    out: str,
    out_type: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch, pa.Array], Sequence[pa.Array]]],
    keep: Sequence[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds the struct column ``out`` computed from the text column, a block of rows at a time.

    ``make()`` runs once in each task and gives a function of (block, its text)
    that returns one array per field of ``out_type``. A column already named
    ``out`` is replaced. ``keep`` names the other columns to return.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    inner = "__text__"
    source = df.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text)).cast("string").alias(inner))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, out_type)])

    def run(batches):
        fn = make()
        for batch in batches:
            for part in cut(batch, inner, block_bytes):
                *kept, texts = part.columns
                fields = fn(part, texts)
                made = pa.StructArray.from_arrays(list(fields), names=out_type.names)
                yield pa.RecordBatch.from_arrays([*kept, made], names=[*keep, out])
        del fn
        give_back()

    return source.mapInArrow(run, schema)
