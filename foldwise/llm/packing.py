"""Packing of documents along a space-filling curve.

Each document becomes a vector of signed hashed word counts, projected to
three dimensions by a fixed random matrix. The place of the projection on a
three-dimensional Hilbert curve is its key; the low bits of the key are a hash
of the document and of its row's place, so that any number of equal documents
and a row repeated any number of times can be split over several ranges. Quantiles of the keys cut the curve into ranges of similar
size. Each range is sorted and packed by one task as a stream: its documents
follow each other in sequences of ``length`` tokens and are cut where a
sequence is full, so only the last sequence of a range has room left.

Texts are tokenized once. The tokenizer drops white space and never joins
characters across it, so the ids of a text are those of its blank-separated
pieces; a task remembers the pieces it has met in arrays of bounded size.

Defined results: a null text is an empty one, whose only token is the end
token; repeated rows are packed one by one; a document of any length is cut
over as many sequences as it fills; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from foldwise.llm.words import BLANK_WORDS, LOWER, give_back, map_text, quoted, text_buffer, word_hashes, word_spans

LENGTH = 2048
END = 1
# buckets of the hashed vector, and bits of one coordinate on the curve
BUCKETS = 512
BITS = 16
SALT_BITS = 15
# characters of text in one range of the curve
RANGE_CHARS = 16_000_000
# documents for each range whose keys find the bounds
SAMPLE_PER_RANGE = 500
# bytes of hashes and ids of met pieces that a task remembers
MEMORY_BYTES = 48 << 20


def projection() -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((BUCKETS, 3))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates of ``bits`` bits (rows of a matrix)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    # undo the rotations of each level, from the coarsest to the finest
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def stems(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blank-separated pieces of texts in lower case (A-Z), without a full stop or comma behind a letter.

    Returns the bytes, starts and ends of the stems, their hashes, what was cut off
    (0 nothing, 1 full stop, 2 comma), and the number of the first stem of each text. What
    was cut off is a piece of its own for the tokenizer too, so the ids stay the same.
    """
    data, offsets = text_buffer(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, BLANK_WORDS)
    tail = np.zeros(len(starts), np.int64)
    if len(starts):
        last, before, third = data[ends - 1], data[np.maximum(ends - 2, 0)], data[np.maximum(ends - 3, 0)]
        latin = (third == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (ends - starts > 2)
        letter = ((before >= 0x61) & (before <= 0x7A) & (ends - starts > 1)) | latin
        tail = np.where(letter & (last == 0x2E), 1, np.where(letter & (last == 0x2C), 2, 0))
        ends = ends - (tail > 0)
    return data, starts, ends, word_hashes(data, starts, ends), tail, first


def curve_places(hashes: np.ndarray, first: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Hilbert key of the projected vector of hashed words of each text."""
    n = len(first) - 1
    slot = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    slot += np.repeat(np.arange(n) * BUCKETS, np.diff(first))
    sign = 1.0 - 2.0 * (hashes >> np.uint64(63)).astype(np.float64)
    vectors = np.bincount(slot, sign, n * BUCKETS).reshape(n, BUCKETS)
    norm = np.sqrt((vectors**2).sum(1, keepdims=True))
    flat = vectors @ matrix / np.where(norm > 0, norm, 1)
    scaled = np.clip((flat + 4) / 8, 0, 1 - 2**-BITS)
    return hilbert((scaled * (1 << BITS)).astype(np.int64))


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """Read once in a Python worker; its size is that of the vocabulary."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Pieces:
    """Token bytes (16 bits each) of texts, put together from remembered stems.

    Lower-casing A-Z first changes nothing, because the tokenizer lower-cases;
    a text that may hold a special token, which is found in its own case, is
    tokenized as it is.
    """

    # stands between stems that are tokenized in one call; a stem that holds it is tokenized alone
    MARK = "\x01"

    def __init__(self, path: str):
        self._forget()
        self.tokenizer = _tokenizer(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        (self.mark,) = self.whole(self.MARK)
        self.tails = [np.zeros(0, np.uint16), self.whole("."), self.whole(",")]

    def _forget(self) -> None:
        """Met pieces: ascending hashes, and where their ids lie in one array."""
        self.keys = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    @property
    def held_bytes(self) -> int:
        return self.keys.nbytes + self.where.nbytes + self.size.nbytes + self.ids.nbytes

    def _remember(self, keys: np.ndarray, made: list[bytes]) -> None:
        sizes = np.array(list(map(len, made)), np.int64) // 2
        at = np.searchsorted(self.keys, keys)
        self.where = np.insert(self.where, at, len(self.ids) + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes)
        self.keys = np.insert(self.keys, at, keys)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), np.uint16)])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _learn(self, words: list[str]) -> list[bytes]:
        joined = f" {self.MARK} ".join(words)
        (made,) = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
        ids = np.array(made.ids, np.uint16)
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
        if len(ends) != len(words):  # some stem holds the mark itself
            return [self.whole(w).tobytes() for w in words]
        raw, out, at = ids.tobytes(), [], 0
        for end in (2 * ends).tolist():
            out.append(raw[at:end])
            at = end + 2
        return out

    def tokens(self, texts, cut_up=None) -> list[bytes]:
        """The ids of each text of an Arrow column."""
        data, starts, ends, hashes, tail, first = cut_up or stems(texts)
        keys, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if self.held_bytes > MEMORY_BYTES:
            self._forget()
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if new.any():
            raw = data.tobytes()
            spans = zip(starts[where[new]].tolist(), ends[where[new]].tolist())
            self._remember(keys[new], self._learn([raw[a:b].decode("utf-8", "replace") for a, b in spans]))
        at = np.searchsorted(self.keys, keys)
        table = np.concatenate([self.ids, *self.tails])
        tails = np.array(list(map(len, self.tails)))
        sizes = np.append(self.size[at], tails)
        from_ = np.append(self.where[at], len(self.ids) + np.cumsum(tails) - tails)
        order = np.empty(2 * len(which), np.int64)
        order[0::2] = which
        order[1::2] = len(keys) + tail
        size = sizes[order]
        behind = np.cumsum(size)
        total = int(behind[-1]) if len(behind) else 0
        ids = table[np.repeat(from_[order] - (behind - size), size) + np.arange(total)].tobytes()
        bounds = (2 * np.append(0, behind)[2 * first]).tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for k in np.flatnonzero(pc.fill_null(pc.match_substring(texts, "<|"), False)):
            out[k] = self.whole(texts[int(k)].as_py()).tobytes()
        return out


def with_curve_key(df: DataFrame, text: str, salt: Sequence[str], tokenizer: str | None, keep: Sequence[str]) -> DataFrame:
    """Adds ``key``: the place on the curve, then bits of a hash of the columns ``salt``; and the ``ids`` if asked for.

    The ids end with the end token and take 16 bits each, little-endian.
    """
    kind = T.StructType([T.StructField("place", T.LongType()), T.StructField("ids", T.BinaryType())])
    matrix = projection()

    def make():
        pieces = Pieces(tokenizer) if tokenizer else None
        end = np.array([END], np.uint16).tobytes()

        def fn(block, texts):
            cut_up = stems(texts)
            place = pa.array(curve_places(cut_up[3], cut_up[5], matrix), pa.int64())
            ids = [raw + end for raw in pieces.tokens(texts, cut_up)] if pieces else [None] * len(texts)
            return [place, pa.array(ids, pa.binary())]

        return fn

    salted = F.xxhash64(*[F.col(quoted(c)) for c in salt]).bitwiseAND(F.lit((1 << SALT_BITS) - 1))
    made = map_text(df.withColumn("__salt__", salted), text, "__made__", kind, make, keep=[*keep, "__salt__"])
    key = F.shiftleft(F.col("__made__.place"), SALT_BITS).bitwiseOR(F.col("__salt__"))
    return made.select(*[F.col(quoted(c)) for c in keep], key.alias("key"), F.col("__made__.ids").alias("ids"))


PIECE = (
    "doc_id {doc}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "padded_length long{ids}"
)


def padded(used: int, length: int) -> int:
    """Length of a sequence that holds ``used`` tokens: full, or the power of two it just fills."""
    return used if used & (used - 1) == 0 else length


def pack(
    documents: DataFrame,
    tokenizer: str,
    text: str = "text",
    doc: str = "doc_id",
    length: int = LENGTH,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: document, place and length in it, CRC-32 of the ids, sequence and place in it.

    ``padded_length`` is the length of the piece's sequence with padding;
    ``with_ids`` adds the ids themselves.
    """
    chars, rows = documents.agg(F.sum(F.length(F.col(quoted(text)).cast("string"))), F.count(F.lit(1))).first()
    n = max(1, -(-(chars or 0) // RANGE_CHARS))
    columns = [F.col(quoted(doc)).alias("d"), F.col(quoted(text)).cast("string").alias("t")]
    source = documents.select(*columns, F.monotonically_increasing_id().alias("place"))
    salt = ["d", "t", "place"]
    bounds = []
    if n > 1:  # at most n - 1 numbers, from a sample that only balances the ranges
        share = min(1.0, SAMPLE_PER_RANGE * n / max(1, rows))
        keys = with_curve_key(source.sample(share, 7), "t", salt, None, keep=[])
        shares = [k / n for k in range(1, n)]
        bounds = sorted(set(keys.agg(F.percentile_approx("key", F.array(*map(F.lit, shares)), 100 * n)).first()[0] or []))
    tokens = with_curve_key(source, "t", salt, tokenizer, keep=["d"])
    edges = np.array(bounds, np.int64)

    def find(batches):
        for batch in batches:
            part = np.searchsorted(edges, batch.column(1).to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    tokens = tokens.mapInArrow(find, T.StructType([*tokens.schema, T.StructField("part", T.IntegerType())]))
    ranges = tokens.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "d")
    piece_type = PIECE.format(doc=source.schema["d"].dataType.simpleString(), ids=", ids binary" * with_ids)
    names = [x.split()[0] for x in piece_type.split(", ")]

    def stream(batches):
        part, sequence, filled = None, 0, 0
        held: list[list] = []  # pieces of the sequence that is open

        def close():
            size = padded(filled, length)
            for row in held:
                row[7] = size
            return held

        def emit(rows):
            columns = list(zip(*rows))
            arrays = [batch_type] + [pa.int64()] * 7 + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrays)], names=names)

        ready: list[list] = []
        batch_type = None
        for batch in batches:
            batch_type = batch.column(0).type
            docs, _, ids, parts = batch.columns
            for d, p, raw in zip(docs.to_pylist(), parts.to_pylist(), ids):
                if p != part:  # a new range starts a new sequence
                    ready += close()
                    held, part, sequence, filled = [], p, p << 40, 0
                wide = np.frombuffer(raw.as_buffer(), "<u2").astype("<u4")
                total, at = len(wide), 0
                while at < total:
                    size = min(length - filled, total - at)
                    body = wide[at : at + size].tobytes()
                    row = [d, at, size, zlib.crc32(body), total, sequence, filled, 0]
                    held.append(row + [body] if with_ids else row)
                    at += size
                    filled += size
                    if filled == length:
                        ready += close()
                        held, sequence, filled = [], sequence + 1, 0
                if len(ready) > 4000 or with_ids and len(ready) > 400:
                    yield emit(ready)
                    ready = []
        ready += close()
        if ready:
            yield emit(ready)
        give_back()

    return ranges.select("d", "key", "ids", "part").mapInArrow(stream, piece_type)
