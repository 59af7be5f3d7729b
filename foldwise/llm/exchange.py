"""Exchange of packed records between tasks.

Hashes of all positions of a corpus are too many for one row each. A task packs
the records of a block of texts into one binary row per target partition, the
target partition sees all records whose hashes fall to it, and answers with
places in the blocks. Equal hashes inside a block are combined before they are
sent, so that a partition gets at most one record of a hash from each block,
however common the hash is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from foldwise.llm.words import cut, quoted, runs
from foldwise.session import settle

# bytes of text in one block
BLOCK = 12 << 20
# kinds of rows; operators may use more
RECORDS, TABLE, FOUND = 0, 1, 2

DOCUMENT = np.dtype([("d", "<i8"), ("n", "<i4"), ("base", "<i4")])
PACKED = "part int, block long, kind int, body binary"
ANSWER = "block long, kind int, body binary"


def keyed(df: DataFrame, doc: str, text: str, *more: str) -> DataFrame:
    """Columns d (id, null as the smallest number), h (hash of the text), t (text), and others as they are."""
    words = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    return df.select(
        F.coalesce(F.col(quoted(doc)).cast("long"), F.lit(-(1 << 63))).alias("d"),
        F.unhex(F.md5(words)).alias("h"),
        words.alias("t"),
        *more,
    )


def parts_for(df: DataFrame, text: str, chars: int) -> int:
    """How many partitions hold the records of ``chars`` characters of text each."""
    total = df.agg(F.sum(F.length(F.col(quoted(text)).cast("string")))).first()[0] or 0
    return max(1, -(-total // chars))


def pack_gaps(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing places as 16-bit gaps, and which of the rows are real (others only carry a long gap on)."""
    gaps = np.diff(places, prepend=0)
    more = gaps // 0xFFFF
    slots = np.arange(len(places)) + np.cumsum(more)
    out = np.full(len(places) + int(more.sum()), 0xFFFF, np.uint16)
    out[slots] = gaps - more * 0xFFFF
    real = np.zeros(len(out), bool)
    real[slots] = True
    return out, real


def unpack_gaps(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps.astype(np.int64))


def send(
    df: DataFrame,
    find: Callable[[pa.RecordBatch], tuple],
    parts: int,
    answer: Callable[[list[tuple]], Iterator[tuple[int, int, np.ndarray]]],
    block_bytes: int = BLOCK,
) -> DataFrame:
    """Rows (block, kind, body): tables of the blocks' documents, and places found in the blocks.

    ``df`` starts with the columns d, h, t. ``find(block)`` gives target numbers (64 bits), structured records
    and increasing places of what is to be sent, by kind the starts and ends of places found in the block itself,
    and the first place of each document with the end (n+1 numbers). ``answer`` gets what
    one partition received, as (block, records, places, documents of the places, places in the documents), and yields
    (block, kind, starts and ends of places found).
    """

    def pack(batches):
        task = TaskContext.get().partitionId()
        number = 0
        for batch in batches:
            for part in cut(batch, "t", block_bytes):
                block = (task << 32) + number
                number += 1
                yield _packed(part, block)

    def _packed(part, block):
        target, records, places, found, first = find(part)
        ids = part.column(0).to_numpy()
        rows = [
            (block % parts, block, TABLE, _table(part, first)),
            *[(block % parts, block, kind, np.stack(pair, 1).astype("<i4").tobytes()) for kind, pair in found.items()],
        ]
        where = ((target >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[p] : bounds[p + 1]]
            rows.append((p, block, RECORDS, _body(records[own], places[own], first, ids)))
        p, b, k, body = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(body, pa.binary())],
            names=["part", "block", "kind", "body"],
        )

    def receive(batches):
        got, through = [], []
        for batch in batches:
            for block, kind, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if kind == RECORDS:
                    got.append((block, *_opened(body.as_buffer())))
                else:
                    through.append((block, kind, body.as_py()))
                if len(through) > 64:
                    yield _rows(through)
                    through = []
        if through:
            yield _rows(through)
        if got:
            for block, kind, pairs in answer(got):
                if len(pairs):
                    yield _rows([(block, kind, np.asarray(pairs, "<i4").tobytes())])

    sent = df.mapInArrow(pack, PACKED).repartitionById(parts, F.col("part"))
    return settle(sent.mapInArrow(receive, ANSWER))


def _rows(rows):
    block, kind, body = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())],
        names=["block", "kind", "body"],
    )


def _table(part: pa.RecordBatch, first: np.ndarray) -> bytes:
    rows = np.zeros(part.num_rows, np.dtype([("d", "<i8"), ("h", "S16"), ("end", "<i8")]))
    rows["d"] = part.column(0).to_numpy()
    rows["h"] = part.column(1).to_pylist()
    rows["end"] = first[1:]
    return rows.tobytes()


def _body(records: np.ndarray, places: np.ndarray, first: np.ndarray, ids: np.ndarray) -> bytes:
    """Records, gaps of their places, and the documents they lie in."""
    gaps, real = pack_gaps(places)
    filled = np.zeros(len(gaps), records.dtype)
    filled[real] = records
    row = np.searchsorted(first, places, "right") - 1
    some, count = np.unique(row, return_counts=True)
    docs = np.zeros(len(some), DOCUMENT)
    docs["d"], docs["n"], docs["base"] = ids[some], count, first[some]
    head = np.array([len(gaps), len(some), records.dtype.itemsize], "<i4").tobytes()
    flags = np.packbits(real).tobytes()
    return head + docs.tobytes() + gaps.tobytes() + flags + filled.tobytes()


def _opened(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m, size = np.frombuffer(raw, "<i4", 3).tolist()
    at = 12
    docs = np.frombuffer(raw, DOCUMENT, m, at)
    at += docs.nbytes
    gaps = np.frombuffer(raw, "<u2", n, at)
    at += gaps.nbytes
    real = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(bool)
    at += -(-n // 8)
    records = np.frombuffer(raw, np.dtype((np.void, size)), n, at)[real]
    places = unpack_gaps(gaps)[real]
    return records, places, np.repeat(docs["d"], docs["n"]), places - np.repeat(docs["base"], docs["n"])


def places_by_document(answers: DataFrame, kinds: tuple[int, ...] = (FOUND,)) -> DataFrame:
    """Rows (d, h, kind, spans): for each document with places found, their stretches as pairs of 32-bit numbers.

    Repeated rows of a document may lie in blocks that were told different things: what any of them was told counts for all,
    so stretches may overlap and come in any order.
    """

    def gather(batches):
        block, table, found = None, None, {}
        for batch in batches:
            for b, kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != block:
                    yield from _all_spans(table, found)
                    block, table, found = b, None, {}
                if kind == TABLE:
                    table = body.as_py()
                elif kind in kinds:
                    found.setdefault(kind, []).append(np.frombuffer(body.as_buffer(), "<i4").reshape(-1, 2))
        yield from _all_spans(table, found)

    by_block = answers.repartition(F.col("block")).sortWithinPartitions("block")
    merged = by_block.mapInArrow(gather, "d long, h binary, kind int, spans binary")
    several = merged.groupBy("d", "h", "kind").agg(F.collect_set("spans").alias("several"))
    return several.select("d", "h", "kind", F.aggregate("several", F.lit(b""), lambda a, b: F.concat(a, b)).alias("spans"))


def _all_spans(table: bytes | None, found: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if table is None:
        return
    docs = np.frombuffer(table, np.dtype([("d", "<i8"), ("h", "V16"), ("end", "<i8")]))
    first = np.append(0, docs["end"])
    n = int(first[-1])
    for kind, several in found.items():
        pairs = np.concatenate(several)
        if not len(pairs) or not n:
            continue
        steps = np.bincount(pairs[:, 0], minlength=n + 1) - np.bincount(pairs[:, 1], minlength=n + 1)
        starts, ends, bounds = runs(np.cumsum(steps[:n]) > 0, first)
        base = np.repeat(first[:-1], np.diff(bounds))
        own = np.stack([starts - base, ends - base], 1).astype("<i4")
        some = np.flatnonzero(np.diff(bounds)).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs["d"][some]),
                pa.array([docs["h"][i].tobytes() for i in some], pa.binary()),
                pa.array([kind] * len(some), pa.int32()),
                pa.array([own[bounds[i] : bounds[i + 1]].tobytes() for i in some], pa.binary()),
            ],
            names=["d", "h", "kind", "spans"],
        )


def spans_of(column) -> list[np.ndarray]:
    """The stretches of each row of a binary column; none where it is null."""
    return [np.frombuffer(x.as_buffer(), "<i4").reshape(-1, 2) if x.is_valid else np.zeros((0, 2), "<i4") for x in column]


def shifted(spans: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """The stretches of all rows, counted from the start of the block."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    sizes = [len(s) for s in spans]
    return np.concatenate(spans).astype(np.int64) + np.repeat(first[:-1], sizes)[:, None]


def per_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the values, and the number of the group of each sorted one."""
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), bool)
    new[1:] = values[order][1:] != values[order][:-1]
    return order, np.cumsum(new) - 1


