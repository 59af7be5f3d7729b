"""Token ids of documents in flat binary files that are memory-mapped.

A folder holds shards. A shard is a run of documents in ascending order of
their id, written by one task as three files:

* ``<name>.bin``: the ids of its documents one after another, as little-endian
  unsigned integers of 16 bits, or of 32 bits for a vocabulary above 65,536;
* ``<name>.idx``: one little-endian signed 64-bit offset per document and one
  more, counted in ids from the start of the shard;
* ``<name>.doc``: the document ids as an Arrow file.

The table ``index`` has one row per shard with its counts and its ``base``,
the number of ids in all shards before: prefix sums of the totals, so no task
waits for another one's length and the place of any document is
``base + offset``. File names are new for each attempt of a task and only the
names that Spark commits are in the index, so a lost executor or a repeated
task leaves no half-written shard behind that is ever read.

Documents are cut into shards by a range shuffle of (id, hash of the text,
place of the row), so a single id or a row repeated any number of times may
fill several shards.

Only pieces that a worker has not met are given to the tokenizer: the text is
cut where its pre-tokenizer always cuts (before white space, and behind a
Latin letter that an ASCII sign or digit follows), and the ids of a piece do
not depend on its neighbours. Texts that hold a special token are encoded
whole.

Defined results: a null text is an empty one, whose only id is the end id; a
null document id sorts first; rows with equal ids are ordered by a hash of
their text; a text of any length is one document; an empty table gives an
empty index. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from foldwise.llm.words import cut, quoted, text_buffer, word_hashes

END = 0
# characters of text in one shard
SHARD_CHARS = 16_000_000
# bytes of ids and hashes of met pieces that a worker remembers
MEMORY_BYTES = 48 << 20
# bytes of text that are cut into pieces at a time
BLOCK_BYTES = 4 << 20
# shards whose prefix sums are taken together
SHARDS_TOGETHER = 1024

_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_SOLID = np.array([0x21 <= b <= 0x7E for b in range(256)])
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_SIGN = _SOLID & ~_LETTER


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of texts, and for each text the number of its first piece (n+1 numbers)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[0], before[1:] = 0x80, data[:-1]
    after[-1], after[:-1] = 0x80, data[1:]
    # a letter of the Latin-1 block: two bytes, the first 0xC3, without the signs of multiplication and division
    lead = np.zeros(n, bool)
    lead[2:] = data[:-2] == 0xC3
    letter = _LETTER[before] | lead & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    start = (_SOLID[before] | letter) & _SPACE[data] | (data == 0x20) & _SOLID[after] | letter & _SIGN[data]
    edges = offsets[:-1]
    start[edges[edges < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in ascending order, the first place of each, and for each hash its number among them; only distinct ones are sorted."""
    codes, found = pd.factorize(hashes)
    order = np.argsort(found)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    which = rank[codes]
    place = np.empty(len(found), np.int64)
    place[which[::-1]] = np.arange(len(which))[::-1]
    return found[order], place, which


class Encoder:
    """Ids of the texts of Arrow columns, put together from met pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.type)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def _learn(self, keys: np.ndarray, raw: list[str]) -> None:
        """Adds pieces that are not remembered yet, in ascending order of their keys."""
        made = self.tokenizer.encode(raw, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(made.ids, self.type)
        sizes = np.bincount(np.array(made.word_ids, np.int64), minlength=len(raw))
        at = np.searchsorted(self.keys, keys)
        self.where = np.insert(self.where, at, len(self.ids) + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes)
        self.keys = np.insert(self.keys, at, keys)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the n+1 offsets of the texts."""
        data, offsets = text_buffer(texts)
        starts, ends, first = pieces_of(data, offsets)
        hashes = word_hashes(data, starts, ends)
        keys, place, which = distinct(hashes)
        if self.ids.nbytes + self.keys.nbytes + self.where.nbytes + self.size.nbytes > MEMORY_BYTES:
            self._forget()
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if new.any():
            raw = data.tobytes()
            spans = zip(starts[place[new]].tolist(), ends[place[new]].tolist())
            self._learn(keys[new], [raw[a:b].decode("utf-8") for a, b in spans])
        at = np.searchsorted(self.keys, keys)
        size = self.size[at][which]
        behind = np.cumsum(size)
        total = int(behind[-1]) if len(behind) else 0
        ids = self.ids[np.repeat(self.where[at][which] - (behind - size), size) + np.arange(total)]
        bounds = np.append(0, behind)[first]
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if not odd.any():
            return ids, bounds
        parts = [self.whole(texts[k].as_py()) if odd[k] else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """The encoder of a worker, with the pieces that its earlier tasks met."""
    return Encoder(path)


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id behind each document."""
    n = len(bounds) - 1
    out = np.empty(len(ids) + n, ids.dtype)
    last = bounds[1:] + np.arange(n)
    inside = np.ones(len(out), bool)
    inside[last] = False
    out[last], out[inside] = end, ids
    return out, bounds + np.arange(n + 1)


def write_files(
    documents: DataFrame,
    tokenizer: str,
    root: str,
    text: str = "text",
    doc: str = "doc_id",
    end: int = END,
    shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """Writes the shards and their index under ``root``, a folder all executors share; returns the index.

    The index: ``part``, ``name``, ``n_docs``, ``n_tokens`` and ``base``.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(quoted(doc)).alias("d"), F.col(quoted(text)).cast("string").alias("t"))
    chars = source.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // shard_chars))
    order = [F.col("d").asc_nulls_first(), F.xxhash64("t"), F.monotonically_increasing_id()]
    ranged = source.repartitionByRange(n, *order).sortWithinPartitions("d", F.xxhash64("t"))

    def write(batches):
        store, folder = _store(root)
        encoder, name = shared_encoder(tokenizer), None
        n_docs = n_tokens = 0
        for batch in batches:
            for part in cut(batch, "t", BLOCK_BYTES):
                if not part.num_rows:
                    continue
                if name is None:
                    name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
                    store.create_dir(folder, recursive=True)
                    tokens = store.open_output_stream(f"{folder}/{name}.bin")
                    offsets = store.open_output_stream(f"{folder}/{name}.idx")
                    docs = pa.ipc.new_file(store.open_output_stream(f"{folder}/{name}.doc"), pa.schema([("doc", part.column(0).type)]))
                    offsets.write(np.zeros(1, "<i8").tobytes())
                ids, bounds = with_end(*encoder.encode(part.column(1)), end)
                tokens.write(ids.tobytes())
                offsets.write((bounds[1:] + n_tokens).astype("<i8").tobytes())
                docs.write_batch(pa.RecordBatch.from_arrays([part.column(0)], names=["doc"]))
                n_docs, n_tokens = n_docs + part.num_rows, n_tokens + len(ids)
        if name is not None:
            tokens.close()
            offsets.close()
            docs.close()
            row = [[TaskContext.get().partitionId()], [name], [n_docs], [n_tokens], [encoder.type.itemsize]]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=names)

    names = ["part", "name", "n_docs", "n_tokens", "width"]
    ranged.mapInArrow(write, "part long, name string, n_docs long, n_tokens long, width long").write.parquet(f"{root}/shards")
    with_bases(spark.read.parquet(f"{root}/shards")).write.parquet(f"{root}/index")
    return spark.read.parquet(f"{root}/index")


def with_bases(shards: DataFrame, together: int = SHARDS_TOGETHER) -> DataFrame:
    """Adds ``base``, the ids in all shards before: prefix sums inside groups of shards, then over the groups."""
    group = F.floor(F.col("part") / together)
    inside = Window.partitionBy("_group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group here, a thousandth of the shards
    over = Window.partitionBy(F.lit(0)).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    rows = shards.withColumn("_group", group)
    sums = rows.groupBy("_group").agg(F.sum("n_tokens").alias("_sum"))
    shift = sums.select("_group", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_shift"))
    local = rows.withColumn("_local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    done = local.join(shift, "_group")
    return done.select(*shards.columns, (F.col("_local") + F.col("_shift")).alias("base"))


def _mapped(store: fs.FileSystem, path: str) -> pa.Buffer:
    """The bytes of a file: mapped into memory where the folder is a mounted one, else read."""
    if isinstance(store, fs.LocalFileSystem):
        file = pa.memory_map(path)
        return file.read_buffer(file.size())
    with store.open_input_file(path) as file:
        return file.read_buffer(file.size())


class Shard:
    """One shard: ``ids`` and ``offsets`` are views of the mapped files."""

    def __init__(self, root: str, name: str, width: int):
        store, folder = _store(root)
        ids = _mapped(store, f"{folder}/{name}.bin")
        self.ids = np.frombuffer(ids, "<u2" if width == 2 else "<u4")
        self.offsets = np.frombuffer(_mapped(store, f"{folder}/{name}.idx"), "<i8")
        self.docs = pa.ipc.open_file(_mapped(store, f"{folder}/{name}.doc"))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.offsets[k] : self.offsets[k + 1]]

    def doc_ids(self) -> Iterator[pa.Array]:
        for k in range(self.docs.num_record_batches):
            yield self.docs.get_batch(k).column(0)


def read_files(spark: SparkSession, root: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32; ``with_ids`` adds the ids (32 bits each)."""
    index = spark.read.parquet(f"{root}/index")
    n = index.count()
    if n:  # the type of the document ids, from one shard's schema
        one = index.select("name", "width").first()
        kind = Shard(root, one["name"], one["width"]).docs.schema.field("doc").type
    else:
        kind = pa.int64()
    doc = spark.createDataFrame(pa.table({"d": pa.array([], kind)})).schema["d"].dataType.simpleString()
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard, at = Shard(root, row["name"], row["width"]), 0
                for docs in shard.doc_ids():
                    bounds = shard.offsets[at : at + len(docs) + 1]
                    raw = [shard.ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    columns = [docs, pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds))]
                    columns.append(pa.array(list(map(zlib.crc32, raw)), pa.int64()))
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names=names)
                    at += len(docs)

    kinds = f"doc_id {doc}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return index.repartition(max(1, n), "part").mapInArrow(read, kinds)


class TokenFiles:
    """Random access to written shards from one process, for a training loader.

    The index (one row per shard) is read; the shards are mapped when asked for.
    """

    def __init__(self, root: str):
        import pyarrow.parquet as pq

        store, folder = _store(root)
        index = pq.read_table(f"{folder}/index", filesystem=store).sort_by("part")
        self.root, self.rows = root, index.to_pylist()
        self.bases = np.append(index.column("base").to_numpy(), index.column("n_tokens").to_numpy().sum()).astype(np.int64)
        self.firsts = np.append(0, np.cumsum(index.column("n_docs").to_numpy())).astype(np.int64)
        self.open: dict[int, Shard] = {}

    def __len__(self) -> int:
        return int(self.firsts[-1])

    @property
    def n_tokens(self) -> int:
        return int(self.bases[-1])

    def shard(self, k: int) -> Shard:
        if k not in self.open:
            self.open[k] = Shard(self.root, self.rows[k]["name"], self.rows[k]["width"])
        return self.open[k]

    def document(self, place: int) -> np.ndarray:
        """Ids of the document with that place in the order of the ids."""
        k = int(np.searchsorted(self.firsts, place, "right")) - 1
        return self.shard(k).document(place - int(self.firsts[k]))

    def window(self, start: int, length: int) -> np.ndarray:
        """``length`` ids from the id number ``start`` on, across documents and shards; fewer at the end."""
        stop, out = min(start + length, self.n_tokens), []
        while start < stop:
            k = int(np.searchsorted(self.bases, start, "right")) - 1
            base, behind = int(self.bases[k]), int(self.bases[k + 1])
            out.append(self.shard(k).ids[start - base : min(stop, behind) - base])
            start = min(stop, behind)
        return np.concatenate(out) if out else np.zeros(0, np.uint16)
