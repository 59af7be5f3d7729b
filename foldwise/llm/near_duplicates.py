"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is a weighted set of shingles of five words, weighted by their counts.
Each element sends arrivals of a Poisson process whose rate is its weight,
each to a random register; a register keeps the first arrival and the element
that sent it. An element stops once its next arrival is later than all
registers of the text. Two texts share a register with the probability
Jaccard of their weights.

Texts that agree on all registers of a band meet in a bucket. Equal texts are
one node. The members of a bucket are compared with its smallest node first,
then with members of the bucket's largest class, one for each bucket and
round, which is linear and joins most of what belongs together. Where a bucket
still holds several classes, members of different classes are compared inside
the bucket, first by their registers, then exactly, and a task hands on only links
that join two classes: no pair of a bucket stays unseen unless one class holds
both, and no list of pairs is written. A pair is linked if the exact probability Jaccard of its
texts is at least 0.8. With 30 bands of 5 registers a pair at 0.8 is met with
a probability of 0.99999; one that 300 registers estimate four standard
deviations below 0.8 is not verified.

Defined results: words are lower-case (A-Z) letters, digits and characters outside ASCII; a
text of one to four words is one shingle; texts without words are in no class
but their own and that of equal texts; rows with the same text are one node; a class is named by its
smallest document id (null only if all ids are null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foldwise.llm.components import components, merged
from foldwise.llm.likely import likely_among
from foldwise.llm.words import (
    give_back,
    ALNUM_WORDS,
    LOWER,
    map_text,
    mix,
    quoted,
    text_buffer,
    whole_windows,
    window_hashes,
    word_hashes,
    word_spans,
)
from foldwise.session import settle

WIDTH = 5
THRESHOLD = 0.8
BANDS = 30
ROWS = 5
# those beyond the bands only sharpen the estimate
REGISTERS = 300
# four standard deviations; a pair estimated lower below the threshold is not verified
MARGIN = 4 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
# rounds in which the members of a bucket meet one member of its largest class
ROUNDS = 2
# members of one bucket that travel in one row, and bytes of their shingles
CHUNK = 1000
PART_BYTES = 16 << 20

SKETCH = T.StructType(
    [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("registers", T.BinaryType())]
)


def shingles(texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, hash and count of the distinct shingles of each text, in order of rows; and the number of rows."""
    data, offsets = text_buffer(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, ALNUM_WORDS)
    hashes = word_hashes(data, starts, ends)
    n_rows = len(first) - 1
    rows = np.repeat(np.arange(n_rows), np.diff(first))
    at = whole_windows(first, width)
    row, value = rows[at], window_hashes(hashes, width)[at] if len(at) else np.zeros(0, np.uint64)
    for size in range(1, width):  # short texts
        short = np.flatnonzero(np.diff(first) == size)
        if len(short):
            row = np.append(row, short)
            value = np.append(value, window_hashes(hashes, size)[first[short]])
    salted = mix(value + row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    _, index, count = np.unique(salted, return_index=True, return_counts=True)
    order = np.argsort(row[index], kind="stable")
    index, count = index[order], count[order]
    return row[index], value[index], count, n_rows


def prob_minhash(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n_rows: int, k: int = REGISTERS) -> np.ndarray:
    """The element in each register of each row; rows without elements have zeros."""
    time = np.full(n_rows * k, np.inf)
    held = np.zeros(n_rows * k, np.uint64)
    now = np.zeros(len(value))
    sent = 0  # arrivals of each live element so far
    while len(value):
        many = int(max(1, min(64, 40_000 // len(value)))) if sent else 1
        number = np.arange(sent + 1, sent + many + 1, dtype=np.uint64)
        draw = mix(value[:, None] + number * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight[:, None]
        arrival = now[:, None] + np.cumsum(gap, axis=1)
        target = (mix(draw) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)
        slot = (row[:, None] * k + target.astype(np.int64)).ravel()
        flat = arrival.ravel()
        np.minimum.at(time, slot, flat)
        first = flat == time[slot]
        held[slot[first]] = np.repeat(value, many)[first]
        now = arrival[:, -1]
        sent += many
        latest = time.reshape(n_rows, k).max(axis=1)
        live = now < latest[row]
        row, value, weight, now = row[live], value[live], weight[live], now[live]
    return held.reshape(n_rows, k)


def band_keys(held: np.ndarray) -> np.ndarray:
    """A key for each band of each row, different for different bands."""
    parts = held[:, : BANDS * ROWS].reshape(len(held), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(1)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def _sketch(texts) -> list[pa.Array]:
    row, value, count, n_rows = shingles(texts)
    held = prob_minhash(row, value, count.astype(float), n_rows)
    some = np.bincount(row, minlength=n_rows) > 0
    keys = band_keys(held)[some].ravel()
    bounds = np.append(0, np.cumsum(some * BANDS))
    small = (held >> np.uint64(56)).astype(np.uint8)  # one byte tells registers apart well enough to estimate
    return [
        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys)),
        pa.array([small[i].tobytes() for i in range(n_rows)], pa.binary()),
    ]


def probability_jaccard(value_a, count_a, value_b, count_b) -> float:
    """Sum over common elements i of 1 / sum over j of max(a_j / a_i, b_j / b_i)."""
    if not len(value_a) or not len(value_b):
        return 0.0
    every = np.union1d(value_a, value_b)
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, value_a)] = count_a
    b[np.searchsorted(every, value_b)] = count_b
    both = (a > 0) & (b > 0)
    if (a <= 1).all() and (b <= 1).all():
        return both.sum() / len(every)
    ratio = np.where(b > 0, a / np.where(b > 0, b, 1), np.inf)
    order = np.argsort(ratio)
    a, b, ratio, both = a[order], b[order], ratio[order], both[order]
    above = np.append(np.cumsum(a[::-1])[::-1], 0)  # elements from here on
    below = np.append(0, np.cumsum(b))
    at = np.searchsorted(ratio, ratio[both])
    return float((1 / (above[at] / a[both] + below[at] / b[both])).sum())


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of a written table whose texts are similar enough."""
    ends = settle(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    texts = likely_among(texts, ends, ["node"])
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    rows = two.select("a", "b", "ta", "tb")

    def run(batches):
        from foldwise.llm.words import cut

        for batch in batches:
            for part in cut(batch, "ta", 1 << 20):
                a, b, ta, tb = part.columns
                sets = []
                for column in (ta, tb):
                    row, value, count, n = shingles(column)
                    bounds = np.searchsorted(row, np.arange(n + 1))
                    sets.append((value, count, bounds))
                (va, ca, ba), (vb, cb, bb) = sets
                keep = [
                    probability_jaccard(
                        va[ba[i] : ba[i + 1]], ca[ba[i] : ba[i + 1]], vb[bb[i] : bb[i + 1]], cb[bb[i] : bb[i + 1]]
                    )
                    >= threshold - 1e-12
                    for i in range(part.num_rows)
                ]
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])
        give_back()

    return rows.mapInArrow(run, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


def _estimated(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose registers agree often enough."""
    one = pairs.join(nodes.select(F.col("node").alias("a"), F.col("registers").alias("ra")), "a")
    two = one.join(nodes.select(F.col("node").alias("b"), F.col("registers").alias("rb")), "b")

    def run(batches):
        for batch in batches:
            a, b, ra, rb = batch.columns
            keep = pa.array(_agreement(ra, rb) >= least)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])
        give_back()

    return two.select("a", "b", "ra", "rb").mapInArrow(run, T.StructType([pairs.schema["a"], pairs.schema["b"]]))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(len(column), -1)


def _agreement(ra, rb) -> np.ndarray:
    if not len(ra):
        return np.zeros(0)
    return (_matrix(ra) == _matrix(rb)).mean(axis=1)


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes, with their class and the bucket's largest."""
    labelled = settle(buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum("n").alias("members"),
        F.max(F.struct("n", "label"))["label"].alias("major"),
    )
    return settle(labelled.join(settle(several.filter("classes > 1").drop("classes")), "key"))


def _met_major(mixed: DataFrame, turn: int) -> DataFrame:
    """Each member outside the largest class of its bucket, with one member of that class."""
    draw = F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("draw"), F.col("node").alias("node"))
    chosen = settle(mixed.filter("label = major").groupBy("key").agg(F.min(draw)["node"].alias("chosen")))
    pairs = mixed.filter("label <> major").join(chosen, "key")
    return pairs.select(F.least("node", "chosen").alias("a"), F.greatest("node", "chosen").alias("b")).distinct()


def _part_pairs(members: DataFrame, fields: list[str], parts) -> DataFrame:
    """Rows (key, ma, mb): two parts of one bucket, at least one of them outside its largest class."""
    part = F.pmod(F.xxhash64("node"), parts).alias("part")
    rows = settle(
        members.withColumn("part", part)
        .groupBy("key", (F.col("label") == F.col("major")).alias("is_major"), "part")
        .agg(F.collect_list(F.struct("node", "label", *fields)).alias("members"))
    )
    minor = rows.filter("not is_major").select("key", F.col("part").alias("pa"), F.col("members").alias("ma"))
    other = rows.select("key", "is_major", F.col("part").alias("pb"), F.col("members").alias("mb"))
    return minor.join(other, "key").filter("is_major or pa <= pb").select("key", "ma", "mb")


def _to_compare(key: int, a, b, least: float):
    """For two parts the names and classes of their members, and for each of the first the members of the second to compare.

    Those are of another class, agree in enough registers, and share no earlier
    band with it: a pair that shares one is compared in that bucket.
    """
    x, y = _matrix(a.field("registers")), _matrix(b.field("registers"))
    na, nb = a.field("node").to_pylist(), b.field("node").to_pylist()
    _, kinds = np.unique(np.array(a.field("label").to_pylist() + b.field("label").to_pylist()), return_inverse=True)
    la, lb = kinds[: len(na)], kinds[len(na) :]
    bx, by = (m.field("bands").flatten().to_numpy().reshape(-1, BANDS) for m in (a, b))
    band = int(np.flatnonzero(bx[0] == key)[0])
    same = na == nb

    def partners(i: int, root: np.ndarray | None = None) -> np.ndarray:
        mine, theirs = (la, lb) if root is None else (root[la], root[lb])
        found = np.flatnonzero(theirs != mine[i])
        if same:
            found = found[found > i]
        found = found[~(by[found, :band] == bx[i, :band]).any(axis=1)]
        return found[(y[found] == x[i]).mean(axis=1) >= least] if len(found) else found

    return na, nb, la, lb, partners


def _compared(mixed: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The members (key, node) that have a pair to compare in their bucket."""
    described = mixed.join(nodes.select("node", "registers", "bands"), "node")
    met = _part_pairs(described, ["registers", "bands"], F.ceil(F.col("members") / CHUNK))

    def run(batches):
        for batch in batches:
            keys, names = [], []
            for key, ma, mb in zip(*batch.columns):
                na, nb, _, _, partners = _to_compare(key.as_py(), ma.values, mb.values, least)
                open_a, open_b = [], np.zeros(len(nb), bool)
                for i in range(len(na)):
                    found = partners(i)
                    if len(found):
                        open_a.append(na[i])
                        open_b[found] = True
                some = {*open_a, *(nb[j] for j in np.flatnonzero(open_b))}
                keys += [key.as_py()] * len(some)
                names += some
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.binary())], names=["key", "node"])
        give_back()

    return met.mapInArrow(run, "key long, node binary").distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """Node, hashes and counts of its shingles; no counts where each is one."""

    def run(batches):
        from foldwise.llm.words import cut

        for batch in batches:
            for part in cut(batch, "text", 1 << 20):
                node, text = part.columns
                row, value, count, n = shingles(text)
                bounds = np.searchsorted(row, np.arange(n + 1))
                spans = list(zip(bounds[:-1], bounds[1:]))
                values = [value[i:j].tobytes() for i, j in spans]
                counts = [b"" if (count[i:j] == 1).all() else count[i:j].astype(np.uint32).tobytes() for i, j in spans]
                columns = [node, pa.array(values, pa.binary()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "counts"])
        give_back()

    return texts.select("node", "text").mapInArrow(run, "node binary, shingles binary, counts binary")


def _read_sets(members) -> tuple[np.ndarray, np.ndarray, list]:
    raw = [v.as_py() for v in members.field("shingles")]
    bounds = np.append(0, np.cumsum([len(v) // 8 for v in raw]))
    counts = [np.frombuffer(c.as_py(), np.uint32) if len(c.as_py()) else None for c in members.field("counts")]
    return np.frombuffer(b"".join(raw), np.uint64), bounds, counts


def _links(key: int, a, b, least: float, threshold: float):
    """Verified pairs that join different classes of two parts: at most one for each class that is joined."""
    na, nb, la, lb, partners = _to_compare(key, a, b, least)
    (va, oa, ca), (vb, ob, cb) = _read_sets(a), _read_sets(b)
    every, ids = np.unique(np.concatenate([va, vb]), return_inverse=True)
    ia, ib = ids[: len(va)], ids[len(va) :]
    own = np.zeros(len(every), bool)
    root = np.arange(max(la.max(), lb.max()) + 1)
    for i in range(len(na)):
        found = partners(i, root)
        if not len(found):
            continue
        mine = slice(oa[i], oa[i + 1])
        own[ia[mine]] = True
        sizes = ob[found + 1] - ob[found]
        hits = np.concatenate([own[ib[ob[j] : ob[j + 1]]] for j in found])
        common = np.add.reduceat(hits.astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
        own[ia[mine]] = False
        likeness = common / (oa[i + 1] - oa[i] + sizes - common)
        for j, like, size in zip(found.tolist(), likeness.tolist(), sizes.tolist()):
            if root[la[i]] == root[lb[j]]:
                continue
            if ca[i] is not None or cb[j] is not None:
                mass_a = np.ones(oa[i + 1] - oa[i]) if ca[i] is None else ca[i]
                mass_b = np.ones(size) if cb[j] is None else cb[j]
                like = probability_jaccard(va[mine], mass_a, vb[ob[j] : ob[j + 1]], mass_b)
            if like >= threshold - 1e-12:
                yield na[i], nb[j]
                root[root == root[lb[j]]] = root[la[i]]


def _across(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, least: float, threshold: float) -> DataFrame:
    """Links (a, b) between the classes of each bucket, verified where its members meet.

    A first pass over registers and bands finds the members that have a pair to
    compare at all. Only those bring the hashes of their shingles into their
    bucket, where each pair is compared once, in the first bucket it shares, and
    only links that join two classes leave the task.
    """
    some = settle(_compared(mixed, nodes, least))
    sets = settle(_sets(texts.join(settle(some.select("node").distinct()), "node", "left_semi")))
    members = (
        some.join(mixed.select("key", "node", "label", "major"), ["key", "node"])
        .join(sets, "node")
        .join(nodes.select("node", "registers", "bands"), "node")
    )
    sized = settle(
        some.join(sets.select("node", F.length("shingles").alias("size")), "node")
        .groupBy("key")
        .agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("size") / PART_BYTES)).alias("parts"))
    )
    met = _part_pairs(members.join(sized, "key"), ["registers", "bands", "shingles", "counts"], F.col("parts"))

    def run(batches):
        for batch in batches:
            for key, ma, mb in zip(*batch.columns):
                found = list(_links(key.as_py(), ma.values, mb.values, least, threshold))
                left = pa.array([min(p) for p in found], pa.binary())
                right = pa.array([max(p) for p in found], pa.binary())
                yield pa.RecordBatch.from_arrays([left, right], names=["a", "b"])
        give_back()

    return met.mapInArrow(run, "a binary, b binary").distinct()


def classes(df: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: doc_id, node (hash of the text), class_id and label.

    The label, the smallest node of a class, tells classes apart whose smallest id is the same or null.
    """
    words = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    slim = df.select(F.col(quoted(doc)).alias("doc_id"), words.alias("text")).withColumn("node", F.unhex(F.md5("text")))
    sketched = map_text(slim, "text", "s", SKETCH, lambda: lambda block, texts: _sketch(texts), keep=["doc_id", "node"])
    rows = settle(sketched.select("doc_id", "node", "s.*"))
    nodes = settle(
        rows.groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("registers").alias("registers")
        )
    )
    banded = nodes.select("node", F.explode("bands").alias("key"))
    keys = settle(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    buckets = settle(likely_among(banded, keys, ["key"]).join(keys, "key"))
    leaders = settle(buckets.groupBy("key").agg(F.min("node").alias("leader")))
    pairs = buckets.join(leaders, "key").filter("node <> leader")
    pairs = pairs.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    least = threshold - MARGIN
    # nodes that may have a partner at all; only their registers, bands and texts are sent again
    met = settle(buckets.select("node").distinct())
    known = settle(likely_among(nodes, met, ["node"]).join(met, "node"))
    registers = known.select("node", "registers")
    first = settle(_estimated(pairs, registers, least))
    # the text of the copy with the smallest id, before anything is sent; equal rows and chance finds leave with the rest
    copies = likely_among(slim, known.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"])
    texts = settle(copies.select("node", "text").join(met, "node").dropDuplicates(["node"]))
    labels = components(settle(_verified(first, texts, threshold)))
    for turn in range(ROUNDS):
        mixed = _mixed(buckets, labels)
        more = settle(_estimated(_met_major(mixed, turn), registers, least))
        labels = merged(labels, settle(_verified(more, texts, threshold)))
        buckets = mixed.select("key", "node")  # a bucket of one class stays so
    labels = merged(labels, settle(_across(_mixed(buckets, labels), known, texts, least, threshold)))
    named = settle(
        nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    )
    heads = settle(named.groupBy("label").agg(F.min("rep").alias("class_id")))
    of_node = settle(named.join(heads, "label").select("node", "class_id", "label"))
    return rows.select("doc_id", "node").join(of_node, "node", "left")


def keep_one(df: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with its own columns: that with the smallest document id.

    Of rows of a class that share this id the text with the smallest hash stays, and of rows equal in both
    the one whose other columns come first as JSON.
    """
    found = classes(df, doc, text, threshold)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node"))
    heads = (
        found.groupBy("label")
        .agg(least.alias("least"))
        .select(F.col("least.doc_id").alias("__class__"), F.col("least.node").alias("__head__"))
    )
    node = F.unhex(F.md5(F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))))
    tagged = df.withColumn("__node__", node)
    met = tagged.join(
        settle(heads), F.col(quoted(doc)).eqNullSafe(F.col("__class__")) & (F.col("__node__") == F.col("__head__"))
    )
    rest = [c for c in df.columns if c != doc]
    others = [F.col(quoted(c)) for c in rest if c != text]
    order = F.to_json(F.struct(*others)) if others else F.lit(0)
    row = F.min_by(F.struct(*[F.col(quoted(c)) for c in rest]), order)
    once = met.groupBy(F.col(quoted(doc)), "__node__").agg(row.alias("__row__"))
    return once.select(*[F.col(quoted(doc)) if c == doc else F.col("__row__").getField(c).alias(c) for c in df.columns])
