"""Trie of conversation prefixes with counts of whole subtrees.

A node is a distinct sequence of first turns. Each turn is hashed before any
shuffle, so no text is moved. The digest of a prefix comes from running sums
of the hashes of (place, turn), which a heavy conversation can hand over from
segment to segment; a digest is enumerated once with the conversations that
start with it, and all of them must name the same parent and the same last
turn, else the query fails.

Subtree sums are taken in shards. A node that more than ``heavy_from``
conversations share is heavy; below the heavy nodes hang subtrees of at most
that many conversations, and a shard holds whole such subtrees. In a shard the
digests get the slots of a minimal perfect hash, the slots are verified
against the whole digests, counts are scattered into flat numpy arrays, and
children are added to the slots of their parents from the deepest level up.
What the subtrees give to their heavy parents is summed by Spark, and the
heavy nodes are one more such table. ``heavy_from`` grows with the number of
conversations beyond ``HEAVY_FLOOR * TOP_SHARE``, so that table stays at about
``TOP_SHARE`` nodes for each level whatever the corpus.

Defined results: turns of a conversation are ordered by turn, null first, then
by a hash of role and text; null role or text is empty; rows without a
conversation id belong to no conversation and are left out; an empty table
gives no nodes. Other columns, whatever their names, are not read. A
conversation of any length is ordered in segments; the identifiers of
conversations that end at one node are streamed in order through one digest,
as SHA-256 asks for, and never held together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.llm.words import mix, quoted
from foldwise.operators.skew import HEAVY_ROWS, OrderedGroups
from foldwise.session import settle

# conversations of a subtree that is one unit of work, at least; and at most that share of all
HEAVY_FLOOR = 20_000
TOP_SHARE = 20_000
# nodes of a shard
SHARD_NODES = 400_000

# fixed values: turns at most that may be shared, and how many conversations share them
SHARED_TURNS = 5
SHARED_BLOCK = 100

NO_ENDS = hashlib.sha256(b"").hexdigest()


class NodeTable:
    """Minimal perfect hash of distinct 128-bit digests: slots 0 to n - 1, verified.

    Level by level, a digest alone in its place of a table of twice the size
    takes it; the others go on to the next level. Its slot is the number of
    taken places before.
    """

    def __init__(self, k0: np.ndarray, k1: np.ndarray):
        n = len(k0)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.slots = np.empty(n, np.int64)
        left, base = np.arange(n), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("a digest twice")
            place = self._place(k0[left], k1[left], len(self.levels), 2 * len(left))
            taken = np.bincount(place, minlength=2 * len(left)) == 1
            rank = np.cumsum(taken) - 1
            self.levels.append((taken, rank.astype(np.int64), base))
            alone = taken[place]
            self.slots[left[alone]] = base + rank[place[alone]]
            base += int(alone.sum())
            left = left[~alone]
        self.k0, self.k1 = np.empty(n, np.int64), np.empty(n, np.int64)
        self.k0[self.slots], self.k1[self.slots] = k0, k1
        if not (self.find(k0, k1) == self.slots).all():
            raise ValueError("slots do not hold their digests")

    @staticmethod
    def _place(k0: np.ndarray, k1: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        mixed = mix(mix(k0.astype(np.uint64) ^ seed) + k1.astype(np.uint64))
        return (mixed % np.uint64(size)).astype(np.int64)

    def find(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """The slots of digests, -1 for those that are not in the table."""
        out = np.full(len(k0), -1, np.int64)
        left = np.arange(len(k0))
        for level, (taken, rank, base) in enumerate(self.levels):
            place = self._place(k0[left], k1[left], level, len(taken))
            hit = taken[place]
            out[left[hit]] = base + rank[place[hit]]
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        wrong = (self.k0[out[found]] != k0[found]) | (self.k1[out[found]] != k1[found])
        out[found[wrong]] = -1
        return out


NODE = "k0 long, k1 long, p0 long, p1 long, conv long, depth long, n long, chars long, up long, more_children long, more_leaves long, more_saved long"
DONE = (
    "k0 long, k1 long, p0 long, p1 long, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, top boolean"
)


def subtree_sums(nodes: pa.Table) -> pa.Table:
    """The nodes of one shard (columns ``NODE``) with the sums of their subtrees (columns ``DONE``).

    ``up`` is the conversation of a parent outside the shard; ``more_*`` are
    sums of subtrees in other shards.
    """
    col = {c: nodes.column(c).to_numpy() for c in ("k0", "k1", "conv", "depth", "n", "chars")}
    more = {c: nodes.column(f"more_{c}").to_numpy() for c in ("children", "leaves", "saved")}
    rooted = nodes.column("p0").is_null().to_numpy(zero_copy_only=False)
    p0, p1 = (nodes.column(c).fill_null(0).to_numpy() for c in ("p0", "p1"))
    table = NodeTable(col["k0"], col["k1"])
    slots = table.slots
    size = len(slots)

    def scatter(values):
        out = np.empty(size, np.int64)
        out[slots] = values
        return out

    parent = scatter(np.where(rooted, -1, table.find(p0, p1)))
    depth, conv = scatter(col["depth"]), scatter(col["conv"])
    inner = parent >= 0
    if (depth[inner] != depth[parent[inner]] + 1).any():
        raise ValueError("a node is not one turn below its parent")
    children = scatter(more["children"]) + np.bincount(parent[inner], minlength=size)
    leaves = scatter(more["leaves"]) + (children == 0)
    saved = scatter(more["saved"] + (col["n"] - 1) * col["chars"])
    order = np.argsort(-depth, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(depth[order]) != 0))
    for a, b in zip(bounds, np.append(bounds[1:], size)):
        level = order[a:b]
        level = level[inner[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    inside = inner[slots]
    up = nodes.column("up").combine_chunks()
    above = pa.array(conv[np.where(inside, parent[slots], 0)])
    columns = {c: nodes.column(c) for c in ("k0", "k1", "p0", "p1")}
    columns |= {"conv_id": nodes.column("conv"), "depth": nodes.column("depth")}
    columns["parent_conv_id"] = pc.if_else(pa.array(inside), above, up)
    columns["n_convs"] = nodes.column("n")
    columns |= {c: pa.array(v[slots]) for c, v in (("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved))}
    columns["top"] = pa.array(~inside)
    return pa.table(columns)


def placed_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str, heavy_rows: int) -> DataFrame:
    """(c, place, h0, h1, chars): the turns of each conversation in order, counted from 0, as hashes."""
    r, t = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.select(
        F.col(quoted(conv)).cast("long").alias("c"),
        F.col(quoted(turn)).alias("turn"),
        F.xxhash64(r, t).alias("h0"),
        F.xxhash64(F.lit(7), t, r).alias("h1"),
        F.length(t).cast("long").alias("chars"),
    ).filter("c is not null")
    groups = OrderedGroups(rows, ["c"], ["turn", "h0", "h1"], heavy_rows)
    return groups.running_sum({"place": F.lit(1)}).result().select("c", "place", "h0", "h1", "chars")


def share_first_turns(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (c), and their turns (c, depth, h0, h1, chars) after the first ones are taken from another.

    Conversation c takes the first ``crc32(c) % 6`` turns from conversation
    ``c - c % 100`` (none if it does not exist) in place of as many of its own.
    """
    base = (F.col("c") - F.col("c") % SHARED_BLOCK).alias("base")
    taken = (F.crc32(F.col("c").cast("string")) % (SHARED_TURNS + 1)).alias("taken")
    convs = placed.filter("place = 0").select("c")
    # at most five turns of one conversation in a hundred
    turn = F.struct("place", "h0", "h1", "chars")
    heads = placed.filter((F.col("place") < SHARED_TURNS) & (F.col("c") % SHARED_BLOCK == 0))
    heads = heads.groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    heads = settle(heads)
    other = F.col("base") != F.col("c")
    copied = convs.select("c", base, taken).filter(other & (F.col("taken") > 0)).join(heads, "base")
    copied = copied.select("c", F.explode(F.slice("head", F.lit(1), F.col("taken").cast("int"))).alias("t"))
    copied = copied.select("c", (F.col("t.place") + 1).alias("depth"), "t.h0", "t.h1", "t.chars")
    own = placed.select("*", base, taken).join(heads.select("base", F.size("head").cast("long").alias("b")), "base", "left")
    shift = F.when(other, F.least("taken", F.coalesce("b", F.lit(0))) - F.col("taken")).otherwise(F.lit(0))
    own = own.filter(~other | (F.col("place") >= F.col("taken")))
    own = own.select("c", (F.col("place") + shift + 1).alias("depth"), "h0", "h1", "chars")
    return convs, copied.unionByName(own)


def _limbs(h: str, at: Column) -> list[Column]:
    """Two numbers of 32 bits from a hash of the place and of a turn's hash, so that sums do not overflow."""
    mixed = F.xxhash64(at, F.col(h))
    return [mixed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(mixed, 32)]


def prefix_rows(convs: DataFrame, turns: DataFrame, heavy_rows: int) -> DataFrame:
    """(c, depth, k0, k1, p0, p1, chars): each prefix of each conversation with its digest and that of its parent."""
    names = ["s0", "s1", "s2", "s3"]
    own = dict(zip(names, [*_limbs("h0", F.col("depth")), *_limbs("h1", F.col("depth"))]))
    groups = OrderedGroups(turns, ["c"], ["depth"], heavy_rows).running_sum(own)
    before = groups.result()

    def digest(values, depth, out):
        return [F.xxhash64(*values, depth).alias(f"{out}0"), F.xxhash64(depth, *reversed(values)).alias(f"{out}1")]

    sums = [F.col(n) for n in names]
    rows = before.select(
        "c",
        "depth",
        *digest([s + o for s, o in zip(sums, own.values())], F.col("depth"), "k"),
        *digest(sums, F.col("depth") - 1, "p"),
        "chars",
    )
    zero = [F.lit(0).cast("long")] * len(names)
    none = F.lit(None).cast("long")
    roots = convs.select("c", zero[0].alias("depth"), *digest(zero, zero[0], "k"), none.alias("p0"), none.alias("p1"), zero[0].alias("chars"))
    return roots.unionByName(rows)


def enumerate_nodes(paths: DataFrame) -> DataFrame:
    """(k0, k1, p0, p1, conv, depth, n, chars): distinct digests with their smallest conversation and its number of them."""
    same = ["depth", "p0", "p1", "chars"]
    found = paths.groupBy("k0", "k1").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("c").alias("conv"),
        *[F.min(c).alias(f"least_{c}") for c in same],
        *[F.max(c).alias(f"most_{c}") for c in same],
    )
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col(f"least_{c}").eqNullSafe(F.col(f"most_{c}"))
    checked = F.when(agree, F.col("n")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long"))
    return found.select("k0", "k1", "conv", checked.alias("n"), *[F.col(f"least_{c}").alias(c) for c in same])


def end_digests(paths: DataFrame) -> DataFrame:
    """(k0, k1, ends_sha256): SHA-256 of the conversations that end at a node, in ascending order and comma-joined."""
    last = F.max_by(F.struct("k0", "k1"), "depth")
    ends = paths.groupBy("c").agg(last.alias("e")).select("e.k0", "e.k1", "c")
    ends = ends.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "c")

    def stream(batches):
        key, state, out = None, None, []

        def made():
            k0, k1, sha = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(k0, pa.int64()), pa.array(k1, pa.int64()), pa.array(sha)], names=["k0", "k1", "ends_sha256"])

        for batch in batches:
            k0, k1, c = (x.to_numpy() for x in batch.columns)
            bounds = np.flatnonzero(np.append(True, (np.diff(k0) != 0) | (np.diff(k1) != 0))) if len(c) else []
            for a, b in zip(bounds, np.append(bounds[1:], len(c)).astype(int)):
                here, text = (int(k0[a]), int(k1[a])), ",".join(map(str, c[a:b].tolist()))
                if here == key:
                    text = "," + text
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = here, hashlib.sha256()
                state.update(text.encode())
            if len(out) > 10_000:
                yield made()
                out = []
        if key is not None:
            out.append((*key, state.hexdigest()))
            yield made()

    return ends.mapInArrow(stream, "k0 long, k1 long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    heavy_floor: int = HEAVY_FLOOR,
    shard_nodes: int = SHARD_NODES,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    placed = settle(placed_turns(conversations, conv, turn, role, text, heavy_rows))
    convs, turns = share_first_turns(placed)
    paths = settle(prefix_rows(convs, settle(turns), heavy_rows))
    nodes = settle(enumerate_nodes(paths))
    total = nodes.agg(F.max("n")).first()[0] or 0  # the root is in all conversations
    bound = max(heavy_floor, total // TOP_SHARE)
    heavy = settle(nodes.filter(F.col("n") > bound))
    # counts never grow along a conversation: its heavy prefixes are its first ones
    met = paths.join(heavy.select("k0", "k1", F.col("conv").alias("owner")), ["k0", "k1"])
    cuts = met.groupBy("c").agg(F.count(F.lit(1)).alias("cut"), F.max_by("owner", "depth").alias("up"))
    tops = paths.join(cuts, "c", "left").filter(F.col("depth") == F.coalesce("cut", F.lit(0)))
    tops = tops.select(F.col("c").alias("conv"), F.xxhash64("k0", "k1").alias("top"), "up")
    light = nodes.filter(F.col("n") <= bound).join(tops, "conv")
    shards = max(1, -(-nodes.count() // shard_nodes))
    zeros = [F.lit(0).cast("long").alias(f"more_{c}") for c in ("children", "leaves", "saved")]
    names = [f.split()[0] for f in NODE.split(", ")]
    work = light.select("*", *zeros, F.pmod("top", F.lit(shards)).alias("shard"))
    below = settle(work.groupBy("shard").applyInArrow(lambda t: subtree_sums(t.select(names)), DONE))
    given = below.filter("top and p0 is not null").groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(
        F.count(F.lit(1)).alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")
    )
    crown = heavy.join(given, ["k0", "k1"], "left").select("*", F.lit(None).cast("long").alias("up"), F.lit(0).alias("shard"))
    crown = crown.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("more_children", "more_leaves", "more_saved")})
    above = crown.groupBy("shard").applyInArrow(lambda t: subtree_sums(t.select(names)), DONE)
    done = below.unionByName(above).join(end_digests(paths), ["k0", "k1"], "left")
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the UTF-8 bytes of ``text``, bit by bit."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    eight = f"list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: {step})"
    bytes_ = f"list_transform(range(1, octet_length(encode({text})) * 2, 2), lambda k: ('0x' || substr(hex(encode({text})), k::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda crc, byte: {eight}), 4294967295)"


def oracle() -> str:
    """DuckDB SQL for the nodes: prefixes as lists of turns, subtrees by comparing lists."""
    return f"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    [coalesce(role, ''), coalesce(text, '')] AS t
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(t ORDER BY place) AS ts FROM turns GROUP BY c),
h AS (SELECT c, ts, {crc32_sql("c::VARCHAR")} % 6 AS h FROM own),
built AS (
  SELECT h.c, CASE WHEN h.c % 100 = 0 THEN h.ts
    ELSE list_concat(coalesce(b.ts, [])[1:h.h], h.ts[h.h + 1:]) END AS ts
  FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100),
paths AS (SELECT c, d::BIGINT AS depth, sha256(ts[1:d]::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(ts[1:d - 1]::VARCHAR) END AS above,
    CASE WHEN d > 0 THEN length(ts[d][2]) ELSE 0 END AS chars, d = len(ts) AS ended
  FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM built)),
nodes AS (
  SELECT node, depth, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends_sha256
  FROM paths GROUP BY node, depth),
kids AS (SELECT above AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY 1, 2),
own_sums AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS saved FROM nodes n LEFT JOIN kids k USING (node, depth)),
pairs AS (SELECT DISTINCT a.node AS top, a.depth AS top_depth, b.node, b.depth FROM paths a JOIN paths b ON a.c = b.c AND b.depth >= a.depth),
sums AS (
  SELECT top AS node, top_depth AS depth, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves, sum(o.saved)::BIGINT AS saved_tokens
  FROM pairs p JOIN own_sums o ON o.node = p.node AND o.depth = p.depth GROUP BY 1, 2)
SELECT o.conv_id, o.depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM own_sums o JOIN sums s USING (node, depth) LEFT JOIN nodes u ON u.node = o.above AND u.depth = o.depth - 1
"""
