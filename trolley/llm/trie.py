"""The trie of conversation prefixes, its node table addressed by minimal perfect hashing.

Every prefix of a conversation has a digest: the sum of hashes of (position, role, text) over its turns. Sums are taken
in two levels, so a very long conversation is no single group. Distinct digests are the nodes.

Shards. The weight of a node is the number of rows below it (all members' turns from its depth on), which one
aggregation gives. Nodes of a weight up to LIGHT are level 0, up to LIGHT * FAN level 1, and so on; the nodes of one level
under one topmost node form a subtree of at most LIGHT rows (level 0) or FAN * depth nodes (above), whatever prefix a
third of the conversations share. Whole subtrees are dealt to shards.

Inside a shard, digests get gapless slots (a cascade of bit arrays: a digest takes the bit that it alone hits, the others
go on to the next array), each checked against the digest stored there. Counts are scattered into flat arrays, and
leaves and savings are added up through the array of parent slots, deepest nodes first. Each topmost node hands its
sums to its parent, which lies in a shard of a higher level.

Cases: rows without a conv_id belong to no conversation; null role and text are empty; rows of one turn number are
ordered by role and text; repeated rows are turns of their own; an empty table has no nodes, not even a root; extra
columns are not read. Texts are hashed where they are read and never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trolley.operators.spread import hot_key_join, running_total
from trolley.sources.scratch import staged

# Rows below a node of level 0 at most, and the factor to the next level.
LIGHT = 16_384
FAN = 1_024
# Positions of a conversation, ids of one list of members that are taken together.
TURNS_TOGETHER = 1_024
IDS_TOGETHER = 65_536


def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, d, t1, t2, n_bytes): every conversation's turns in order, d from 1, role and text as hashes."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    block = F.coalesce(F.floor(F.col("turn") / TURNS_TOGETHER), F.lit(-(1 << 62)))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    numbered = running_total(rows, ["conv_id"], block, order, F.lit(1), "_before")
    return numbered.select(
        "conv_id",
        (F.col("_before") + 1).cast("bigint").alias("d"),
        F.xxhash64("role", "text").alias("t1"),
        F.xxhash64(F.lit(1), "text", "role").alias("t2"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
    )


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that have turns."""
    return turns.groupBy("conv_id").agg(F.max("d").alias("n_turns"))


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that start like a common one: (turns, members with their number of turns, none included).

    Conversation c takes the first h turns of c - c % every (all if fewer, none if there is no such conversation), then
    its own turns after its first h; h is the crc32 of the decimal id, modulo `most`.
    """
    convs = staged(
        lengths(turns).select(
            "conv_id",
            "n_turns",
            (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"),
            (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
        ),
        "conversations",
    )
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    plan = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = staged(plan, "plan")
    content = ["t1", "t2", "n_bytes"]
    first = turns.filter(F.col("d") < most).withColumnRenamed("conv_id", "base")
    borrowed = plan.select("conv_id", "base", "taken").join(first, "base").filter("d <= taken")
    counts = plan.select("conv_id", F.col("n_turns").alias("n"))
    own = hot_key_join(turns, plan.select("conv_id", "h", "taken"), "conv_id", counts=counts).filter("d > h")
    own = own.withColumn("d", F.col("taken") + F.col("d") - F.col("h"))
    rows = borrowed.select("conv_id", "d", *content).unionByName(own.select("conv_id", "d", *content))
    n = F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))
    return rows, plan.select("conv_id", n.cast("bigint").alias("n_turns"))


def _prefixes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row a (conversation, depth): the prefix's digest (hi, lo) and its parent's (phi, plo)."""

    def unsigned(h: Column) -> Column:
        return h.cast("decimal(20,0)") + F.expr("9223372036854775808BD")

    high = unsigned(F.xxhash64("d", "t1", "t2"))
    low = F.xxhash64("t2", "d", "t1").bitwiseAND(F.lit((1 << 32) - 1)).cast("decimal(10,0)")
    # 96 bits a turn; sums of up to 10^9 turns stay below 38 digits.
    value = (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(38,0)")
    summed = running_total(
        turns.withColumn("_turn", value), ["conv_id"], F.floor(F.col("d") / TURNS_TOGETHER), [F.col("d")], F.col("_turn"), "_sum"
    )
    halves = {}
    for names, total in ((("phi", "plo"), "_sum"), (("hi", "lo"), "_sum + _turn")):
        halves[names[0]] = F.expr(f"CAST(({total}) div 9223372036854775808BD AS BIGINT)")
        halves[names[1]] = F.expr(f"CAST(({total}) % 9223372036854775808BD AS BIGINT)")
    counts = members.select("conv_id", F.col("n_turns").alias("n"))
    rows = summed.select("conv_id", "d", "n_bytes", *[c.alias(n) for n, c in halves.items()])
    return hot_key_join(rows, members, "conv_id", counts=counts)


def _level(weight: str) -> Column:
    level, bound = F.lit(0), LIGHT
    while bound < 1 << 62:
        level = level + (F.col(weight) > bound).cast("int")
        bound *= FAN
    return level.alias("level")


def _nodes(paths: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct digests with their counts; digests that stand for two different prefixes are an error."""
    found = paths.groupBy("hi", "lo").agg(
        F.min("phi").alias("phi"), F.min("plo").alias("plo"), F.min("d").alias("depth"),
        F.min("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum(F.col("n_turns") - F.col("d") + 1).alias("weight"),
        (
            (F.min("phi") == F.max("phi")) & (F.min("plo") == F.max("plo")) & (F.min("d") == F.max("d"))
            & (F.min("n_bytes") == F.max("n_bytes"))
        ).alias("one"),
    )
    checked = F.when(F.col("one"), F.col("depth")).otherwise(F.raise_error(F.lit("two prefixes share a digest")))
    found = found.withColumn("depth", checked.cast("bigint")).drop("one")
    none = F.lit(None).cast("bigint")
    root = members.agg(
        F.lit(0).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("lo"), none.alias("phi"), none.alias("plo"),
        F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("n_bytes"),
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum(F.col("n_turns") + 1).alias("weight"),
    ).filter("n_convs > 0")
    return found.unionByName(root).withColumn("level", _level("weight"))


def _grouped(nodes: DataFrame, paths: DataFrame, top: int) -> DataFrame:
    """Nodes with the digest of the topmost node of their level above them (ghi, glo)."""
    heavy = nodes.filter("level > 0 and depth > 0").select(
        F.struct("hi", "lo").alias("node"), F.col("level").alias("own_level")
    )
    counts = nodes.filter("depth > 0").select(F.struct("hi", "lo").alias("node"), F.col("n_convs").alias("n"))
    on_path = paths.select("conv_id", "d", F.struct("hi", "lo").alias("node"))
    met = hot_key_join(on_path, heavy, "node", counts=counts)
    last = [F.max(F.when(F.col("own_level") > i, F.col("d"))).alias(f"m{i}") for i in range(top)]
    marks = met.groupBy("conv_id").agg(*last) if top else None
    under = nodes.filter(F.col("level") < top)
    if marks is not None:
        above = F.element_at(F.array(*[F.col(f"m{i}") for i in range(top)]), F.col("level") + 1)
        under = hot_key_join(under, marks, "conv_id", "left").withColumn("g", F.coalesce(above, F.lit(0)) + 1)
        starts = paths.select("conv_id", F.col("d").alias("g"), F.col("hi").alias("ghi"), F.col("lo").alias("glo"))
        under = under.join(starts, ["conv_id", "g"]).select(*nodes.columns, "ghi", "glo")
    else:
        under = under.select(*nodes.columns, F.lit(0).cast("bigint").alias("ghi"), F.lit(0).cast("bigint").alias("glo"))
    rest = nodes.filter(F.col("level") == top)
    zero = F.lit(0).cast("bigint")
    return under.unionByName(rest.withColumns({"ghi": zero, "glo": zero}))


_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(hi: np.ndarray, lo: np.ndarray, seed: int) -> np.ndarray:
    x = (hi ^ (lo * _ODD[0])) + np.uint64((seed + 1) * int(_ODD[2]) & (1 << 64) - 1)
    for shift, factor in ((30, _ODD[1]), (27, _ODD[2])):
        x = (x ^ (x >> np.uint64(shift))) * factor
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Slots:
    """A minimal perfect hash of 128-bit digests: slots 0 .. n - 1 without gaps, checked on every lookup."""

    bits: list[np.ndarray]
    ranks: list[np.ndarray]
    hi: np.ndarray
    lo: np.ndarray

    @staticmethod
    def of(hi: np.ndarray, lo: np.ndarray) -> Slots:
        """`hi` and `lo` as uint64; a repeated digest is an error."""
        bits, ranks, slot, left, used = [], [], np.zeros(len(hi), np.int64), np.arange(len(hi)), 0
        while len(left):
            if len(bits) == 64:
                raise ValueError("a digest occurs twice in a shard")
            at = (_mixed(hi[left], lo[left], len(bits)) % np.uint64(2 * len(left))).astype(np.int64)
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            rank = used + np.cumsum(alone) - 1
            hit = alone[at]
            slot[left[hit]] = rank[at[hit]]
            used += int(alone.sum())
            bits.append(alone)
            ranks.append(rank)
            left = left[~hit]
        own_hi, own_lo = np.zeros(len(hi), np.uint64), np.zeros(len(hi), np.uint64)
        own_hi[slot], own_lo[slot] = hi, lo
        return Slots(bits, ranks, own_hi, own_lo)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for one that is not in the table."""
        slot, left = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for i, (alone, rank) in enumerate(zip(self.bits, self.ranks)):
            at = (_mixed(hi[left], lo[left], i) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            slot[left[hit]] = rank[at[hit]]
            left = left[~hit]
        known = slot >= 0
        known[known] = (self.hi[slot[known]] == hi[known]) & (self.lo[slot[known]] == lo[known])
        return np.where(known, slot, -1)


_SHARD_OUT = (
    "hi bigint, lo bigint, phi bigint, plo bigint, depth bigint, conv_id bigint, n_convs bigint, "
    "parent_conv_id bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, topmost boolean"
)


def _shard(rows: pa.Table) -> pa.Table:
    """All sums of the nodes of one shard; what lower levels hand up is in the columns b_*."""

    def column(name: str, empty: int = 0) -> np.ndarray:
        return rows.column(name).fill_null(empty).to_numpy().astype(np.int64)

    hi, lo = column("hi").view(np.uint64), column("lo").view(np.uint64)
    table = Slots.of(hi, lo)
    slot = table.find(hi, lo)
    n = len(slot)

    def scatter(values: np.ndarray) -> np.ndarray:
        flat = np.zeros(n, np.int64)
        flat[slot] = values
        return flat

    phi, plo = scatter(column("phi", -1)).view(np.uint64), scatter(column("plo", -1)).view(np.uint64)
    parent = table.find(phi, plo)
    depth, n_convs, conv_id = scatter(column("depth")), scatter(column("n_convs")), scatter(column("conv_id"))
    inside = parent >= 0
    children = scatter(column("b_children")) + np.bincount(parent[inside], minlength=n)
    leaves = scatter(column("b_leaves")) + (children == 0)
    saved = scatter(column("b_saved")) + (n_convs - 1) * scatter(column("n_bytes"))
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for block in np.split(order, edges):
        block = block[inside[block]]
        np.add.at(leaves, parent[block], leaves[block])
        np.add.at(saved, parent[block], saved[block])
    above = pa.array(conv_id[np.where(inside, parent, 0)], mask=~inside)
    names = [part.split()[0] for part in _SHARD_OUT.split(", ")]
    has_parent = depth > 0
    parts = [
        pa.array(table.hi.view(np.int64)), pa.array(table.lo.view(np.int64)),
        pa.array(phi.view(np.int64), mask=~has_parent), pa.array(plo.view(np.int64), mask=~has_parent),
        pa.array(depth), pa.array(conv_id), pa.array(n_convs), above, pa.array(children), pa.array(leaves),
        pa.array(saved), pa.array(~inside & has_parent),
    ]
    return pa.Table.from_arrays(parts, names=names)


def _ends(paths: DataFrame, members: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the nodes at which conversations end.

    Ids are joined in stretches of IDS_TOGETHER consecutive ids, and a node's stretches are hashed one after the
    other as they come out of the sort, so no list of members is ever held.
    """
    zero = F.lit(0).cast("bigint")
    last = paths.filter("d = n_turns").select("hi", "lo", "conv_id")
    last = last.unionByName(members.filter("n_turns = 0").select(zero.alias("hi"), zero.alias("lo"), "conv_id"))
    stretch = F.floor(F.col("conv_id") / IDS_TOGETHER).alias("stretch")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = last.groupBy("hi", "lo", stretch).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids"))):
                if (hi, lo) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (hi, lo), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _hashed(out)
        if node is not None:
            yield _hashed([(*node, state.hexdigest())])

    ordered = parts.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "stretch").select("hi", "lo", "ids")
    return ordered.mapInArrow(run, "hi bigint, lo bigint, ends_sha256 string")


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["hi", "lo", "ends_sha256"])


def prefix_trie(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row a node: hi, lo (its digest), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    `turns` as from `digested`; `members` (conv_id, n_turns) adds conversations without turns.
    """
    members = staged(lengths(turns) if members is None else members, "members")
    paths = staged(_prefixes(turns, members), "paths")
    nodes = staged(_nodes(paths, members), "nodes")
    weight, top = nodes.agg(F.max("weight"), F.max("level")).first()
    grouped = staged(_grouped(nodes, paths, top or 0), "grouped")
    pending, done = None, []
    for level in range((top or 0) + 1):
        own = grouped.filter(F.col("level") == level)
        if pending is None:
            own = own.withColumns({c: F.lit(0).cast("bigint") for c in ("b_children", "b_leaves", "b_saved")})
        else:
            below = pending.groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(
                F.count(F.lit(1)).alias("b_children"), F.sum("n_leaves").alias("b_leaves"), F.sum("saved_tokens").alias("b_saved")
            )
            own = own.join(below, ["hi", "lo"], "left")
        shards = max(1, -(-(weight or 0) // (LIGHT * FAN**level)))
        sent = own.withColumn("shard", F.pmod(F.xxhash64("ghi", "glo"), F.lit(shards)))
        out = staged(sent.groupBy("shard").applyInArrow(_shard, _SHARD_OUT), "shard-sums")
        done.append(out)
        handed = out.filter("topmost").select("phi", "plo", "n_leaves", "saved_tokens")
        pending = handed if pending is None else pending.unionByName(handed)
    rows = done[0]
    for part in done[1:]:
        rows = rows.unionByName(part)
    # A topmost node's parent is a heavy node or the root.
    parents = nodes.filter("level > 0 or depth = 0").select(F.struct("hi", "lo").alias("parent"), F.col("conv_id").alias("found"))
    tops = hot_key_join(rows.filter("topmost").withColumn("parent", F.struct("phi", "plo")), _renamed(parents), "parent")
    kept = ["hi", "lo", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    tops = tops.withColumn("parent_conv_id", F.col("found")).select(*kept)
    rows = rows.filter("not topmost").select(*kept).unionByName(tops)
    ended = rows.join(_ends(paths, members), ["hi", "lo"], "left")
    return ended.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def _renamed(parents: DataFrame) -> DataFrame:
    return parents.withColumn("parent", F.struct(F.col("parent.hi").alias("phi"), F.col("parent.lo").alias("plo")))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are: `prefix_trie` of their turns."""
    return prefix_trie(staged(digested(conversations), "turns"))
