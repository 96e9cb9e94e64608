"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws -ln(u) / weight from the row's key and its own id, and the smallest draw
wins, so a child receives rows in proportion to its weight. A weight that changes moves rows only between
its own subtree and the others of that parent; draws of unchanged children stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from trolley.functions.arrays import count_at_most, probe_steps
from trolley.functions.draws import DRAW_SPAN, draw


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, added: int = 0, per_rack: int = 2, racks_per_region: int = 2) -> list[Shard]:
    """Equal shards dealt to racks and regions; each of `added` further shards opens a region of its own.

    A shard in a new region takes rows only into itself. (One added to an old rack would raise that rack's
    and region's weight, and rows drawn into the region may then land on any of its shards.)
    """
    base = [Shard(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(shards)]
    regions, racks = base[-1].region + 1, base[-1].rack + 1
    return base + [Shard(regions + i, racks + i, shards + i) for i in range(added)]


def _children(tree: list[Shard]) -> dict[str, list[tuple[int, float]]]:
    """Per inner node ('' the root, 'r1' a region, 'k3' a rack): its children with the weight of their subtrees."""
    out: dict[str, dict[int, float]] = {}
    for s in tree:
        for node, child in (("", s.region), (f"r{s.region}", s.rack), (f"k{s.rack}", s.shard)):
            kids = out.setdefault(node, {})
            kids[child] = kids.get(child, 0.0) + s.weight
    return {node: sorted(kids.items()) for node, kids in out.items()}


def place(tree: list[Shard], key: Column) -> Column:
    """The shard a key belongs to; decided by the key and the tree alone."""
    kids = _children(tree)

    def pick(level: str, node: Column) -> Column:
        table = F.create_map(
            *[
                part
                for name, children in kids.items()
                if name[:1] == level
                for part in (
                    F.lit(int(name[1:] or 0)),
                    F.array(*[F.struct(F.lit(c).alias("id"), F.lit(w).alias("w")) for c, w in children]),
                )
            ]
        )

        def clock(child: Column) -> Column:
            u = (draw(f"tree{level}", key, child["id"]) + F.lit(0.5)) / F.lit(float(DRAW_SPAN))
            return F.struct((-F.ln(u) / child["w"]).alias("t"), child["id"].alias("id"))

        return F.array_min(F.transform(table[node], clock))["id"]

    def then(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]  # binds a value once

    return then(pick("", F.lit(0)), lambda r: then(pick("r", r), lambda k: pick("k", k)))


def slots(rows: DataFrame, by: str, order: list[Column], rows_per_range: int | None = None) -> DataFrame:
    """Number the rows of each `by` from 0 in the given order, whose first column is `doc_id`.

    Rows are numbered inside ranges of doc_id, cut at its quantiles, and the ranges' counts are summed
    ahead of them: no task holds a whole shard. There are about sqrt(n) / 16 ranges, so both the list of
    cuts and a range's share grow slowly with the input. Null ids come first.
    """
    n = rows.count()
    ranges = -(-n // rows_per_range) if rows_per_range else max(1, int(n**0.5 / 16))
    shares = ", ".join(f"{i / ranges}D" for i in range(1, ranges)) or "0.5D"
    cuts = rows.selectExpr(f"percentile_approx(doc_id, array({shares}), {max(10_000, 10 * ranges)})").first()[0]
    points = F.array(*[F.lit(c) for c in sorted(set(cuts or [0]))])
    own = F.coalesce(count_at_most(points, probe_steps(F.size(points)), F.col("doc_id")), F.lit(0))
    cut = rows.withColumn("_range", own)
    ahead = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = sums.select(by, "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)) - 1
    numbered = cut.withColumn("_inside", inside).join(before, [by, "_range"])
    return numbered.withColumn("slot", F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Law `key`: doc_id and the shard count decide; with one more shard, rows move only into it. Sizes are
    UTF-8 bytes plus 1 (null text: 1, checksum of the empty string 0). Null ids share one shard, rows that
    repeat an id its shard; slots follow doc_id, then size and checksum, and rows equal in all three are
    interchangeable. An empty table gives no rows; further columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(topology(shards), key).alias("shard"),
        place(topology(shards, added=1), key).alias("grown_shard"),
    )
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    return slots(rows, "shard", order).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard"
    )
