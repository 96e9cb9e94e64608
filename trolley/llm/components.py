"""Connected components of a link table by alternating large and small stars, as joins on distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trolley.sources.scratch import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of (u, v) rows; root is the smallest node of its component.

    Each round sends a node's larger neighbours to its smallest one (large star), then its smaller ones
    (small star). Minima are pre-aggregated before the shuffle, and a node with very many links meets its
    one minimum in a join whose large side the adaptive planner splits. Rounds end at written tables and
    stop when the table no longer changes. An empty link table gives no rows; nulls are ignored.
    """
    rows = links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = staged(rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        large = staged(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(least, "u").filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        now = staged(least.withColumnRenamed("_m", "v").union(small).distinct(), "small")
        was, mark = mark, _mark(now)
        if mark == was:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
