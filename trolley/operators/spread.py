"""Numbering, running totals and joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trolley.functions.arrays import count_at_most, probe_steps

# Global orders are cut into at most this many ranges, so tables of ranges are small by construction.
MOST_RANGES = 1024
ROWS_PER_RANGE = 1_000_000
# A key is hot when it holds more than 1/HOT_SHARE of the rows, or more than ROWS_PER_SLICE of them. There are
# fewer than max(HOT_SHARE, rows / ROWS_PER_SLICE) such keys whatever the data, which bounds the table of hot
# keys that is broadcast (a million short rows at 10^12), and no slice grows with the data.
HOT_SHARE = 1000
ROWS_PER_SLICE = 1_000_000


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key into the session's full number of shuffle partitions.

    For steps whose work per row is far above its size: the adaptive planner merges partitions by
    size and would leave such a step with too few tasks. A grouping on the keys reuses the partitioning.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def running_total(
    df: DataFrame, keys: Sequence[str], coarse: Column, order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """Sum of `value` over the earlier rows of a key (the row itself excluded).

    `coarse` must not decrease along `order`. Rows are summed inside (key, coarse) and the groups'
    totals are carried over, so no task meets more than one coarse group of a key.
    """
    tagged = df.withColumn("_coarse", coarse).withColumn("_value", value)
    inner = Window.partitionBy(*keys, "_coarse").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tagged.groupBy(*keys, "_coarse")
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, "_coarse", F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_carried"))
    )
    return (
        tagged.withColumn("_earlier", _sum_before(inner))
        .join(carried, [*keys, "_coarse"])
        .withColumn(out, F.col("_carried") + F.col("_earlier"))
        .drop("_coarse", "_value", "_earlier", "_carried")
    )


def _sum_before(ordered) -> Column:
    return F.coalesce(F.sum("_value").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def split_points(df: DataFrame, value: Column, rows_per_range: int = ROWS_PER_RANGE) -> list:
    """Ascending cut points that divide a numeric column into ranges of about equal size.

    One aggregate pass; at most MOST_RANGES numbers reach the driver. A small table gives no cut.
    """
    shares = ", ".join(f"{i / MOST_RANGES}D" for i in range(1, MOST_RANGES))
    sketch = f"percentile_approx(v, array({shares}), {10 * MOST_RANGES})"
    n, cuts = df.select(value.alias("v")).selectExpr("count(v)", sketch).first()
    ranges = min(MOST_RANGES, -(-n // rows_per_range))
    if ranges <= 1:
        return []
    return sorted({cuts[i * MOST_RANGES // ranges - 1] for i in range(1, ranges)})


def global_running_total(
    df: DataFrame,
    order: Sequence[str],
    value: Column,
    out: str,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Sum of `value` over all rows earlier in `order`, whose first column is numeric.

    A table of up to `rows_per_range` rows is summed by one window. A larger one is cut into ranges at
    quantiles of the first column, and only the ranges' totals, MOST_RANGES rows at most, are summed
    together.
    """
    first = F.col(order[0])
    cuts = split_points(df, first, rows_per_range)
    in_order = [F.col(c) for c in order]
    if not cuts:
        return (
            df.withColumn("_value", value).withColumn(out, _sum_before(Window.orderBy(*in_order))).drop("_value")
        )
    points = F.array(*[F.lit(c) for c in cuts])
    return running_total(df, [], count_at_most(points, probe_steps(F.lit(len(cuts))), first), in_order, value, out)


def hot_key_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None
) -> DataFrame:
    """Join many left rows to few right rows a key ('inner' or 'left'), with the left's hot keys split.

    A hot key is cut into slices of a thousandth of the left rows or ROWS_PER_SLICE, whichever is less; its
    right rows are repeated once a slice. Other keys keep one slice.
    `counts` (key, n) saves the counting pass where left rows a key are known already; it only steers
    the slicing, so near counts do.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(key, F.col("n").alias("_n"))
    total = counts.agg(F.sum("_n").alias("total")).scalar()
    slice_rows = F.least(total / HOT_SHARE, F.lit(float(ROWS_PER_SLICE)))
    hot = counts.filter(F.col("_n") > slice_rows).select(
        key, F.ceil(F.col("_n") / slice_rows).cast("int").alias("_slices")
    )
    others = [c for c in left.columns if c != key]
    slices = F.coalesce("_slices", F.lit(1))
    cut = left.join(F.broadcast(hot), key, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(*others, F.lit(1)), slices).cast("int")
    )
    copies = right.join(F.broadcast(hot), key, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))
    )
    return cut.drop("_slices").join(copies.drop("_slices"), [key, "_slice"], how).drop("_slice")
