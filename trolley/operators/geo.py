"""Geo cells: counts, neighbours, nearby points, popular items around a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trolley.functions import geocells as g
from trolley.operators.spread import hot_key_join, spread_by
from trolley.operators.topk import top_k

# A tile is 8 x 8 cells.
TILE_BITS = 3


def with_cell(points: DataFrame, precision: int) -> DataFrame:
    """Points with grid coordinates `x`, `y`."""
    return points.withColumns({"x": g.lng_cell(F.col("lng"), precision), "y": g.lat_cell(F.col("lat"), precision)})


def cell_counts(points: DataFrame, precision: int = 12) -> DataFrame:
    """Points a cell and the cell's centre."""
    counts = with_cell(points, precision).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_points"))
    x, y = F.col("x"), F.col("y")
    return counts.select(
        g.cell_text(x, y, precision).alias("cell"),
        "n_points",
        g.centre_lat(y, precision).alias("center_lat"),
        g.centre_lng(x, precision).alias("center_lng"),
    )


def cell_bounds(cells: DataFrame, precision: int) -> DataFrame:
    """Corners of cells given by `x`, `y`."""
    x_bits, y_bits = g.axis_bits(precision)
    wide, high = 360.0 / (1 << x_bits), 180.0 / (1 << y_bits)
    return cells.withColumns(
        {
            "min_lat": F.col("y") * high - 90.0,
            "max_lat": (F.col("y") + 1) * high - 90.0,
            "min_lng": F.col("x") * wide - 180.0,
            "max_lng": (F.col("x") + 1) * wide - 180.0,
        }
    )


def neighbours(cells: DataFrame, precision: int) -> DataFrame:
    """The eight cells around each cell, clockwise from north: (cell, direction, neighbour)."""
    x, y = F.col("x"), F.col("y")
    around = []
    for place, (direction, (east, north)) in enumerate(g.DIRECTIONS.items()):
        nx, ny = g.shifted(x, y, precision, east, north)
        around.append(
            F.struct(
                F.lit(place).alias("place"),
                F.lit(direction).alias("direction"),
                g.cell_text(nx, ny, precision).alias("neighbour"),
            )
        )
    listed = cells.select(g.cell_text(x, y, precision).alias("cell"), F.explode(F.array(*around)).alias("next"))
    return listed.select("cell", "next.*")


def spread_over_block(df: DataFrame, precision: int) -> DataFrame:
    """Copy rows with `x`, `y` to their own and the eight cells around (`here` marks the own cell)."""
    moved = df.withColumn("to", F.explode(g.block(F.col("x"), F.col("y"), precision)))
    here = ((F.col("to.x") == F.col("x")) & (F.col("to.y") == F.col("y"))).cast("int")
    return moved.withColumn("here", here).withColumn("x", F.col("to.x")).withColumn("y", F.col("to.y")).drop("to")


def proximity_join(left: DataFrame, right: DataFrame, precision: int) -> DataFrame:
    """For each left point, the right points in its cell and in its cell or the eight around.

    Right points are counted per cell first and only the counts are copied to neighbours, so a
    crowded cell costs one row, not a row for every pair of points.
    """
    counts = with_cell(right, precision).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    near = (
        spread_over_block(counts, precision)
        .groupBy(g.cell_number(F.col("x"), F.col("y"), precision).alias("cell"))
        .agg(F.sum(F.col("n") * F.col("here")).alias("n_same_cell"), F.sum("n").alias("n_nearby"))
    )
    placed = with_cell(left, precision).select("id", g.cell_number(F.col("x"), F.col("y"), precision).alias("cell"))
    return hot_key_join(placed, near, "cell", "left").select(
        "id",
        F.coalesce("n_same_cell", F.lit(0)).alias("n_same_cell"),
        F.coalesce("n_nearby", F.lit(0)).alias("n_nearby"),
    )


def _sums_around(per_cell: DataFrame, precision: int) -> DataFrame:
    """Sums of `n` (x, y, product_id) over a cell and the eight around: (x, y, product_id, cnt).

    Cells lie in tiles. A row is sent to the tiles that its block touches, one for most cells, and copied to the
    cells there, so the nine copies are made and summed without being sent. A group holds a tile's cells of an item.
    """

    def tile(cell) -> list:
        return [F.shiftright(cell[a], TILE_BITS).alias(f"t{a}") for a in ("x", "y")]

    block = g.block(F.col("x"), F.col("y"), precision)
    touched = F.explode(F.array_distinct(F.transform(block, lambda c: F.struct(*tile(c))))).alias("tile")
    sent = per_cell.select("x", "y", "product_id", "n", touched).select("x", "y", "product_id", "n", "tile.*")
    here = F.filter(block, lambda c: (tile(c)[0] == F.col("tx")) & (tile(c)[1] == F.col("ty")))
    copies = spread_by(sent, "tx", "ty", "product_id").select("tx", "ty", "product_id", "n", F.explode(here).alias("to"))
    cells = copies.select("tx", "ty", F.col("to.x").alias("x"), F.col("to.y").alias("y"), "product_id", "n")
    return cells.groupBy("tx", "ty", "x", "y", "product_id").agg(F.sum("n").alias("cnt")).drop("tx", "ty")


def cell_hot(points: DataFrame, purchases: DataFrame, precision: int = 5, k: int = 20) -> DataFrame:
    """Items bought most by users in a cell and its neighbours.

    `points` locates users (id), `purchases` has (user_id, product_id). Purchases are counted per user
    and item, then per cell and item, before the counts are copied to the cells around.
    """
    bought = purchases.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    placed = with_cell(points, precision).select(F.col("id").alias("user_id"), "x", "y")
    per_cell = hot_key_join(bought, placed, "user_id").groupBy("x", "y", "product_id").agg(F.sum("n").alias("n"))
    around = _sums_around(per_cell, precision)
    occupied = placed.select("x", "y").distinct()
    best = top_k(
        around.join(occupied, ["x", "y"], "left_semi"), ["x", "y"], [F.col("cnt").desc(), F.col("product_id").asc()], k
    )
    return best.select(g.cell_text(F.col("x"), F.col("y"), precision).alias("cell"), "product_id", "cnt", "rank")
