"""Points within a distance: an exact filter whose work does not grow with crowded places.

Points are places on the unit sphere, cut into cubes as wide as the distance, so poles and the date line are nothing
special. A cube with many places is cut into eight, and so on. Seekers are gathered in such cubes too, called tiles, and
a tile looks at the cubes around it for all of them: one that lies wholly within the distance of the whole tile counts as
a number, one that lies outside is left, and the places of the small cubes between are sent to the tile once and compared
with its seekers there, so that no row is made for a seeker and a cube.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trolley.operators.spread import hot_key_join
from trolley.sources.scratch import staged

EARTH_KM = 6371.0088
# Different places of a cube that are compared one by one; cubes with more are cut.
CROWDED = 64
# Different places of the seekers of a tile.
TILE = 512
# Cubes are not cut further than this: at poles places may differ in longitude alone.
MOST_LEVELS = 24
# Pairs compared at a time.
PAIRS_AT_ONCE = 1_000_000
# Left to the exact comparison: cubes so close to the distance that rounding could decide.
SLACK = 1e-9
AXES = ("x", "y", "z")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance of two points given in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    b = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a + b)))


def _on_sphere(points: DataFrame) -> DataFrame:
    lat, lng = F.radians("lat"), F.radians("lng")
    return points.withColumns({"x": F.cos(lat) * F.cos(lng), "y": F.cos(lat) * F.sin(lng), "z": F.sin(lat)})


def _cube(level: int, side: float) -> Column:
    parts = [F.floor((F.col(a) + 2) / F.lit(side / 2**level)).alias(a) for a in AXES]
    return F.struct(F.lit(level).alias("level"), *parts).alias("cube")


def _tree(spots: DataFrame, side: float, crowded: int) -> tuple[list[DataFrame], DataFrame]:
    """Cubes (cube, n, leaf) of each level, and the places with the leaf they lie in."""
    levels, leaves, left = [], [], spots
    while True:
        tagged = staged(left.withColumn("cube", _cube(len(levels), side)), "places")
        cubes = tagged.groupBy("cube").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("spots"))
        cubes = staged(cubes.select("cube", "n", "spots", ((F.col("spots") <= crowded) | F.lit(len(levels) >= MOST_LEVELS)).alias("leaf")), "cubes")
        counts = cubes.select("cube", F.col("spots").alias("n"))
        known = hot_key_join(tagged, cubes.select("cube", "leaf"), "cube", counts=counts)
        levels.append(cubes.drop("spots"))
        leaves.append(known.filter("leaf").select("cube", "lat", "lng", "n"))
        left = known.filter("not leaf").drop("cube", "leaf")
        if cubes.filter("not leaf").isEmpty():
            break
    places = leaves[0]
    for more in leaves[1:]:
        places = places.unionByName(more)
    return levels, staged(places, "leaf-places")


def _reach(tile: Column, cube: Column, side: float, width: float) -> tuple[Column, Column]:
    """Squared least and largest distance of a tile from a cube of the given width."""
    least, most, wide = F.lit(0.0), F.lit(0.0), F.lit(side) / F.pow(F.lit(2.0), tile["level"])
    for a in AXES:
        low, own = cube[a] * F.lit(width), tile[a] * wide
        up, down = low + width - own, own + wide - low  # from the one's lower to the other's upper face
        least = least + F.pow(F.greatest(F.lit(0.0), -up, -down), 2)
        most = most + F.pow(F.greatest(F.abs(up), F.abs(down)), 2)
    return least, most


def _parts(level: int, parent: Column) -> Column:
    """The eight cubes of a level that make up a parent."""
    return F.transform(
        _steps((0, 1)), lambda s: F.struct(F.lit(level).alias("level"), *[(parent[a] * 2 + s[a]).alias(a) for a in AXES])
    )


def _steps(values: tuple[int, ...]) -> Column:
    return F.array(*[
        F.struct(*[F.lit(v).cast("bigint").alias(a) for a, v in zip(AXES, (i, j, k))])
        for i in values for j in values for k in values
    ])


def _spots(points: DataFrame) -> DataFrame:
    """Different places with the number of points there."""
    known = points.filter("lat is not null and lng is not null").groupBy("lat", "lng").agg(F.count(F.lit(1)).alias("n"))
    return _on_sphere(known).filter(~F.isnan("x") & ~F.isnan("y") & ~F.isnan("z"))


def _counted(km: float, inside: float, outside: float):
    """Places of a tile with how many points lie near them; points without coordinates count for the whole tile."""

    def place(table: pa.Table, lat: str, lng: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        degrees = [table.column(c).to_numpy() for c in (lat, lng)]
        b, l = np.radians(degrees)
        return *degrees, np.stack([np.cos(b) * np.cos(l), np.cos(b) * np.sin(l), np.sin(b)])

    def count(seekers: pa.Table, points: pa.Table) -> pa.Table:
        whole = points.column("to_lat").is_null()
        n_within = np.full(len(seekers), points.filter(whole).column("to_n").to_numpy().sum(), np.int64)
        points = points.filter(points.column("to_lat").is_valid())
        lat, lng, own = place(seekers, "lat", "lng")
        to_lat, to_lng, there = place(points, "to_lat", "to_lng")
        many = points.column("to_n").to_numpy().astype(np.int64)
        step = max(1, PAIRS_AT_ONCE // max(1, len(many)))
        for at in range(0, len(own[0]) if len(many) else 0, step):
            apart = sum((a[at : at + step, None] - b[None, :]) ** 2 for a, b in zip(own, there))
            near = apart <= inside
            row, col = np.nonzero(~near & (apart <= outside))  # too close to call
            b1, b2 = lat[at + row], to_lat[col]
            h = np.sin(np.radians(b2 - b1) / 2) ** 2
            h += np.cos(np.radians(b1)) * np.cos(np.radians(b2)) * np.sin(np.radians(to_lng[col] - lng[at + row]) / 2) ** 2
            near[row, col] = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0))) <= km
            n_within[at : at + step] += near @ many
        return pa.table({"lat": seekers.column("lat"), "lng": seekers.column("lng"), "n_within": pa.array(n_within)})

    return count


def within_distance(left: DataFrame, right: DataFrame, km: float, crowded: int = CROWDED, tile: int = TILE) -> DataFrame:
    """(id, n_within): for each left point (id, lat, lng; ids are unique) how many right points lie within `km`.

    Points at one place are one row, on both sides. Points without coordinates are near nothing.
    """
    chord = 2 * math.sin(min(km / EARTH_KM, math.pi) / 2)
    side = max(chord, 1e-7)
    inside, outside = max(chord - SLACK, 0) ** 2, (chord + SLACK) ** 2
    levels, places = _tree(_spots(right), side, crowded)
    tiles, seekers = _tree(_spots(left), side, tile)
    leaves = tiles[0]
    for more in tiles[1:]:
        leaves = leaves.unionByName(more)
    leaves = leaves.filter("leaf").select(F.col("cube").alias("tile"))
    top = [F.floor(F.col("tile")[a] / F.pow(F.lit(2.0), F.col("tile.level"))) for a in AXES]
    around = F.transform(
        _steps((-1, 0, 1)), lambda s: F.struct(F.lit(0).alias("level"), *[(own + s[a]).alias(a) for a, own in zip(AXES, top)])
    )
    front, sent = leaves.withColumn("cube", F.explode(around)), []
    nowhere = [F.lit(None).cast("double").alias(c) for c in ("to_lat", "to_lng")]
    for level, cubes in enumerate(levels):
        least, most = _reach(F.col("tile"), F.col("cube"), side, side / 2**level)
        met = staged(hot_key_join(staged(front.filter(least <= outside), "front"), cubes, "cube"), "met")
        sent.append(met.filter(most <= inside).groupBy("tile").agg(F.sum("n").alias("to_n")).select("tile", *nowhere, "to_n"))
        cut = met.filter(most > inside)
        there = places.filter(F.col("cube.level") == level).select(
            "cube", F.col("lat").alias("to_lat"), F.col("lng").alias("to_lng"), F.col("n").alias("to_n")
        )
        one = staged(cut.filter("leaf").select("tile", "cube"), "one-by-one")
        sent.append(hot_key_join(one, there, "cube").select("tile", "to_lat", "to_lng", "to_n"))
        parts = F.explode(_parts(level + 1, F.col("cube"))).alias("cube")
        front = cut.filter("not leaf").select("tile", parts)
    points = sent[0]
    for more in sent[1:]:
        points = points.unionByName(more)
    key = ["level", *AXES]
    asking = seekers.select("cube.*", "lat", "lng").groupBy(*key)
    asked = points.select("tile.*", "to_lat", "to_lng", "to_n").groupBy(*key)
    near = asking.cogroup(asked).applyInArrow(_counted(km, inside, outside), "lat double, lng double, n_within bigint")
    near = near.select(F.struct("lat", "lng").alias("place"), "n_within").filter("n_within > 0")
    known = left.filter("id is not null and lat is not null and lng is not null")
    found = hot_key_join(known.select("id", F.struct("lat", "lng").alias("place")), near, "place")
    total = found.groupBy("id").agg(F.sum("n_within").alias("n_within"))
    return left.select("id").join(total, "id", "left").select("id", F.coalesce("n_within", F.lit(0)).alias("n_within"))
