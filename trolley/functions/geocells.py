"""Geohash cells as integer grid coordinates and as text.

A cell of precision p has 5p bits, longitude first. A point on a border belongs to the lower cell
(the upper half is taken only when strictly greater). The borders are dyadic fractions, exact in a
double, so a closed-form guess corrected against its own borders equals repeated halving.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The geohash alphabet and the eight neighbour directions as (east, north) steps.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
DIRECTIONS = {
    "n": (0, 1), "ne": (1, 1), "e": (1, 0), "se": (1, -1),
    "s": (0, -1), "sw": (-1, -1), "w": (-1, 0), "nw": (-1, 1),
}


def axis_bits(precision: int) -> tuple[int, int]:
    """Bits of longitude and of latitude at a precision."""
    return (5 * precision + 1) // 2, 5 * precision // 2


def _axis_cell(value: Column, low: float, span: float, bits: int) -> Column:
    cells = float(1 << bits)
    guess = F.ceil((value - low) / span * cells).cast("bigint") - 1
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit((1 << bits) - 1))

    def border(i: Column) -> Column:
        return i.cast("double") * F.lit(span / cells) + F.lit(low)

    return (
        F.when((value <= border(guess)) & (guess > 0), guess - 1)
        .when((value > border(guess + 1)) & (guess < (1 << bits) - 1), guess + 1)
        .otherwise(guess)
    )


def lng_cell(lng: Column, precision: int) -> Column:
    return _axis_cell(lng, -180.0, 360.0, axis_bits(precision)[0])


def lat_cell(lat: Column, precision: int) -> Column:
    return _axis_cell(lat, -90.0, 180.0, axis_bits(precision)[1])


def cell_number(x: Column, y: Column, precision: int) -> Column:
    """Grid coordinates as one number, a single join key."""
    return x * F.lit(1 << axis_bits(precision)[1]).cast("bigint") + y


def cell_text(x: Column, y: Column, precision: int) -> Column:
    """Geohash text of grid coordinates: bits interleaved longitude first, five to a character."""
    x_bits, y_bits = axis_bits(precision)
    letters = []
    for start in range(0, 5 * precision, 5):
        digit = F.lit(0).cast("bigint")
        for place, bit in enumerate(range(start, start + 5)):
            source, width = (x, x_bits) if bit % 2 == 0 else (y, y_bits)
            one = F.shiftright(source, width - 1 - bit // 2).bitwiseAND(F.lit(1).cast("bigint"))
            digit = digit + one * (16 >> place)
        letters.append(F.substring(F.lit(BASE32), (digit + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def centre_lng(x: Column, precision: int) -> Column:
    return (x.cast("double") + 0.5) * F.lit(360.0 / (1 << axis_bits(precision)[0])) - 180.0


def centre_lat(y: Column, precision: int) -> Column:
    return (y.cast("double") + 0.5) * F.lit(180.0 / (1 << axis_bits(precision)[1])) - 90.0


def shifted(x: Column, y: Column, precision: int, east: int, north: int) -> tuple[Column, Column]:
    """Grid coordinates some steps away; both axes wrap around."""
    x_bits, y_bits = axis_bits(precision)
    return F.pmod(x + east, F.lit(1 << x_bits)), F.pmod(y + north, F.lit(1 << y_bits))


def block(x: Column, y: Column, precision: int) -> Column:
    """The cell and its neighbours as an array of (x, y): around the date line, but not over a pole; duplicates
    (tiny grids) removed."""
    steps = [(0, 0), *DIRECTIONS.values()]
    cells = []
    for east, north in steps:
        nx, _ = shifted(x, y, precision, east, north)
        cells.append(F.struct(nx.alias("x"), (y + north).alias("y")))
    rows = 1 << axis_bits(precision)[1]
    return F.array_distinct(F.filter(F.array(*cells), lambda c: (c["y"] >= 0) & (c["y"] < rows)))
