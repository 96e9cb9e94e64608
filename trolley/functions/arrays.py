"""Array helpers: columns that stay inside the JVM, and a search over many lists inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def probe_steps(size: Column) -> Column:
    """Descending powers of two not above `size`: the step lengths of a binary search."""
    top = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    return F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda e: F.call_function("shiftleft", F.lit(1), e))


def count_at_most(values: Column, steps: Column, x: Column) -> Column:
    """How many entries of the ascending array `values` are <= x, in log(size) probes."""
    return F.aggregate(
        steps,
        F.lit(0),
        lambda lo, s: F.when((lo + s <= F.size(values)) & (F.get(values, lo + s - 1) <= x), lo + s).otherwise(lo),
    )


def at_most_counts(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """`count_at_most` for each x in its own list values[start : start + size], probe for probe."""
    low = np.zeros(len(x), np.int64)
    step = 1 << max(int(sizes.max(initial=0)).bit_length() - 1, 0)
    while step and len(values):
        inside = low + step <= sizes
        place = np.where(inside, starts + low + step - 1, 0)
        low[inside & (values[place] <= x)] += step
        step >>= 1
    return low


def joined(values: Column, sep: str = " ") -> Column:
    """A list as text; an empty or missing list is the empty string."""
    return F.coalesce(F.array_join(values.cast("array<string>"), sep), F.lit(""))


def pad(values: Column, width: int | Column, fill: int = 0) -> Column:
    """Right-pad a list to `width`. A longer list is an error, never cut."""
    missing = (F.lit(width) - F.size(values)).cast("int")
    return F.when(
        missing >= 0, F.concat(values, F.array_repeat(F.lit(fill).cast("bigint"), F.greatest(missing, F.lit(0))))
    ).otherwise(F.raise_error(F.concat(F.lit("list longer than the padded width: "), F.size(values).cast("string"))))


def one_hot(position: Column, width: int) -> Column:
    """Dense 0/1 array of `width` with a one at `position`."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == position).cast("int"))


def parse_array(text: Column, element: str = "int") -> Column:
    """`[1 2 3]` or `[ 1 2 3 ]` as an array of numbers; an empty pair of brackets is an empty array."""
    body = F.trim(F.regexp_replace(text, r"[\[\]]", " "))
    return F.when(body == "", F.array().cast(f"array<{element}>")).otherwise(
        F.transform(F.split(body, r"\s+"), lambda t: t.cast(element))
    )


def bracketed(values: Column) -> Column:
    """The text form read by `parse_array`."""
    return F.concat(F.lit("["), joined(values), F.lit("]"))
