"""Distinct counts from sketches that are kept a day and united over any days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# 2^LG_REGISTERS registers a sketch, whatever the rows. The standard error is below 1.04 / sqrt(registers).
LG_REGISTERS = 12


def error_bound(lg_registers: int = LG_REGISTERS, deviations: float = 3.0) -> float:
    """Relative error not exceeded but in about one case of 370 (three standard errors)."""
    return deviations * 1.04 / 2 ** (lg_registers / 2)


def daily(df: DataFrame, day: str, columns: Sequence[str], lg_registers: int = LG_REGISTERS) -> DataFrame:
    """One row a day: a sketch of each column's values, some kilobytes each. Nulls are not counted."""
    sketch = {c: F.hll_sketch_agg(F.col(c).cast("string"), lg_registers).alias(c) for c in columns}
    return df.groupBy(day).agg(*sketch.values())


def estimates(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct) over all given days. Sketches of one value in several days count it once."""
    united = sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit(0)).alias("n_distinct")) for c in columns])
    return united.select(F.inline(rows))
