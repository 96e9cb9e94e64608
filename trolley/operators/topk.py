"""Top-k per group. `row_number() <= k` lets Spark keep only k rows a group before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group in the given order, with a rank from 1.

    The order must be total within a group (end it with an id), or ties are arbitrary.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def by_score(score: str, *ids: str) -> list[Column]:
    """Descending score, compared at 9 decimals so that summation order cannot decide, then ids."""
    return [F.round(F.col(score), 9).desc(), *[F.col(i).asc() for i in ids]]


def head(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of a table in a total order: each task keeps its own n, and only these are merged."""
    return df.orderBy(*order).limit(n)
