"""Popularity retrieval by weekday and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trolley.operators.topk import top_k

SLOT = ["order_dow", "order_hour_of_day"]
# 7 weekdays x 24 hours: with the list length this bounds the slot table, so it may be broadcast.
SLOTS = 7 * 24
BROADCAST_ROWS = 1_000_000


def by_slot(context: DataFrame, k: int = 20) -> DataFrame:
    """The k products bought most in each weekday and hour."""
    counts = context.groupBy(*SLOT, "product_id").agg(F.count(F.lit(1)).alias("cnt"))
    return top_k(counts, SLOT, [F.col("cnt").desc(), F.col("product_id").asc()], k)


def _small(hot: DataFrame, k: int) -> DataFrame:
    return F.broadcast(hot) if SLOTS * k <= BROADCAST_ROWS else hot


def recall(targets: DataFrame, hot: DataFrame, k: int = 20) -> DataFrame:
    """The slot's list for every target order."""
    asked = targets.select("order_id", *SLOT).distinct()
    return asked.join(_small(hot, k), SLOT).select("order_id", "product_id", "cnt", "rank")


def metric(truth: DataFrame, hot: DataFrame, k: int = 20) -> DataFrame:
    """Hits, bought products and recall over the orders whose slot has a list.

    Each bought product is looked up in the slot's list, so no list is copied to the orders.
    """
    listed = _small(hot.select(*SLOT, "product_id", F.lit(1).alias("hit")), k)
    covered = _small(hot.select(*SLOT).distinct(), k)
    return (
        truth.select(*SLOT, "product_id")
        .join(covered, SLOT, "left_semi")
        .join(listed, [*SLOT, "product_id"], "left")
        .agg(F.count("hit").alias("tp"), F.count(F.lit(1)).alias("p"))
        .select("tp", "p", F.try_divide(F.col("tp").cast("double"), F.col("p").cast("double")).alias("recall"))
    )
