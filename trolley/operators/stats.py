"""Item and order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trolley.operators.topk import top_k


def with_context(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines with the columns of their order; a line without an order keeps nulls."""
    return lines.join(orders, "order_id", "left")


def broad_table(context: DataFrame, products: DataFrame) -> DataFrame:
    """Lines, their order and their product's aisle and department in one row.

    No broadcast hint: the product table grows with the data, so Spark decides by its size.
    """
    return context.join(products, "product_id", "left").select(
        "order_id",
        "user_id",
        "product_id",
        "add_to_cart_order",
        "reordered",
        "order_number",
        "order_dow",
        F.col("order_hour_of_day").alias("order_hod"),
        "days_since_prior_order",
        "aisle_id",
        "department_id",
    )


def item_hot_time(context: DataFrame, k: int = 1) -> DataFrame:
    """Each product's busiest weekday and hour."""
    counts = context.groupBy("product_id", "order_dow", F.col("order_hour_of_day").alias("order_hod")).agg(
        F.count("order_id").alias("order_cnt")
    )
    order = [F.col("order_cnt").desc(), F.col("order_dow").asc(), F.col("order_hod").asc()]
    return top_k(counts, ["product_id"], order, k, "ranking").select(
        "order_cnt", "product_id", "order_dow", "order_hod", "ranking"
    )


def item_order_index(context: DataFrame) -> DataFrame:
    """Lines, buyers, reordered lines and reorder users per product.

    `reorder_uv` counts all buyers, as the reference statistic does; `reorder_uv_strict` only those
    who bought again.
    """
    again = F.when(F.col("reordered") == 1, F.col("user_id"))
    return context.groupBy("product_id").agg(
        F.count("order_id").alias("order_pv"),
        F.count_distinct("user_id").alias("order_uv"),
        F.sum("reordered").cast("bigint").alias("reorder_pv"),
        F.count_distinct("user_id").alias("reorder_uv"),
        F.count_distinct(again).alias("reorder_uv_strict"),
    )


def item_avg_cart_order(lines: DataFrame) -> DataFrame:
    return lines.groupBy("product_id").agg(F.avg("add_to_cart_order").alias("avg_cart_order"))


def all_orders(orders: DataFrame, prior: DataFrame, train: DataFrame) -> DataFrame:
    """Distinct union of the two splits, each order left-joined to its lines."""

    def branch(lines: DataFrame, split: str) -> DataFrame:
        own = lines.select("order_id", "product_id", "add_to_cart_order", "reordered")
        return (
            orders.filter(F.col("eval_set") == split)
            .join(own, "order_id", "left")
            .select("order_id", "user_id", "product_id", "order_number", "add_to_cart_order", "reordered")
        )

    return branch(prior, "prior").union(branch(train, "train")).distinct()


def main_orders_context(orders: DataFrame, lines: DataFrame, eval_set: str) -> DataFrame:
    """Slot and days of the split's orders, one row a line."""
    return (
        orders.filter(F.col("eval_set") == eval_set)
        .join(lines.select("order_id"), "order_id", "left")
        .select("order_id", "order_dow", "order_hour_of_day", "days_since_prior_order")
    )


def days_stats(orders: DataFrame) -> DataFrame:
    """Mean and sample deviation of the days since the order before; one row."""
    return orders.agg(
        F.avg("days_since_prior_order").alias("mean_days"), F.stddev_samp("days_since_prior_order").alias("sd_days")
    )


def popularity(lines: DataFrame, items: DataFrame, power: float = 0.75) -> DataFrame:
    """Smoothed purchase probability of every catalogue item, 0 when never bought."""
    counts = lines.groupBy("product_id").agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("mass"))
    total = counts.agg(F.sum("mass").alias("total")).scalar()
    share = counts.select("product_id", (F.col("mass") / total).alias("prob"))
    return (
        items.select("product_id")
        .join(share, "product_id", "left")
        .select("product_id", F.coalesce("prob", F.lit(0.0)).alias("prob"))
    )


def basket_stats(baskets: DataFrame) -> DataFrame:
    """Longest and median basket, and whether every basket has an item."""
    length = F.size("items")
    return baskets.agg(
        F.max(length).alias("max_len"),
        F.percentile(length, 0.5).alias("p50_len"),
        F.every(length > 0).alias("all_nonempty"),
    )
