"""Logical tables over the given parquet folders: orders, order lines, products, clicks, vectors, points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trolley.functions.dates import HOUR_FORMAT, hour_parts
from trolley.operators.stats import with_context


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders numbered per user; a user's last of two or more is the held-out `train` order.

    Numbering runs inside (user, month) and months are carried over, so a user with a large share of
    all orders is spread over the months of the calendar.
    """
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at")
    )
    raw = raw.withColumn("month", F.year("at") * 12 + F.month("at"))
    per_user = Window.partitionBy("user_id")
    in_turn = per_user.orderBy("month")
    months = (
        raw.groupBy("user_id", "month")
        .agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))
        .select(
            "user_id",
            "month",
            F.coalesce(F.sum("n").over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.sum("n").over(per_user).alias("user_orders"),
            F.lag("last_at").over(in_turn).alias("previous_month_at"),
        )
    )
    in_month = Window.partitionBy("user_id", "month").orderBy("at", "order_id")
    numbered = (
        raw.withColumn("in_month", F.row_number().over(in_month))
        .withColumn("previous_at", F.lag("at").over(in_month))
        .join(months, ["user_id", "month"])
        .withColumn("order_number", (F.col("before") + F.col("in_month")).cast("int"))
    )
    held_out = (F.col("order_number") == F.col("user_orders")) & (F.col("user_orders") >= 2)
    gap = F.date_diff(F.to_date("at"), F.to_date(F.coalesce("previous_at", "previous_month_at")))
    return numbered.select(
        "order_id",
        "user_id",
        F.when(held_out, "train").otherwise("prior").alias("eval_set"),
        "order_number",
        (F.dayofweek("at") - 1).alias("order_dow"),
        F.pmod("order_id", F.lit(24)).cast("int").alias("order_hour_of_day"),
        gap.cast("double").alias("days_since_prior_order"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, one a product, joined to their order: the split, the slot and the reorder flag.

    A line is a first purchase when (user, product, order number) is the pair's smallest number. That
    key is unique among lines, so even a pair bought very often is not gathered anywhere.
    """
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))
        .agg(F.min("l_linenumber").alias("line"))
    )
    in_cart = Window.partitionBy("order_id").orderBy("line", "product_id")
    carts = items.select("order_id", "product_id", F.row_number().over(in_cart).alias("add_to_cart_order"))
    known = with_context(carts, orders(spark, sf_dir))
    firsts = known.groupBy("user_id", "product_id").agg(F.min("order_number").alias("order_number"))
    firsts = firsts.withColumn("first_time", F.lit(True))
    return known.join(firsts, ["user_id", "product_id", "order_number"], "left").select(
        "order_id",
        "product_id",
        "add_to_cart_order",
        F.when(F.col("first_time") | F.col("order_number").isNull(), 0).otherwise(1).alias("reordered"),
        "user_id",
        "eval_set",
        "order_number",
        "order_dow",
        "order_hour_of_day",
        "days_since_prior_order",
    )


def prior(context: DataFrame) -> DataFrame:
    return context.filter(F.col("eval_set") == "prior")


def train(context: DataFrame) -> DataFrame:
    return context.filter(F.col("eval_set") == "train")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("aisle_id"), F.col("p_type").alias("department_id")
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click log: label, hour text and categorical fields."""
    events = table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_type") == "click").cast("int").alias("click"),
        F.date_format("ts", HOUR_FORMAT).alias("hour"),
        F.col("ts").alias("at"),
        F.col("value"),
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.floor(F.col("value") / 10).cast("int").alias("value_bucket"),
    )
    parts = hour_parts(F.col("hour"))
    return events.select(
        "*",
        parts["weekday"].alias("weekday"),
        parts["hour"].alias("hour_of_day"),
        parts["day"].alias("day"),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"), "label"
    )


def points(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Customers or suppliers as points; the tables hold no coordinates, so keys give them."""
    k = F.col(key)
    return table(spark, sf_dir, name).select(
        k.alias("id"),
        (((k * 7919) % 18000).cast("double") / 100 - 90).alias("lat"),
        (((k * 104729) % 36000).cast("double") / 100 - 180).alias("lng"),
    )
