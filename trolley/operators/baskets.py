"""Baskets, purchase history and order features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from trolley.functions.arrays import joined
from trolley.functions.draws import draw
from trolley.operators.spread import running_total
from trolley.operators.topk import top_k

# A running total over a user's orders is split every so many orders.
ORDERS_PER_RANGE = 1024


def basket(lines: DataFrame) -> DataFrame:
    """One row an order: its products in cart order. A basket is at most the catalogue long."""
    cart = F.sort_array(F.collect_list(F.struct("add_to_cart_order", "product_id")))
    return lines.groupBy("order_id").agg(F.transform(cart, lambda c: c["product_id"]).alias("items"))


def sequences(lines: DataFrame, shuffles: int = 0) -> DataFrame:
    """Baskets in cart order (copy 0) and in `shuffles` reproducible random orders."""
    first = basket(lines).select("order_id", F.lit(0).alias("copy"), F.col("items").alias("seq"))
    if shuffles == 0:
        return first

    def shuffled(order_id, copy, items):
        keyed = F.transform(items, lambda p: F.struct(draw("shuf", copy, order_id, p).alias("u"), p.alias("p")))
        return F.transform(F.sort_array(keyed), lambda s: s["p"])

    copies = basket(lines).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(shuffles))))
    seq = F.when(F.col("copy") == 0, F.col("items")).otherwise(shuffled(F.col("order_id"), F.col("copy"), F.col("items")))
    return copies.select("order_id", "copy", seq.alias("seq"))


def _line_counts(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders with how many of the user's lines came before them."""
    counts = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_lines"))
    sized = orders.select("order_id", "user_id", "order_number").join(counts, "order_id", "left")
    sized = sized.withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    return running_total(
        sized,
        ["user_id"],
        F.floor(F.col("order_number") / ORDERS_PER_RANGE),
        [F.col("order_number")],
        F.col("n_lines"),
        "lines_before",
    )


def recent_items(orders: DataFrame, lines: DataFrame, limit: int = 75, only_reordered: bool = False) -> DataFrame:
    """The last `limit` items a user bought before each order, newest first.

    A user's lines are numbered 1, 2, ... through time and cut into ranges of `limit`. The items an
    order needs lie in at most two ranges, so an order meets at most 2 * limit lines, never the
    user's whole history. Orders without earlier items are left out.
    """
    own = lines.filter(F.col("reordered") == 1) if only_reordered else lines
    placed = _line_counts(orders, own)
    in_cart = Window.partitionBy("order_id").orderBy("add_to_cart_order", "product_id")
    numbered = (
        own.select("order_id", "product_id", F.row_number().over(in_cart).alias("place"))
        .join(placed.select("order_id", "user_id", "lines_before"), "order_id")
        .select("user_id", "product_id", (F.col("lines_before") + F.col("place")).alias("nth"))
        .withColumn("range", F.floor((F.col("nth") - 1) / limit))
    )
    newest = F.col("lines_before")
    oldest = F.greatest(newest - limit + 1, F.lit(1))
    spans = F.array_distinct(F.array(F.floor((oldest - 1) / limit), F.floor((newest - 1) / limit)))
    wanted = placed.filter(newest > 0).select(
        "order_id", "user_id", newest.alias("newest"), oldest.alias("oldest"), F.explode(spans).alias("range")
    )
    met = wanted.join(numbered, ["user_id", "range"]).filter(F.col("nth").between(F.col("oldest"), F.col("newest")))
    newest_first = F.sort_array(F.collect_list(F.struct("nth", "product_id")), asc=False)
    return met.groupBy("order_id").agg(F.transform(newest_first, lambda h: h["product_id"]).alias("items"))


def order_features(
    orders: DataFrame, lines: DataFrame, hist_limit: int = 75, reorder_limit: int = 20
) -> DataFrame:
    """Slot, days, recent items, recent reordered items and the basket of every order but a user's first."""
    empty = F.array().cast("array<bigint>")
    later = orders.filter(F.col("order_number") > 1)
    hist = recent_items(orders, lines, hist_limit).withColumnRenamed("items", "hist")
    again = recent_items(orders, lines, reorder_limit, True).withColumnRenamed("items", "hist_reordered")
    own = basket(lines).withColumnRenamed("items", "basket")
    joined_up = later.join(hist, "order_id", "left").join(again, "order_id", "left").join(own, "order_id", "left")
    return joined_up.select(
        "order_id",
        "order_dow",
        F.col("order_hour_of_day").alias("order_hod"),
        "days_since_prior_order",
        F.coalesce("hist", empty).alias("hist"),
        F.coalesce("hist_reordered", empty).alias("hist_reordered"),
        F.coalesce("basket", empty).alias("basket"),
    )


def previous_orders(orders: DataFrame, earlier: DataFrame) -> DataFrame:
    """Each order with the id of the user's order before it; null when there is none.

    The key (user, order number) is unique, so a user with very many orders stays spread out.
    """
    before = earlier.select(
        "user_id", (F.col("order_number") + 1).alias("order_number"), F.col("order_id").alias("last_order_id")
    )
    return orders.join(before, ["user_id", "order_number"], "left")


def newest_orders(orders: DataFrame, n: int = 2) -> DataFrame:
    """A user's n newest orders."""
    return top_k(orders, ["user_id"], [F.col("order_number").desc(), F.col("order_id").asc()], n, "newness")


def next_basket(orders: DataFrame, prior: DataFrame, train: DataFrame, eval_set: str = "prior") -> DataFrame:
    """Orders with the basket before and their own.

    'prior' gives training rows among prior orders and drops rows with any null of the order columns;
    'train' gives the held-out orders against the user's newest orders and keeps all of them.
    """
    own = orders.filter(F.col("eval_set") == eval_set)
    if eval_set == "prior":
        chained = previous_orders(own, own).na.drop()
        truth = prior
    else:
        chained = previous_orders(own, newest_orders(orders))
        truth = train
    last = basket(prior).select(F.col("order_id").alias("last_order_id"), F.col("items").alias("last_basket"))
    this = basket(truth).select("order_id", F.col("items").alias("basket"))
    empty = F.array().cast("array<bigint>")
    return (
        chained.join(last, "last_order_id", "left")
        .join(this, "order_id", "left")
        .withColumn("last_basket", F.coalesce("last_basket", empty))
        .withColumn("basket", F.coalesce("basket", empty))
    )


def as_text(df: DataFrame, *lists: str) -> DataFrame:
    """List columns as blank-separated text."""
    return df.withColumns({c: joined(F.col(c)) for c in lists})
