"""Every registered query: name -> function of (session, data folder)."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trolley.functions.arrays import joined
from trolley.functions import dates
from trolley.operators import (
    baskets, ctr, deepfm, dictionary, distance, evaluate, features, geo, hot, itemcf, ivf, pruned, retriever, sampling, scorer,
    sketches, skipgram, stats, vectors,
)
from trolley.operators.spread import hot_key_join
from trolley.operators.topk import head
from trolley.sources import prepared, tables, text, views
from trolley.sources.scratch import scratch_path, scratch_table, staged

QUERIES: dict = {}
HOLDOUT = dt.datetime(2024, 1, 25)
CTR_FIELDS = ["k", "user_id", "value_bucket", "weekday", "hour_of_day", "day"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: str) -> Column:
    return F.round(F.col(column), 6).alias(column)


SLOT_COLUMNS = ["order_id", "product_id", "eval_set", "order_dow", "order_hour_of_day"]


def stored_lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The lines (or some of their columns) as a stored table, for queries that read them several times."""
    lines = views.lines(spark, sf)
    return staged(lines.select(*columns) if columns else lines, "lines")


def stored_orders(spark: SparkSession, sf: str) -> DataFrame:
    return staged(views.orders(spark, sf), "orders")


# Item statistics


@query
def broad_table(spark: SparkSession, sf: str) -> DataFrame:
    return stats.broad_table(views.prior(views.lines(spark, sf)), views.products(spark, sf))


@query
def broad_table_train(spark: SparkSession, sf: str) -> DataFrame:
    return stats.broad_table(views.train(views.lines(spark, sf)), views.products(spark, sf))


@query
def all_orders(spark: SparkSession, sf: str) -> DataFrame:
    lines = views.lines(spark, sf)
    return stats.all_orders(views.orders(spark, sf), views.prior(lines), views.train(lines))


@query
def main_orders_context(spark: SparkSession, sf: str) -> DataFrame:
    return stats.main_orders_context(views.orders(spark, sf), views.prior(views.lines(spark, sf)), "prior")


@query
def item_hot_time(spark: SparkSession, sf: str) -> DataFrame:
    return stats.item_hot_time(views.prior(views.lines(spark, sf)))


@query
def item_order_index(spark: SparkSession, sf: str) -> DataFrame:
    return stats.item_order_index(views.train(views.lines(spark, sf)))


@query
def item_avg_cart_order(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.item_avg_cart_order(views.prior(views.lines(spark, sf)))
    return found.select("product_id", r6("avg_cart_order"))


@query
def popularity_probs(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.popularity(staged(views.prior(views.lines(spark, sf)).select("product_id"), "bought"), views.products(spark, sf))
    return found.select("product_id", r6("prob"))


@query
def days_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.days_stats(views.orders(spark, sf)).select(r6("mean_days"), r6("sd_days"))


@query
def basket_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.basket_stats(baskets.basket(views.prior(views.lines(spark, sf))))


# Popularity retrieval


@query
def hot_by_slot(spark: SparkSession, sf: str) -> DataFrame:
    return hot.by_slot(views.prior(views.lines(spark, sf)))


@query
def hot_recall(spark: SparkSession, sf: str) -> DataFrame:
    lines = stored_lines(spark, sf, *SLOT_COLUMNS)
    return hot.recall(views.train(lines), hot.by_slot(views.prior(lines)))


@query
def hot_recall_metric(spark: SparkSession, sf: str) -> DataFrame:
    lines = stored_lines(spark, sf, *SLOT_COLUMNS)
    found = hot.metric(views.train(lines), hot.by_slot(views.prior(lines)))
    return found.select("tp", "p", r6("recall"))


# Item-to-item retrieval


@query
def item_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = itemcf.pairs(staged(views.prior(views.lines(spark, sf)), "lines"), reorder_weight=1)
    return found.select("product_id1", "product_id2", r6("pair_weight"))


@query
def itemcf_sim(spark: SparkSession, sf: str) -> DataFrame:
    found = itemcf.similarity(staged(views.prior(views.lines(spark, sf)), "lines"), reorder_weight=1)
    return found.select("product_id", "sim_product_id", "sim", "rank")


@query
def itemcf_sim_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """`itemcf_sim` with baskets of more than three items visited only where they can change a list."""
    lines = staged(views.prior(views.lines(spark, sf)), "lines")
    found = pruned.similarity(lines, reorder_weight=1, split_above=3, block_items=256)
    return found.select("product_id", "sim_product_id", "sim", "rank")


@query
def user_triggers(spark: SparkSession, sf: str) -> DataFrame:
    return itemcf.triggers(views.prior(views.lines(spark, sf)))


@query
def user_triggers_by_times(spark: SparkSession, sf: str) -> DataFrame:
    return itemcf.triggers(views.prior(views.lines(spark, sf)), order_by="times")


def _itemcf(spark: SparkSession, sf: str, **options):
    lines = stored_lines(spark, sf)
    history, targets = views.prior(lines), views.train(lines)
    starts = staged(itemcf.triggers(history), "triggers")
    sim = staged(itemcf.similarity(history, reorder_weight=1), "item_sim")
    found = itemcf.recall(targets, starts, sim, **options)
    return found, targets, starts


@query
def itemcf_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _itemcf(spark, sf)[0].select("order_id", "product_id", "score")


@query
def itemcf_recall_merged(spark: SparkSession, sf: str) -> DataFrame:
    found = _itemcf(spark, sf, merge="sum", top_n=20)[0]
    return found.select("order_id", "product_id", F.round("score", 9).alias("score"), "rank")


@query
def itemcf_metric(spark: SparkSession, sf: str) -> DataFrame:
    found, targets, starts = _itemcf(spark, sf)
    sums = evaluate.micro_recall(found, targets, itemcf.covered_orders(targets, starts))
    return sums.select("tp", "p", "recalled", "orders", r6("recall"))


# Item embeddings


@query
def basket_sequences(spark: SparkSession, sf: str) -> DataFrame:
    found = baskets.sequences(views.prior(views.lines(spark, sf)))
    return found.select("order_id", joined(F.col("seq")).alias("seq"))


@query
def basket_sequences_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    found = baskets.sequences(views.prior(views.lines(spark, sf)), shuffles=2)
    return found.select("order_id", "copy", joined(F.col("seq")).alias("seq"))


@query
def item2vec_recall(spark: SparkSession, sf: str) -> DataFrame:
    lines = stored_lines(spark, sf)
    history, targets = views.prior(lines), views.train(lines)
    fitted = vectors.fit_item_vectors(baskets.sequences(history))
    near = vectors.neighbors(fitted).select(
        F.col("item_id").alias("product_id"), F.col("neighbor_id").alias("sim_product_id"), "sim"
    )
    found = itemcf.recall(targets, staged(itemcf.triggers(history), "triggers"), staged(near, "near"))
    return found.select("order_id", "product_id", r6("score"))


@query
def item2vec_blocks_recall(spark: SparkSession, sf: str) -> DataFrame:
    """`item2vec_recall` with vectors trained in blocks and neighbours searched through an inverted file."""
    lines = stored_lines(spark, sf)
    history, targets = views.prior(lines), views.train(lines)
    fitted = skipgram.fit_item_vectors(baskets.sequences(history), "order_id", dim=64)
    near = ivf.neighbors(fitted).select(
        F.col("item_id").alias("product_id"), F.col("neighbor_id").alias("sim_product_id"), "sim"
    )
    found = itemcf.recall(targets, staged(itemcf.triggers(history), "triggers"), staged(near, "near"))
    return found.select("order_id", "product_id", r6("score"))


@query
def vector_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    found = vectors.neighbors(views.item_vectors(spark, sf))
    return found.select(F.col("item_id").alias("vec_id"), "neighbor_id", r6("sim"), "rank")


@query
def vector_neighbors_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """The exact list through an inverted file, cells left out by their bounds."""
    found = ivf.neighbors(views.item_vectors(spark, sf), probes="all")
    return found.select(F.col("item_id").alias("vec_id"), "neighbor_id", r6("sim"), "rank")


@query
def pooled_recall_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """`pooled_recall` without probabilities, through an inverted file."""
    history, _ = _eval_history(spark, sf)
    items = staged(views.item_vectors(spark, sf).select("item_id", "vector"), "catalogue")
    queries = staged(vectors.pooled(history, items, "order_id").withColumnRenamed("order_id", "query_id"), "pooled")
    found = ivf.search(queries, ivf.build(items), 10, probes="all")
    return found.select(F.col("query_id").alias("order_id"), F.col("item_id").alias("vec_id"), r6("score"), "rank")


@query
def pooled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    items = views.item_vectors(spark, sf)
    groups = items.select("label", F.col("item_id").alias("product_id"))
    means = vectors.pooled(groups, items, "label")
    return means.select("label", F.posexplode("vector").alias("dim", "mean_value")).select(
        "label", "dim", r6("mean_value")
    )


def _eval_history(spark: SparkSession, sf: str):
    lines = stored_lines(spark, sf, "order_id", "product_id", "eval_set", "add_to_cart_order")
    targets = baskets.next_basket(stored_orders(spark, sf), views.prior(lines), views.train(lines), "train")
    return targets.select("order_id", F.explode("last_basket").alias("product_id")), views.train(lines)


@query
def pooled_recall(spark: SparkSession, sf: str) -> DataFrame:
    history, _ = _eval_history(spark, sf)
    found = vectors.pooled_recall(history, views.item_vectors(spark, sf))
    return found.select("order_id", F.col("item_id").alias("vec_id"), r6("prob"), "rank")


@query
def pooled_recall_metric(spark: SparkSession, sf: str) -> DataFrame:
    history, truth = _eval_history(spark, sf)
    found = vectors.pooled_recall(history, views.item_vectors(spark, sf), n=20)
    scored = found.select("order_id", F.col("item_id").alias("product_id"), "score")
    sums = evaluate.recall_at(scored, truth, 10)
    return sums.select("tp", "p", "recalled", "orders", r6("recall"))


# Order features and the neural retriever's input


@query
def order_features(spark: SparkSession, sf: str) -> DataFrame:
    found = baskets.order_features(stored_orders(spark, sf), stored_lines(spark, sf))
    return baskets.as_text(found, "hist", "hist_reordered", "basket")


@query
def order_negatives(spark: SparkSession, sf: str) -> DataFrame:
    found = sampling.distinct_negatives(views.lines(spark, sf), views.products(spark, sf))
    return baskets.as_text(found, "negatives")


@query
def uniform_negatives(spark: SparkSession, sf: str) -> DataFrame:
    lines = views.prior(views.lines(spark, sf))
    return baskets.as_text(sampling.uniform_negatives(lines, views.products(spark, sf)), "candidates", "labels")


@query
def popularity_negatives(spark: SparkSession, sf: str) -> DataFrame:
    lines = staged(views.prior(views.lines(spark, sf)).select("order_id", "product_id"), "lines")
    return baskets.as_text(sampling.popularity_negatives(lines, lines), "candidates", "labels")


def _chained(orders: DataFrame, lines: DataFrame, eval_set: str) -> DataFrame:
    return baskets.next_basket(orders, views.prior(lines), views.train(lines), eval_set)


def _chain_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return stored_orders(spark, sf), stored_lines(spark, sf, "order_id", "product_id", "eval_set", "add_to_cart_order")


@query
def prev_basket(spark: SparkSession, sf: str) -> DataFrame:
    found = _chained(*_chain_tables(spark, sf), "prior").select("order_id", "user_id", "last_order_id", "last_basket", "basket")
    return baskets.as_text(found, "last_basket", "basket")


@query
def prev_basket_eval(spark: SparkSession, sf: str) -> DataFrame:
    found = _chained(*_chain_tables(spark, sf), "train").select("order_id", "user_id", "last_order_id", "last_basket", "basket")
    return baskets.as_text(found, "last_basket", "basket")


def _prior_days(orders: DataFrame) -> DataFrame:
    return stats.days_stats(orders.filter(F.col("eval_set") == "prior"))


@query
def next_basket_train(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = _chain_tables(spark, sf)

    def candidates(context: DataFrame) -> DataFrame:
        return sampling.uniform_negatives(views.prior(lines), views.products(spark, sf), context=context)

    chained = staged(_chained(orders, lines, "prior"), "chained")  # measured for its width, then read
    rows = features.training_rows(chained, candidates, _prior_days(orders))
    return baskets.as_text(rows.withColumn("days_z", r6("days_z")), "hist_padded", "candidates", "labels")


@query
def next_basket_eval(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = _chain_tables(spark, sf)
    rows = features.eval_rows(_chained(orders, lines, "train"), _prior_days(orders))
    return rows.withColumn("days_z", r6("days_z"))


@query
def prepared_train(spark: SparkSession, sf: str) -> DataFrame:
    """`next_basket_train` from two prepared tables, bucketed by order, that are kept and read back."""
    orders, lines = _chain_tables(spark, sf)
    found = sampling.uniform_negatives(views.prior(lines), views.products(spark, sf))
    chained = staged(_chained(orders, lines, "prior"), "chained")
    rows = features.padded_history(features.with_context_features(chained, _prior_days(orders)))
    contexts = rows.select("order_id", "dow_idx", "hod_idx", "days_z", "hist_len", "hist_padded")
    sides = []
    for name, side in (("contexts", contexts), ("candidates", found)):
        path = scratch_path(spark, name)
        table = scratch_table(f"trolley_{name}_" + path.rsplit("-", 1)[1])
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        prepared.kept(side, table, "order_id", buckets, sf, path)
        sides.append(prepared.kept(side, table, "order_id", buckets, sf, path))  # read back, not written again
    joined_rows = sides[0].join(sides[1], "order_id").withColumn("days_z", r6("days_z"))
    return baskets.as_text(joined_rows, "hist_padded", "candidates", "labels")


@query
def eval_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first 1,000 rows of the evaluation set, by order and item."""
    return head(next_basket_eval(spark, sf), [F.col("order_id"), F.col("product_id")], 1000)


@query
def slot_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return features.slot_one_hot(views.orders(spark, sf))


def _pair_scorer(spark: SparkSession, sf: str, dim: int = 16):
    lines = stored_lines(spark, sf)
    orders = stored_orders(spark, sf)
    history, held_out = views.prior(lines), views.train(lines)
    products = views.products(spark, sf)
    items = vectors.fit_item_vectors(baskets.sequences(history), dim=dim)
    items = staged(vectors.with_group_vectors(items, products), "item_vectors")
    days = _prior_days(orders)
    past = staged(features.with_context_features(baskets.next_basket(orders, history, held_out, "prior"), days), "past")
    candidates = staged(sampling.uniform_negatives(history, products), "candidates")
    model = scorer.fit_cells(staged(scorer.pair_cells(past, candidates, items), "pair_cells"), 3 * dim)
    target = features.with_context_features(baskets.next_basket(orders, history, held_out, "train"), days)
    return scorer.recall(model, target, items), held_out


@query
def pair_scorer_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _pair_scorer(spark, sf)[0].withColumn("score", r6("score"))


@query
def pair_scorer_metric(spark: SparkSession, sf: str) -> DataFrame:
    found, truth = _pair_scorer(spark, sf)
    return evaluate.recall_at(found, truth, 10).select("tp", "p", r6("recall"))


def _retriever_tables(spark: SparkSession, sf: str):
    """Prior lines, prior orders and held-out orders with their last baskets and context, held-out lines."""
    orders, lines = _chain_tables(spark, sf)
    days = _prior_days(orders)
    past, target = (
        staged(features.with_context_features(_chained(orders, lines, part), days), part) for part in ("prior", "train")
    )
    return views.prior(lines), past, target, views.train(lines)


def _retriever(spark: SparkSession, sf: str, dim: int = 64):
    history, past, target, truth = _retriever_tables(spark, sf)
    items = vectors.fit_item_vectors(baskets.sequences(history), dim=dim)
    items = vectors.normalised(vectors.with_group_vectors(staged(items, "items"), views.products(spark, sf)))
    items = staged(retriever.with_shares(items, history), "items")
    bought = past.select("order_id", F.explode("basket").alias("product_id"))
    blocks = retriever.training_blocks(bought, retriever.inputs(past, items), items, history)
    model = retriever.fit(blocks, 3 * dim)
    return retriever.recall(model, retriever.inputs(target, items), items), truth


@query
def retriever_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best items of each held-out order by the retriever trained with a sampled softmax."""
    found = _retriever(spark, sf)[0]
    return found.select("order_id", "product_id", r6("score"), r6("prob"), "rank")


@query
def retriever_metric(spark: SparkSession, sf: str) -> DataFrame:
    found, truth = _retriever(spark, sf)
    return evaluate.recall_at(found, truth, 10).select("tp", "p", r6("recall"))


@query
def retriever_top_text(spark: SparkSession, sf: str) -> DataFrame:
    """The lists of `retriever_fixed` in the recall list's text form, written and read back."""
    path = scratch_path(spark, "retriever-list")
    found = retriever_fixed(spark, sf).select("order_id", F.col("vec_id").alias("product_id"), F.round("score", 3).alias("score"))
    text.save_recall_list(found, path)
    return text.long_form(text.read_recall_list(spark, path))


def _fixed_tower(dim: int, hidden: int = 16) -> retriever.Tower:
    """Weights from a rule, so that SQL can repeat them."""
    shape = retriever.Tower.shape(dim, hidden)
    flat = np.zeros(shape.size)
    p = shape.views(flat)
    p["A"][:] = np.sin(np.arange(p["A"].size).reshape(p["A"].shape)) / 4
    p["a"][:] = np.cos(np.arange(hidden)) / 10
    p["B"][:] = np.cos(np.arange(p["B"].size).reshape(p["B"].shape)) / 4
    p["b"][:] = np.sin(np.arange(dim)) / 10
    p["popularity"][:] = 0.5
    return retriever.Tower(dim, shape, flat)


@query
def retriever_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Scoring by given weights over the stored vectors."""
    history, _, target, _ = _retriever_tables(spark, sf)
    known = views.item_vectors(spark, sf)
    items = staged(retriever.with_shares(known, history), "items")
    found = retriever.recall(_fixed_tower(64), retriever.inputs(target, items), items)
    return found.select("order_id", F.col("product_id").alias("vec_id"), r6("score"), r6("prob"), "rank")


# Click prediction


@query
def ctr_time_features(spark: SparkSession, sf: str) -> DataFrame:
    found = ctr.time_features(views.clicks(spark, sf).select("event_id", "hour"))
    return found.select("event_id", "year", "month_b", "day_b", "hour_b", "day", F.col("hour_of_day").alias("hour"), "weekday")


@query
def ctr_column_profile(spark: SparkSession, sf: str) -> DataFrame:
    log = ctr.time_features(views.clicks(spark, sf))
    return ctr.column_profile(log, ctr.feature_columns(log, ["event_id", "click", "hour", "at", "value"]))


def _fitted_rows(log: DataFrame) -> DataFrame:
    return log.filter(F.col("at") < F.lit(HOLDOUT).cast("timestamp_ntz"))


@query
def ctr_label_encoded(spark: SparkSession, sf: str) -> DataFrame:
    log = views.clicks(spark, sf)
    return ctr.label_codes(log, CTR_FIELDS, fit=_fitted_rows(log)).select("event_id", *CTR_FIELDS)


@query
def ctr_label_encoded_all(spark: SparkSession, sf: str) -> DataFrame:
    log = views.clicks(spark, sf)
    return ctr.label_codes(log, CTR_FIELDS).select("event_id", *CTR_FIELDS)


@query
def ctr_first_seen_encoded(spark: SparkSession, sf: str) -> DataFrame:
    log = views.clicks(spark, sf)
    return hot_key_join(log, ctr.first_seen_codes(log, "user_id", "at"), "user_id").select("event_id", "code")


@query
def ctr_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the fields' vocabularies and the largest."""
    counted = [c for c in CTR_FIELDS if c not in ctr.CALENDAR_SIZES]
    return ctr.vocabulary(views.clicks(spark, sf), counted, ctr.CALENDAR_SIZES)


@query
def ctr_incremental_encoded(spark: SparkSession, sf: str) -> DataFrame:
    """First-seen codes from a stored dictionary that three chunks of the log extend one after the other."""
    log = views.clicks(spark, sf)
    path = scratch_path(spark, "dictionary")
    cuts = [None, dt.datetime(2024, 1, 10), HOLDOUT, None]
    for start, stop in zip(cuts, cuts[1:]):
        later = F.lit(True) if start is None else F.col("at") >= F.lit(start).cast("timestamp_ntz")
        earlier = F.lit(True) if stop is None else F.col("at") < F.lit(stop).cast("timestamp_ntz")
        known = dictionary.extend(path, log.filter(later & earlier), "user_id", "at")
    return dictionary.encode(log.select("event_id", "user_id"), known, "user_id").select("event_id", "code")


@query
def ctr_sketched_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Exact distinct counts, and whether the estimate from daily sketches keeps its error bound."""
    log = ctr.time_features(views.clicks(spark, sf)).withColumn("date", F.to_date("at"))
    fields = ctr.feature_columns(log, ["event_id", "click", "hour", "at", "value", "date"])
    days = staged(sketches.daily(log, "date", fields), "sketches")
    rough = sketches.estimates(days, fields).select("column", F.col("n_distinct").alias("rough"))
    exact = ctr.column_profile(log, fields).select("column", "n_distinct")
    off = F.abs(F.col("rough") - F.col("n_distinct"))
    within = (off <= F.ceil(F.col("n_distinct") * sketches.error_bound())).cast("int")
    return exact.join(rough, "column").select("column", "n_distinct", within.alias("within_bound"))


def _small_fields(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """The click log with calendar parts, and its fields (ids apart) of more than one and fewer than FEW values."""
    log = ctr.time_features(views.clicks(spark, sf))
    fields = ctr.feature_columns(log, ["event_id", "user_id", "click", "hour", "at", "value"])
    chosen = ctr.select_columns(log, fields, above=1, below=ctr.FEW)
    return log.select("event_id", "click", *chosen), chosen


@query
def ctr_dummies(spark: SparkSession, sf: str) -> DataFrame:
    return ctr.dummies(*_small_fields(spark, sf))


@query
def ctr_sampled(spark: SparkSession, sf: str) -> DataFrame:
    return ctr.sampled(views.clicks(spark, sf), "event_id", "click").select("event_id", "click", "part")


@query
def ctr_small_sample(spark: SparkSession, sf: str) -> DataFrame:
    log, chosen = _small_fields(spark, sf)
    return ctr.prepare(log, "event_id", chosen)


def _ctr_sets(spark: SparkSession, sf: str, validation: bool = False):
    """Encoded training and test rows; with `validation`, also the rows marked for choosing a model."""
    log = views.clicks(spark, sf)
    fields = ctr.select_columns(log, CTR_FIELDS, above=1, below=ctr.MANY)
    seen = ctr.sampled(_fitted_rows(log), "event_id", "click")
    encoder = ctr.fit_encoder(seen, fields)
    kept = ["event_id", "click", "features"]
    train = staged(encoder.transform(seen.filter(F.col("part") == "train")).select(*kept), "ctr-train")
    test = encoder.transform(log.filter(F.col("at") >= F.lit(HOLDOUT).cast("timestamp_ntz"))).select(*kept)
    if not validation:
        return train, test
    return train, test, staged(encoder.transform(seen.filter(F.col("part") == "valid")).select(*kept), "ctr-valid")


def _ctr_result(name: str, scored: DataFrame) -> DataFrame:
    return evaluate.auc(staged(scored, "scores"), "click", "score").select(F.lit(name).alias("model"), r6("auc"))


@query
def ctr_lr(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _ctr_sets(spark, sf)
    return _ctr_result("lr", ctr.scores(ctr.fit_lr(train), test))


@query
def ctr_lr_grid(spark: SparkSession, sf: str) -> DataFrame:
    train, test, valid = _ctr_sets(spark, sf, validation=True)
    return _ctr_result("lr_grid", ctr.scores(ctr.fit_lr(train, grid=ctr.C_GRID, valid=valid), test))


@query
def ctr_fm(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _ctr_sets(spark, sf)
    return _ctr_result("fm", ctr.scores(ctr.fit_fm(train), test))


@query
def ctr_mlp(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _ctr_sets(spark, sf)
    return _ctr_result("mlp", ctr.scores(ctr.fit_mlp(train), test))


@query
def ctr_fm_mlp(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _ctr_sets(spark, sf)
    pair = [ctr.scores(fit(train), test, "event_id", "click") for fit in (ctr.fit_fm, ctr.fit_mlp)]
    return _ctr_result("fm_mlp", ctr.blended(*pair, "event_id"))


def _coded_log(spark: SparkSession, sf: str, fields: list[str] | None = None):
    """The click log with fields as codes, their sizes (one code for unknown values), and the fitted rows' draw."""
    log = views.clicks(spark, sf)
    seen = ctr.sampled(_fitted_rows(log), "event_id", "click") if fields is None else _fitted_rows(log)
    fields = fields or ctr.select_columns(log, CTR_FIELDS, above=1, below=ctr.MANY)
    known = {r["column"]: r["n_distinct"] for r in ctr.column_profile(seen, fields).collect()}
    coded = ctr.label_codes(log, fields, fit=seen).select("event_id", "click", "at", *fields)
    return staged(coded, "coded"), fields, [known[c] + 1 for c in fields]


@query
def ctr_deepfm(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out AUC of the deep factorisation machine: one model, one loss, shared embeddings."""
    coded, fields, sizes = _coded_log(spark, sf)
    train = ctr.sampled(_fitted_rows(coded), "event_id", "click").filter(F.col("part") == "train")
    model = deepfm.fit(deepfm.coded(train, fields, "click", "event_id"), sizes, "event_id")
    test = coded.filter(F.col("at") >= F.lit(HOLDOUT).cast("timestamp_ntz"))
    scored = deepfm.scores(model, deepfm.coded(test, fields, "click", "click"), "click")
    return _ctr_result("deepfm", scored)


def _fixed_weights(spark: SparkSession, fields: list[str], sizes: list[int], step: int) -> DataFrame:
    """Weights from a rule, so that SQL can repeat them: one row a field and code."""
    known = [F.struct(F.lit(c).alias("field"), F.lit(i).alias("f"), F.lit(n).alias("n")) for i, (c, n) in enumerate(zip(fields, sizes))]
    rows = spark.range(1).select(F.inline(F.array(*known))).select("field", "f", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("code"))
    return rows.select("field", "code", (F.sin((F.col("f") * 100 + F.col("code")) * step) / 4).alias("weight"))


@query
def ctr_lr_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """A logistic model with given weights over the whole log."""
    coded, fields, sizes = _coded_log(spark, sf, CTR_FIELDS)
    weights = staged(_fixed_weights(spark, fields, sizes, 1), "weights")
    return ctr.weighted_scores(coded, fields, weights, -0.5, "event_id").select("event_id", r6("score"))


@query
def ctr_choice_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Three given models by their area on the marked part of the sampled log, and the one that is chosen."""
    coded, fields, sizes = _coded_log(spark, sf, CTR_FIELDS)
    valid = staged(ctr.sampled(_fitted_rows(coded), "event_id", "click").filter("part = 'valid'"), "valid")
    found = []
    for step in (1, 2, 3):
        weights = staged(_fixed_weights(spark, fields, sizes, step), "weights")
        scored = ctr.weighted_scores(valid, fields, weights, -0.5, "click").withColumn("score", F.round("score", 9))
        found.append(evaluate.auc(staged(scored, "scores"), "click", "score").select(F.lit(step).alias("model"), r6("auc")))
    areas = staged(found[0].unionByName(found[1]).unionByName(found[2]), "areas")
    best = areas.agg(F.max(F.struct("auc", -F.col("model"))).alias("b")).select(-F.col("b.col2")).scalar()
    return areas.withColumn("chosen", (F.col("model") == best).cast("int"))


def _fixed_deepfm(sizes: list[int], hidden: tuple[int, int] = (16, 8)) -> deepfm.DeepFM:
    """Weights from a rule, so that SQL can repeat them."""
    model = deepfm.begun(sizes, hidden=hidden)
    p = model.layout.views(model.flat)
    place = np.concatenate([100 * f + np.arange(n) for f, n in enumerate(sizes)])
    p["bias"][:] = -0.1
    p["linear"][:] = np.sin(place) / 4
    p["embedding"][:] = np.sin(place[:, None] + 10 * np.arange(deepfm.FACTORS)) / 4
    for i, n in enumerate(hidden):
        p[f"w{i}"][:] = np.sin(np.arange(p[f"w{i}"].size).reshape(p[f"w{i}"].shape)) / 4
        p[f"b{i}"][:] = np.cos(np.arange(n)) / 10
    p["out"][:] = np.sin(np.arange(hidden[-1])) / 2
    return model


@query
def ctr_deepfm_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """The deep factorisation machine's forward pass with given weights, over the whole log."""
    coded, fields, sizes = _coded_log(spark, sf, CTR_FIELDS)
    rows = deepfm.coded(coded, fields, "click", "event_id")
    return deepfm.scores(_fixed_deepfm(sizes), rows, "event_id").select("event_id", r6("score"))


@query
def auc_exact(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.auc(views.clicks(spark, sf), "click", "value").select(r6("auc"))


@query
def auc_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """The area from counts a score range, and the error it can have."""
    return evaluate.auc_bounds(views.clicks(spark, sf), "click", "value").select(r6("auc"), r6("error"))


# Sinks


def _hot_scores(spark: SparkSession, sf: str) -> DataFrame:
    return hot_recall(spark, sf).select("order_id", "product_id", F.col("cnt").cast("double").alias("score"))


@query
def recall_list_text(spark: SparkSession, sf: str) -> DataFrame:
    return text.recall_lines(_hot_scores(spark, sf))


@query
def recall_list_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "recall-list")
    text.save_recall_list(_hot_scores(spark, sf), path)
    return text.long_form(text.read_recall_list(spark, path))


@query
def order_lists_text(spark: SparkSession, sf: str) -> DataFrame:
    lines = stored_lines(spark, sf)
    found = baskets.order_features(stored_orders(spark, sf), lines)
    negatives = sampling.distinct_negatives(lines, views.products(spark, sf), context=found)
    sampled = negatives.withColumn("sampled", F.concat(F.array("product_id"), F.col("negatives")))
    return text.order_lines(sampled, "sampled")


@query
def csv_array_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv-arrays")
    text.save_csv_with_arrays(baskets.basket(views.lines(spark, sf)), path, ["items"])
    back = text.load_csv_with_arrays(spark, path, "order_id bigint, items string", {"items": "bigint"})
    return back.select("order_id", F.posexplode("items").alias("pos", "product_id"))


def _day_table(spark: SparkSession, sf: str, rows: dict) -> tuple[str, str]:
    path = scratch_path(spark, "days")
    name = scratch_table("trolley_" + path.rsplit("-", 1)[1])
    for day, df in rows.items():
        tables.write_partition(df, name, day, location=path)
    return name, path


@query
def partition_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    orders = views.orders(spark, sf)
    name, path = _day_table(spark, sf, {"2024-01-01": orders, "2024-01-02": orders})
    tables.write_partition(orders.filter(F.col("eval_set") == "train"), name, "2024-01-02")
    return spark.table(name).groupBy("dt").agg(F.count(F.lit(1)).alias("rows"))


@query
def partition_expire(spark: SparkSession, sf: str) -> DataFrame:
    orders = views.orders(spark, sf)
    name, path = _day_table(spark, sf, {"2024-01-01": orders, "2024-01-02": orders})
    held_out = orders.filter(F.col("eval_set") == "train")
    tables.write_partition(held_out, name, "2024-01-03", old_partition="2024-01-01")
    return spark.table(name).groupBy("dt").agg(F.count(F.lit(1)).alias("rows"))


@query
def shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.lines(spark, sf).select("order_id", "product_id", "add_to_cart_order", "reordered")
    written = tables.write_shards(rows, scratch_path(spark, "shards"), ["order_id", "product_id"])
    return written.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))


@query
def kv_export(spark: SparkSession, sf: str) -> DataFrame:
    lists = staged(text.recall_lines(_hot_scores(spark, sf)), "lists")
    return tables.kv_export(lists, "order_id", "line", prefix="HotSlot_", ttl_s=1_296_000, min_rows=100)


# Dates and places


@query
def date_keys(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("at"))
    day = F.to_date("at")
    start, stop = dt.date(1997, 1, 1), dt.date(1997, 12, 31)
    return raw.select(
        "order_id",
        dates.date_key(day).alias("day"),
        F.date_format(dates.days_before(day, 7), "yyyy-MM-dd").alias("day_minus_n"),
        dates.date_key(dates.days_before(day, 7)).alias("key_minus_n"),
        dates.inside(F.col("at"), start, stop).cast("int").alias("in_window"),
        dates.epoch_start(day).alias("epoch_start"),
    )


@query
def date_window(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("at"))
    inside = dates.in_window(raw, "at", dt.date(1997, 1, 1), dt.date(1997, 12, 31))
    return inside.groupBy(dates.date_key(F.col("at")).alias("day")).agg(F.count(F.lit(1)).alias("orders"))


def _both(spark: SparkSession, sf: str) -> DataFrame:
    customers = views.points(spark, sf, "customer", "c_custkey")
    return customers.unionByName(views.points(spark, sf, "supplier", "s_suppkey"))


@query
def geo_cells(spark: SparkSession, sf: str) -> DataFrame:
    found = geo.cell_counts(_both(spark, sf), precision=5)
    return found.select("cell", "n_points", r6("center_lat"), r6("center_lng"))


@query
def geo_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    cells = geo.with_cell(_both(spark, sf), 5).select("x", "y").distinct()
    return geo.neighbours(cells, 5)


@query
def geo_proximity_join(spark: SparkSession, sf: str) -> DataFrame:
    customers = views.points(spark, sf, "customer", "c_custkey")
    suppliers = views.points(spark, sf, "supplier", "s_suppkey")
    return geo.proximity_join(customers, suppliers, precision=2).withColumnRenamed("id", "c_custkey")


@query
def geo_within_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers within 1,500 km of each customer, by great-circle distance."""
    customers = views.points(spark, sf, "customer", "c_custkey")
    suppliers = views.points(spark, sf, "supplier", "s_suppkey")
    return distance.within_distance(customers, suppliers, 1500.0).withColumnRenamed("id", "c_custkey")


@query
def geo_cell_hot(spark: SparkSession, sf: str) -> DataFrame:
    purchases = views.prior(views.lines(spark, sf)).select("user_id", "product_id")
    return geo.cell_hot(views.points(spark, sf, "customer", "c_custkey"), purchases, precision=2)
