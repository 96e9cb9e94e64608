import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.fixtures import A, B, C, D, LINES, ORDERS, items, lines, orders, rows
from trolley.functions import arrays, draws
from trolley.functions.arrays import count_at_most, joined, pad, parse_array, probe_steps
from trolley.operators import baskets, features, sampling, spread, stats
from trolley.sources.views import prior, train


@pytest.fixture()
def context(spark):
    return stats.with_context(lines(spark), orders(spark))


def lists(df, key, column):
    return {r[key]: list(r[column]) for r in df.collect()}


def test_history(spark):
    found = lists(baskets.recent_items(orders(spark), lines(spark)), "order_id", "items")
    assert found == {2: [B, A], 3: [C, A, B, A], 5: [C, B]}
    again = lists(baskets.recent_items(orders(spark), lines(spark), 20, True), "order_id", "items")
    assert again == {3: [A]}


def test_order_features(spark):
    found = baskets.as_text(baskets.order_features(orders(spark), lines(spark)), "hist", "hist_reordered", "basket")
    assert rows(found, "order_id", "hist", "hist_reordered", "basket") == [
        (2, "2 1", "", "1 3"), (3, "3 1 2 1", "1", "1 2"), (5, "3 2", "", "3 4"),
    ]


def test_history_of_a_hot_user_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(baskets, "ORDERS_PER_RANGE", 4)
    rng = random.Random(4)
    head, body, order_id = [], [], 0
    for user, n in ((1, 40), (2, 3), (3, 1)):
        for number in range(1, n + 1):
            order_id += 1
            head.append((order_id, user, number, 0, 0, "prior", None))
            for place in range(1, rng.choice([0, 1, 2, 6]) + 1):
                body.append((order_id, rng.randint(1, 50), place, rng.randint(0, 1)))
    for only, limit in ((False, 7), (True, 3)):
        want, past = {}, defaultdict(list)
        for o, user, *_ in head:
            if past[user]:
                want[o] = past[user][-limit:][::-1]
            past[user] += [p for i, p, _, flag in body if i == o and (flag or not only)]
        found = lists(
            baskets.recent_items(orders(spark, head), lines(spark, body), limit, only), "order_id", "items"
        )
        assert found == want


def test_next_basket(spark, context):
    past = baskets.next_basket(orders(spark), prior(context), train(context), "prior")
    assert rows(past, "order_id", "last_basket", "basket") == [(2, [A, B], [A, C])]
    held_out = baskets.next_basket(orders(spark), prior(context), train(context), "train")
    assert rows(held_out, "order_id", "last_basket", "basket") == [(3, [A, C], [A, B]), (5, [B, C], [C, D])]


def test_sequences(spark):
    found = baskets.sequences(lines(spark), shuffles=3)
    assert found.count() == 5 * 4
    for r in found.collect():
        basket = [p for o, p, _, _ in LINES if o == r["order_id"]]
        assert (r["seq"] == basket) if r["copy"] == 0 else (sorted(r["seq"]) == sorted(basket))


@pytest.mark.parametrize("ids", [(1, 2, 3, 4), (1, 2, 3, 4, 100, 250)])
def test_uniform_and_distinct_negatives(spark, ids):
    in_basket = defaultdict(set)
    for o, p, _, _ in LINES:
        in_basket[o].add(p)
    found = sampling.uniform_negatives(lines(spark), items(spark, ids), k=6).collect()
    assert len(found) == len(LINES)
    for r in found:
        assert len(r["candidates"]) == 7 and r["candidates"][-1] == r["product_id"]
        assert list(r["labels"]) == [0] * 6 + [1]
        assert not set(r["candidates"][:-1]) & in_basket[r["order_id"]]
        assert set(r["candidates"]) <= set(ids)
    few = sampling.distinct_negatives(lines(spark), items(spark, ids), n=3).collect()
    for r in few:
        outside = set(ids) - in_basket[r["order_id"]]
        assert len(r["negatives"]) == len(set(r["negatives"])) == min(3, len(outside))
        assert set(r["negatives"]) <= outside


def test_distinct_negatives_are_spread_evenly(spark):
    table = lines(spark, [(o, o % 10, 1, 0) for o in range(2000)])
    found = sampling.distinct_negatives(table, items(spark, range(10)), n=4)
    counts = [c for _, c in rows(found.select(F.explode("negatives").alias("p")).groupBy("p").count(), "p", "count")]
    assert len(counts) == 10 and all(abs(c - 800) < 120 for c in counts)


def test_basket_of_the_whole_catalogue_has_no_negatives(spark):
    table = lines(spark, [(1, p, p, 0) for p in (1, 2, 3, 4)])
    assert [r["candidates"] for r in sampling.uniform_negatives(table, items(spark)).collect()] == [[1], [2], [3], [4]]
    assert all(r["negatives"] == [] for r in sampling.distinct_negatives(table, items(spark)).collect())
    assert sorted(r["candidates"] for r in sampling.popularity_negatives(table, table).collect()) == [[1], [2], [3], [4]]


def test_popularity_negatives_follow_the_masses(spark):
    history = lines(spark, [(o, 1, 1, 0) for o in range(16)] + [(100 + o, 2, 1, 0) for o in range(1)] + [(0, 3, 2, 0)])
    table = lines(spark, [(o, 3, 1, 0) for o in range(400)] + [(o, 99, 2, 0) for o in range(400)])
    found = sampling.popularity_negatives(table, history, k=10)
    drawn = found.filter("product_id = 3").select(F.explode(F.slice("candidates", 1, 10)).alias("p"))
    counts = dict(rows(drawn.groupBy("p").count(), "p", "count"))
    assert set(counts) == {1, 2}
    assert counts[1] / 4000 == pytest.approx(8 / 9, abs=0.03)
    assert found.count() == 800


def test_training_rows(spark, context):
    past = baskets.next_basket(orders(spark), prior(context), train(context), "prior")
    candidates = sampling.uniform_negatives(prior(context), items(spark), k=2)
    days = stats.days_stats(orders(spark))
    found = features.training_rows(past, candidates, days, width=5).collect()
    assert len(found) == 2
    for r in found:
        assert (r["dow_idx"], r["hod_idx"], r["hist_len"]) == (6, 8, 2)
        assert r["hist_padded"] == [A + 1, B + 1, 0, 0, 0]
        assert r["days_z"] == pytest.approx(-1.0)
        assert set(r["candidates"][:2]) <= {B, D}


def test_padding_takes_the_longest_basket(spark):
    table = spark.createDataFrame([(1, list(range(200))), (2, [4])], "order_id bigint, last_basket array<bigint>")
    found = lists(features.padded_history(table), "order_id", "hist_padded")
    assert found == {1: list(range(1, 201)), 2: [5] + [0] * 199}
    short = features.padded_history(table.filter("order_id = 2")).first()
    assert len(short["hist_padded"]) == features.HISTORY_WIDTH


def test_popularity_negatives_of_a_big_basket(spark):
    table = lines(spark, [(1, p, p + 1, 0) for p in range(3000)] + [(2, p, 1, 0) for p in range(3000, 3020)])
    found = sampling.popularity_negatives(table.filter("order_id = 1"), table, k=3).collect()
    assert len(found) == 3000
    assert all(len(r["candidates"]) == 4 and min(r["candidates"][:3]) >= 3000 for r in found)


def test_array_helpers(spark):
    one = spark.range(1)
    assert one.select(pad(F.array(F.lit(3).cast("bigint")), 3).alias("v")).first()["v"] == [3, 0, 0]
    with pytest.raises(Exception, match="longer than the padded width"):
        one.select(pad(F.sequence(F.lit(1), F.lit(4)).cast("array<bigint>"), 3)).collect()
    for value in ("[1 2 3]", "[ 1 2  3 ]", "1 2 3"):
        assert one.select(parse_array(F.lit(value)).alias("v")).first()["v"] == [1, 2, 3]
    assert one.select(parse_array(F.lit("[]")).alias("v")).first()["v"] == []
    assert one.select(joined(F.lit(None).cast("array<int>")).alias("v")).first()["v"] == ""
    for size in range(0, 9):
        values = F.array(*[F.lit(2 * i) for i in range(size)]).cast("array<int>")
        for x in range(-1, 2 * size + 1):
            n = one.select(count_at_most(values, probe_steps(F.size(values)), F.lit(x)).alias("n")).first()["n"]
            assert n == sum(2 * i <= x for i in range(size))


def test_global_numbering_over_ranges(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10_000), 300)
    table = spark.createDataFrame([(i,) for i in ids], "id bigint")
    found = spread.global_running_total(table, ["id"], F.lit(1), "n", rows_per_range=20)
    assert rows(found, "id", "n") == [(i, n) for n, i in enumerate(sorted(ids))]


def test_hot_key_join(spark):
    left = spark.createDataFrame([(7, i) for i in range(3000)] + [(i, i) for i in range(20)], "k int, v int")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(0, 20, 2)] + [(7, "seven")], "k int, name string")
    for how in ("inner", "left"):
        names = ("k", "v", "name")
        found = spread.hot_key_join(left, right, "k", how).fillna("-")
        assert rows(found, *names) == rows(left.join(right, "k", how).fillna("-"), *names)


def test_draws_inside_a_task_are_those_of_the_columns(spark):
    """Positions drawn in Python equal the column draws and probes, with null keys and repeated items."""
    pairs = [(1, 7), (None, 7), (123456789012, None), (5, -3)]
    table = spark.createDataFrame(pairs, "a bigint, b bigint").withColumn("d", F.explode(F.sequence(F.lit(9), F.lit(13))))
    want = [r[0] for r in table.select(draws.draw("t", F.col("a"), F.col("b"), F.col("d"))).collect()]
    assert draws.draws("t", *zip(*pairs), [range(9, 14)] * 4).tolist() == want
    lists = [[3, 5, 9], [4, 4, 3, 8, 8], [], [7]]
    probes = spark.createDataFrame([(v, x) for v in lists for x in range(11)], "v array<bigint>, x bigint")
    counted = probes.select(arrays.count_at_most(F.col("v"), arrays.probe_steps(F.size("v")), F.col("x"))).collect()
    sizes, ends = np.array([len(v) for v in lists]), np.cumsum([len(v) for v in lists])
    own = np.repeat(np.arange(4), 11)
    found = arrays.at_most_counts(np.array(sum(lists, [])), (ends - sizes)[own], sizes[own], np.tile(np.arange(11), 4))
    assert found.tolist() == [r[0] for r in counted]


def test_drawn_lists_hold_with_repeated_lines_and_items_without_id(spark):
    table = spark.createDataFrame([(1, 2), (1, 2), (1, None), (2, 3)], "order_id bigint, product_id bigint")
    found = sampling.distinct_negatives(table, items(spark, range(40)), n=30).collect()
    assert Counter((r.order_id, r.product_id) for r in found) == Counter([(1, 2), (1, 2), (1, None), (2, 3)])
    assert all(len(set(r.negatives)) == 30 for r in found if r.order_id == 2)
    assert all(len(r.candidates) == 5 and r.labels == [0] * 4 + [1] for r in sampling.uniform_negatives(table, items(spark, range(40)), k=4).collect())


@pytest.mark.parametrize("ids", [(A, B, C, D), (A, B, C, D, 9)])
def test_draws_are_not_sent_to_the_columns_they_are_joined_to(spark, ids):
    """Draws take far more bytes than a basket, so an order's columns come to the basket; the rows are those of a join."""
    context = spark.createDataFrame(
        [(1, [1, 2], "x", None), (1, None, None, 0.5), (4, [], "y", 1.0), (8, [3], "z", 2.0), (None, [5], "n", 3.0)],
        "order_id bigint, basket array<bigint>, name string, days double",
    )
    table = lines(spark).unionByName(lines(spark, [(None, A, 1, 0)])).unionByName(lines(spark, [(4, None, 3, 0)]))
    sampling.CARRIED_AT_ONCE, kept = 30, sampling.CARRIED_AT_ONCE
    try:
        for draw in (sampling.distinct_negatives, sampling.uniform_negatives):
            apart = draw(table, items(spark, ids)).join(context, "order_id")
            found = draw(table, items(spark, ids), context=context)
            assert sorted(map(str, found.select(*apart.columns).collect())) == sorted(map(str, apart.collect()))
            if ids[-1] == D:
                top = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
                assert "Exchange" not in top and "Join" not in top
    finally:
        sampling.CARRIED_AT_ONCE = kept
