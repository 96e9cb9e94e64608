import itertools
import random
from collections import Counter, defaultdict
from math import sqrt

import pytest

from tests.fixtures import A, B, C, D, E, ORDERS, LINES, items, lines, orders, rows
from trolley.operators import evaluate, hot, itemcf, stats
from trolley.sources.views import prior, train


@pytest.fixture()
def context(spark):
    return stats.with_context(lines(spark), orders(spark))


def test_hot_by_slot_and_metric(context):
    slots = hot.by_slot(prior(context))
    assert rows(slots, "order_dow", "product_id", "cnt", "rank") == [
        (0, A, 2, 1), (0, B, 1, 2), (0, C, 1, 3), (1, B, 1, 1), (1, C, 1, 2),
    ]
    assert rows(hot.recall(train(context), slots), "order_id", "product_id") == [
        (3, A), (3, B), (3, C), (5, B), (5, C),
    ]
    found = hot.metric(train(context), slots).first()
    assert (found["tp"], found["p"], found["recall"]) == (3, 4, 0.75)


def test_slot_without_history_is_not_counted(spark):
    more = orders(spark, ORDERS + [(7, 3, 1, 5, 23, "train", None)])
    context = stats.with_context(lines(spark, LINES + [(7, A, 1, 0)]), more)
    assert hot.metric(train(context), hot.by_slot(prior(context))).first()["p"] == 4


def test_item_statistics(context):
    hot_time = stats.item_hot_time(prior(context))
    assert rows(hot_time, "product_id", "order_dow", "order_hod", "order_cnt") == [
        (A, 0, 8, 2), (B, 0, 8, 1), (C, 0, 8, 1),
    ]
    assert rows(stats.item_avg_cart_order(prior(context)), "product_id", "avg_cart_order") == [
        (A, 1.0), (B, 1.5), (C, 2.0),
    ]
    index = stats.item_order_index(train(context))
    names = ("product_id", "order_pv", "order_uv", "reorder_pv", "reorder_uv", "reorder_uv_strict")
    assert rows(index, *names) == [
        (A, 1, 1, 1, 1, 1), (B, 1, 1, 1, 1, 1), (C, 1, 1, 1, 1, 1), (D, 1, 1, 0, 1, 0),
    ]


def test_popularity_sums_to_one(spark, context):
    share = stats.popularity(prior(context), items(spark))
    assert [(p, round(v, 6)) for p, v in rows(share, "product_id", "prob")] == [
        (A, 0.333333), (B, 0.333333), (C, 0.333333), (D, 0.0),
    ]


def test_all_orders_keeps_orders_without_lines(spark, context):
    more = orders(spark, ORDERS + [(9, 3, 1, 2, 2, "prior", None)])
    found = stats.all_orders(more, prior(context), train(context))
    assert found.count() == len(LINES) + 1
    assert found.filter("order_id = 9 and product_id is null").count() == 1


@pytest.mark.parametrize(
    "weight, expected",
    [
        (0, {(A, B): 0.5, (A, C): 0.5, (B, C): 0.5}),
        (1, {(A, B): 0.316228, (A, C): 0.632456, (B, C): 0.5}),
    ],
)
@pytest.mark.parametrize("split_above", [256, 1])
def test_similarity(context, weight, expected, split_above):
    found = {}
    for p, q, s in rows(
        itemcf.similarity(prior(context), weight, split_above=split_above), "product_id", "sim_product_id", "sim"
    ):
        found[p, q] = round(s, 6)
    assert found == {**expected, **{(q, p): s for (p, q), s in expected.items()}}


def test_recall_and_metric(context):
    history, targets = prior(context), train(context)
    starts = itemcf.triggers(history)
    assert rows(starts, "user_id", "rank", "product_id", "last_order_number", "times") == [
        (1, 1, A, 2, 2), (1, 2, C, 2, 1), (1, 3, B, 1, 1), (2, 1, B, 1, 1), (2, 2, C, 1, 1),
    ]
    plain = itemcf.recall(targets, starts, itemcf.similarity(history))
    assert rows(plain, "order_id", "product_id", "score") == [
        (o, p, 0.5) for o in (3, 5) for p in (A, B, C)
    ]
    weighed = itemcf.recall(targets, starts, itemcf.similarity(history, 1))
    assert weighed.count() == 10
    merged = itemcf.recall(targets, starts, itemcf.similarity(history, 1), merge="max", top_n=1)
    assert [(o, p) for o, p in rows(merged, "order_id", "product_id")] == [(3, A), (5, A)]
    for found in (plain, weighed):
        sums = evaluate.micro_recall(found, targets, itemcf.covered_orders(targets, starts)).first()
        assert (sums["tp"], sums["p"], sums["recalled"], sums["orders"], sums["recall"]) == (3, 4, 6, 2, 0.75)


def test_order_with_empty_lists_counts(spark):
    more = orders(spark, ORDERS + [(6, 3, 1, 1, 1, "prior", None), (7, 3, 2, 1, 1, "train", 1.0)])
    context = stats.with_context(lines(spark, LINES + [(6, E, 1, 0), (7, A, 1, 0)]), more)
    history, targets = prior(context), train(context)
    starts = itemcf.triggers(history)
    found = itemcf.recall(targets, starts, itemcf.similarity(history))
    covered = evaluate.micro_recall(found, targets, itemcf.covered_orders(targets, starts)).first()
    assert (covered["p"], covered["orders"]) == (5, 3)
    bare = evaluate.micro_recall(found, targets).first()
    assert (bare["p"], bare["orders"]) == (4, 2)
    assert evaluate.micro_recall(found, targets, denominator="all").first()["orders"] == 3


def test_pairs_against_brute_force_with_hot_order_and_item(spark):
    rng = random.Random(1)
    bought = {(o, p) for o in range(1, 60) for p in rng.sample(range(2, 90), 3)}
    bought |= {(o, 1) for o in range(1, 60)}
    bought |= {(0, p) for p in range(1, 90)}
    flags = {line: rng.randint(0, 1) for line in sorted(bought)}
    table = lines(spark, [(o, p, 1, f) for (o, p), f in flags.items()])
    weight = {line: 1.0 + 2 * f for line, f in flags.items()}
    by_order, norm = defaultdict(list), Counter()
    for (o, p), w in weight.items():
        by_order[o].append((p, w))
        norm[p] += w * w
    want = Counter()
    for basket in by_order.values():
        for (p, v), (q, w) in itertools.combinations(sorted(basket), 2):
            want[p, q] += v * w
    for split_above in (256, 20, 2):
        found = itemcf.pairs(table, 2, split_above=split_above)
        got = {(p, q): w for p, q, w in rows(found, "product_id1", "product_id2", "pair_weight")}
        assert got == dict(want)
    near = itemcf.similarity(table, 2, k=5, split_above=20)
    for p, q, s in rows(near, "product_id", "sim_product_id", "sim"):
        assert s == pytest.approx(want[min(p, q), max(p, q)] / sqrt(norm[p] * norm[q]))
        assert 0 < s <= 1 + 1e-12
    per_item = Counter(p for p, _ in rows(near, "product_id", "rank"))
    assert set(per_item.values()) == {5}


def test_block_product_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(itemcf, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(itemcf, "CHUNK_LINES", 10)
    rng = random.Random(2)
    table = [(o, p, 1, 0) for o in range(8) for p in rng.sample(range(30), 9)]
    small = itemcf.pairs(lines(spark, table), 0)
    large = itemcf.pairs(lines(spark, table), 0, split_above=1)
    names = ("product_id1", "product_id2", "pair_weight")
    assert rows(small, *names) == rows(large, *names)


def test_auc(spark):
    def auc(pairs, **options):
        return evaluate.auc(spark.createDataFrame(pairs, "y int, s double"), "y", "s", **options).first()["auc"]

    assert auc([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)]) == 0.75
    assert auc([(1, 0.5), (0, 0.5), (0, 0.5)]) == 0.5
    assert auc([(1, 0.5), (1, 0.1)]) is None
    rng = random.Random(3)
    pairs = [(rng.randint(0, 1), rng.choice([0.25, rng.random()])) for _ in range(300)]
    wins = sum((s > t) + (s == t) / 2 for y, s in pairs if y for z, t in pairs if not z)
    want = wins / (sum(y for y, _ in pairs) * sum(1 - y for y, _ in pairs))
    assert auc(pairs) == pytest.approx(want)
    assert auc(pairs, rows_per_range=10) == pytest.approx(want)


def test_recall_at(spark):
    scored = spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.8), (1, 9, 0.1)], "order_id bigint, product_id bigint, score double")
    truth = spark.createDataFrame([(1, 8), (1, 9)], "order_id bigint, product_id bigint")
    assert evaluate.recall_at(scored, truth, 1).first()["tp"] == 0
    assert evaluate.recall_at(scored, truth, 2).first()["recall"] == 0.5
