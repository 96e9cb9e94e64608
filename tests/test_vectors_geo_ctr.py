import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.fixtures import rows
from trolley.functions import dates, geocells
from trolley.functions.draws import draw, keep
from trolley.operators import ctr, geo, vectors


def vector_table(spark, table):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in table.items()], "item_id bigint, vector array<double>")


def test_neighbors(spark):
    table = vector_table(spark, {1: (1, 0), 2: (1, 1), 3: (0, 1), 4: (-1, 0), 5: (0, 0)})
    found = vectors.neighbors(table, k=3)
    of_a = [(n, round(s, 6)) for i, r, n, s in rows(found, "item_id", "rank", "neighbor_id", "sim") if i == 1]
    assert of_a == [(2, 0.707107), (3, 0.0), (4, -1.0)]
    assert found.filter("item_id = 5 or neighbor_id = 5").count() == 0


def test_best_items_over_blocks_against_numpy(spark):
    rng = np.random.default_rng(0)
    q, m = rng.normal(size=(30, 4)), rng.normal(size=(50, 4))
    m[10:20] = m[0]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vector array<double>")
    items = spark.createDataFrame(
        [(i, v.tolist(), i / 100) for i, v in enumerate(m)], "item_id bigint, vector array<double>, bias double"
    )
    scores = q @ m.T + np.arange(50) / 100
    want = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :5]
    prob = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    for block_rows in (4096, 7):
        found = vectors.softmax_best(queries, items, 5, block_rows).collect()
        assert len(found) == 150
        for r in found:
            assert want[r["query_id"], r["rank"] - 1] == r["item_id"]
            assert r["prob"] == pytest.approx(prob[r["query_id"], r["item_id"]])


def test_lsh_finds_the_close_ones(spark):
    table = vector_table(spark, {i: (math.cos(i / 10), math.sin(i / 10)) for i in range(20)})
    exact = {(a, b) for a, b in rows(vectors.neighbors(table, k=1), "item_id", "neighbor_id")}
    close = {(a, b) for a, b in rows(vectors.neighbors(table, k=1, method="lsh", radius=0.5), "item_id", "neighbor_id")}
    assert len(exact & close) >= 15


def test_pooled(spark):
    table = vector_table(spark, {1: (1, 0), 3: (0, 1)})
    history = spark.createDataFrame([(9, 1), (9, 3), (9, 77)], "order_id bigint, product_id bigint")
    assert vectors.pooled(history, table, "order_id").first()["vector"] == [0.5, 0.5]
    found = vectors.pooled_recall(history, vector_table(spark, {1: (0, 0), 3: (2 * math.log(3), 0)}), n=2)
    assert [round(p, 6) for _, p in rows(found, "rank", "prob")][0] > 0.5


def test_softmax_values(spark):
    queries = spark.createDataFrame([(1, [1.0])], "query_id bigint, vector array<double>")
    found = vectors.softmax_best(queries, vector_table(spark, {1: (0,), 2: (math.log(3),)}), 2)
    assert [(i, round(p, 6)) for _, i, p in rows(found, "rank", "item_id", "prob")] == [(2, 0.75), (1, 0.25)]


def test_group_vectors(spark):
    table = vector_table(spark, {1: (1, 0), 2: (3, 0)})
    products = spark.createDataFrame([(1, "x", "d"), (2, "x", "e")], "product_id bigint, aisle_id string, department_id string")
    found = dict(rows(vectors.with_group_vectors(table, products), "item_id", "vector"))
    assert found[1] == [1, 0, 2, 0, 1, 0] and found[2] == [3, 0, 2, 0, 3, 0]


def halving(lat, lng, precision):
    low, high, out = [-180.0, -90.0], [180.0, 90.0], ""
    for start in range(0, 5 * precision, 5):
        digit = 0
        for bit in range(start, start + 5):
            axis, value = bit % 2, (lng, lat)[bit % 2]
            mid = (low[axis] + high[axis]) / 2
            digit = 2 * digit + (value > mid)
            (low if value > mid else high)[axis] = mid
        out += geocells.BASE32[digit]
    return out


def test_geohash(spark):
    rng = random.Random(6)
    points = [(57.64911, 10.40744), (23.08502197265625, 114.4061279296875), (0.0, 0.0), (90.0, 180.0), (-90.0, -180.0)]
    points += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)]
    points += [(rng.randint(-9000, 9000) / 100, rng.randint(-1024, 1024) * 180 / 1024) for _ in range(200)]
    table = spark.createDataFrame(points, "lat double, lng double")
    for precision in (1, 5, 6, 12):
        placed = geo.with_cell(table, precision)
        cell = geocells.cell_text(F.col("x"), F.col("y"), precision)
        for r in placed.select("lat", "lng", cell.alias("cell")).collect():
            assert r["cell"] == halving(r["lat"], r["lng"], precision)
    known = [halving(23.08502197265625, 114.4061279296875, p) for p in (1, 5, 6, 12)]
    assert known == ["w", "ws177", "ws1776", "ws17767zzzzz"]


def test_neighbours_and_bounds(spark):
    cells = geo.with_cell(spark.createDataFrame([(57.64911, 10.40744)], "lat double, lng double"), 5)
    found = geo.neighbours(cells, 5)
    assert " ".join(n for _, n in rows(found, "place", "neighbour")) == "u4r2h u4r2j u4prv u4prt u4prs u4pre u4prg u4r25"
    r = geo.cell_bounds(cells, 5).first()
    assert r["min_lat"] < 57.64911 <= r["max_lat"] and r["min_lng"] < 10.40744 <= r["max_lng"]


def test_proximity(spark):
    left = spark.createDataFrame([(1, 10.0, 10.0), (2, -50.0, 100.0), (3, 1.0, 179.9)], "id bigint, lat double, lng double")
    right = spark.createDataFrame([(7, 10.1, 10.1), (8, 10.0, 13.0), (9, 1.0, -179.9)], "id bigint, lat double, lng double")
    assert rows(geo.proximity_join(left, right, 3), "id", "n_same_cell", "n_nearby") == [(1, 1, 1), (2, 0, 0), (3, 0, 1)]


def test_cell_hot(spark):
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.0, 11.4), (3, -60.0, 0.0)], "id bigint, lat double, lng double")
    bought = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (3, 7)], "user_id bigint, product_id bigint")
    found = geo.cell_hot(points, bought, precision=3, k=1)
    assert sorted(p for p, _ in rows(found, "product_id", "cnt")) == [5, 5, 7]


def test_time_features(spark):
    found = ctr.time_features(spark.createDataFrame([("14102100",)], "hour string")).first()
    assert (found["year"], found["month_b"], found["day_b"], found["hour_b"], found["weekday"]) == (2014, 2, 1, 0, 1)


def test_profile_and_choice(spark):
    table = spark.createDataFrame([(1, i, i % 2) for i in range(20)], "same int, many int, two int")
    assert ctr.select_columns(table, table.columns, above=1, below=ctr.FEW) == ["two"]
    assert ctr.feature_columns(table, ["same"]) == ["many", "two"]


def test_codes(spark):
    table = spark.createDataFrame([(i, v, i) for i, v in enumerate("bacadz")], "id int, v string, n int")
    seen = table.filter("id < 4")
    coded = ctr.label_codes(table, ["v", "n"], fit=seen)
    assert rows(coded, "id", "v", "n") == [(0, 1, 0), (1, 0, 1), (2, 2, 2), (3, 0, 3), (4, 3, 4), (5, 3, 4)]
    first = ctr.first_seen_codes(
        table.withColumn("at", F.timestamp_seconds("id")), "v", "at", rows_per_range=1
    )
    assert rows(first, "v", "code") == [("a", 1), ("b", 0), ("c", 2), ("d", 3), ("z", 4)]


def test_dummies_and_samples(spark):
    table = spark.range(4000).select(F.col("id"), (F.col("id") % 3).alias("c"), (F.col("id") % 5 == 0).cast("int").alias("click"))
    flags = ctr.dummies(table, ["c"])
    assert flags.columns == ["id", "click", "c_0", "c_1", "c_2"]
    assert flags.filter("c_0 + c_1 + c_2 <> 1").count() == 0
    kept = ctr.sampled(table, "id", "click")
    share = dict(rows(kept.groupBy("click").count(), "click", "count"))
    assert share[1] == pytest.approx(800 * 0.7, abs=60) and share[0] == pytest.approx(3200 * 0.14, abs=70)
    assert kept.exceptAll(ctr.sampled(table.repartition(7), "id", "click")).count() == 0


def test_draws_are_uniform(spark):
    table = spark.range(5000)
    half = table.filter(keep("x", 0.5, F.col("id"))).count()
    assert abs(half - 2500) < 150
    low, high = table.agg(F.min(draw("x", F.col("id"))), F.max(draw("x", F.col("id")))).first()
    assert 0 <= low < 1 << 50 and high > (1 << 60) - (1 << 50)


def test_models_learn(spark):
    rng = random.Random(7)
    data = [(i, a, b, int(rng.random() < (0.9 if (a + b) % 2 else 0.1))) for i in range(800) for a, b in [(rng.randint(0, 1), rng.randint(0, 1))]]
    table = spark.createDataFrame(data, "event_id bigint, a int, b int, click int")
    ready = ctr.fit_encoder(table, ["a", "b"]).transform(table)
    from trolley.operators.evaluate import auc

    for fit, floor in ((ctr.fit_lr, 0.45), (ctr.fit_fm, 0.7), (ctr.fit_mlp, 0.7)):
        scored = ctr.scores(fit(ready), ready, "event_id", "click")
        assert auc(scored, "click", "score").first()["auc"] > floor
    blend = ctr.blended(scored, scored, "event_id")
    assert blend.count() == 800


def test_dates(spark):
    day = F.lit(dt.date(2024, 3, 1))
    r = spark.range(1).select(
        dates.days_before(day, 1).cast("string").alias("d"),
        dates.date_key(dates.days_before(day, 1)).alias("k"),
        dates.epoch_start(day).alias("e"),
    ).first()
    assert (r["d"], r["k"], r["e"]) == ("2024-02-29", "20240229", 1709251200)
    moments = spark.sql("select explode(array(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-02 23:59:59', timestamp_ntz'2024-01-03')) as ts")
    assert dates.in_window(moments, "ts", dt.date(2024, 1, 1), dt.date(2024, 1, 2)).count() == 2


def test_no_neighbours_over_a_pole(spark):
    from trolley.operators import geo

    points = spark.createDataFrame([(1, 89.99, 10.0), (2, -89.99, 10.0)], "id bigint, lat double, lng double")
    found = geo.proximity_join(points.filter("id = 1"), points, 2).first()
    assert (found.n_same_cell, found.n_nearby) == (1, 1)


def test_codes_of_wide_columns(spark):
    from trolley.operators import ctr

    n = ctr.MANY + 1
    rows = spark.range(n).selectExpr("id", "id * 3 % 10007 AS number", "concat('v', id * 7 % 10007) AS name")
    found = ctr.label_codes(rows, ["number", "name"]).toPandas().sort_values("id")
    want = rows.toPandas().sort_values("id")
    for c in ("number", "name"):
        order = {v: i for i, v in enumerate(sorted(set(want[c])))}
        assert found[c].tolist() == [order[v] for v in want[c]]
