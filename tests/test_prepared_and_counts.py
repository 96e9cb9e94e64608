"""Growing dictionary, united sketches, bucketed prepared tables, the AUC from counts, and points within a distance."""

import datetime as dt
import math
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tests.fixtures import rows
from trolley.operators import ctr, dictionary, distance, evaluate, sketches
from trolley.sources import prepared


def log(spark, n=900):
    """A third of the rows have one value; some have none."""
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(n):
        value = "hot" if i % 3 == 0 else (None if i % 17 == 0 else f"user_{rng.randrange(200):06d}")
        data.append((i, start + dt.timedelta(minutes=i), value))
    return spark.createDataFrame(data, "event_id bigint, at timestamp_ntz, user string")


def test_chunks_give_the_ids_of_one_pass(spark, tmp_path):
    whole, path = log(spark), str(tmp_path / "known")
    assert dictionary.read(spark, path) is None
    sizes = []
    for low, high in ((0, 300), (300, 310), (310, 310), (310, 900)):
        sizes.append(dictionary.extend(path, whole.filter((F.col("event_id") >= low) & (F.col("event_id") < high)), "user", "at").count())
    want = rows(ctr.first_seen_codes(whole, "user", "at"), "user", "code")
    assert rows(dictionary.read(spark, path), "value", "id") == want
    assert sizes == sorted(sizes) and sizes[1] == sizes[2] and dictionary.read(spark, path, 1).count() == sizes[0]
    again = dictionary.extend(path, whole, "user", "at")  # nothing new
    assert rows(again, "value", "id") == want
    coded = {r.event_id: r.code for r in dictionary.encode(whole, again, "user").collect()}
    assert len(coded) == 900 and coded[0] == 0 and coded[17] is None


def test_an_unfinished_version_is_written_anew(spark, tmp_path):
    whole, path = log(spark, 100), str(tmp_path / "known")
    first = dictionary.extend(path, whole.limit(0), "user", "at")
    assert first.count() == 0
    dictionary.extend(path, whole, "user", "at")
    os.remove(f"{path}/version-00000002/_SUCCESS")
    assert dictionary.read(spark, path).count() == 0
    assert rows(dictionary.extend(path, whole, "user", "at"), "value", "id") == rows(
        ctr.first_seen_codes(whole, "user", "at"), "user", "code"
    )


def test_sketches_of_days_are_united(spark):
    df = spark.range(120_000).selectExpr(
        "cast(id % 7 AS int) AS day", "id % 40000 AS many", "cast(id % 5 AS string) AS few", "cast(NULL AS string) AS none"
    )
    columns = ["many", "few", "none"]
    days = sketches.daily(df, "day", columns).cache()
    assert days.count() == 7
    found = {r.column: r.n_distinct for r in sketches.estimates(days, columns).collect()}
    assert abs(found["many"] - 40_000) <= sketches.error_bound() * 40_000 and found["few"] == 5 and found["none"] == 0
    one = {r.column: r.n_distinct for r in sketches.estimates(days.filter("day = 3"), columns).collect()}
    exact = df.filter("day = 3").select("many").distinct().count()
    assert abs(one["many"] - exact) <= sketches.error_bound() * exact
    assert {r.n_distinct for r in sketches.estimates(days.filter("day = 99"), columns).collect()} == {0}


def test_prepared_tables_join_without_an_exchange(spark, tmp_path):
    names = [f"prepared_{uuid.uuid4().hex}" for _ in range(2)]
    left = spark.range(500).selectExpr("id AS order_id", "id * 2 AS a")
    right = spark.range(1500).selectExpr("id % 500 AS order_id", "id AS b")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sides = [prepared.kept(df, n, "order_id", 4, "v1", str(tmp_path / n)) for df, n in zip((left, right), names)]
        joined = sides[0].join(sides[1], "order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert rows(joined, "order_id", "a", "b") == rows(left.join(right, "order_id"), "order_id", "a", "b")

        def files(name):
            return sorted(os.listdir(tmp_path / name))

        before = files(names[0])
        prepared.kept(left, names[0], "order_id", 4, "v1", str(tmp_path / names[0]))
        assert files(names[0]) == before  # an equal request reads what is there
        other = prepared.kept(left.filter("order_id < 10"), names[0], "order_id", 4, "v2", str(tmp_path / names[0]))
        assert other.count() == 10 and files(names[0]) != before
        assert prepared.kept(left, names[0], "order_id", 2, "v2", str(tmp_path / names[0])).count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def scored(spark, kind, n=4000):
    rng = random.Random(7)
    data = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        s = rng.gauss(y, 1) if kind == "spread" else (0.5 if rng.random() < 0.9 else rng.random()) if kind == "ties" else math.exp(8 * rng.random() + y)
        data.append((y, s))
    return spark.createDataFrame(data + [(1, None)], "click int, score double")


@pytest.mark.parametrize("kind", ["spread", "ties", "long tail"])
def test_area_from_counts_keeps_its_error(spark, kind):
    df = scored(spark, kind)
    exact = evaluate.auc(df, "click", "score").first().auc
    rough = evaluate.auc_bounds(df, "click", "score").first()
    assert abs(rough.auc - exact) <= rough.error + 1e-12
    if kind != "ties":  # ties are half right whatever the ranges
        assert rough.error < 0.002
    coarse = evaluate.auc_bounds(df, "click", "score", bins=8).first()
    assert abs(coarse.auc - exact) <= coarse.error + 1e-12


def test_area_of_one_class_or_one_score(spark):
    schema = "click int, score double"
    assert evaluate.auc_bounds(spark.createDataFrame([(1, 0.5)], schema), "click", "score").first().auc is None
    assert evaluate.auc_bounds(spark.createDataFrame([], schema), "click", "score").first().auc is None
    assert evaluate.auc_bounds(spark.createDataFrame([(1, 0.5), (0, 0.5)], schema), "click", "score").first().auc == 0.5


def km(a, b):
    (la, oa), (lb, ob) = ((math.radians(v) for v in p) for p in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2
    return 2 * distance.EARTH_KM * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("reach, crowded", [(25.0, 64), (25.0, 3), (900.0, 4), (25_000.0, 16), (0.0, 2)])
def test_points_within_a_distance(spark, reach, crowded):
    rng = random.Random(int(reach))
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    spots += [(48 + rng.gauss(0, 0.1), 2 + rng.gauss(0, 0.1)) for _ in range(250)]  # a town with over a third of all
    spots += [(48.0, 2.0)] * 80  # one place, many points
    spots += [(90.0, 0.0), (89.9, 100.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -179.9), (0.05, 179.95)]
    seekers = spots[::7] + [(48.01, 2.01)] * 3 + [(90.0, 170.0), (0.0, -180.0)]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(seekers)] + [(-1, None, 2.0)], "id bigint, lat double, lng double")
    right = spark.createDataFrame([*spots, (None, 1.0)], "lat double, lng double")
    want = {i: sum(km(p, q) <= reach for q in spots) for i, p in enumerate(seekers)} | {-1: 0}
    assert {r.id: r.n_within for r in distance.within_distance(left, right, reach, crowded).collect()} == want


def test_vocabulary_and_head(spark):
    from trolley.operators.topk import head

    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, None), (3, "b")], "x int, y string")
    assert rows(ctr.vocabulary(df, ["x", "y"], {"day": 31}), "field", "size", "largest") == [("day", 31, 3), ("x", 3, 3), ("y", 2, 3)]
    assert rows(ctr.vocabulary(df, ["y"]), "field", "size", "largest") == [("y", 2, 2)]
    assert [r.x for r in head(df, [F.col("x").desc(), F.col("y").asc_nulls_last()], 2).collect()] == [3, 2]


def _brute(left, right, km):
    def apart(a, b):
        (p, q), (r, s) = (map(math.radians, c) for c in (a, b))
        h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
        return 2 * distance.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    return {i: sum(apart((a, b), place) <= km for place in right) for i, a, b in left}


def test_seekers_are_not_rows_a_cube(spark, monkeypatch):
    """Rows that travel between seekers and cubes follow the tiles; seekers at one place and near the poles count as any."""
    rng = random.Random(9)
    right = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(90.0, float(i)) for i in range(30)]
    left = [(i, 48 + rng.random(), 2 + rng.random()) for i in range(600)] + [(600 + i, 89.9, 12.0 * i) for i in range(30)]
    left += [(700 + i, 10.0, 20.0) for i in range(40)]
    sizes, real = {}, distance.staged

    def counted(df, name):
        table = real(df, name)
        sizes[name] = sizes.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(distance, "staged", counted)
    monkeypatch.setattr(distance, "MOST_LEVELS", 1)  # places at the pole cannot be told apart by cutting
    found = distance.within_distance(
        spark.createDataFrame(left, "id bigint, lat double, lng double"),
        spark.createDataFrame([(i, *p) for i, p in enumerate(right)], "id bigint, lat double, lng double"), 1500.0, 20, 300,
    )
    assert {r.id: r.n_within for r in found.collect()} == _brute(left, right, 1500.0)
    assert sizes["front"] < 600 and sizes["met"] < 600
