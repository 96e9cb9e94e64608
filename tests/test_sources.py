import os

import pytest
from pyspark.sql import functions as F

from tests.fixtures import lines, orders, rows
from trolley.operators import baskets
from trolley.sources import tables, text, views
from trolley.sources.scratch import scratch_path, scratch_space, scratch_table, staged


def test_recall_list_round_trip(spark, tmp_path):
    found = spark.createDataFrame(
        [(5, 2, 0.5), (5, 1, 0.5), (5, 1, 0.5), (5, 3, 0.25)], "order_id bigint, product_id bigint, score double"
    )
    assert text.recall_lines(found).first()["line"] == "5:1_0.5;2_0.5;3_0.25;"
    path = str(tmp_path / "list")
    text.save_recall_list(found, path)
    text.save_recall_list(found, path)
    back = text.long_form(text.read_recall_list(spark, path))
    assert rows(back, "order_id", "product_id", "score") == [(5, 1, 0.5), (5, 2, 0.5), (5, 3, 0.25)]


def test_empty_list_and_missing_path(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([("7:",)], "value string").write.text(path)
    assert text.read_recall_list(spark, path).first()["list"] == []
    assert text.long_form(text.read_recall_list(spark, path)).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text.read_recall_list(spark, str(tmp_path / "none")).collect()


def test_order_lists(spark, tmp_path):
    found = baskets.order_features(orders(spark), lines(spark)).filter("order_id = 5").withColumn("sampled", F.col("hist"))
    path = str(tmp_path / "lists")
    text.save_order_lists(found, path)
    assert spark.read.text(path).first()["value"] == "5,1,9,5.0,3 2,,3 4,3 2"


def test_csv_arrays(spark, tmp_path):
    path = str(tmp_path / "csv")
    text.save_csv_with_arrays(baskets.basket(lines(spark)), path, ["items"])
    back = text.load_csv_with_arrays(spark, path, "order_id bigint, items string", {"items": "int"})
    assert rows(back, "order_id", "items") == [(1, [1, 2]), (2, [1, 3]), (3, [1, 2]), (4, [2, 3]), (5, [3, 4])]


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_partitions(spark, tmp_path, fmt):
    name, place = f"days_{fmt}", str(tmp_path / "days")
    table = spark.range(4).select(F.col("id").cast("int").alias("id"))
    for day in ("2024-01-01", "2024-01-02"):
        tables.write_partition(table, name, day, location=place, fmt=fmt)
    tables.write_partition(table.filter("id = 0"), name, "2024-01-02")

    def counts():
        return rows(spark.table(name).groupBy("dt").count(), "dt", "count")

    assert counts() == [("2024-01-01", 4), ("2024-01-02", 1)]
    tables.write_partition(table.filter("id < 2"), name, "2024-01-03", old_partition="2024-01-01")
    assert counts() == [("2024-01-02", 1), ("2024-01-03", 2)]
    tables.write_partition(table, name, "2024-01-04", drop_table=True, location=str(tmp_path / "again"), fmt=fmt)
    assert counts() == [("2024-01-04", 4)]
    spark.sql(f"DROP TABLE {name}")


def test_shards_are_disjoint_complete_and_reused(spark, tmp_path):
    path = str(tmp_path / "shards")
    table = spark.range(500)
    written = tables.write_shards(table, path, ["id"], n=10)
    assert rows(written, "id") == [(i,) for i in range(500)]
    assert written.select("shard").distinct().count() == 10
    assert tables.write_shards(table.limit(1), path, ["id"], n=10).count() == 500


def test_kv_export(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, list string")
    assert rows(tables.kv_export(table, "id", "list", "P_", 60, 2), "key", "value", "ttl_s") == [("P_1", "a", 60), ("P_2", "b", 60)]
    with pytest.raises(Exception, match="fewer than 3 rows"):
        tables.kv_export(table, "id", "list", "P_", 60, 3).collect()


def test_staged_table_lies_in_the_shared_folder(spark):
    path = scratch_path(spark, "x")
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert path.startswith(root.rstrip("/"))
    assert staged(spark.range(3)).count() == 3


def test_scratch_space_leaves_nothing_behind(spark):
    with scratch_space(spark):
        kept = staged(spark.range(3))
        folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert kept.count() == 3 and os.path.isdir(folder)
        name = scratch_table("trolley_gone")
        spark.range(2).write.saveAsTable(name)
    assert not os.path.exists(folder) and not spark.catalog.tableExists(name)


def test_settings_of_a_write_are_put_back(spark, tmp_path):
    key = "spark.sql.files.maxRecordsPerFile"
    before = spark.conf.get(key)
    tables.write_partition(spark.range(4), "set_days", "2024-01-01", location=str(tmp_path / "d"), settings={key: "1"})
    assert spark.conf.get(key) == before and spark.table("set_days").count() == 4
    spark.sql("DROP TABLE set_days")


def test_shards_in_several_files(spark, tmp_path):
    written = tables.write_shards(spark.range(900), str(tmp_path / "salted"), ["id"], n=2, files=4)
    assert rows(written, "id") == [(i,) for i in range(900)] and len(written.inputFiles()) > 2


def test_views_with_hot_keys(spark, tmp_path):
    """A user with most orders and an order with many repeated lines."""
    days = "cast(timestamp_ntz'1995-01-01' + make_interval(0, 0, 0, cast(id % 400 as int)) as timestamp_ntz)"
    spark.range(300).selectExpr(
        "id as o_orderkey", "if(id % 3 = 0, id, 7) as o_custkey", f"{days} as o_orderdate"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(2000).selectExpr(
        "if(id % 2 = 0, 7, id % 300) as l_orderkey", "id % 11 as l_partkey", "cast(id % 7 as int) as l_linenumber"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    own = views.orders(spark, str(tmp_path)).toPandas()
    raw = spark.read.parquet(f"{tmp_path}/orders.parquet").toPandas().sort_values(["o_custkey", "o_orderdate", "o_orderkey"])
    raw["n"] = raw.groupby("o_custkey").cumcount() + 1
    gap = raw.groupby("o_custkey")["o_orderdate"].diff().dt.days
    both = own.merge(raw.assign(gap=gap), left_on="order_id", right_on="o_orderkey")
    assert (both["order_number"] == both["n"]).all()
    assert (both["days_since_prior_order"].fillna(-1) == both["gap"].fillna(-1)).all()
    assert (own[own["eval_set"] == "train"].groupby("user_id").size() == 1).all()
    table = views.lines(spark, str(tmp_path)).toPandas()
    assert not table.duplicated(["order_id", "product_id"]).any()
    first = table.groupby(["user_id", "product_id"])["order_number"].transform("min")
    assert ((table["order_number"] > first).astype(int) == table["reordered"]).all()
