"""Partitioned tables, training shards and key-value exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trolley.functions.draws import draw


def _exists(df: DataFrame, table: str) -> bool:
    return df.sparkSession.catalog.tableExists(table)


def write_partition(
    df: DataFrame,
    table: str,
    dt: str,
    old_partition: str | None = None,
    drop_table: bool = False,
    location: str | None = None,
    fmt: str = "parquet",
    settings: dict[str, str] | None = None,
) -> None:
    """Overwrite one `dt` partition of a table, creating the table from the DataFrame if absent.

    An expired partition, or the whole table, can be dropped first. `fmt='text'` gives tab-delimited
    files. Other partitions are not touched. `settings` hold for this write and are put back.
    """
    spark = df.sparkSession
    before = {key: spark.conf.get(key, None) for key in settings or {}}
    for key, value in (settings or {}).items():
        spark.conf.set(key, value)
    try:
        _write_partition(df, table, dt, old_partition, drop_table, location, fmt)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _write_partition(
    df: DataFrame, table: str, dt: str, old_partition: str | None, drop_table: bool, location: str | None, fmt: str
) -> None:
    spark = df.sparkSession
    if drop_table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    elif old_partition is not None and _exists(df, table):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (dt='{old_partition}')")
    if not _exists(df, table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        using = "csv OPTIONS (sep '\t')" if fmt == "text" else fmt
        place = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE TABLE {table} ({columns}, dt STRING) USING {using} PARTITIONED BY (dt){place}")
    names = ", ".join(f"`{c}`" for c in df.columns)
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (dt='{dt}') SELECT {names} FROM {{rows}}", rows=df)


def write_shards(
    df: DataFrame, path: str, keys: list[str], n: int = 100, reuse: bool = True, files: int = 1
) -> DataFrame:
    """Disjoint training shards by key hash, one folder a shard, each written by `files` tasks; kept if already there."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if not (reuse and done):
        shard = (draw("shard", *[F.col(k) for k in keys]) % n).cast("int")
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
        dealt = df.withColumn("shard", shard).repartition(n * files, "shard", salt)
        dealt.write.mode("overwrite").partitionBy("shard").parquet(path)
    return spark.read.parquet(path)


def kv_export(df: DataFrame, key: str, value: str, prefix: str, ttl_s: int, min_rows: int) -> DataFrame:
    """(key, value, ttl) rows ready to publish; too few rows is an error raised when the rows are read."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    shaped = F.when(rows >= min_rows, F.concat(F.lit(prefix), F.col(key).cast("string"))).otherwise(
        F.raise_error(F.concat(F.lit(f"fewer than {min_rows} rows to publish: "), rows.cast("string")))
    )
    return df.select(shaped.alias("key"), F.col(value).alias("value"), F.lit(ttl_s).cast("bigint").alias("ttl_s"))
