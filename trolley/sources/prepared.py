"""Prepared sets kept as bucketed tables: joined on their key without another exchange."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

REQUEST = "prepared.request"


def request(df: DataFrame, key: str, buckets: int, source: str) -> str:
    """What a table was prepared from: its columns and types, key, buckets, and the caller's word for the input."""
    told = [df.schema.jsonValue(), key, buckets, source]
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def kept(df: DataFrame, table: str, key: str, buckets: int, source: str, path: str | None = None) -> DataFrame:
    """The rows as a table bucketed and sorted by `key`, written unless it is there for an equal request.

    `source` names the input (folder, day, parameters); another source, other columns, another key or another number
    of buckets writes the table anew. Each bucket is one file, so a key's rows are read by one task; take more
    buckets rather than large ones.
    """
    spark = df.sparkSession
    wanted = request(df, key, buckets, source)
    if _told(spark, table) == wanted:
        return spark.table(table)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    # Told last: a table whose writing failed half way is written again.
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{REQUEST}' = '{wanted}')")
    return spark.table(table)


def _told(spark: SparkSession, table: str) -> str | None:
    if not spark.catalog.tableExists(table):
        return None
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
    return next((r["value"] for r in rows if r["key"] == REQUEST), None)
