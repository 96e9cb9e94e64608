"""A value dictionary that grows chunk by chunk: values keep their ids, new ones are numbered after the highest.

It is a folder of numbered versions, each holding only the values met first in its chunk. A version counts once it is
written as a whole; one left over from a failed job is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley.operators.ctr import first_seen_codes
from trolley.operators.spread import ROWS_PER_RANGE, hot_key_join


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the finished versions, oldest first."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(root) if s.getPath().getName().startswith("version-")]
    return sorted(p for p in found if fs.exists(jvm.Path(f"{p}/_SUCCESS")))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """(value, id) as of a version (the newest by default); None before the first."""
    known = versions(spark, path)[:version]
    return spark.read.parquet(*known) if known else None


def extend(
    path: str, chunk: DataFrame, column: str, at: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Number the values of a chunk that are not known yet, by first appearance (`at`, then value), as a new version.

    Only the chunk is read, and the dictionary once; nulls get no id. Returns the whole dictionary (value, id).
    """
    spark = chunk.sparkSession
    done = versions(spark, path)
    known = read(spark, path)
    met = chunk.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(at).alias("at"))
    if known is not None:
        met = met.join(known, "value", "left_anti")
        start = known.agg((F.max("id") + 1).alias("n")).scalar()
    else:
        start = F.lit(0)
    fresh = first_seen_codes(met, "value", "at", rows_per_range)
    fresh = fresh.select("value", (F.col("code") + F.coalesce(start, F.lit(0))).cast("bigint").alias("id"))
    fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version-{len(done) + 1:08d}")
    return read(spark, path)


def encode(df: DataFrame, known: DataFrame, column: str, out: str = "code") -> DataFrame:
    """The rows with the id of their value, null for a value without one; hot values are split."""
    ids = known.select(F.col("value").alias(column), F.col("id").alias(out))
    return hot_key_join(df, ids, column, "left")
