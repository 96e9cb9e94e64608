"""Where intermediate tables go: the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Lists of paths and tables handed out inside the open `scratch_space` blocks, the innermost last.
_open: list[tuple[list[str], list[str]]] = []


def scratch_root(spark: SparkSession) -> str:
    """The session's setting; a temporary folder only on a local master that has none."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trolley-"))
        root = sc.getCheckpointDir()
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1][0].append(path)
    return path


def scratch_table(name: str) -> str:
    """Note a catalog table that goes with the surrounding `scratch_space`."""
    if _open:
        _open[-1][1].append(name)
    return name


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table used several times and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replaced(old: str | None, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write the next state of an iteration, then remove the one before: (table, its path)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if old is not None:
        _remove(spark, old)
    return spark.read.schema(df.schema).parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """Remove what queries stage inside the block when it ends. Write or collect their results before that."""
    paths: list[str] = []
    names: list[str] = []
    _open.append((paths, names))
    try:
        yield
    finally:
        _open.remove((paths, names))
        for table in names:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in paths:
            _remove(spark, path)
