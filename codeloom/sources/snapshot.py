"""Versioned snapshots of the index: a folder of Parquet tables a version, and a pointer written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _pointers(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit())


def current(spark: SparkSession, root: str) -> int | None:
    """The newest version whose tables are all written."""
    found = _pointers(spark, root)
    return found[-1] if found else None


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Writes all tables of a new version, then its pointer; readers of older versions aren't disturbed."""
    version = (current(spark, root) or 0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v{version}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}/{version}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False).close()
    return version


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/v{version or current(spark, root)}/{name}")


def replaced(old: DataFrame, new: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """Old rows whose key is not replaced, and all new rows.

    keys: the keys that are replaced, as a file that was parsed again and has no symbols now; without it those of the new rows.
    """
    gone = new.select(key) if keys is None else keys.select(key).unionByName(new.select(key))
    return old.join(gone.distinct(), key, "left_anti").unionByName(new)


def removed(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(F.col(key)).distinct(), key, "left_anti")
