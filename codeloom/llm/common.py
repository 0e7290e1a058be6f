"""What the operators of this subpackage share: reading tables, cutting lineage, Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone, so that any store will do."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local session import this package wherever the driver was started."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{path}".rstrip(":")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="codeloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: it outlives executors, and later steps don't repeat earlier ones."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame) -> DataFrame:
    """The same rows in as many parts as shuffles have, where Spark has split skewed ones into more; rows don't move."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_place(df: DataFrame) -> DataFrame:
    """The same columns, named by their places."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | list], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to one batch; columns go in under their places, as names may hold dots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return by_place(df).mapInArrow(run, schema)


def texts_of(column: pa.Array) -> Iterator[str]:
    """The strings of an Arrow column one at a time, null as the empty text."""
    for i in range(len(column)):
        yield column[i].as_py() or ""
