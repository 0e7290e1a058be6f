"""Change detection and batch forms of the change feed's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(indexed: DataFrame, seen: DataFrame) -> DataFrame:
    """path, action of two listings (path, content_hash): skip, reindex or remove."""
    old, new = indexed.select("path", F.col("content_hash").alias("old")), seen.select(F.col("path").alias("p"), F.col("content_hash").alias("new"))
    met = old.join(new, F.col("path") == F.col("p"), "full_outer")
    return met.select(F.coalesce("path", "p").alias("path"), F.when(F.col("p").isNull(), "remove").when(F.col("old") == F.col("new"), "skip").otherwise("reindex").alias("action"))


def latest_intents(events: DataFrame) -> DataFrame:
    """path, intent, first_seen, last_seen: the last added event of a path decides."""
    return events.groupBy("path").agg(F.max_by("intent", "seq").alias("intent"), F.min_by("ts", "seq").alias("first_seen"), F.max_by("ts", "seq").alias("last_seen"))


def quiet_bursts(events: DataFrame, quiet_seconds: int) -> DataFrame:
    """path, burst, n_events: events of a path with less than the quiet time between them."""
    own = Window.partitionBy("path").orderBy("ts", "seq")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(own)
    marked = events.withColumn("new", F.when(gap.isNull() | (gap >= quiet_seconds * 1_000_000), 1).otherwise(0))
    numbered = marked.withColumn("burst", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("path", "burst").agg(F.count("*").alias("n_events"), F.max_by("intent", "seq").alias("intent"))


def unfinished(journal: DataFrame) -> DataFrame:
    """batch_id of intents without a completion."""
    return journal.where("type = 'intent'").join(journal.where("type = 'complete'").select("batch_id"), "batch_id", "left_anti").select("batch_id").distinct()


def source_window(files: DataFrame, text_col: str, start: int, most: int) -> DataFrame:
    """Lines start .. start + most - 1 of each text and whether more follow."""
    lines = F.split(F.regexp_replace(F.col(text_col), r"\n$", ""), "\n")
    return files.select("*", F.array_join(F.slice(lines, start, most), "\n").alias("window"), (F.size(lines) >= start + most).alias("truncated"))
