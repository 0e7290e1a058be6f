"""Per-group ranking: diverse top symbols, first declarations of files, outlines, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N


def diverse_top(symbols: DataFrame, limit: int) -> DataFrame:
    """At most max(2, limit // kinds) symbols of each ranked kind, refilled from the rest in (rank, name, path) order, sorted again."""
    ranked = symbols.withColumn("rank", N.kind_rank("kind")).where(F.col("rank") < len(N.KINDS))
    own = Window.partitionBy("kind").orderBy("name", "file_path", "start_line", "id")
    kept = ranked.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= limit)
    kinds = F.size(F.collect_set("kind").over(Window.partitionBy(F.lit(1))))  # over limit x kinds rows at most
    kept = kept.withColumn("over", (F.col("rn") > F.greatest(F.lit(2), F.floor(F.lit(limit) / kinds))).cast("int"))
    return kept.orderBy("over", "rank", "name", "file_path", "start_line", "id").limit(limit).select("id", "kind", "name", "file_path", "rank").orderBy("rank", "name", "file_path", "id")


def declared_cascade(symbols: DataFrame, limit: int) -> DataFrame:
    """The first symbols by rank of kind, name, path, line."""
    return symbols.withColumn("rank", N.kind_rank("kind")).where(F.col("rank") < len(N.KINDS)).orderBy("rank", "name", "file_path", "start_line", "id").limit(limit).select("id", "kind", "name")


def first_of_files(symbols: DataFrame, limit: int) -> DataFrame:
    """The first top-level symbols of each file, by line and id, with the file's exact total.

    Totals are counted apart, so the ranking can drop rows early (a group limit below its shuffle).
    """
    top = symbols.where("container_id is null")
    totals = top.groupBy(F.col("file_path").alias("f")).agg(F.count("*").alias("total"))
    ranked = top.withColumn("rn", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id"))).where(F.col("rn") <= limit)
    return ranked.join(totals, F.col("file_path") == F.col("f")).select("file_path", "id", "rn", "total")


def depths(symbols: DataFrame) -> DataFrame:
    """id, depth, root of each symbol along its containers. As many joins as the deepest nesting; a cycle is an error."""
    parents = symbols.select(F.col("id").alias("p_id"), F.col("container_id").alias("p_up"))
    known = symbols.select("id", F.col("container_id").alias("up"), F.col("id").alias("root"), F.lit(0).alias("depth"))
    done = None
    while True:
        over = known.where("up is null")
        done = over if done is None else done.unionByName(over)
        known = known.where("up is not null").join(parents, F.col("up") == F.col("p_id")).select("id", F.col("p_up").alias("up"), F.col("p_id").alias("root"), (F.col("depth") + 1).alias("depth"))
        left = known.agg(F.count("*").alias("n"), F.min(F.when(F.col("root") == F.col("id"), F.col("id"))).alias("again")).head()
        if left["again"] is not None:  # met on each cycle after as many joins as it has symbols
            raise ValueError(f"a symbol contains itself: {left['again']}")
        if not left["n"]:
            break
    return done.select("id", "depth", "root")


def children(symbols: DataFrame, limit: int) -> DataFrame:
    """For each container: its number of children and the names of the first by line and id."""
    ranked = symbols.where("container_id is not null").withColumn("rn", F.row_number().over(Window.partitionBy("container_id").orderBy("start_line", "id")))
    return ranked.groupBy("container_id").agg(
        F.count("*").alias("n_children"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= limit, F.struct("rn", "name")))), lambda x: x["name"]), ",").alias("first_children")
    )


def innermost(points: DataFrame, spans: DataFrame, rank: Column | None = None) -> DataFrame:
    """For points (file, point_id, at): the shortest span (file, span_id, start, end) that holds it, both ends included; null without one.

    rank: a number of the spans' columns that decides instead of length, start and id; of spans of one rank the smallest id.
    """
    joined = points.join(spans, (points["file"] == spans["file"]) & (F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end")), "left")
    order = [F.col("end") - F.col("start"), F.col("start")] if rank is None else [rank]
    best = F.min_by("span_id", F.when(F.col("span_id").isNotNull(), F.struct(*order, F.col("span_id"))))
    return joined.groupBy("point_id").agg(best.alias("span_id"))
