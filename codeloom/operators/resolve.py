"""Name resolution: raw references to symbols, by staged equi-joins on a suffix index."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXCLUDED = ("namespace", "import")


def suffix_index(symbols: DataFrame, sep: str = ".") -> DataFrame:
    """text, exact_n, exact_id, suffix_n, suffix_id: how many symbols have a text as qualified name or as a dotted suffix of it, and the least id of these.

    One aggregation serves all lookups of the resolver; a name is the shortest suffix.
    """
    parts = symbols.where(~F.col("kind").isin(*EXCLUDED)).select("id", F.split("qualified_name", re.escape(sep)).alias("parts"))
    texts = parts.select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice("parts", k, F.size("parts")), sep))).alias("at", "text"))
    whole = F.col("at") == 0
    return texts.groupBy("text").agg(
        F.count_distinct(F.when(whole, F.col("id"))).alias("exact_n"), F.min(F.when(whole, F.col("id"))).alias("exact_id"), F.count_distinct("id").alias("suffix_n"), F.min("id").alias("suffix_id")
    )


def name_index(symbols: DataFrame) -> DataFrame:
    """name, ids: each simple and qualified name with the ids that carry it, in order."""
    return symbols.select("id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name")).where("name is not null").groupBy("name").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def resolution_facts(symbols: DataFrame) -> DataFrame:
    return symbols.select("id", "kind", F.coalesce("qualified_name", "name").alias("known_as"))


def resolve(refs: DataFrame, symbols: DataFrame, sep: str = ".") -> DataFrame:
    """Adds to_symbol_id, resolution, confidence.

    In order: the unique exact qualified name, the unique dotted suffix, the one of several candidates that lies
    within the scope, the only candidate; otherwise no target, ambiguous with candidates and unresolved without.
    References repeat few texts, so each distinct combination is resolved once.
    """
    keys = ["qualified_text", "scope_prefix", "to_name"]
    index = suffix_index(symbols, sep)
    asked = refs.select(*keys).distinct()
    side = lambda p: index.select(*[F.col(c).alias(f"{p}_{c}") for c in index.columns])
    met = asked.join(side("q"), F.col("qualified_text") == F.col("q_text"), "left")
    met = met.join(side("c"), F.col("to_name") == F.col("c_text"), "left")
    met = met.join(side("p"), F.concat("scope_prefix", F.lit(sep), "to_name") == F.col("p_text"), "left")
    scoped = (F.col("c_suffix_n") > 1) & (F.col("p_exact_n") == 1)
    target = F.when(F.col("q_exact_n") == 1, F.col("q_exact_id")).when(F.col("q_suffix_n") == 1, F.col("q_suffix_id")).when(scoped, F.col("p_exact_id")).when(F.col("c_suffix_n") == 1, F.col("c_suffix_id"))
    how = F.when((F.col("q_exact_n") == 1) | (F.col("q_suffix_n") == 1), "exact").when(scoped, "scoped").when(F.col("c_suffix_n") == 1, "unique-name").when(F.col("c_suffix_n") > 1, "ambiguous").otherwise("unresolved")
    done = met.select(*[F.col(k).alias(f"k_{k}") for k in keys], target.alias("to_symbol_id"), how.alias("resolution"))
    out = refs.join(done, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]).drop(*[f"k_{k}" for k in keys])
    return out.withColumn("confidence", F.when(F.col("resolution") == "exact", "high").when(F.col("resolution").isin("scoped", "unique-name"), "medium").otherwise("low"))


def resolution_counts(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """How many references each way of resolution has; references are counted by their texts before any join."""
    keys = ["qualified_text", "scope_prefix", "to_name"]
    counted = refs.groupBy(*keys).agg(F.count("*").alias("n"))
    return resolve(counted, symbols).groupBy("resolution").agg(F.sum("n").alias("n_refs"))


def contains_edges(symbols: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    return symbols.where("container_id is not null").select(
        F.concat_ws(":", F.lit("contains"), "container_id", "id").alias("id"), F.lit("contains").alias("kind"), F.col("container_id").alias("from_symbol_id"), F.col("id").alias("to_symbol_id"),
        F.col("file_path").alias("from_file_path"), null.alias("to_name"), null.alias("resolution"), null.alias("usage_kind"), F.lit(None).cast("int").alias("start_line"), F.lit("high").alias("confidence"),
    )


def relations(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Reference edges and containment edges."""
    made = resolve(refs, symbols).select(F.col("ref_id").alias("id"), F.lit("references").alias("kind"), "from_symbol_id", "to_symbol_id", "from_file_path", "to_name", "resolution", "usage_kind", "start_line", "confidence")
    return made.unionByName(contains_edges(symbols))
