"""What a name holds at a place of a file: innermost bindings, conservative declared types, members of types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def declared_types(sites: DataFrame, bindings: DataFrame) -> DataFrame:
    """site_id, type_name of sites (site_id, file, name, at) where one type is proven, null elsewhere.

    bindings: file, name, type_name, scope_start, scope_end, annotated, frame_start, frame_end, parameter. The shortest
    typed binding around a site decides, unless another binding of the name at the same span, or one nested in the span
    within its frame, has another type or none.
    """
    b = bindings.select(*[F.col(c).alias(f"b_{c}") for c in bindings.columns])
    covering = sites.join(b, (F.col("file") == F.col("b_file")) & (F.col("name") == F.col("b_name")) & (F.col("b_scope_start") <= F.col("at")) & (F.col("at") <= F.col("b_scope_end")))
    span = F.col("b_scope_end") - F.col("b_scope_start")
    best = F.min(F.when(F.col("b_type_name").isNotNull(), F.struct(span.alias("span"), "b_scope_start", "b_scope_end", "b_type_name", "b_frame_start", "b_frame_end")))
    held = F.collect_set(F.struct("b_scope_start", "b_scope_end", F.coalesce("b_type_name", F.lit("")).alias("t")))
    proven = covering.groupBy("site_id", "file", "name").agg(best.alias("best"), held.alias("held")).where("best is not null")
    proven = proven.where(~F.exists("held", lambda h: (h["b_scope_start"] == F.col("best.b_scope_start")) & (h["b_scope_end"] == F.col("best.b_scope_end")) & (h["t"] != F.col("best.b_type_name"))))
    nested = (F.col("b_scope_start") >= F.col("best.b_scope_start")) & (F.col("b_scope_end") <= F.col("best.b_scope_end")) & ((F.col("b_scope_start") != F.col("best.b_scope_start")) | (F.col("b_scope_end") != F.col("best.b_scope_end")))
    framed = (F.col("b_frame_start") == F.col("best.b_frame_start")) & (F.col("b_frame_end") == F.col("best.b_frame_end"))
    contested = (F.col("file") == F.col("b_file")) & (F.col("name") == F.col("b_name")) & nested & framed & ~F.col("b_type_name").eqNullSafe(F.col("best.b_type_name"))
    kept = proven.join(b, contested, "left_anti").select(F.col("site_id").alias("s"), F.col("best.b_type_name").alias("type_name"))
    return sites.select("site_id").join(kept, F.col("site_id") == F.col("s"), "left").select("site_id", "type_name")


def bound(sites: DataFrame, bindings: DataFrame, but_parameters: bool = False) -> DataFrame:
    """The sites whose name some binding covers."""
    b = (bindings.where("not parameter") if but_parameters else bindings).select(F.col("file").alias("bf"), F.col("name").alias("bn"), "scope_start", "scope_end")
    return sites.join(b, (F.col("file") == F.col("bf")) & (F.col("name") == F.col("bn")) & (F.col("scope_start") <= F.col("at")) & (F.col("at") <= F.col("scope_end")), "left_semi")


TYPE_KINDS = ("class", "record", "interface", "struct", "enum", "type")


def unique_types(symbols: DataFrame, strict: bool) -> DataFrame:
    """name, type_id, type_name (qualified): names that one type alone has; strict: and that nothing else has."""
    is_type = F.col("kind").isin(*TYPE_KINDS)
    grouped = symbols.where("kind <> 'import'").groupBy("name").agg(F.count_if(is_type).alias("types"), F.count_if(~is_type).alias("others"), F.min(F.when(is_type, F.struct("id", "qualified_name"))).alias("t"))
    kept = grouped.where((F.col("types") == 1) & ((F.col("others") == 0) | F.lit(not strict)))
    return kept.select("name", F.col("t.id").alias("type_id"), F.col("t.qualified_name").alias("type_name"))


def members(asked: DataFrame, symbols: DataFrame, sep: str = ".") -> DataFrame:
    """site_id, member_id for asked (site_id, type_name, member): the only symbol of the qualified name."""
    named = symbols.groupBy(F.col("qualified_name").alias("q")).agg(F.count("*").alias("n"), F.min("id").alias("member_id")).where("n = 1")
    return asked.join(named, F.concat("type_name", F.lit(sep), "member") == F.col("q")).select("site_id", "member_id")


def enclosing_members(asked: DataFrame, symbols: DataFrame, sep: str = ".") -> DataFrame:
    """site_id, member_id for asked (site_id, inside, member): the member of the deepest container of `inside` that has it alone."""
    parts = F.split("inside", f"[{sep}]")
    prefixes = asked.select("site_id", "member", F.explode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), sep).alias("type_name")))).alias("p")).select("site_id", "member", "p.*")
    named = symbols.groupBy(F.col("qualified_name").alias("q")).agg(F.count("*").alias("n"), F.min("id").alias("member_id")).where("n = 1")
    met = prefixes.join(named, F.concat("type_name", F.lit(sep), "member") == F.col("q"))
    return met.groupBy("site_id").agg(F.max_by("member_id", "depth").alias("member_id"))
