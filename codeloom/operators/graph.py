"""Counts, neighbours and groups over the relation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

TRUSTED = ("exact", "scoped")
CALLS = ("invocation", "object-creation")


def trusted_in_degree(relations: DataFrame) -> DataFrame:
    """to_symbol_id, degree over exact and scoped references."""
    return relations.where((F.col("kind") == "references") & F.col("resolution").isin(*TRUSTED)).groupBy("to_symbol_id").agg(F.count("*").alias("degree"))


def top_trusted(relations: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
    """The most referenced ids; ids without a symbol are dropped after the limit, so fewer may come back."""
    top = trusted_in_degree(relations).orderBy(F.desc("degree"), "to_symbol_id").limit(limit)
    return symbols.join(F.broadcast(top), F.col("id") == F.col("to_symbol_id")).select("id", "name", "kind", "degree")


def child_counts(symbols: DataFrame, limit: int = 1000) -> DataFrame:
    return symbols.where("container_id is not null").groupBy("container_id").agg(F.count("*").alias("n_children")).orderBy(F.desc("n_children"), "container_id").limit(limit)


def cross_file_counts(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """from_path, to_path, n of references into other files."""
    named = symbols.select(F.col("id").alias("target"), F.col("file_path").alias("to_path"))
    # Edges are counted by target before the join, so that the join moves a row for each pair and not for each edge.
    counted = relations.where("kind = 'references' and to_symbol_id is not null").groupBy("from_file_path", "to_symbol_id").agg(F.count("*").alias("n"))
    met = counted.join(named, F.col("to_symbol_id") == F.col("target")).where("from_file_path <> to_path")
    return met.groupBy(F.col("from_file_path").alias("from_path"), "to_path").agg(F.sum("n").alias("n_refs"))


def cross_file_sites(relations: DataFrame, symbols: DataFrame, from_path: str, to_path: str, limit: int = 10) -> DataFrame:
    """Example sites between two files, exact ones first, then by line and id."""
    named = symbols.where(F.col("file_path") == to_path).select(F.col("id").alias("target"))
    met = relations.where((F.col("from_file_path") == from_path) & (F.col("kind") == "references") & F.col("start_line").isNotNull()).join(named, F.col("to_symbol_id") == F.col("target"))
    return met.orderBy(F.when(F.col("resolution") == "exact", 0).otherwise(1), "start_line", "id").limit(limit).select("id", "start_line", "resolution")


def one_hop(relations: DataFrame, ids: list[str]) -> DataFrame:
    """Edges into and out of a few symbols, with direction and the symbol's id as key."""
    into = relations.where(F.col("to_symbol_id").isin(ids)).withColumn("direction", F.lit("in")).withColumn("key", F.col("to_symbol_id"))
    out = relations.where(F.col("from_symbol_id").isin(ids)).withColumn("direction", F.lit("out")).withColumn("key", F.col("from_symbol_id"))
    return into.unionByName(out)


def edge_order() -> list:
    """Best evidence first."""
    return [F.col("kind"), N.resolution_rank("resolution"), N.confidence_rank("confidence"), F.coalesce("start_line", F.lit(0)), F.col("id")]


def groups(hop: DataFrame, sites: int = 3) -> DataFrame:
    """For each key, direction, far end and call-ness: number of sites, the first few of them, how many more there are."""
    far = F.when(F.col("direction") == "in", F.col("from_symbol_id")).otherwise(F.coalesce("to_symbol_id", F.concat(F.lit("~"), "to_name")))
    keyed = hop.withColumn("far", F.coalesce(far, F.lit("~None"))).withColumn("is_call", F.coalesce(F.col("usage_kind").isin(*CALLS), F.lit(False)))
    by = ["key", "direction", "far", "is_call"]
    ranked = keyed.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*edge_order())))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n_sites"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= sites, F.struct("rn", "id")))), lambda x: x["id"]), ",").alias("first_sites"),
        F.greatest(F.count("*") - sites, F.lit(0)).alias("more"),
    )


def dependencies_page(relations: DataFrame, symbol_id: str, limit: int, offset: int = 0) -> DataFrame:
    found = relations.where(F.col("from_symbol_id") == symbol_id).orderBy("id").limit(limit + offset)
    return found.offset(offset) if offset else found


def confirmed(relations: DataFrame, symbol_id: str) -> DataFrame:
    """Resolved references to a symbol in reading order, labelled by their evidence."""
    found = relations.where((F.col("kind") == "references") & (F.col("to_symbol_id") == symbol_id))
    return found.select("id", "from_file_path", "start_line", N.edge_trust("kind", "resolution").alias("match")).orderBy("from_file_path", F.coalesce("start_line", F.lit(0)), "id")


def possible(relations: DataFrame, name: str) -> DataFrame:
    """References without a target that use a name."""
    found = relations.where((F.col("kind") == "references") & F.col("to_symbol_id").isNull() & (F.col("to_name") == name))
    return found.select("id", "from_file_path", "start_line", "resolution").orderBy("from_file_path", F.coalesce("start_line", F.lit(0)), "id")


def reference_counters(relations: DataFrame, by: str = "to_name") -> DataFrame:
    """Per name: references by evidence."""
    one = lambda cond: F.count_if(cond)
    r = F.col("resolution")
    return relations.where("kind = 'references'").groupBy(by).agg(
        one(r == "exact").alias("n_exact"), one(r == "scoped").alias("n_scoped"), one(F.col("to_symbol_id").isNotNull() & ~r.isin(*TRUSTED)).alias("n_heuristic"), one(r == "ambiguous").alias("n_ambiguous"), one(r == "unresolved").alias("n_unresolved")
    )


def related(relations: DataFrame, symbols: DataFrame, symbol_id: str, limit: int = 50) -> DataFrame:
    """Symbols near one: it refers to them (1), they refer to it (2), siblings (3), equal stems (4); the least rank of each."""
    me = symbols.where(F.col("id") == symbol_id).select(F.col("container_id").alias("own_container"), N.name_stem("name").alias("own_stem"))
    refs = relations.where("kind = 'references'")
    out = refs.where(F.col("from_symbol_id") == symbol_id).select(F.col("to_symbol_id").alias("other"), F.lit(1).alias("rank"))
    into = refs.where(F.col("to_symbol_id") == symbol_id).select(F.col("from_symbol_id").alias("other"), F.lit(2).alias("rank"))
    # `me` is one row.
    siblings = symbols.join(F.broadcast(me), F.col("container_id") == F.col("own_container")).select(F.col("id").alias("other"), F.lit(3).alias("rank"))
    stems = symbols.join(F.broadcast(me), N.name_stem("name") == F.col("own_stem")).select(F.col("id").alias("other"), F.lit(4).alias("rank"))
    best = out.unionByName(into).unionByName(siblings).unionByName(stems).where(F.col("other").isNotNull() & (F.col("other") != symbol_id)).groupBy("other").agg(F.min("rank").alias("rank"))
    return symbols.join(best, F.col("id") == F.col("other")).select("id", "name", "rank").orderBy("rank", "name", "id").limit(limit)


def dependents(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Files with a reference to one of the names."""
    return relations.where("kind = 'references'").join(names.select(F.col("name").alias("to_name")), "to_name", "left_semi").select(F.col("from_file_path").alias("path")).distinct()


def unresolved_by_name(relations: DataFrame, name: str, limit: int) -> DataFrame:
    """The first references without target that use a name, each with the exact total."""
    found = relations.where((F.col("kind") == "references") & F.col("to_symbol_id").isNull() & (F.col("to_name") == name))
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.orderBy("from_file_path", F.coalesce("start_line", F.lit(0)), "id").limit(limit).select("id", "from_file_path", "start_line").join(F.broadcast(total))


def compact_context(relations: DataFrame, symbols: DataFrame, symbol_id: str, limit: int = 20) -> DataFrame:
    """Names that a symbol's first dependencies lead to, each once, by the place of its first edge."""
    first = dependencies_page(relations.where("kind = 'references'"), symbol_id, limit).select("id", "to_symbol_id", "to_name")
    named = symbols.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    met = named.join(F.broadcast(first), F.col("target") == F.col("to_symbol_id"), "right")  # twenty rows
    return met.groupBy(F.coalesce("target_name", "to_name").alias("name")).agg(F.min("id").alias("first_edge"))


def import_matches(imports: DataFrame, files: DataFrame) -> DataFrame:
    """page_id, to_name, path: import texts whose segments end a file's segments, met on the last segment."""
    asked = imports.select("page_id", "to_name").distinct().withColumn("i", N.import_segments("to_name")).where(F.size("i") > 0)
    held = files.select("path", N.path_segments("path").alias("f")).where(F.size("f") > 0)
    met = asked.join(held, F.element_at("i", -1) == F.element_at("f", -1))
    return met.where(N.ends_with(F.col("f"), F.col("i"))).select("page_id", "to_name", "path")


def project_totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: files, symbols, ranked symbols, namespaces, languages."""
    s = symbols.agg(F.count("*").alias("n_symbols"), F.count_if(N.kind_rank("kind") < len(N.KINDS)).alias("n_ranked"), F.count_distinct(F.when(F.col("kind") == "namespace", F.col("name"))).alias("n_namespaces"))
    f = files.agg(F.count("*").alias("n_files"), F.count_distinct("language").alias("n_languages"))
    return s.join(F.broadcast(f))  # one row each


def outline_page(symbols: DataFrame, path: str, limit: int) -> DataFrame:
    """The first symbols of a file, and for each whether its container is on the page (else it is a root)."""
    page = symbols.where(F.col("file_path") == path).orderBy("start_line", "id").limit(limit)
    up = page.select(F.col("id").alias("up"))
    return page.join(F.broadcast(up), F.col("container_id") == F.col("up"), "left").select("id", "name", F.col("up").alias("parent"))


def windows_of_tokens(tokens: DataFrame, symbols: DataFrame, most_lines: int) -> DataFrame:
    """token, reason, start, end of continuation requests (token, handle, line, fingerprint, expected, symbol_start, symbol_end): null reason where lines can be served."""
    ended = F.least("symbol_end", F.col("line") + most_lines - 1)
    reason = F.when(F.col("handle").isNull(), "invalid").when(F.col("symbol_end").isNull(), "unknown-symbol").when(F.col("fingerprint") != F.col("expected"), "stale").when((F.col("line") <= F.col("symbol_start")) | (F.col("line") > F.col("symbol_end")), "out-of-range")
    return tokens.select("token", reason.alias("reason"), F.when(reason.isNull(), F.col("line")).alias("start"), F.when(reason.isNull(), ended).alias("end"))
