"""Orientation: several terms against names and paths, merged by symbol, ranked production-first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from . import areas, graph, search

# Bounds of the operator and the order of matches.
MOST_TERMS, PAGE, CROWDED_PAGE, PATHS = 12, 25, 200, 20
MATCHES, WEAK, CENTRAL = 12, 8, 10
EXACT, PREFIX, INSIDE, PATH = 0, 1, 2, 3
RARE = 1 << 60


@dataclass
class Found:
    """Candidates (symbol columns, tier, terms, name_terms, rarest), totals by term, crowded and unmatched terms."""

    candidates: DataFrame
    totals: dict[str, int]
    crowded: list[str]
    unmatched: list[str]


def best_declarations(symbols: DataFrame) -> DataFrame:
    """For each file its first declaration of the best kind."""
    ranked = symbols.where("kind <> 'import'").withColumn("rank", N.kind_rank("kind"))
    own = Window.partitionBy("file_path").orderBy((F.col("rank") == len(N.KINDS)).cast("int"), "rank", "start_line", "id")
    return ranked.withColumn("rn", F.row_number().over(own)).where("rn = 1").drop("rn", "rank")


def match_terms(spark: SparkSession, symbols: DataFrame, files: DataFrame, terms: list[str], scope: str | None = None) -> Found:
    """The union of three channels for each term: definitions, a page of names, files with their best declaration.

    Terms are a dozen at most and pages bounded, so only counts and bounded pages are computed for each.
    """
    wanted = list(dict.fromkeys(t.strip() for t in terms if t.strip()))
    if len(wanted) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms")
    declared = search.filtered(symbols, declarations_only=True, scope=scope)
    held = {t: F.coalesce(N.fold("name").contains(N.fold_text(t)), F.lit(False)) | F.coalesce(N.fold("qualified_name").contains(N.fold_text(t)), F.lit(False)) for t in wanted}
    counted = declared.agg(F.count("*").alias("_all"), *[F.count_if(c).alias(f"_{i}") for i, c in enumerate(held.values())]).first()
    totals = {t: counted[f"_{i}"] for i, t in enumerate(wanted)}
    limit = max(25, counted["_all"] // 100)
    crowded = [t for t in wanted if totals[t] > limit]
    columns = ["id", "kind", "name", "qualified_name", "file_path", "start_line"]
    best = best_declarations(symbols).select(*columns)
    found = None
    for t in wanted:
        same = (F.col("name") == t) | F.coalesce(F.col("qualified_name") == t, F.lit(False))
        exact = search.definitions(declared, t).select(*columns, F.lit(EXACT).alias("tier"), F.lit(True).alias("by_name"))
        page = search.search_page(declared, t, limit=CROWDED_PAGE if t in crowded else PAGE)
        tier = F.when(same, EXACT).when(N.prefix_at_word_start("name", t.lower()), PREFIX).otherwise(INSIDE)
        named = page.select(*columns, tier.alias("tier"), F.lit(True).alias("by_name"))
        if t in crowded:
            named = named.where((F.col("tier") == EXACT) | N.subtoken_match("name", t.lower()))
        paths = search.files_matching(files.where(N.in_scope("path", scope)), t, PATHS).select(F.col("path").alias("p"))
        through = best.join(F.broadcast(paths), F.col("file_path") == F.col("p")).select(*columns, F.lit(PATH).alias("tier"), F.lit(False).alias("by_name"))
        one = exact.unionByName(named).unionByName(through).withColumn("term", F.lit(t)).withColumn("total", F.when(F.col("by_name"), F.lit(totals[t])).otherwise(F.lit(RARE)))
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = symbols.limit(0).select(*columns, F.lit(0).alias("tier"), F.lit(True).alias("by_name"), F.lit("").alias("term"), F.lit(0).alias("total"))
    merged = found.groupBy(*columns).agg(F.min("tier").alias("tier"), F.count_distinct("term").alias("n_terms"), F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"), F.min("total").alias("rarest"))
    seen = {r["term"] for r in found.select("term").distinct().collect()}
    return Found(merged, totals, crowded, [t for t in wanted if t not in seen and t not in crowded])


def ranked(found: DataFrame, relations: DataFrame, symbols: DataFrame, limit: int = MATCHES + WEAK) -> DataFrame:
    """The candidates in their order, with place, degree of trusted references and whether they are entry points."""
    # Candidates are a bounded set of pages, entry points ten.
    wanted = found.select(F.col("id").alias("to_symbol_id"))
    degree = graph.trusted_in_degree(relations.join(F.broadcast(wanted), "to_symbol_id", "left_semi"))
    entries = areas.entrypoints(symbols).select(F.col("id").alias("e")).distinct()
    met = found.join(F.broadcast(degree), F.col("id") == F.col("to_symbol_id"), "left").join(F.broadcast(entries), F.col("id") == F.col("e"), "left")
    met = met.withColumn("trusted", F.coalesce("degree", F.lit(0))).withColumn("entry", F.col("e").isNotNull())
    order = [
        N.is_test_path("file_path").cast("int"), N.is_generated_path("file_path").cast("int"), F.desc("n_terms"), F.col("tier"), F.col("rarest"), F.desc(F.least("trusted", F.lit(CENTRAL))),
        (~F.col("entry")).cast("int"), N.kind_rank("kind"), F.length("name"), F.col("file_path"), F.col("start_line"), F.col("id"),
    ]
    top = met.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "id", "name", "kind", "file_path", "start_line", "tier", "n_terms", "terms", "trusted", "entry")
