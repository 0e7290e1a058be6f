"""The code graph derived from the driver's tables: symbols, raw references, files, imports, change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, qualified_name, file_path, container_id, start_line, language."""
    t = lambda n: read(spark, sf_dir, n)
    region, nation = t("region"), t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))

    def shaped(df: DataFrame, prefix: str, key: str, kind, name, qname, path, parent) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"{prefix}:"), _text(key)).alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), name.alias("name"), qname.alias("qualified_name"),
            path.alias("file_path"), (F.lit(None).cast("string") if parent is None else parent).alias("container_id"), (F.col(key) + 1).cast("int").alias("start_line"), F.lit("tpc").alias("language"),
        )

    key = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), _text(c))
    geo = F.concat(F.lit("geo/"), F.col("r_name"), F.lit(".geo"))
    package = F.concat_ws(".", "r_name", "n_name")
    # Nations are 25 rows, so the joins that follow broadcast a side of a fixed size.
    placed = F.broadcast(nation.select("n_nationkey", "n_name", "r_name"))
    supplier = t("supplier").join(placed, F.col("s_nationkey") == F.col("n_nationkey"))
    customer = t("customer").join(placed, F.col("c_nationkey") == F.col("n_nationkey"))
    top = F.when(F.col("c_custkey") % 10 == 0, "tests").otherwise("app")
    cus = F.concat(top, F.lit("/"), F.col("n_name"), F.lit("/customers.cus"))
    orders = t("orders").join(customer.select("c_custkey", "c_name", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    order_name = F.concat(F.lit("order_"), _text("o_orderkey"))
    part_kind = F.coalesce(*[F.when(F.col("p_type").startswith(p), k) for p, k in PART_KINDS], F.lit("variable"))
    brand, part_name = F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("_"))
    part_path = F.concat(F.when(F.col("p_size") % 10 == 0, "generated").otherwise("lib"), F.lit("/"), brand, F.lit("/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit(".prt"))
    made = [
        shaped(region, "ns", "r_regionkey", "namespace", F.col("r_name"), F.col("r_name"), geo, None),
        shaped(nation, "pk", "n_nationkey", "package", F.col("n_name"), package, geo, key("ns", "n_regionkey")),
        shaped(supplier, "cl", "s_suppkey", "class", F.col("s_name"), F.concat_ws(".", package, "s_name"), F.concat(F.lit("app/"), F.col("n_name"), F.lit("/suppliers.sup")), key("pk", "s_nationkey")),
        shaped(customer, "rc", "c_custkey", "record", F.col("c_name"), F.concat_ws(".", package, "c_name"), cus, key("pk", "c_nationkey")),
        shaped(t("part"), "fn", "p_partkey", part_kind, part_name, F.concat(brand, F.lit(".k"), _text("p_partkey"), F.lit("."), part_name), part_path, None),
        shaped(orders, "me", "o_orderkey", "method", order_name, F.concat_ws(".", "c_name", order_name), cus, key("rc", "o_custkey")),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


# The kind that a part's type stands for.
PART_KINDS = (("PROMO", "function"), ("ECONOMY", "class"), ("STANDARD", "interface"), ("SMALL", "struct"), ("MEDIUM", "enum"))


def raw_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, from_symbol_id, from_file_path, start_line, to_name, qualified_text, scope_prefix, usage_kind.

    Line items have no key; rows of one order are numbered by all of their columns, so equal rows may swap numbers.
    """
    from pyspark.sql import Window

    t = lambda n: read(spark, sf_dir, n)
    placed = F.broadcast(t("nation").select("n_nationkey", "n_name"))
    custs = t("customer").join(placed, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.when(F.col("c_custkey") % 10 == 0, "tests").otherwise("app"), F.lit("/"), F.col("n_name"), F.lit("/customers.cus")).alias("path"))
    paths = t("orders").join(custs, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "path", "o_orderpriority")
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    items = items.withColumn("n", F.row_number().over(own)).join(paths, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    part = t("part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".k"), _text("p_partkey")).alias("prefix"))
    supplier = t("supplier").select("s_suppkey", "s_name")
    open_ = F.col("l_linestatus") == "O"
    suffix = F.concat(F.lit("k"), _text("l_partkey"), F.lit("."), F.col("name"))
    head = [F.concat(F.lit("me:"), _text("l_orderkey")).alias("from_symbol_id"), F.col("path").alias("from_file_path"), F.col("l_linenumber").cast("int").alias("start_line")]
    none = F.lit(None).cast("string")
    calls = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("r:"), _text("l_orderkey"), F.lit(":"), _text("n"), F.lit(":p")).alias("ref_id"), *head, F.col("name").alias("to_name"),
        F.when(open_ & (F.col("l_returnflag") == "N"), suffix).when(open_, F.concat_ws(".", "prefix", "name")).alias("qualified_text"),
        F.when(F.col("l_returnflag") == "A", F.col("prefix")).alias("scope_prefix"), F.lit("invocation").alias("usage_kind"),
    )
    types = items.where("l_returnflag = 'R'").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("r:"), _text("l_orderkey"), F.lit(":"), _text("n"), F.lit(":s")).alias("ref_id"), *head, F.col("s_name").alias("to_name"), none.alias("qualified_text"), none.alias("scope_prefix"), F.lit("declared-type").alias("usage_kind")
    )
    members = paths.select(
        F.concat(F.lit("o:"), _text("o_orderkey")).alias("ref_id"), F.concat(F.lit("me:"), _text("o_orderkey")).alias("from_symbol_id"), F.col("path").alias("from_file_path"), F.lit(1).alias("start_line"),
        F.col("o_orderpriority").alias("to_name"), none.alias("qualified_text"), none.alias("scope_prefix"), F.lit("member-access").alias("usage_kind"),
    )
    return calls.unionByName(types).unionByName(members)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, content_hash."""
    top = F.when(F.col("doc_id") % 10 == 0, "tests/").when(F.col("doc_id") % 10 == 1, "migrations/").otherwise("app/")
    docs = read(spark, sf_dir, "documents").select(F.concat(top, F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), _text("doc_id"), F.lit(".txt")).alias("path"), F.col("lang").alias("language"), F.sha2("text", 256).alias("content_hash"))
    address = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    pages = read(spark, sf_dir, "pages").select(F.concat(address, F.lit("#"), _text("page_id")).alias("path"), F.lit("html").alias("language"), F.sha2("html", 256).alias("content_hash"))
    return docs.unionByName(pages)


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, to_name: every reference of a page's links, repeated as often as it occurs."""
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"""href=["']([^"'#?>]+)"""), F.lit(1))).alias("to_name"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, kind, intent, ts, seq of the change feed."""
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "rename").otherwise("modify")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), kind.alias("kind"), F.when(F.col("event_type") == "error", "remove").otherwise("reindex").alias("intent"), "ts", F.col("event_id").alias("seq"))


# The same views in DuckDB's dialect.
SYMBOLS_SQL = """
sym_nation as (select n_nationkey, n_name, n_regionkey, r_name from nation join region on n_regionkey = r_regionkey),
v_symbols as (
  select 'ns:' || r_regionkey as id, 'namespace' as kind, r_name as name, r_name as qualified_name, 'geo/' || r_name || '.geo' as file_path,
         cast(null as varchar) as container_id, cast(r_regionkey + 1 as int) as start_line, 'tpc' as language from region
  union all
  select 'pk:' || n_nationkey, 'package', n_name, r_name || '.' || n_name, 'geo/' || r_name || '.geo', 'ns:' || n_regionkey, cast(n_nationkey + 1 as int), 'tpc' from sym_nation
  union all
  select 'cl:' || s_suppkey, 'class', s_name, r_name || '.' || n_name || '.' || s_name, 'app/' || n_name || '/suppliers.sup', 'pk:' || s_nationkey, cast(s_suppkey + 1 as int), 'tpc'
  from supplier join sym_nation on s_nationkey = n_nationkey
  union all
  select 'rc:' || c_custkey, 'record', c_name, r_name || '.' || n_name || '.' || c_name,
         (case when c_custkey % 10 = 0 then 'tests' else 'app' end) || '/' || n_name || '/customers.cus', 'pk:' || c_nationkey, cast(c_custkey + 1 as int), 'tpc'
  from customer join sym_nation on c_nationkey = n_nationkey
  union all
  select 'fn:' || p_partkey,
         case when p_type like 'PROMO%' then 'function' when p_type like 'ECONOMY%' then 'class' when p_type like 'STANDARD%' then 'interface'
              when p_type like 'SMALL%' then 'struct' when p_type like 'MEDIUM%' then 'enum' else 'variable' end,
         replace(p_name, ' ', '_'), replace(p_brand, '#', '') || '.k' || p_partkey || '.' || replace(p_name, ' ', '_'),
         (case when p_size % 10 = 0 then 'generated' else 'lib' end) || '/' || replace(p_brand, '#', '') || '/' || replace(lower(p_type), ' ', '_') || '.prt', null, cast(p_partkey + 1 as int), 'tpc' from part
  union all
  select 'me:' || o_orderkey, 'method', 'order_' || o_orderkey, c_name || '.order_' || o_orderkey,
         (case when c_custkey % 10 = 0 then 'tests' else 'app' end) || '/' || n_name || '/customers.cus', 'rc:' || o_custkey, cast(o_orderkey + 1 as int), 'tpc'
  from orders join customer on o_custkey = c_custkey join sym_nation on c_nationkey = n_nationkey
)"""

REFS_SQL = """
ref_paths as (select o_orderkey, o_orderpriority, (case when c_custkey % 10 = 0 then 'tests' else 'app' end) || '/' || n_name || '/customers.cus' as path
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
ref_items as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as n
  from lineitem left join ref_paths on l_orderkey = o_orderkey),
ref_parts as (select p_partkey, replace(p_name, ' ', '_') as name, replace(p_brand, '#', '') || '.k' || p_partkey as prefix from part),
v_raw_refs as (
  select 'r:' || l_orderkey || ':' || n || ':p' as ref_id, 'me:' || l_orderkey as from_symbol_id, path as from_file_path, cast(l_linenumber as int) as start_line, name as to_name,
         case when l_linestatus = 'O' and l_returnflag = 'N' then 'k' || l_partkey || '.' || name when l_linestatus = 'O' then prefix || '.' || name end as qualified_text,
         case when l_returnflag = 'A' then prefix end as scope_prefix, 'invocation' as usage_kind
  from ref_items join ref_parts on l_partkey = p_partkey
  union all
  select 'r:' || l_orderkey || ':' || n || ':s', 'me:' || l_orderkey, path, cast(l_linenumber as int), s_name, null, null, 'declared-type'
  from ref_items join supplier on l_suppkey = s_suppkey where l_returnflag = 'R'
  union all
  select 'o:' || o_orderkey, 'me:' || o_orderkey, path, 1, o_orderpriority, null, null, 'member-access' from ref_paths
)"""

FILES_SQL = """
v_files as (
  select (case when doc_id % 10 = 0 then 'tests/' when doc_id % 10 = 1 then 'migrations/' else 'app/' end) || source || '/' || lang || '/doc_' || doc_id || '.txt' as path, lang as language, sha256(text) as content_hash from documents
  union all
  select regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '#' || page_id, 'html', sha256(html) from pages
)"""

IMPORTS_SQL = """
v_imports as (select page_id, unnest(regexp_extract_all(html, 'href=["'']([^"''#?>]+)', 1)) as to_name from pages)"""

EVENTS_SQL = """
v_events as (select user_id as path, case event_type when 'signup' then 'create' when 'error' then 'delete' when 'purchase' then 'rename' else 'modify' end as kind,
  case when event_type = 'error' then 'remove' else 'reindex' end as intent, ts, event_id as seq from events)"""

# The resolver over the views: unique exact name, unique dotted suffix, one candidate within a scope, unique name, else none.
RELATIONS_SQL = f"""{SYMBOLS_SQL},{REFS_SQL},
idx_exact as (select qualified_name as t, count(distinct id) as n, min(id) as id from v_symbols where kind not in ('namespace', 'import') group by 1),
idx_parts as (select id, string_split(qualified_name, '.') as parts from v_symbols where kind not in ('namespace', 'import')),
idx_suffix as (select array_to_string(parts[k:], '.') as t, count(distinct id) as n, min(id) as id from (select id, parts, unnest(range(1, len(parts) + 1)) as k from idx_parts) group by 1),
resolved as (
  select r.*, case when e.n = 1 then e.id when s.n = 1 then s.id when c.n > 1 and p.n = 1 then p.id when c.n = 1 then c.id end as to_symbol_id,
         case when e.n = 1 or s.n = 1 then 'exact' when c.n > 1 and p.n = 1 then 'scoped' when c.n = 1 then 'unique-name' when c.n > 1 then 'ambiguous' else 'unresolved' end as resolution
  from v_raw_refs r left join idx_exact e on r.qualified_text = e.t left join idx_suffix s on r.qualified_text = s.t
  left join idx_suffix c on r.to_name = c.t left join idx_exact p on r.scope_prefix || '.' || r.to_name = p.t
),
relations as (
  select ref_id as id, 'references' as kind, from_symbol_id, to_symbol_id, from_file_path, to_name, resolution, usage_kind, start_line,
         case resolution when 'exact' then 'high' when 'scoped' then 'medium' when 'unique-name' then 'medium' else 'low' end as confidence from resolved
  union all
  select 'contains:' || container_id || ':' || id, 'contains', container_id, id, file_path, null, null, null, null, 'high' from v_symbols where container_id is not null
)"""
