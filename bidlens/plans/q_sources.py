"""Registered queries: sources, cleaning, sinks."""

from pyspark.sql import functions as F

from bidlens.functions import text as X
from bidlens.plans.q_analytics import as_of
from bidlens.plans.q_text import norm_sql
from bidlens.plans.registry import query, shared
from bidlens.sources import cleaning as C
from bidlens.sources import files as S
from bidlens.session import work_path

DEDUP = "string_split(attributes_raw, '; ')[1] || '; ' || string_split(attributes_raw, '; ')[2]"


@query("read_catalog", f"SELECT item_id, name, category, {DEDUP} AS attributes FROM t_items")
def read_catalog(t):
    path = work_path(t.spark, "catalog-csv")
    t.catalog_base.select("item_id", "name", "category", "attributes_raw").write.option("sep", ";").csv(path)
    return S.read_catalog(t.spark, path)


@query("read_contracts", """
SELECT contract_id, item_id, CAST(contract_date AS VARCHAR) AS contract_date, cents / 100.0 AS cost, CAST(customer_id AS VARCHAR) AS customer_inn, customer_name,
  customer_region, CAST(supplier_id AS VARCHAR) AS supplier_inn FROM t_contracts
""")
def read_contracts(t):
    path = work_path(t.spark, "contracts-csv")
    none = F.lit(None).cast("string")
    t.contracts.select(
        none.alias("p"), "contract_id", "item_id", "contract_date", "cost", "customer_id", "customer_name", "customer_region",
        "supplier_id", none.alias("s"), none.alias("r"),
    ).write.option("sep", ";").csv(path)
    return S.read_contracts(t.spark, path).drop("purchase_name", "supplier_name", "supplier_region")


@query("harmonise_columns", "SELECT CAST(item_id AS VARCHAR) AS id, name, category, attributes_raw AS attributes FROM t_items")
def harmonise_columns(t):
    odd = t.catalog_base.select(
        F.col("item_id").cast("string").alias(" STE_ID "), F.col("name").alias("Naimenovanie tovara"),
        F.col("category").alias("Kategoriya"), F.col("attributes_raw").alias("product attrs"),
    )
    return S.harmonise_columns(odd, S.CATALOG_ALIASES)


@query("dedup_catalog", """
SELECT item_id, ord, line, supplier_id, cost FROM (SELECT l_partkey AS item_id, l_orderkey AS ord, l_linenumber AS line, l_suppkey AS supplier_id,
  l_extendedprice AS cost, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1
""")
def dedup_catalog(t):
    rows = t.raw("lineitem").select(
        F.col("l_partkey").alias("item_id"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supplier_id"), F.col("l_extendedprice").alias("cost"),
    )
    return C.first_by_key(rows, "item_id", ["ord", "line", "supplier_id", "cost"])


@query("dedup_contracts", """
SELECT contract_id, item_id, supplier_id, cost, n AS copies FROM (SELECT l_orderkey || '-' || l_linenumber AS contract_id, l_partkey AS item_id, l_suppkey AS supplier_id,
  l_extendedprice AS cost, row_number() OVER w AS rn, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice)) WHERE rn = 1
""")
def dedup_contracts(t):
    rows = t.raw_contract_rows
    copies = rows.groupBy("contract_id").agg(F.count("*").alias("copies"))
    return C.first_by_key(rows, "contract_id", ["item_id", "supplier_id", "cost"]).join(copies, "contract_id")


@query("dedup_attributes", f"SELECT item_id, {DEDUP} AS attributes FROM t_items")
def dedup_attributes(t):
    return t.catalog_base.select("item_id", C.dedup_attributes(F.col("attributes_raw")).alias("attributes"))


@query("parse_attributes", """
SELECT item_id, 'brand' AS key, creator_user_id AS value FROM t_items
UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part
UNION ALL SELECT event_id, 'k', json_extract_string(props, '$.k') FROM events
UNION ALL SELECT vec_id, 'raw', 'label ' || label FROM embeddings
""")
def parse_attributes(t):
    texts = t.catalog_base.select("item_id", F.col("attributes_raw").alias("a")).union(
        t.raw("events").select("event_id", "props")
    ).union(t.raw("embeddings").select("vec_id", F.concat(F.lit("label "), "label")))
    return texts.select("item_id", F.explode(C.parse_attributes(F.col("a"))).alias("key", "value"))


shared("t_texts_typed", """
SELECT o_orderkey, printf('%.2f', o_totalprice) AS total, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS status FROM orders
""")


def text_orders(t):
    return t.raw("orders").select(
        "o_orderkey", F.format_string("%.2f", "o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("status"),
    )


@query("typed_cast", """
SELECT o_orderkey, CAST(trunc(CAST(total AS DOUBLE)) AS BIGINT) AS total, TRY_CAST(priority AS DOUBLE) AS priority,
  CAST(TRY_CAST(day AS DATE) AS VARCHAR) AS day, CAST(TRY_CAST(status AS DATE) AS VARCHAR) AS status FROM t_texts_typed
""")
def typed_cast(t):
    return C.typed_cast(text_orders(t), ints=["total"], numbers=["priority"], days=["day", "status"])


@query("ingest_report", """
SELECT count(*) AS rows_in, count(*) FILTER (TRY_CAST(total AS DOUBLE) IS NULL) AS rejected_total,
  count(*) FILTER (TRY_CAST(priority AS DOUBLE) IS NULL) AS rejected_priority, count(*) FILTER (TRY_CAST(day AS DATE) IS NULL) AS rejected_day FROM t_texts_typed
""")
def ingest_report(t):
    raw = text_orders(t)
    typed = C.typed_cast(raw, ints=["total"], numbers=["priority"], days=["day"])
    return C.ingest_report(raw, typed, "o_orderkey", ["total", "priority", "day"])


@query("profiles_from_contracts", """
SELECT DISTINCT customer_id AS user_id, customer_name AS name, customer_region AS region FROM t_contracts
WHERE customer_id NOT IN (SELECT user_id FROM events)
""")
def profiles_from_contracts(t):
    return C.profiles_from_contracts(t.contracts, t.raw("events").select("user_id"))


INCOMING = """
SELECT c_custkey + CASE WHEN c_mktsegment = 'MACHINERY' THEN 10000000 ELSE 0 END AS user_id, CASE WHEN c_acctbal > 3000 THEN upper(c_name) ELSE '' END AS name,
  CAST(NULL AS {text}) AS region, CASE WHEN c_nationkey > 12 THEN 'FURNITURE' END AS industry,
  CASE WHEN c_acctbal < 500 THEN {array} END AS interests FROM customer
"""


@query("profile_upsert", f"""
WITH n AS ({INCOMING.format(text='VARCHAR', array="['MACHINERY', 'BUILDING']")}),
  m AS (SELECT *, coalesce(interests, CASE WHEN industry IS NOT NULL THEN [industry] END) AS wanted FROM n)
SELECT coalesce(e.user_id, m.user_id) AS user_id, coalesce(nullif(m.name, ''), e.name) AS name, coalesce(m.region, e.region) AS region,
  coalesce(m.industry, CASE WHEN e.user_id IS NULL THEN wanted[1] END, e.industry) AS industry,
  array_to_string(coalesce(wanted, e.interests, []), '|') AS interests
FROM t_profiles e FULL JOIN m ON m.user_id = e.user_id
""")
def profile_upsert(t):
    t.raw("customer").createOrReplaceTempView("bidlens_customer")
    incoming = t.spark.sql(INCOMING.format(text="string", array="array('MACHINERY', 'BUILDING')").replace("FROM customer", "FROM bidlens_customer"))
    out = C.profile_upsert(t.profiles, incoming)
    return out.withColumn("interests", F.coalesce(F.array_join("interests", "|"), F.lit("")))


PATTERNS = [(1, "STAND", 45), (1, "eco", 20), (2, "LARGE", 80), (2, "m", 60), (3, "pro", 12)]
shared("t_patterns_wanted", "SELECT * FROM (VALUES " + ", ".join(f"({a}, '{b}', {c})" for a, b, c in PATTERNS) + ") v(profile_id, pattern, n)")


@query("category_sample_contracts", """
SELECT DISTINCT ON (contract_id) contract_id, profile_id, item_id, 'Закупка: ' || min(pattern) OVER (PARTITION BY contract_id) AS purchase_name,
  CAST(d - CAST(h % 365 + 1 AS INT) AS VARCHAR) AS contract_date, (h % 49900001 + 100000) / 100.0 AS cost
FROM (SELECT *, 'DEMO-' || profile_id || '-' || item_id AS contract_id, CAST('0x' || substr(md5('DEMO-' || profile_id || '-' || item_id), 1, 8) AS BIGINT) AS h
  FROM (SELECT profile_id, pattern, n, item_id, row_number() OVER (PARTITION BY profile_id, pattern ORDER BY item_id) AS rn
    FROM t_patterns_wanted JOIN t_items ON category ILIKE '%' || pattern || '%') WHERE rn <= n), t_as_of
""")
def category_sample_contracts(t):
    patterns = t.dim(PATTERNS, "profile_id long, pattern string, n int")
    return C.category_sample_contracts(patterns, t.catalog_base, as_of(t))


@query("delta_ingest", f"SELECT item_id, {norm_sql('name')} AS normalized FROM t_items WHERE item_id NOT IN (SELECT vec_id FROM embeddings)")
def delta_ingest(t):
    derive = lambda new: new.select("item_id", X.normalize_text(F.col("name")).alias("normalized"))
    return C.delta_ingest(t.catalog_base, t.item_vectors, "item_id", derive)


@query("feature_sink", "SELECT item_id, popularity_score FROM t_popularity")
def feature_sink(t):
    from bidlens.operators.analytics import item_popularity

    path = work_path(t.spark, "popularity")
    S.feature_sink(item_popularity(t.facts), path)
    return t.spark.read.parquet(path).select("item_id", "popularity_score")


@query("replace_slice", """
SELECT item_id, name, category FROM t_items WHERE category <> 'PROMO' UNION ALL SELECT item_id, upper(name), category FROM t_items WHERE category = 'PROMO'
""")
def replace_slice(t):
    path = work_path(t.spark, "slices")
    rows = t.catalog_base.select("item_id", "name", "category")
    S.replace_slice(rows, path, "category")
    S.replace_slice(rows.where("category = 'PROMO'").withColumn("name", F.upper("name")), path, "category")
    return t.spark.read.parquet(path)
