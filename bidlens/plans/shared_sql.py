"""Named subqueries of the check SQL: the engine tables, written independently in SQL."""

from bidlens.functions import dicts
from bidlens.plans.registry import shared


def values(rows, cols):
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({', '.join(cols)})"


shared("t_items", """
SELECT p_partkey AS item_id, p_name AS name, p_type AS category, p_brand AS creator_user_id,
       'brand:' || p_brand || '; size:' || p_size || '; brand:' || p_brand AS attributes_raw
FROM part
""")
shared("t_purchases", """
SELECT l_partkey AS item_id, c_custkey AS customer_id, l_suppkey AS supplier_id,
       CAST(o_orderdate AS DATE) AS contract_date, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
       l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
""")
shared("t_regions", """
SELECT c_custkey AS customer_id, c_name AS customer_name, r_name AS customer_region,
       c_mktsegment AS segment, c_acctbal AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
shared("t_contracts", """
SELECT l_orderkey || '-' || l_linenumber || '-' || row_number() OVER (
         PARTITION BY l_orderkey, l_linenumber ORDER BY item_id, supplier_id, l_quantity, cents, l_discount,
         l_tax, l_shipdate, l_returnflag, l_linestatus) AS contract_id,
       item_id, contract_date, cents, customer_id, customer_name, customer_region, supplier_id
FROM t_purchases JOIN t_regions USING (customer_id)
""")
shared("t_catalog", """
SELECT i.*, coalesce(o.n, 0) AS order_count
FROM t_items i LEFT JOIN (SELECT item_id, count(*) AS n FROM t_purchases GROUP BY item_id) o USING (item_id)
""")
shared("t_profiles", """
SELECT customer_id AS user_id, customer_name AS name, customer_region AS region,
       CASE WHEN balance > 0 THEN segment END AS industry,
       CASE WHEN balance > 5000 THEN [segment, 'BUILDING'] END AS interests
FROM t_regions
""")
shared("t_events", """
SELECT event_id, ts, user_id, item_id, kind AS event_type, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
       CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '*' WHEN 2 THEN upper(split_part(name, ' ', 1))
            WHEN 3 THEN '  ' || split_part(name, ' ', 2) || ' ' ELSE name END AS query,
       category, name
FROM (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
        CASE event_type WHEN 'purchase' THEN 'like' WHEN 'signup' THEN 'compare'
          WHEN 'error' THEN CASE WHEN value < 20 THEN 'bounce' WHEN value < 60 THEN 'dislike' ELSE 'hide' END
          ELSE event_type END AS kind FROM events) e
JOIN t_items USING (item_id)
""")
shared("t_requests", """
SELECT r.user_id || '|' || r.query AS request_id, r.user_id, r.query, r.session_id, c_mktsegment AS segment
FROM (SELECT user_id, lower(trim(query)) AS query, max(session_id) AS session_id FROM t_events
      WHERE lower(trim(query)) NOT IN ('', '*') GROUP BY 1, 2) r
LEFT JOIN customer ON c_custkey = r.user_id
""")
shared("t_as_of", "SELECT CAST(max(o_orderdate) AS DATE) AS d FROM orders")
shared("t_event_now", "SELECT max(ts) AS now_ts FROM events")
shared("t_industry_categories", values(dicts.INDUSTRY_CATEGORIES, ["industry", "category"]))
shared("t_universal", values(dicts.UNIVERSAL_CATEGORIES, ["category"]))
shared("t_domain", values(dicts.DOMAIN_CATEGORIES, ["category", "industry"]))
shared("t_synonyms", values(dicts.SYNONYMS, ["term", "ord", "synonym"]))
shared("t_phrases", values(dicts.PHRASE_REWRITES, ["ord", "phrase", "rw_ord", "rewrite"]))
shared("t_homographs", values(dicts.HOMOGRAPHS, ["word", "context", "ord", "expansion"]))
shared("t_aliases", values(dicts.INDUSTRY_ALIASES, ["alias", "context"]))
shared("t_lemmas", values(dicts.LEMMAS, ["token", "lemma"]))
shared("t_actions", values(dicts.ACTION_WEIGHTS, ["action", "weight"]))
shared("t_queries", "SELECT DISTINCT query FROM t_requests")
shared("t_query_terms", """
SELECT query, term, count(*) OVER (PARTITION BY query) AS n_terms
FROM (SELECT DISTINCT query, unnest(string_split(query, ' ')) AS term FROM t_queries)
""")
shared("t_item_terms", """
SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(string_split(lower(name), ' ')) AS term FROM t_items)
GROUP BY ALL
""")
shared("t_query_hits", """
SELECT query, item_id, ts_score FROM (
  SELECT query, item_id, ts_score,
         row_number() OVER (PARTITION BY query ORDER BY ts_score DESC, item_id) AS rn, n_terms
  FROM (SELECT q.query, i.item_id, q.n_terms, round(sum(1 - 1.0 / (1 + i.tf)) / q.n_terms, 6) AS ts_score
        FROM t_query_terms q JOIN t_item_terms i USING (term)
        GROUP BY q.query, i.item_id, q.n_terms HAVING count(*) = q.n_terms))
WHERE rn <= CASE WHEN n_terms >= 2 THEN 80 ELSE 30 END
""")
shared("t_cands", """
SELECT r.request_id, r.user_id, r.session_id, r.query, r.segment, h.item_id, h.ts_score, h.ts_score AS bm25_score,
  CAST(0 AS DOUBLE) AS semantic_score, h.ts_score AS base_score, c.name, c.category, c.order_count
FROM t_requests r JOIN t_query_hits h USING (query) JOIN t_catalog c USING (item_id)
""")
