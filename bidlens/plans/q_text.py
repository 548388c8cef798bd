"""Registered queries: text preparation over documents, catalogue texts and the query log."""

from pyspark.sql import functions as F

from bidlens.functions import dicts
from bidlens.functions import text as X
from bidlens.operators import textprep as P
from bidlens.plans.registry import query, shared
from bidlens.plans.shared_sql import values

STOP = dicts.TEXT_STOP_WORDS + dicts.SAMPLE_STOP_WORDS
SP = r"[\s\p{Z}]"
WD = r"[\p{L}\p{N}_]"


def quoted(words):
    return ", ".join("'" + w + "'" for w in words)


def units_sql(c):
    return f"regexp_replace({c}, '(\\d+){SP}*({'|'.join(dicts.UNITS)})($|[^\\p{{L}}\\p{{N}}_])', '\\2\\3', 'gi')"


def squeeze_sql(c):
    return f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'))"


def norm_sql(c):
    inner = units_sql(squeeze_sql(f"lower({c})"))
    return squeeze_sql(f"regexp_replace({inner}, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}.-]', ' ', 'g')")


def words_sql(c, stop=True):
    cond = "length(w) >= 2" + (f" AND w NOT IN ({quoted(STOP)})" if stop else "")
    return f"list_filter(string_split({norm_sql(c)}, ' '), lambda w: {cond})"


def tokens_sql(c):
    return f"list_filter(regexp_split_to_array({squeeze_sql(f'lower({c})')}, '[\\s\\p{{Z}}\\-/,;]+'), lambda w: length(w) > 1)"


shared("t_doc_words", f"SELECT doc_id, {words_sql('text')} AS ws FROM documents")
shared("t_log", "SELECT DISTINCT query FROM t_events WHERE query IS NOT NULL")


def log(t):
    return t.user_events.select("query").where("query is not null").distinct()


def lemma_dim(t):
    return t.dim(dicts.LEMMAS, "token string, lemma string")


def synonym_dim(t):
    return t.dim(dicts.SYNONYMS, "term string, ord int, synonym string")


def phrase_dim(t):
    return t.dim(dicts.PHRASE_REWRITES, "ord int, phrase string, rw_ord int, rewrite string")


def homograph_dim(t):
    return t.dim(dicts.HOMOGRAPHS, "word string, context string, ord int, expansion string")


def alias_dim(t):
    return t.dim(dicts.INDUSTRY_ALIASES, "alias string, context string")


def translit_dim(t):
    return t.dim(dicts.TRANSLIT_TERMS, "term string, replacement string")


@query("normalize_text", f"SELECT doc_id, {norm_sql('text')} AS normalized FROM documents")
def normalize_text(t):
    return t.documents.select("doc_id", X.normalize_text(F.col("text")).alias("normalized"))


UNIT_TEXT = "p_name || ' ' || p_size || ' мм, ' || p_partkey || 'шт ' || p_size || ' кгс'"


@query("normalize_units", f"SELECT p_partkey AS item_id, {units_sql(UNIT_TEXT)} AS text FROM part")
def normalize_units(t):
    text = F.format_string("%s %d мм, %dшт %d кгс", "p_name", "p_size", "p_partkey", "p_size")
    return t.raw("part").select(F.col("p_partkey").alias("item_id"), X.normalize_units(text).alias("text"))


@query("tokenize", f"SELECT doc_id, array_to_string({tokens_sql('text')}, '|') AS tokens FROM documents")
def tokenize(t):
    return t.documents.select("doc_id", F.array_join(X.tokenize(F.col("text")), "|").alias("tokens"))


@query("remove_stopwords", f"""
SELECT doc_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE ws END, '|') AS tokens FROM (
  SELECT doc_id, ws, list_filter(ws, lambda w: w NOT IN ({quoted(STOP)})) AS k
  FROM (SELECT doc_id, {tokens_sql('text')} AS ws FROM documents))
""")
def remove_stopwords(t):
    kept = X.remove_stopwords(X.tokenize(F.col("text")), STOP)
    return t.documents.select("doc_id", F.array_join(kept, "|").alias("tokens"))


@query("lemmatize", """
SELECT doc_id, coalesce(string_agg(coalesce(lemma, token), ' ' ORDER BY pos), '') AS lemmas FROM (
  SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM t_doc_words) LEFT JOIN t_lemmas USING (token)
GROUP BY doc_id UNION ALL SELECT doc_id, '' FROM t_doc_words WHERE len(ws) = 0
""")
def lemmatize(t):
    docs = t.documents.select("doc_id", X.words(F.col("text"), STOP).alias("tokens"))
    return P.lemmatize(docs, "doc_id", "tokens", lemma_dim(t)).select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


BOILER = "(?i)^(" + "|".join(dicts.BOILERPLATE) + r")\s+"
BOILER_TEXT = "'Поставка товара ' || query"


def boiler_sql(c):
    once = f"trim({c})"
    for _ in range(3):
        once = f"trim(regexp_replace({once}, '{BOILER}', ''))"
    return f"coalesce(nullif({once}, ''), {c})"


@query("strip_boilerplate", f"SELECT query, {boiler_sql(BOILER_TEXT)} AS stripped FROM t_log")
def strip_boilerplate(t):
    return log(t).select("query", X.strip_boilerplate(F.concat(F.lit("Поставка товара "), "query")).alias("stripped"))


NEG = r"(?i)(?:^|\s)(?:-|не\s+)(\S+)"
NEG_TEXT = "name || ' -' || category || ' Не ' || creator_user_id || ' set'"


@query("extract_negatives", f"""
SELECT item_id, trim(regexp_replace({NEG_TEXT}, '{NEG}', ' ', 'g')) AS clean,
       lower(array_to_string(regexp_extract_all({NEG_TEXT}, '{NEG}', 1), '|')) AS negatives FROM t_items
""")
def extract_negatives(t):
    text = F.format_string("%s -%s Не %s set", "name", "category", "creator_user_id")
    return t.catalog_base.select(
        "item_id", X.drop_negatives(text).alias("clean"), F.array_join(X.negative_terms(text), "|").alias("negatives")
    )


def letters_sql(c):
    for a, b in dicts.TRANSLIT_LETTERS:
        c = f"replace({c}, '{a}', '{b}')"
    return c


shared("t_translit", values(dicts.TRANSLIT_TERMS, ["term", "replacement"]))
shared("t_translit_text", f"""
SELECT name, coalesce(p.replacement, b.txt) AS transliterated, p.replacement IS NOT NULL OR b.chg AS was_changed FROM (
  SELECT name, string_agg(CASE WHEN latin THEN coalesce(replacement, {letters_sql('term')}) ELSE term END, ' ' ORDER BY pos) AS txt,
         bool_or(latin) AS chg
  FROM (SELECT *, regexp_full_match(term, '[a-zA-Z][a-zA-Z0-9\\-]*') AS latin FROM (
     SELECT name, unnest(string_split(lower(name), ' ')) AS term, generate_subscripts(string_split(name, ' '), 1) AS pos
     FROM (SELECT DISTINCT c_name || ' ' || c_mktsegment || ' лента Printer' AS name FROM customer
           UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part)))
  LEFT JOIN t_translit USING (term) GROUP BY name) b
LEFT JOIN t_translit p ON p.term = lower(name)
""")


@query("transliterate", "SELECT * FROM t_translit_text")
def transliterate(t):
    names = (
        t.raw("customer").select(F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" лента Printer")).alias("name"))
        .union(t.raw("part").select("p_name"))
        .union(t.raw("part").select(F.split_part("p_name", F.lit(" "), F.lit(2))))
        .distinct()
    )
    return P.transliterate(names, "name", "name", translit_dim(t))


INTENT_TEXT = """CASE event_type WHEN 'like' THEN 'снова ' || name WHEN 'compare' THEN 'Цена ' || name
 WHEN 'click' THEN name || ' ' || (event_id + 1000) WHEN 'view' THEN name WHEN 'bounce' THEN 'купить ' || name || ' для большого склада'
 WHEN 'hide' THEN name || ' ' || item_id || ' кг' ELSE 'сцена ' || name || ' цементный' END"""
EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
SPEC = "|".join([
    r"\d{4,}", r"гост\s*р?\s*\d", r"ту\s+\d", EDGE_L + r"[A-Z]{2,}\d{2,}", EDGE_L + r"\d+[xх]\d+",
    EDGE_L + r"\d+\s*(" + "|".join(dicts.SPEC_UNITS) + ")" + EDGE_R,
])
shared("t_intents", f"""
SELECT event_id, q AS text, CASE WHEN q = '' THEN 'general'
  WHEN regexp_matches(q, '(?i){EDGE_L}({'|'.join(dicts.REORDER_WORDS)}){EDGE_R}') THEN 'reorder'
  WHEN regexp_matches(q, '(?i){EDGE_L}({'|'.join(dicts.PRICE_WORDS)}){EDGE_R}') THEN 'price_check'
  WHEN regexp_matches(q, '(?i)({SPEC})') THEN 'spec_search'
  WHEN len(list_filter(string_split(lower(q), ' '), lambda w: length(w) >= 2 AND w NOT IN ({quoted(dicts.BUYING_WORDS)}))) <= 2
       AND NOT regexp_matches(q, '[0-9]') THEN 'category_browse' ELSE 'general' END AS intent
FROM (SELECT event_id, {INTENT_TEXT} AS q FROM t_events)
""")


def intent_texts(t):
    return t.user_events.selectExpr("event_id", f"{INTENT_TEXT} AS text")


@query("detect_intent", "SELECT * FROM t_intents")
def detect_intent(t):
    return intent_texts(t).withColumn("intent", X.detect_intent(F.col("text")))


STRATEGY_COLS = ["intent", "history_mult", "popularity_mult", "trigram_mult", "text_mult", "price_context", "description"]
shared("t_strategy", values(dicts.INTENT_STRATEGY, STRATEGY_COLS))


def strategy_dim(t):
    return t.dim(
        dicts.INTENT_STRATEGY,
        "intent string, history_mult double, popularity_mult double, trigram_mult double, text_mult double, "
        "price_context boolean, description string",
    )


@query("intent_strategy", "SELECT event_id, t_strategy.* FROM t_intents JOIN t_strategy USING (intent)")
def intent_strategy(t):
    found = intent_texts(t).select("event_id", X.detect_intent(F.col("text")).alias("intent"))
    return found.join(strategy_dim(t), "intent")


@query("query_length_type", f"""
SELECT query, CASE WHEN n <= 1 THEN 'short' WHEN n > 3 THEN 'long' ELSE 'medium' END AS query_type
FROM (SELECT query, len({words_sql('query')}) AS n FROM t_log)
""")
def query_length_type(t):
    return log(t).select("query", X.query_length_type(X.words(F.col("query"), STOP)).alias("query_type"))


PROC_TEXT = "'закупка ' || query || ' -' || category || ' для ' || creator_user_id"


@query("process_query", f"""
WITH src AS (SELECT DISTINCT {PROC_TEXT.replace('query', 'e.query').replace('category', 'i.category')} AS query
             FROM t_events e JOIN t_items i USING (item_id) WHERE e.query IS NOT NULL),
  s1 AS (SELECT query, {boiler_sql('query')} AS stripped FROM src),
  s2 AS (SELECT query, stripped, lower(array_to_string(regexp_extract_all(stripped, '{NEG}', 1), '|')) AS negatives,
           lower({squeeze_sql(f"regexp_replace(stripped, '{NEG}', ' ', 'g')")}) AS clean FROM s1),
  w AS (SELECT query, unnest(string_split(clean, ' ')) AS term, generate_subscripts(string_split(clean, ' '), 1) AS pos FROM s2),
  tr AS (SELECT query, string_agg(CASE WHEN regexp_full_match(term, '[a-zA-Z][a-zA-Z0-9\\-]*')
            THEN coalesce(replacement, {letters_sql('term')}) ELSE term END, ' ' ORDER BY pos) AS original,
            bool_or(regexp_full_match(term, '[a-zA-Z][a-zA-Z0-9\\-]*')) AS was_changed
         FROM w LEFT JOIN t_translit USING (term) GROUP BY query),
  tk AS (SELECT query, original, was_changed, ws, list_filter(ws, lambda w: w NOT IN ({quoted(dicts.QUERY_STOP_WORDS)})) AS k
         FROM (SELECT *, {tokens_sql('original')} AS ws FROM tr)),
  lm AS (SELECT query, string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS lemmatized FROM (
           SELECT query, unnest(t) AS token, generate_subscripts(t, 1) AS pos
           FROM (SELECT query, CASE WHEN len(k) > 0 THEN k ELSE ws END AS t FROM tk)) LEFT JOIN t_lemmas USING (token) GROUP BY query)
SELECT query, stripped, original, was_changed, coalesce(lemmatized, original) AS lemmatized,
       replace(coalesce(lemmatized, original), ' ', ' | ') AS or_query, negatives
FROM s2 JOIN tk USING (query) LEFT JOIN lm USING (query)
""")
def process_query(t):
    texts = (
        t.user_events.where("query is not null")
        .join(t.catalog_base.select("item_id", "creator_user_id"), "item_id")
        .selectExpr(f"{PROC_TEXT} AS query")
        .distinct()
    )
    out = P.process_query(texts, "query", "query", translit_dim(t), lemma_dim(t))
    return out.drop("lemmas").withColumn("negatives", F.array_join("negatives", "|"))


shared("t_word_counts", "SELECT word, count(*) AS freq FROM (SELECT unnest(ws) AS word FROM t_doc_words) GROUP BY 1")
shared("t_vocab", """
SELECT word, greatest(coalesce(freq, 0), coalesce(floor, 0)) AS freq FROM t_word_counts FULL JOIN (
  SELECT word, max(f) AS floor FROM (SELECT term AS word, 5000 AS f FROM t_synonyms
    UNION ALL SELECT unnest(string_split(synonym, ' ')), 1000 FROM t_synonyms) GROUP BY 1) USING (word)
WHERE greatest(coalesce(freq, 0), coalesce(floor, 0)) >= 2
""")


def vocabulary(t):
    return P.build_vocabulary(t.documents, "text", synonym_dim(t), STOP)


@query("build_vocabulary", "SELECT * FROM t_vocab")
def build_vocabulary(t):
    return vocabulary(t)


shared("t_typed", f"""
SELECT DISTINCT token FROM (SELECT unnest(string_split({norm_sql('text')}, ' ')) AS token FROM benchmark)
WHERE length(token) > 2 AND token NOT IN ({quoted(STOP)})
""")
# DuckDB measures edit distance in bytes: map the corpus' accented letters to one byte each
ONE_BYTE = "translate({}, 'äöüßéèêçñíóáúàâîôûïëœæìò', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
shared("t_fixes", f"""
SELECT token, coalesce(word, token) AS corrected, word IS NOT NULL AS was_corrected FROM t_typed LEFT JOIN (
  SELECT token, word, row_number() OVER (PARTITION BY token ORDER BY d, freq DESC, word) AS rn FROM (
    SELECT token, word, freq, levenshtein({ONE_BYTE.format('token')}, {ONE_BYTE.format('word')}) AS d FROM t_typed, t_vocab
    WHERE abs(length(token) - length(word)) <= 2 AND token NOT IN (SELECT word FROM t_vocab)) WHERE d <= 2) b
  USING (token) WHERE coalesce(rn, 1) = 1
""")


@query("correct_typos", "SELECT * FROM t_fixes")
def correct_typos(t):
    tokens = t.raw("benchmark").select(F.explode(F.split(X.normalize_text(F.col("text")), " ")).alias("token")).where(
        (F.length("token") > 2) & ~F.col("token").isin(STOP)
    )
    return P.correct_typos(tokens, vocabulary(t))


@query("process_query_ml", f"""
WITH w AS (SELECT item_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos
           FROM (SELECT item_id, string_split({norm_sql('text')}, ' ') AS ws FROM benchmark)),
  c AS (SELECT item_id, string_agg(coalesce(corrected, token), ' ' ORDER BY pos) AS corrected,
          coalesce(bool_or(f.was_corrected), false) AS was_corrected FROM w LEFT JOIN t_fixes f USING (token) GROUP BY 1),
  l AS (SELECT item_id, count(*) AS n_lemmas FROM (SELECT item_id, unnest({words_sql('corrected')}) AS x FROM c) GROUP BY 1)
SELECT item_id, corrected, was_corrected, coalesce(n_lemmas, 0) AS n_lemmas,
       CASE WHEN coalesce(n_lemmas, 0) <= 1 THEN 'short' WHEN n_lemmas > 3 THEN 'long' ELSE 'medium' END AS query_type
FROM c LEFT JOIN l USING (item_id)
""")
def process_query_ml(t):
    fixed = P.correct_texts(t.raw("benchmark"), "item_id", "text", vocabulary(t), STOP)
    words = X.words(F.col("corrected"), STOP)
    return fixed.select(
        "item_id", "corrected", "was_corrected", F.size(words).alias("n_lemmas"), X.query_length_type(words).alias("query_type")
    )


@query("phrase_rewrite", """
SELECT query, phrase, rw_ord, rewrite FROM (SELECT query, min(ord) AS ord FROM t_queries, t_phrases
  WHERE contains(query, phrase) GROUP BY 1) JOIN t_phrases USING (ord)
""")
def phrase_rewrite(t):
    return P.phrase_rewrite(t.requests.select("query").distinct(), phrase_dim(t))


shared("t_ask", "SELECT DISTINCT query, segment AS industry FROM t_requests")
shared("t_ask_words", f"""
SELECT DISTINCT query, industry, coalesce(lemma, token) AS word FROM
  (SELECT query, industry, unnest({words_sql('query')}) AS token FROM t_ask) LEFT JOIN t_lemmas USING (token)
""")
shared("t_homo", """
SELECT w.query, w.industry, w.word, h.ord, h.expansion FROM (
  SELECT x.*, coalesce(a.context, lower(industry)) AS ctx FROM t_ask_words x LEFT JOIN t_aliases a ON a.alias = lower(industry)) w
JOIN t_homographs h ON h.word = w.word AND h.context = CASE WHEN EXISTS
  (SELECT 1 FROM t_homographs g WHERE g.word = w.word AND g.context = w.ctx) THEN w.ctx ELSE 'default' END
""")


def asked(t):
    return t.requests.select("query", F.col("interests")[0].alias("industry"))


def asked_words(t):
    rows = asked(t).distinct().select("query", "industry", F.explode(X.words(F.col("query"), STOP)).alias("token"))
    return rows.join(lemma_dim(t), "token", "left").select(
        "query", "industry", F.coalesce("lemma", "token").alias("word")
    ).distinct()


@query("resolve_homograph", "SELECT DISTINCT word, industry, ord, expansion FROM t_homo")
def resolve_homograph(t):
    words = asked_words(t).select("word", "industry").distinct()
    return P.resolve_homograph(words, homograph_dim(t), alias_dim(t))


shared("t_expanded", f"""
WITH ph AS (SELECT query, rewrite FROM (SELECT query, min(ord) AS ord FROM t_queries, t_phrases
              WHERE contains(query, phrase) GROUP BY 1) JOIN t_phrases USING (ord)),
  ext AS (SELECT query, industry, rewrite AS extra FROM t_ask JOIN ph USING (query)
    UNION ALL SELECT query, industry, rewrite FROM t_ask JOIN t_learned3 USING (query)
    UNION ALL SELECT query, industry, (SELECT min(term) FROM t_synonyms s WHERE s.synonym = query) FROM t_ask
              WHERE query IN (SELECT synonym FROM t_synonyms)
    UNION ALL SELECT query, industry, expansion FROM t_homo WHERE query NOT IN (SELECT query FROM ph)
    UNION ALL SELECT query, industry, synonym FROM t_ask_words JOIN t_synonyms ON term = word
              WHERE query NOT IN (SELECT query FROM ph) AND word NOT IN (SELECT word FROM t_homographs))
SELECT query, industry, word AS term FROM t_ask_words
UNION SELECT query, industry, coalesce(lemma, token) FROM (SELECT query, industry, unnest({words_sql('extra')}) AS token FROM ext)
  LEFT JOIN t_lemmas USING (token)
""")


@query("expand_synonyms", """
SELECT query, industry, string_agg(term, '|' ORDER BY term) AS terms FROM t_expanded GROUP BY ALL
""")
def expand_synonyms(t):
    from bidlens.operators import sessions as S

    patterns = S.collective_patterns(t.user_events)
    learned = S.learned_rewrites(patterns)
    out = P.expand_synonyms(
        asked(t), synonym_dim(t), phrase_dim(t), homograph_dim(t), alias_dim(t), learned, lemma_dim(t), STOP
    )
    return out.groupBy("query", "industry").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("terms"))


shared("t_reverse", "SELECT lower(synonym) AS synonym, min(term) AS main FROM t_synonyms GROUP BY 1")


@query("expand_query_dict", """
WITH w AS (SELECT query, unnest(string_split(query, ' ')) AS term, generate_subscripts(string_split(query, ' '), 1) - 1 AS pos FROM t_queries),
  a AS (SELECT query, 0 AS st, pos, 0 AS ord, term AS extra, false AS free FROM w
    UNION ALL SELECT query, 1, pos, ord, lower(synonym), true FROM w JOIN t_synonyms USING (term) WHERE ord <= 2
    UNION ALL SELECT query, 2, 0, ord, lower(synonym), false FROM t_queries JOIN t_synonyms ON term = query WHERE ord <= 2
    UNION ALL SELECT query, 3, pos, 0, main, true FROM w JOIN t_reverse ON synonym = term),
  k AS (SELECT *, row_number() OVER (PARTITION BY query, extra ORDER BY st, pos, ord) AS rn FROM a)
SELECT query, string_agg(extra, ' ' ORDER BY st, pos, ord) AS expanded, count(*) FILTER (st > 0) AS n_added
FROM k WHERE NOT free OR rn = 1 GROUP BY query
""")
def expand_query_dict(t):
    return P.expand_query_dict(t.requests.select("query").distinct(), synonym_dim(t))


@query("lemma_synonyms", """
SELECT word AS lemma, ord, synonym AS term FROM (SELECT DISTINCT word FROM t_ask_words) JOIN t_synonyms ON term = word WHERE ord <= 3
UNION ALL SELECT word, 4, main FROM (SELECT DISTINCT word FROM t_ask_words) JOIN t_reverse ON synonym = word
""")
def lemma_synonyms(t):
    return P.lemma_synonyms(asked_words(t).select(F.col("word").alias("lemma")).distinct(), synonym_dim(t))


shared("t_learned3", """
SELECT query, product_name AS rewrite, user_count, rn FROM (SELECT *, row_number() OVER (
  PARTITION BY query ORDER BY user_count DESC, product_name) AS rn FROM t_patterns) WHERE rn <= 3
""")


@query("learned_rewrites", "SELECT query, rewrite, user_count, rn AS position FROM t_learned3 WHERE query IN (FROM t_queries)")
def learned_rewrites(t):
    from bidlens.operators import sessions as S

    found = S.learned_rewrites(S.collective_patterns(t.user_events))
    return found.join(t.requests.select("query").distinct(), "query", "left_semi")


def tri_sql(c):
    return f"list_distinct(list_transform(range(1, length('  ' || {c} || ' ') - 1), lambda i: substr('  ' || {c} || ' ', i, 3)))"


shared("t_catalog_vocab", """
SELECT word FROM (SELECT unnest(string_split(lower(name), ' ')) AS word FROM t_items UNION SELECT word FROM t_word_counts)
""")
shared("t_catalog_terms", f"""
WITH l AS (SELECT DISTINCT word AS lemma, {tri_sql('word')} AS lt FROM t_ask_words WHERE length(word) >= 4),
  v AS (SELECT DISTINCT word, {tri_sql('word')} AS wt FROM t_catalog_vocab WHERE length(word) >= 4),
  s AS (SELECT lemma, word, len(list_intersect(lt, wt)) AS n, len(lt) + len(wt) AS m FROM l, v WHERE lemma <> word)
SELECT lemma, word, similarity, rn FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY similarity DESC, word) AS rn FROM (
  SELECT lemma, word, round(n / (m - n), 6) AS similarity FROM s) WHERE similarity >= 0.35) WHERE rn <= 3
""")


def catalog_vocabulary(t):
    names = t.catalog_base.select(F.explode(F.split(F.lower("name"), " ")).alias("word"))
    return names.union(P.word_counts(t.documents, "text", STOP).select("word")).distinct()


@query("catalog_expand", "SELECT * FROM t_catalog_terms")
def catalog_expand(t):
    return P.catalog_expand(asked_words(t).select(F.col("word").alias("lemma")), catalog_vocabulary(t))


def or_terms(t):
    words = (
        t.requests.select("query").distinct()
        .select("query", F.posexplode(X.words(F.col("query"), STOP)).alias("pos", "token"))
        .join(lemma_dim(t), "token", "left")
        .select("query", "pos", F.coalesce("lemma", "token").alias("lemma"))
    )
    base = words.select("query", (F.col("pos") * 10).alias("ord"), F.col("lemma").alias("term"))
    syn = words.join(P.lemma_synonyms(words.select("lemma").distinct(), synonym_dim(t)), "lemma").select(
        "query", (1000 + F.col("pos") * 10 + F.col("ord")).alias("ord"), "term"
    )
    mined = words.join(P.catalog_expand(words.select("lemma"), catalog_vocabulary(t)), "lemma").select(
        "query", (2000 + F.col("pos") * 10 + F.col("rn")).alias("ord"), F.col("word").alias("term")
    )
    return base.unionByName(syn).unionByName(mined)


shared("t_or_terms", f"""
WITH w AS (SELECT query, pos, coalesce(lemma, token) AS lemma FROM (SELECT query, unnest({words_sql('query')}) AS token,
       generate_subscripts({words_sql('query')}, 1) - 1 AS pos FROM t_queries) LEFT JOIN t_lemmas USING (token))
SELECT query, pos * 10 AS ord, lemma AS term FROM w
UNION ALL SELECT query, 1000 + pos * 10 + ord, synonym FROM w JOIN t_synonyms ON term = lemma WHERE ord <= 3
UNION ALL SELECT query, 1004 + pos * 10, main FROM w JOIN t_reverse ON synonym = lemma
UNION ALL SELECT query, 2000 + pos * 10 + rn, word FROM w JOIN t_catalog_terms USING (lemma)
""")


@query("build_or_query", """
SELECT query, string_agg(term, ' | ' ORDER BY ord, term) AS or_query FROM (
  SELECT query, term, min(ord) AS ord FROM (SELECT query, ord,
    trim(regexp_replace(term, '[^\\p{L}\\p{N}_\\s\\p{Z}-]', '', 'g')) AS term FROM t_or_terms) WHERE term <> '' GROUP BY 1, 2)
GROUP BY query
""")
def build_or_query(t):
    return P.build_or_query(or_terms(t))


@query("query_trace", f"""
SELECT q.query, {boiler_sql('q.query')} AS after_boilerplate_strip, o.or_query AS final_or_query,
   coalesce(s.n, 0) AS manual_synonyms, coalesce(c.n, 0) AS catalog_terms,
   CASE WHEN len(string_split(q.query, ' ')) <= 2 THEN 'category_browse' ELSE 'general' END AS intent
FROM t_queries q JOIN (SELECT query, string_agg(term, ' | ' ORDER BY ord, term) AS or_query FROM (
    SELECT query, term, min(ord) AS ord FROM (SELECT query, ord,
      trim(regexp_replace(term, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}-]', '', 'g')) AS term FROM t_or_terms) WHERE term <> '' GROUP BY 1, 2) GROUP BY 1) o USING (query)
LEFT JOIN (SELECT query, count(*) AS n FROM t_or_terms WHERE ord BETWEEN 1000 AND 1999 GROUP BY 1) s USING (query)
LEFT JOIN (SELECT query, count(*) AS n FROM t_or_terms WHERE ord >= 2000 GROUP BY 1) c USING (query)
""")
def query_trace(t):
    terms = or_terms(t)
    counts = terms.groupBy("query").agg(
        F.count_if(F.col("ord").between(1000, 1999)).alias("manual_synonyms"),
        F.count_if(F.col("ord") >= 2000).alias("catalog_terms"),
    )
    return (
        P.build_or_query(terms).withColumnRenamed("or_query", "final_or_query")
        .join(counts, "query")
        .withColumn("after_boilerplate_strip", X.strip_boilerplate(F.col("query")))
        .withColumn("intent", X.detect_intent(F.col("query")))
    )
