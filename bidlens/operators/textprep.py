"""Query-log and catalogue text preparation as joins over token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import dicts
from bidlens.functions import text as X
from bidlens.operators.analytics import top_per_group


def lemmatize(df: DataFrame, key: str, tokens: str, lemmas: DataFrame, out: str = "lemmas") -> DataFrame:
    """Replace tokens by their normal form; unknown tokens stay. ``lemmas(token, lemma)``.

    Only distinct tokens meet the dictionary, so a frequent word is looked up once.
    """
    exploded = df.select(key, F.posexplode(tokens).alias("pos", "token"))
    forms = (
        exploded.select("token").distinct().join(lemmas, "token")
    )
    grouped = (
        exploded.join(forms, "token", "left")
        .select(key, F.struct("pos", F.coalesce("lemma", "token").alias("w")).alias("s"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("s")).alias("ws"))
        .select(key, F.col("ws.w").alias(out))
    )
    return df.join(grouped, key, "left").withColumn(
        out, F.coalesce(out, F.array().cast("array<string>"))
    )


def transliterate(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """Latin words to Cyrillic: whole phrase, then word by dictionary, then by letters."""
    q = df.select(key, X.squeeze(F.lower(text)).alias("_q"))
    by_word = (
        q.select(key, F.posexplode(F.split("_q", " ")).alias("pos", "term"))
        .join(terms, "term", "left")
        .select(
            key,
            F.struct(
                "pos",
                F.when(X.is_latin(F.col("term")), F.coalesce("replacement", X.transliterate_letters(F.col("term"))))
                .otherwise(F.col("term")).alias("w"),
                X.is_latin(F.col("term")).alias("latin"),
            ).alias("s"),
        )
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("s")).alias("ws"))
    )
    phrase = terms.select(F.col("term").alias("_q"), F.col("replacement").alias("phrase"))
    return (
        q.join(phrase, "_q", "left")
        .join(by_word, key)
        .select(
            key,
            F.coalesce("phrase", F.array_join("ws.w", " ")).alias("transliterated"),
            (F.col("phrase").isNotNull() | F.exists("ws.latin", lambda b: b)).alias("was_changed"),
        )
    )


def process_query(df: DataFrame, key: str, text: str, terms: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Boilerplate, negatives, transliteration, tokens, stop words and lemmas of a query log."""
    base = df.select(key, X.strip_boilerplate(F.col(text)).alias("stripped")).withColumn(
        "negatives", X.negative_terms(F.col("stripped"))
    ).withColumn("clean", X.drop_negatives(F.col("stripped")))
    latin = transliterate(base, key, "clean", terms)
    tokens = latin.withColumn(
        "tokens", X.remove_stopwords(X.tokenize(F.col("transliterated")), dicts.QUERY_STOP_WORDS)
    )
    out = lemmatize(tokens, key, "tokens", lemmas)
    nonempty = F.size("lemmas") > 0
    return out.join(base.select(key, "stripped", "negatives"), key).select(
        key, "stripped", F.col("transliterated").alias("original"), "was_changed",
        F.when(nonempty, F.array_join("lemmas", " ")).otherwise(F.col("transliterated")).alias("lemmatized"),
        F.when(nonempty, F.array_join("lemmas", " | ")).otherwise(F.col("transliterated")).alias("or_query"),
        "negatives", "lemmas",
    )


def word_counts(df: DataFrame, text: str, stop: list[str]) -> DataFrame:
    return (
        df.select(F.explode(X.words(F.col(text), stop)).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    )


def build_vocabulary(corpus: DataFrame, text: str, synonyms: DataFrame, stop: list[str]) -> DataFrame:
    """Word frequencies with floors for dictionary words; words seen once are dropped."""
    counted = word_counts(corpus, text, stop)
    floors = (
        synonyms.select(F.col("term").alias("word"), F.lit(5000).alias("floor"))
        .unionByName(
            synonyms.select(F.explode(F.split("synonym", " ")).alias("word"), F.lit(1000).alias("floor"))
        )
        .groupBy("word")
        .agg(F.max("floor").cast("long").alias("floor"))
    )
    return (
        counted.join(floors, "word", "full")
        .select("word", F.greatest(F.coalesce("freq", F.lit(0)), F.coalesce("floor", F.lit(0))).alias("freq"))
        .where("freq >= 2")
    )


def correct_typos(tokens: DataFrame, vocabulary: DataFrame, max_distance: int = 2) -> DataFrame:
    """Closest vocabulary word of each distinct token: (distance, frequency, alphabet).

    Tokens known to the vocabulary stay. The others meet only the words that share a deletion
    key and have a fitting length; the distance is then verified, so nothing is lost.
    """
    distinct = tokens.select("token").distinct()
    known = distinct.join(vocabulary.select(F.col("word").alias("token")), "token", "left_semi")
    unknown = distinct.join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti")
    keyed_words = vocabulary.select(
        "word", "freq", F.explode(X.delete_keys(F.col("word"))).alias("k"), F.length("word").alias("n")
    )
    keyed_tokens = unknown.select("token", F.explode(X.delete_keys(F.col("token"))).alias("k")).select(
        "token", "k",
        F.explode(F.sequence(F.length("token") - max_distance, F.length("token") + max_distance)).alias("n"),
    )
    best = (
        keyed_tokens.join(keyed_words, ["k", "n"])
        .withColumn("d", F.levenshtein("token", "word", max_distance))
        .where("d >= 0")
        .groupBy("token")
        .agg(F.min(F.struct("d", (-F.col("freq")).alias("f"), "word")).alias("b"))
        .select("token", F.col("b.word").alias("corrected"))
    )
    fixed = unknown.join(best, "token", "left").select(
        "token", F.coalesce("corrected", "token").alias("corrected"), F.col("corrected").isNotNull().alias("was_corrected")
    )
    same = known.select("token", F.col("token").alias("corrected"), F.lit(False).alias("was_corrected"))
    return same.unionByName(fixed)


def correct_texts(df: DataFrame, key: str, text: str, vocabulary: DataFrame, stop: list[str]) -> DataFrame:
    """Corrected normalised text per row and whether any word changed."""
    token = F.col("token")
    exploded = df.select(key, F.posexplode(F.split(X.normalize_text(F.col(text)), " ")).alias("pos", "token"))
    eligible = exploded.where((F.length(token) > 2) & ~token.isin(stop))
    fixes = correct_typos(eligible, vocabulary).where("was_corrected")
    return (
        exploded.join(fixes, "token", "left")
        .select(
            key, F.struct("pos", F.coalesce("corrected", "token").alias("w")).alias("s"),
            F.coalesce("was_corrected", F.lit(False)).alias("c"),
        )
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("s")).alias("ws"), F.max("c").alias("was_corrected"))
        .select(key, F.array_join("ws.w", " ").alias("corrected"), "was_corrected")
    )


def phrase_rewrite(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """First dictionary phrase contained in a query and its rewrites.

    A phrase meets the queries that contain its first three letters, not every query.
    """
    keyed = phrases.select(
        "ord", "phrase", "rw_ord", "rewrite", F.substring("phrase", 1, 3).alias("w0")
    )
    head = keyed.select("ord", "phrase", "w0").distinct()
    found = (
        queries.select("query", F.explode(X.short_substrings(F.col("query"))).alias("w0"))
        .distinct()
        .join(head, "w0")
        .where(F.contains("query", "phrase"))
        .groupBy("query")
        .agg(F.min("ord").alias("ord"))
    )
    return found.join(keyed.drop("w0"), "ord").select("query", "phrase", "rw_ord", "rewrite")


def resolve_homograph(words: DataFrame, homographs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Expansion of (word, industry): the industry's context, else the default one."""
    asked = (
        words.withColumn("alias", F.lower(F.trim("industry")))
        .join(aliases.withColumnRenamed("context", "mapped"), "alias", "left")
        .withColumn("context", F.coalesce("mapped", "alias"))
        .drop("alias", "mapped")
    )
    own = homographs.select("word", "context").distinct().withColumn("own", F.lit(True))
    chosen = asked.join(own, ["word", "context"], "left").withColumn(
        "context", F.when(F.col("own"), F.col("context")).otherwise("default")
    ).drop("own")
    return chosen.join(homographs, ["word", "context"]).drop("context")


def reverse_synonyms(synonyms: DataFrame) -> DataFrame:
    """Synonym to its main term; the alphabetically first main term if there are several."""
    return synonyms.groupBy(F.lower(F.trim("synonym")).alias("synonym")).agg(F.min("term").alias("main"))


def lemma_synonyms(lemmas: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Up to three direct synonyms and one reverse synonym per lemma."""
    direct = lemmas.join(synonyms.where("ord <= 3").withColumnRenamed("term", "lemma"), "lemma").select(
        "lemma", "ord", F.col("synonym").alias("term")
    )
    back = lemmas.join(reverse_synonyms(synonyms).withColumnRenamed("synonym", "lemma"), "lemma").select(
        "lemma", F.lit(4).alias("ord"), F.col("main").alias("term")
    )
    return direct.unionByName(back)


def expand_query_dict(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Query followed by at most two synonyms per word and for the whole text, then main terms."""
    two = synonyms.where("ord <= 2").select("term", "ord", F.lower("synonym").alias("extra"))
    words = queries.select("query", F.posexplode(F.split(X.squeeze(F.lower("query")), " ")).alias("pos", "term"))
    base = words.select("query", F.lit(0).alias("stage"), "pos", F.lit(0).alias("ord"), F.col("term").alias("extra"))
    per_word = words.join(two, "term").select("query", F.lit(1).alias("stage"), "pos", "ord", "extra")
    whole = (
        queries.select("query", X.squeeze(F.lower("query")).alias("term"))
        .join(two, "term")
        .select("query", F.lit(2).alias("stage"), F.lit(0).alias("pos"), "ord", "extra")
    )
    back = words.join(
        reverse_synonyms(synonyms).select(F.col("synonym").alias("term"), F.col("main").alias("extra")), "term"
    ).select("query", F.lit(3).alias("stage"), "pos", F.lit(0).alias("ord"), "extra")
    # per-word synonyms and main terms are added once; the query's own words and the synonyms of
    # the whole text always stay
    keep_all = base.unionByName(whole)
    add_once = per_word.unionByName(back)
    first_seen = (
        keep_all.withColumn("free", F.lit(False)).unionByName(add_once.withColumn("free", F.lit(True)))
        .groupBy("query", "extra")
        .agg(
            F.min(F.when(~F.col("free"), F.struct("stage", "pos", "ord"))).alias("fixed"),
            F.min(F.when(F.col("free"), F.struct("stage", "pos", "ord"))).alias("opt"),
        )
        .where("opt is not null and (fixed is null or fixed > opt)")
        .select("query", "opt.stage", "opt.pos", "opt.ord", "extra")
    )
    return (
        keep_all.unionByName(first_seen)
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("stage", "pos", "ord", "extra"))).alias("parts"))
        .select(
            "query", F.array_join("parts.extra", " ").alias("expanded"),
            F.size(F.filter("parts", lambda p: p["stage"] > 0)).alias("n_added"),
        )
    )


def expand_synonyms(
    requests: DataFrame, synonyms: DataFrame, phrases: DataFrame, homographs: DataFrame,
    aliases: DataFrame, learned: DataFrame, lemmas: DataFrame, stop: list[str],
) -> DataFrame:
    """Set of lemmas for each (query, industry): own words, rewrites, homographs, synonyms.

    ``learned(query, rewrite)`` are product names chosen for the query by many users.
    Returns (query, industry, term) rows.
    """
    asked = requests.select("query", "industry").distinct()
    queries = asked.select("query").distinct()
    own = lemmatize(queries.withColumn("tokens", X.words(F.col("query"), stop)), "query", "tokens", lemmas)
    own_terms = own.select("query", F.explode("lemmas").alias("lemma"))
    rewritten = phrase_rewrite(queries, phrases)
    texts = rewritten.select("query", F.col("rewrite").alias("extra"))
    texts = texts.unionByName(learned.join(queries, "query", "left_semi").select("query", F.col("rewrite").alias("extra")))
    main = reverse_synonyms(synonyms).select(F.col("synonym").alias("query"), F.col("main").alias("extra"))
    texts = texts.unionByName(queries.join(main, "query"))
    open_terms = own_terms.join(rewritten.select("query").distinct(), "query", "left_anti")
    per_context = open_terms.join(asked, "query").select("query", "industry", F.col("lemma").alias("word")).distinct()
    homo = resolve_homograph(per_context, homographs, aliases).select("query", "industry", "word", F.col("expansion").alias("extra"))
    plain = per_context.join(homographs.select("word").distinct(), "word", "left_anti").join(
        synonyms.select(F.col("term").alias("word"), F.col("synonym").alias("extra")), "word"
    ).select("query", "industry", "extra")
    for_all = own_terms.select("query", F.col("lemma").alias("term")).unionByName(
        _lemmas_of(texts, ["query"], lemmas, stop)
    )
    contextual = _lemmas_of(homo.select("query", "industry", "extra").unionByName(plain), ["query", "industry"], lemmas, stop)
    return asked.join(for_all, "query").unionByName(contextual).distinct()


def _lemmas_of(texts: DataFrame, keys: list[str], lemmas: DataFrame, stop: list[str]) -> DataFrame:
    exploded = texts.select(*keys, F.explode(X.words(F.col("extra"), stop)).alias("token"))
    return exploded.join(lemmas, "token", "left").select(*keys, F.coalesce("lemma", "token").alias("term")).distinct()


def catalog_expand(
    lemmas: DataFrame, vocabulary: DataFrame, threshold: float = 0.35, extras: int = 3, min_len: int = 4
) -> DataFrame:
    """Per lemma the most similar other catalogue words by trigram Jaccard.

    Prefix filter: two sets with Jaccard >= t share one of the |x| - ceil(t|x|) + 1 rarest
    trigrams of x, so a frequent trigram rarely takes part; candidates are then verified.
    """
    words = vocabulary.select("word").where(F.length("word") >= min_len).withColumn("wt", X.word_trigrams(F.col("word")))
    words = words.withColumn("wt", F.array_distinct("wt"))
    asked = lemmas.select("lemma").distinct().where(F.length("lemma") >= min_len)
    grams = words.select("word", "wt", F.explode("wt").alias("g"))
    gram_df = grams.groupBy("g").agg(F.count("*").alias("df"))
    asked_grams = asked.select("lemma", F.explode(F.array_distinct(X.word_trigrams(F.col("lemma")))).alias("g")).join(
        gram_df, "g", "left"
    )
    ordered = asked_grams.groupBy("lemma").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))).alias("gs")
    )
    prefix = ordered.select(
        "lemma", F.col("gs.g").alias("lt"),
        F.explode(F.slice(F.col("gs.g"), F.lit(1), F.size("gs") - F.ceil(F.size("gs") * threshold).cast("int") + 1)).alias("g"),
    )
    n, m = F.size("lt"), F.size("wt")
    pairs = (
        grams.join(prefix, "g")
        .where((F.col("word") != F.col("lemma")) & (m >= n * threshold) & (n >= m * threshold))
        .dropDuplicates(["lemma", "word"])
    )
    both = F.size(F.array_intersect("lt", "wt"))
    scored = pairs.select("lemma", "word", F.round(both / (n + m - both), 6).alias("similarity")).where(
        F.col("similarity") >= threshold
    )
    return top_per_group(scored, "lemma", [F.desc("similarity"), "word"], extras)


def build_or_query(terms: DataFrame) -> DataFrame:
    """Ordered, de-duplicated, cleaned terms joined by `` | ``. ``terms(query, ord, term)``."""
    clean = F.trim(F.regexp_replace("term", r"[^\p{L}\p{N}_\s\p{Z}-]", ""))
    return (
        terms.select("query", "ord", clean.alias("term"))
        .where("term <> ''")
        .groupBy("query", "term")
        .agg(F.min("ord").alias("ord"))
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("ts"))
        .select("query", F.array_join("ts.term", " | ").alias("or_query"))
    )
