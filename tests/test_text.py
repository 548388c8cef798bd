import itertools

from pyspark.sql import functions as F

from bidlens.functions import text as X
from bidlens.operators import textprep as P


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


def test_cleaning(spark):
    assert one(spark, "  Бумага 2 кг,  А4! ", X.normalize_text) == "бумага кг а4"
    assert one(spark, "100 шт 5 кгс", X.normalize_units) == "шт 5 кгс"
    assert one(spark, "Стол-стул / a, лампа", X.tokenize) == ["стол", "стул", "лампа"]
    assert one(spark, "поставка товара бумага", X.strip_boilerplate) == "бумага"
    assert one(spark, "закупка ", X.strip_boilerplate) == "закупка"  # never empty
    assert one(spark, "принтер -Лазерный не струйный", X.negative_terms) == ["лазерный", "струйный"]
    assert one(spark, "принтер -лазерный", X.drop_negatives) == "принтер"


def test_stop_words_keep_all_if_nothing_left(spark):
    tokens = F.split(F.col("v"), " ")
    row = spark.createDataFrame([("и в",), ("и стол",)], "v string").select(X.remove_stopwords(tokens, ["и", "в"]).alias("r"))
    assert [r.r for r in row.collect()] == [["и", "в"], ["стол"]]


def test_intents(spark):
    cases = {
        "": "general", "снова бумага": "reorder", "цена бумаги": "price_check", "сценарий": "category_browse",
        "труба 20 мм": "spec_search", "кабель AB12": "spec_search", "стол": "category_browse",
        "купить большой стол для дома": "general",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", X.detect_intent(F.col("v")).alias("i"))
    assert {r.v: r.i for r in df.collect()} == cases


def test_trigrams_are_symmetric(spark):
    df = spark.createDataFrame([("red bolt", "red bolts"), ("", "a"), ("x", "x")], "a string, b string")
    rows = df.select(
        X.trigram_similarity(F.col("a"), F.col("b")).alias("s"), X.trigram_similarity(F.col("b"), F.col("a")).alias("t")
    ).collect()
    assert all(r.s == r.t for r in rows)
    assert rows[2].s == 1.0 and rows[1].s == 0.0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_typo_keys_lose_nothing(spark):
    words = ["".join(w) for n in range(3, 6) for w in itertools.islice(itertools.product("abc", repeat=n), 0, None, 7)]
    words += ["abcabcabca", "abcabcabcb", "cabcabcabca", "bbcabcabcaa"]
    vocab = [(w, 1 + i % 5) for i, w in enumerate(words[::2])]
    tokens = [(w,) for w in words]
    out = P.correct_typos(
        spark.createDataFrame(tokens, "token string"), spark.createDataFrame(vocab, "word string, freq long")
    ).collect()
    got = {r.token: r.corrected for r in out}
    known = dict(vocab)
    for w in words:
        if w in known:
            assert got[w] == w
            continue
        near = sorted((edit_distance(w, v), -f, v) for v, f in vocab if edit_distance(w, v) <= 2)
        assert got[w] == (near[0][2] if near else w)


def test_transliterate(spark):
    terms = spark.createDataFrame([("printer", "принтер"), ("printer laser", "принтер лазерный")], "term string, replacement string")
    rows = spark.createDataFrame([("printer laser",), ("shhuka printer",), ("стол",)], "q string")
    got = {r.q: (r.transliterated, r.was_changed) for r in P.transliterate(rows.withColumn("k", F.col("q")), "q", "k", terms).collect()}
    assert got["printer laser"] == ("принтер лазерный", True)
    assert got["shhuka printer"] == ("щука принтер", True)
    assert got["стол"] == ("стол", False)


def test_catalog_expand_matches_brute_force(spark):
    words = ["paper", "papers", "papery", "pepper", "printer", "sprinter", "print", "prints", "taper", "vapor"]
    def grams(w):
        s = f"  {w} "
        return {s[i:i + 3] for i in range(len(s) - 2)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.lemma, r.word) for r in P.catalog_expand(df.withColumnRenamed("word", "lemma"), df).collect()}
    want = set()
    for a in words:
        near = sorted((-round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 6), b) for b in words if b != a)
        want |= {(a, b) for s, b in near[:3] if -s >= 0.35}
    assert got == want
