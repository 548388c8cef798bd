"""Column expressions for text: cleaning, tokens, intent, trigrams. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens.functions import dicts

SPACE = r"[\s\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
UNIT = rf"(\d+){SPACE}*({'|'.join(dicts.UNITS)})(?!{WORD})"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def normalize_units(c: Column) -> Column:
    """Drop the number in front of a unit: '2 кг' -> 'кг'."""
    return F.regexp_replace(c, "(?iu)" + UNIT, "$2")


def normalize_text(c: Column) -> Column:
    text = normalize_units(F.lower(c))
    return squeeze(F.regexp_replace(text, r"[^\p{L}\p{N}_\s\p{Z}.-]", " "))


def tokenize(c: Column) -> Column:
    """Split a query on blanks, hyphens, slashes, commas; drop one-letter tokens."""
    return F.filter(F.split(squeeze(F.lower(c)), rf"[\s\p{{Z}}\-/,;]+"), lambda t: F.length(t) > 1)


def words(c: Column, stop: list[str] | None = None) -> Column:
    """Words of a normalised text without stop words and one-letter words."""
    tokens = F.filter(F.split(normalize_text(c), " "), lambda t: F.length(t) >= 2)
    return without(tokens, stop) if stop else tokens


def without(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(stop))


def remove_stopwords(tokens: Column, stop: list[str]) -> Column:
    """Keep all tokens if nothing else would be left."""
    kept = without(tokens, stop)
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def strip_boilerplate(c: Column) -> Column:
    lead = rf"(?iu)^({'|'.join(dicts.BOILERPLATE)})\s+"
    text = F.trim(c)
    for _ in range(3):
        text = F.trim(F.regexp_replace(text, lead, ""))
    return F.coalesce(F.nullif(text, F.lit("")), c)


NEGATIVE = r"(?iu)(?:^|\s)(?:-|не\s+)(\S+)"


def negative_terms(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(NEGATIVE), F.lit(1)), F.lower)


def drop_negatives(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, NEGATIVE, " "))


def is_latin(word: Column) -> Column:
    return word.rlike(r"^[a-zA-Z][a-zA-Z0-9\-]*$")


def transliterate_letters(word: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), dicts.TRANSLIT_LETTERS, F.lower(word))


def _any_word(options: list[str]) -> str:
    return rf"(?<!{WORD})({'|'.join(options)})(?!{WORD})"


def detect_intent(c: Column) -> Column:
    q = squeeze(c)
    spec = "|".join([
        r"\d{4,}", r"гост\s*р?\s*\d", r"ту\s+\d", rf"(?<!{WORD})[A-Z]{{2,}}\d{{2,}}",
        rf"(?<!{WORD})\d+[xх]\d+", rf"(?<!{WORD})\d+\s*({'|'.join(dicts.SPEC_UNITS)})(?!{WORD})",
    ])
    content = F.filter(
        F.split(F.lower(q), " "), lambda w: (F.length(w) >= 2) & ~w.isin(dicts.BUYING_WORDS)
    )
    return (
        F.when(q.isNull() | (q == ""), "general")
        .when(q.rlike("(?iu)" + _any_word(dicts.REORDER_WORDS)), "reorder")
        .when(q.rlike("(?iu)" + _any_word(dicts.PRICE_WORDS)), "price_check")
        .when(q.rlike("(?iu)(" + spec + ")"), "spec_search")
        .when((F.size(content) <= 2) & ~q.rlike(r"\p{Nd}"), "category_browse")
        .otherwise("general")
    )


def query_length_type(lemmas: Column) -> Column:
    n = F.size(lemmas)
    return F.when(n <= 1, "short").when(n > 3, "long").otherwise("medium")


def word_trigrams(word: Column) -> Column:
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.transform(
        F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))
    )


def trigrams(c: Column) -> Column:
    """Distinct padded character trigrams of all words of a text."""
    parts = F.filter(F.split(F.lower(c), rf"[^\p{{L}}\p{{N}}]+"), lambda w: F.length(w) > 0)
    return F.array_distinct(F.flatten(F.transform(parts, word_trigrams)))


def trigram_similarity(a: Column, b: Column) -> Column:
    ta, tb = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(ta, tb))
    either = F.size(ta) + F.size(tb) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def one_deleted(word: Column) -> Column:
    return F.when(
        F.length(word) > 0,
        F.transform(
            F.sequence(F.lit(1), F.length(word)),
            lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
        ),
    ).otherwise(F.array().cast("array<string>"))


def delete_keys(word: Column, prefix: int = 7) -> Column:
    """The word's prefix with up to two letters deleted.

    Words within edit distance two share at least one key: each edit leaves at most one letter
    of either prefix unmatched.
    """
    head = F.substring(word, 1, prefix)
    once = one_deleted(head)
    twice = F.flatten(F.transform(once, one_deleted))
    return F.array_distinct(F.concat(F.array(head), once, twice))


def short_substrings(c: Column, size: int = 3) -> Column:
    """Distinct substrings of up to ``size`` letters, at every position."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))

    def pieces(n: int) -> Column:
        return F.transform(at, lambda i: F.substring(c, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*[pieces(n) for n in range(1, size + 1)])))
