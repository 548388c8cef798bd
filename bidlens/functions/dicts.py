"""Small dimension tables. A user replaces any of them with a table of their own.

The word lists and constants below are fixed values of the search service whose results this
package reproduces; the industry/category tables are samples for the test data.
"""

# --- fixed values: stop words of the query log (two lists) --------------------------------
QUERY_STOP_WORDS = [
    "и", "в", "на", "с", "по", "для", "из", "или", "а", "но",
    "не", "что", "это", "как", "к", "о", "от", "до", "же",
]
TEXT_STOP_WORDS = [
    "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а",
    "то", "все", "она", "так", "его", "но", "да", "ты", "к", "у", "же",
    "вы", "за", "бы", "по", "только", "ее", "мне", "было", "вот", "от",
    "меня", "еще", "нет", "о", "из", "ему", "теперь", "когда", "даже",
    "ну", "вдруг", "ли", "если", "уже", "или", "ни", "быть", "был",
    "него", "до", "вас", "нибудь", "опять", "уж", "вам", "ведь", "там",
    "потом", "себя", "ничего", "ей", "может", "они", "тут", "где", "есть",
    "надо", "ней", "для", "мы", "тебя", "их", "чем", "была", "сам", "чтоб",
    "без", "будто", "чего", "раз", "тоже", "себе", "под", "при",
]
# stop words of the Latin-script sample corpus
SAMPLE_STOP_WORDS = ["the", "and", "of", "in", "is", "with", "by", "for", "le", "la", "un", "der", "die", "el"]

# --- fixed values: leading procurement words removed from a query -------------------------
BOILERPLATE = [
    "поставка", "поставку", "закупка", "закупку", "закупок", "приобретение", "приобретению",
    "покупка", "покупку", "снабжение", "снабжению", "обеспечение", "обеспечению",
    r"услуги?\s+по\s+поставке", r"услуги?\s+поставки", "товар[ыа]?",
]

# --- fixed values: units whose leading number is dropped ----------------------------------
UNITS = ["кг", "г", "мг", "л", "мл", "шт", "уп", "рул", "пач", "м", "мм", "см", "км", "т"]

# --- fixed values: Latin to Cyrillic letters, longest first -------------------------------
TRANSLIT_LETTERS = [
    ("shh", "щ"), ("sh", "ш"), ("ch", "ч"), ("yu", "ю"), ("ya", "я"), ("yo", "ё"), ("ye", "е"),
    ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("eh", "э"), ("a", "а"), ("b", "б"), ("v", "в"),
    ("g", "г"), ("d", "д"), ("e", "е"), ("z", "з"), ("i", "и"), ("j", "й"), ("k", "к"),
    ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"), ("r", "р"), ("s", "с"),
    ("t", "т"), ("u", "у"), ("f", "ф"), ("x", "кс"), ("y", "ы"),
]
# sample of the whole-term table; users bring the full one
TRANSLIT_TERMS = [
    ("printer", "принтер"), ("printer laser", "принтер лазерный"), ("laptop", "ноутбук"),
    ("monitor", "монитор"), ("paper", "бумага"), ("pencil", "карандаш"), ("gloves", "перчатки"),
    ("cement", "цемент"), ("paint", "краска"), ("lamp", "лампа"), ("bolt", "болт"), ("ring", "кольцо"),
]

# --- fixed values: intent rules ------------------------------------------------------------
REORDER_WORDS = ["снова", "ещё раз", "опять", "повтор", "как в прошлый раз", "как прошлый раз", "заново"]
PRICE_WORDS = ["цена", "цены", "стоимость", "стоимости", "сколько стоит", "почём", "расценки", "прайс"]
SPEC_UNITS = ["мм", "см", "м", "л", "кг", "г", "шт", "уп"]
BUYING_WORDS = [
    "купить", "найти", "заказать", "поставка", "подобрать", "нужен", "нужна", "нужны", "требуется", "ищу",
]
# intent, history multiplier, popularity multiplier, trigram multiplier, text multiplier, price context, text
INTENT_STRATEGY = [
    ("reorder", 2.0, 1.0, 1.0, 1.0, True, "Повторная закупка — ваши прошлые товары выше"),
    ("price_check", 1.0, 1.0, 1.0, 1.0, True, "Поиск по цене — показываем данные по контрактам"),
    ("spec_search", 1.0, 1.0, 1.5, 0.7, False, "Точный поиск по характеристикам"),
    ("category_browse", 1.0, 1.8, 1.0, 1.0, False, "Просмотр категории — популярные товары выше"),
    ("general", 1.0, 1.0, 1.0, 1.0, False, "Стандартный поиск"),
]

# --- samples for the test data ------------------------------------------------------------
INDUSTRY_CATEGORIES = [
    ("BUILDING", "MEDIUM"), ("BUILDING", "LARGE"), ("MACHINERY", "STANDARD"), ("MACHINERY", "LARGE"),
    ("FURNITURE", "SMALL"), ("FURNITURE", "PROMO"), ("AUTOMOBILE", "ECONOMY"), ("AUTOMOBILE", "STANDARD"),
    ("HOUSEHOLD", "SMALL"), ("HOUSEHOLD", "ECONOMY"),
]
UNIVERSAL_CATEGORIES = [("STANDARD",)]
DOMAIN_CATEGORIES = [
    ("LARGE", "BUILDING"), ("LARGE", "MACHINERY"), ("PROMO", "FURNITURE"),
    ("ECONOMY", "AUTOMOBILE"), ("ECONOMY", "HOUSEHOLD"),
]
SYNONYMS = [  # term, ordinal, synonym
    ("hot", 1, "warm"), ("hot", 2, "heated"), ("hot", 3, "thermal item"), ("bolt", 1, "screw"),
    ("bolt", 2, "fastener"), ("ring", 1, "washer"), ("small", 1, "mini"), ("small ring", 1, "tiny washer"),
    ("plate", 1, "sheet metal"),
]
PHRASE_REWRITES = [  # ordinal, phrase, rewrite ordinal, rewrite
    (1, "red bolt", 1, "red screw"), (1, "red bolt", 2, "scarlet fastener"), (2, "old rod", 1, "used bar"),
    (3, "ring", 1, "round seal"),
]
HOMOGRAPHS = [  # word, context, ordinal, expansion
    ("plate", "building", 1, "base plate"), ("plate", "building", 2, "slab"), ("plate", "default", 1, "dish"),
    ("gear", "machinery", 1, "cog wheel"), ("gear", "default", 1, "equipment"), ("rod", "default", 1, "bar"),
]
INDUSTRY_ALIASES = [("construction", "building"), ("automobile", "machinery"), ("household", "home")]
LEMMAS = [("rings", "ring"), ("bolts", "bolt"), ("widget", "gadget"), ("small", "little"), ("the", "the")]

# --- fixed values: signals and weights ----------------------------------------------------
ACTION_WEIGHTS = [
    ("purchase", 5.0), ("add_to_compare", 3.0), ("compare", 3.0), ("click", 1.0), ("view", 0.5), ("bounce", -2.0),
]
FEATURES = [
    "bm25_score", "semantic_score", "category_match", "category_weight", "profile_similarity",
    "popularity_score", "name_length", "is_previously_purchased", "is_negative_signal",
    "total_user_contracts", "session_click_count",
]
FEATURE_WEIGHTS = [0.40, 0.40, 0.03, 0.02, 0.03, 0.03, 0.01, 0.02, -0.05, 0.01, 0.01]
FEATURE_TEXTS = [
    ("bm25_score", "Exact keyword match in product name"),
    ("semantic_score", "Semantic meaning similarity to your query"),
    ("category_match", "Product category matches your purchase history"),
    ("category_weight", "Frequently purchased product category"),
    ("profile_similarity", "Similar to products you've bought before"),
    ("popularity_score", "Popular product among all buyers"),
    ("name_length", "Specific product description"),
    ("is_previously_purchased", "You have purchased this product before"),
    ("is_negative_signal", "You previously showed disinterest in this product"),
    ("total_user_contracts", "Adjusted for your experience level"),
    ("session_click_count", "Adjusted based on your current session activity"),
]
# factor, text with its placeholder filled, text without
FACTOR_TEXTS = [
    ("bm25", None, "Точное совпадение слов в названии товара"),
    ("semantic", None, "Семантически похож на запрос пользователя"),
    ("history", "Пользователь закупал товары категории «{category}» — {count} контрактов в истории",
     "Совпадает с историей закупок пользователя"),
    ("category", "Входит в предпочтительную категорию «{category}»", "Входит в предпочтительную категорию"),
    ("session", "Пользователь просматривал похожие товары {count} раз в этой сессии",
     "Интерес проявлен в текущей сессии"),
    ("negative", None, "Снижен в позиции — пользователь ранее отклонил похожие товары"),
    ("profile_mismatch", "Вероятно не соответствует профилю пользователя (категория: {category})",
     "Вероятно не соответствует профилю пользователя"),
    ("popularity", None, "Часто заказывается другими покупателями"),
    ("region", None, "Популярно в вашем регионе"),
    ("like_boost", None, "Поднят — пользователь оценил этот товар положительно"),
    ("dislike_penalty", None, "Опущен — пользователь отметил как нерелевантный"),
    ("catboost", None, "ML-модель оценила как подходящий для данного пользователя"),
    ("decay", "Категория «{category}» давно не просматривалась — приоритет снижен",
     "Категория давно не просматривалась — приоритет снижен"),
    ("freshness", None, "Товар имеет высокую активность в последнее время"),
]
EVENT_TYPES = ["click", "view", "compare", "like", "dislike", "bounce", "hide"]
