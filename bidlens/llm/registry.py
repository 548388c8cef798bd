"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from bidlens.llm import (
    bpe, chat, factor, gnat, mixing, oracles, qualityrules, secretscan, setjoin, suffix, topk, urlrules, whiten, windows,
)
from bidlens.llm.tables import load

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def repo():
    return F.concat_ws("/", "source", "lang")


def owner():
    return F.col("source")


def op1_topk_search(spark, folder):
    return topk.search(load(spark, folder, "embeddings"))


def op2_secret_scan(spark, folder):
    found = secretscan.scan_secrets(load(spark, folder, "documents"), repo(), owner())
    held = lambda verdict: F.size(F.filter("hits", lambda h: h["verdict"] == verdict)).cast("long")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secretscan.hit_list().alias("spans"),
        held("live").alias("n_live"), held("shared").alias("n_shared"), held("example").alias("n_example"),
        secretscan.hit_list(fields=("repos", "owners")).alias("holders"),
    )


def op3_bpe(spark, folder):
    return bpe.encode_texts(load(spark, folder, "documents"), TOKENIZER)


def op4_url_filter(spark, folder):
    rules = spark.createDataFrame(urlrules.RULES, "verdict string, rule string")
    return urlrules.match_urls(load(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


def op5_chat_rotation(spark, folder):
    return chat.rotate_perspectives(load(spark, folder, "conversations"))


def op6_jaccard_join(spark, folder):
    return setjoin.jaccard_components(load(spark, folder, "documents"))


def op7_suffix_dedup(spark, folder):
    return suffix.remove_repeats(load(spark, folder, "documents"))


def op8_source_mix(spark, folder):
    return mixing.mix_sources(load(spark, folder, "documents"))


def op9_quality_classifier(spark, folder):
    return factor.score_quality(load(spark, folder, "documents"), load(spark, folder, "labels"))


def op10_quality_rules(spark, folder):
    return qualityrules.quality_rules(load(spark, folder, "documents"), load(spark, folder, "labels"))


def op11_embedding_whitening(spark, folder):
    return whiten.whiten(load(spark, folder, "embeddings"))


def op12_hard_negatives(spark, folder):
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return gnat.mine(load(spark, folder, "embeddings").withColumn("label", flipped))


def op13_substring_dedup(spark, folder):
    kept = windows.remove_windows(load(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = [
    op1_topk_search, op2_secret_scan, op3_bpe, op4_url_filter, op5_chat_rotation, op6_jaccard_join,
    op7_suffix_dedup, op8_source_mix, op9_quality_classifier, op10_quality_rules, op11_embedding_whitening,
    op12_hard_negatives, op13_substring_dedup,
]


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return dict(oracles.SQL)
