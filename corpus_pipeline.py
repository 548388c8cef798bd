"""From raw documents to token ids: quality rules, near copies, secrets, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last keep the columns of documents. Any column may hold nulls, texts may be empty or very long, rows may
repeat; empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidlens.llm import bpe, mixing, qualityrules, registry, secretscan, setjoin
from bidlens.llm.tables import load, ship, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    return qualityrules.keep_good(docs, load(spark, sf_dir, "labels"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one document stays."""
    ship(spark)
    return setjoin.one_of_each(docs, 80, 100, 5)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets other than widely copied examples are replaced by their kind; every document stays."""
    ship(spark)
    return secretscan.mask_secrets(docs, registry.repo(), registry.owner())


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the source mix takes it, 0 to 3 times."""
    return mixing.apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    ship(spark)
    return bpe.encode_texts(docs, registry.TOKENIZER, keep_ids=True)


STAGES = [
    ("quality_rules", quality_stage), ("near_copies", near_copy_stage), ("secrets", secret_stage), ("source_mix", mix_stage),
    ("bpe", token_stage),
]
ORACLE_SQL = None  # forest, set join and BPE are beyond SQL; tests/llm hold a brute-force pipeline


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is staged in the shared folder."""
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
