"""The corpus pipeline: language identification, near-dedup, secret masking, mixing, tokenization.

Every stage takes any table with the columns of documents, with nulls in any of them, and with more columns, whatever their names, which all but the last stage hand on. An empty
table gives an empty table. Texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, langid, minhash, mixing, secrets
from quarry.llm.common import written

#: The vocabulary of the tokens, whose words also rank what is easily guessed.
WORDS = public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the model rejects; a null text, and one without a letter, is rejected. Repeated rows go or stay together. Where no row has a language to learn from, all go."""
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that with the least id; of rows of one id one. Copies without an id go too; what has no words, and an id of its own or none, stays."""
    return minhash.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts, sets n_chars anew and keeps all rows, repeated ones alike; a null text stays null, with a null length."""
    return secrets.without_secrets(docs, WORDS, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as the mix does: a repeated document is a repeated row. A null source is a source; a row without words is taken as its source's others are, at no cost."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the tokens and of the text decoded from them, one row for each row; a null text has none, as the empty one."""
    return bpe.bpe_digests(docs, WORDS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Classifier, signatures, guess costs and merges have no SQL form; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
