"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.audio import aligned
from quarry.llm.bpe import bpe_digests
from quarry.llm.langid import language_id
from quarry.llm.minhash import near_duplicates
from quarry.llm.license import license_scan, license_sql
from quarry.llm.mixing import mix_documents
from quarry.llm.secrets import secret_scan
from quarry.llm.sharding import regular, shard, shard_sql
from quarry.llm.suffix import repeated_passages
from quarry.llm.vectors import vector_duplicates

SHARDS, GROWN = regular(24, 3, 4), regular(24, 3, 4, extra=1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: documents has no paths: ids are dealt over directories three deep, and every fifth document is a licence file at one of the three levels.
PATH = """concat({source}, CASE WHEN {id} % 5 = 0 AND {half} % 3 = 2 THEN '' ELSE concat('/', {third}) END,
CASE WHEN {id} % 5 = 0 AND {half} % 3 >= 1 THEN '' ELSE concat('/', {fourth}) END, CASE WHEN {id} % 5 = 0 THEN concat('/LICENSE.', {id}) ELSE concat('/', {id}, '.txt') END)"""
LICENCE_FILE = "coalesce(doc_id % 5 = 0, false)"


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = PATH.format(id="doc_id", source="coalesce(source, '')", half="(doc_id div 5)", third="(doc_id div 2000)", fourth="(doc_id div 200)")
    return license_scan(table(spark, sf_dir, "documents"), F.expr(path), F.expr(LICENCE_FILE))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no recordings: a text's UTF-8 bytes are read as unsigned 8-bit samples. Queries: ids divisible by 100."""
    docs = table(spark, sf_dir, "documents")
    out = aligned(docs, F.col("id") % 100 == 0, "doc_id", F.encode("text", "UTF-8"))
    return out.withColumnRenamed("id", "doc_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache_words=600_000)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), SHARDS, GROWN)


#: By brute force: all pairs of a label, and what is reachable.
VECTORS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id <= coalesce(low.b, vec_id) AS kept FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id"""

QUERIES = {"op1_license": op1_license, "op8_audio": op8_audio, "op2_bpe": op2_bpe, "op3_mixing": op3_mixing, "op4_near_duplicates": op4_near_duplicates, "op5_passages": op5_passages, "op7_vectors": op7_vectors, "op9_sharding": op9_sharding, "op6_secrets": op6_secrets, "op10_language": op10_language}
SQL: dict[str, str] = {"op1_license": license_sql(PATH.format(id="doc_id", source="coalesce(source, '')", half="(doc_id // 5)", third="(doc_id // 2000)", fourth="(doc_id // 200)"), LICENCE_FILE), "op7_vectors": VECTORS_SQL, "op9_sharding": shard_sql(SHARDS, GROWN)}
