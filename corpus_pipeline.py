"""Corpus pipeline: from raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared checkpoint folder and reads it back for the next stage.

1. language_id    rejects documents without letters or without likeness to any language
2. simhash        keeps one document of each group of near-duplicates
3. suffix_dedup   cuts out bytes of 200-byte strings that stand elsewhere, too
4. mix_sources    repeats or drops documents so that sources meet their target weights
5. byte_bpe       encodes the texts and decodes them again
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import byte_bpe, language_id, mixing, passage_dedup, simhash
from vigil.llm.common import scratch_dropped, scratch_path
from vigil.llm.plans import tokenizer_file, tokenizer_pattern
from vigil.session import ensure_defaults


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.drop_foreign(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle=3, radius=2)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passage_dedup.drop_passages(docs, window=200)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (little-endian unsigned 32-bit), n_tokens and both digests."""
    named = [F.col(c) for c in ("doc_id", "lang", "source")]
    encoded = byte_bpe.encode_texts(
        docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern(), *named
    )
    return byte_bpe.token_digests(encoded, *named, F.col("ids"))


STAGES = [
    ("language_id", language_stage),
    ("simhash", simhash_stage),
    ("suffix_dedup", passage_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", token_stage),
]

#: Fingerprints, suffix arrays and tokens are no SQL; tests compare ``run`` with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scratch_dropped(spark):  # a stage's own tables; its result stays
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
