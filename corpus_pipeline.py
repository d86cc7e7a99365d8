"""Corpus pipeline: five stages over ``documents``, each written and read again.

Each stage works on all that the one before it kept.  A null id stays through
every stage; a null text goes at the first (it has no letter).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privtab.llm import bpe, common, decontaminate, langid, neardup, queries, substrings

REST = ("lang", "source", "n_chars")
COLUMNS = ["doc_id", "text", *REST]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    out = langid.identify(docs, queries.remainder("doc_id", 4) != 2, carry=REST, with_text=True)
    return out.filter("NOT rejected").select("doc_id", "text", "carry.*").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id
    (of rows that repeat an id and a text, one; a null id stays)."""
    kept = neardup.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS)).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the text; a text
    that loses words is its kept words joined by one space."""
    out = substrings.remove_repeats(docs, carry=REST)
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("carry.n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "carry.lang", "carry.source", chars.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.contamination(docs, benchmark, carry=REST)
    return out.filter("NOT contaminated").select("doc_id", "text", "carry.*").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept text, with digests of ids and decoded text."""
    out = bpe.encode_texts(docs, queries.vocabulary(), carry=REST)
    return out.select("doc_id", "carry.*", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("decontamination", decontamination), ("bpe_tokens", tokens)]

#: Language ID, MinHash and BPE have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
