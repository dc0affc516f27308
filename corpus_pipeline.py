"""Corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all its predecessor kept. All but the
last return the columns of ``documents``; the last returns the placed pieces of every document left.
Defined cases: null texts and those without a letter go in the first stage; repeated rows count as one
document from the second on, unrelated texts under one id (or none) all stay; of near duplicates the one
of the smallest id stays, of several under it the one whose text hashes lower; texts of any length are read
whole; columns beside those of ``documents``, whatever their names, pass through every stage but the last;
an empty table, or an empty benchmark, passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language, near_dup, packing, pii
from millrace.llm.common import fold, materialize, table
from millrace.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that resemble a language of the corpus."""
    return language.keep_identified(docs, language.learn(docs, fold(4) != 2))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dup.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows where a text changed."""
    out = pii.redact(docs.withColumn("__was", F.xxhash64("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.xxhash64("text") != F.col("__was"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises what is left and packs it."""
    return packing.run(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: components, learned models and tokenisers are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
