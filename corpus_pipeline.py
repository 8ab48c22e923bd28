"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coordspark.llm import decontam, langid, mixing, planes, simhash
from coordspark.llm.common import delete, new_path, scratch, table
from coordspark.llm.queries import END_ID, tokenizer_path

#: A document goes if its language is undetermined or its words' labels are less certain than this on average.
MIN_CERTAINTY = 0.5
#: Near copies: five-word shingles with a Jaccard similarity of this or more.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: The rarest source may be read this often for each time that the most frequent one is; none goes unread.
MAX_REPEATS = 1.25
#: Words whose ids a worker keeps; fewer than alone, since executors have other stages behind them.
CACHED_WORDS = 80_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is determined."""
    return langid.identified(docs, MIN_CERTAINTY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of exact or near copies."""
    return simhash.dedup(docs, SHINGLE_WORDS, SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no item of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of rarer sources again, as their weights ask."""
    return mixing.mixture(docs, MAX_REPEATS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mixture as bit-plane shuffled token ids and lists its documents from the files."""
    return planes.read_tokens(spark, planes.write_tokens(docs, tokenizer_path(), END_ID, cached=CACHED_WORDS))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: No SQL: the first stage is a trained model and the last writes a binary format.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; gives what the last one returns.

    What a stage wrote on its way is deleted once its result is stored, and that result once the next one's is;
    the token files, which are what the pipeline is for, and the last table stay.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
