"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.llm import decontam, exact, langid, lines, mixing, planes, secrets, sharding, simhash, warc
from coordspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The tokenizer file, by the package that holds it; the id that ends a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: The share of the greatest entropy that the mixture reaches, its most repeats, and its seed.
MIX_ENTROPY, MIX_REPEATS, MIX_SEED = 0.95, 4.0, 0


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2)
    return found.select("doc_id", simhash.print_hex(found.fp).alias("fingerprint"), "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.page_rows(warc.assemble(warc.read_records(spark, path, with_payload=False)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = planes.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return planes.read_tokens(spark, path)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, target_entropy=MIX_ENTROPY, max_repeats=MIX_REPEATS, seed=MIX_SEED)
    return mixed.select("doc_id", "source", mixing.tokens().alias("tokens"), F.col("mix_alpha").alias("alpha"), F.round("mix_weight", 6).alias("weight"), F.col("mix_block").alias("block"), F.col("mix_rank").alias("block_rank"), F.col("mix_copies").alias("copies"))


def queries() -> dict[str, Query]:
    ops = (op1_language_id, op2_virtual_slots, op3_simhash, op4_secrets, op5_warc, op6_exact_dedup, op7_bit_planes, op8_decontamination, op9_line_chunks, op10_temperature_mix)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": secrets.ORACLE_SQL, "op5_warc": warc.ORACLE_SQL, "op6_exact_dedup": exact.ORACLE_SQL, "op9_line_chunks": lines.ORACLE_SQL, "op10_temperature_mix": mixing.ORACLE_SQL}
