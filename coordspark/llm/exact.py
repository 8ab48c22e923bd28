"""Exact de-duplication: counting quotient filters find repeated fingerprints, bytes decide.

Each partition builds counting quotient filters of its texts' 64-bit fingerprints. The leading bits choose a
block (the shuffle key), the next ``QUOTIENT_BITS`` the quotient, the rest is the remainder. A filter keeps an
occupied bit for each quotient, a run-end bit for each remainder, the remainders in order and the counts above
one. Filters of a block merge losslessly, since quotient and remainder give the whole fingerprint back and
runs are sorted. Texts whose fingerprint counts once are unique; the others are grouped by their bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import matched, text_of, written

QUOTIENT_BITS = 8
#: Fingerprints that a partition holds before it gives its filters out, and that a block is planned to hold.
PARTITION_HELD, BLOCK_HELD = 4_000_000, 1_000_000


class CountingQuotientFilter:
    """Distinct values below ``2**bits`` with counts, as quotients, remainder runs and counters."""

    def __init__(self, bits: int, values: np.ndarray, counts: np.ndarray):
        """``values`` ascending and distinct."""
        self.bits, self.values, self.counts = bits, values.astype(np.uint64), counts.astype(np.int64)

    @classmethod
    def of(cls, bits: int, values: np.ndarray) -> CountingQuotientFilter:
        return cls(bits, *np.unique(values.astype(np.uint64), return_counts=True))

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        """The sorted runs of all filters as one: the stable sort finds runs that are in order and merges them. Equal
        remainders of a quotient add their counts."""
        values = np.concatenate([self.values, *(o.values for o in others)])
        counts = np.concatenate([self.counts, *(o.counts for o in others)])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
        return CountingQuotientFilter(self.bits, values[first], np.add.reduceat(counts, first) if len(first) else counts)

    def to_bytes(self) -> bytes:
        remainder_bits = max(0, self.bits - QUOTIENT_BITS)
        quotients = (self.values >> np.uint64(remainder_bits)).astype(np.int64)
        occupied, run_end = np.zeros(1 << QUOTIENT_BITS, bool), np.ones(len(self.values), bool)
        occupied[quotients] = True
        run_end[:-1] = quotients[1:] != quotients[:-1]
        width = (remainder_bits + 7) // 8
        remainders = (self.values & np.uint64((1 << remainder_bits) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        many = np.flatnonzero(self.counts > 1)
        return b"".join((struct.pack("<BII", self.bits, len(self.values), len(many)), np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(), remainders.tobytes(), many.astype("<u4").tobytes(), self.counts[many].astype("<i8").tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, n, n_many = struct.unpack_from("<BII", data)
        at = struct.calcsize("<BII")
        remainder_bits = max(0, bits - QUOTIENT_BITS)
        width = (remainder_bits + 7) // 8

        def take(size: int, dtype: str) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size).view(dtype)

        occupied = np.flatnonzero(np.unpackbits(take((1 << QUOTIENT_BITS) // 8, "u1")))
        run_end = np.unpackbits(take((n + 7) // 8, "u1"))[:n]
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :width] = take(n * width, "u1").reshape(n, width)
        runs = np.cumsum(run_end) - run_end
        counts = np.ones(n, np.int64)
        many = take(n_many * 4, "<u4").astype(np.int64)
        counts[many] = take(n_many * 8, "<i8")
        values = occupied[runs].astype(np.uint64) << np.uint64(remainder_bits) | remainders.view("<u8").ravel()
        return cls(bits, values, counts)


def repeated_fingerprints(prints: DataFrame, block_bits: int) -> DataFrame:
    """``prints(fp)`` to ``(fp, n)`` for those that occur more than once."""
    rest = 64 - block_bits

    def give_out(held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(held))
        blocks = (values >> np.uint64(rest)).astype(np.int64) if block_bits else np.zeros(len(values), np.int64)
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        own = values & np.uint64((1 << rest) - 1)
        filters = [CountingQuotientFilter.of(rest, part).to_bytes() for part in np.split(own, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(blocks[cuts], pa.int64()), pa.array(filters, pa.binary())], ["block", "filter"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64).copy())
                n += b.num_rows
            if n >= PARTITION_HELD:
                yield give_out(held)
                held, n = [], 0
        if held:
            yield give_out(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first, *others = map(CountingQuotientFilter.from_bytes, pdf["filter"])
        merged = first.merge(*others)
        many = merged.counts > 1
        fps = merged.values[many] | (np.uint64(pdf["block"].iloc[0]) << np.uint64(rest) if block_bits else np.uint64(0))
        return pd.DataFrame({"fp": fps.view(np.int64), "n": merged.counts[many]})

    built = prints.select("fp").mapInArrow(build, "block long, filter binary")
    return built.groupBy("block").applyInPandas(merge, "fp long, n long")


def normalised(text: str | Column = "text") -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", "")


def exact_groups(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, keep_id, group_size, kept, text_sha256)``, a row for each input row.

    Texts are equal when identical without white space ``[\\x20\\x09-\\x0D]``; null and empty texts are equal.
    The row with the most code points in its original text stays, then the one with the smallest doc_id (of any
    type that can be ordered; a null one comes last), then any one of rows that repeat both. Texts of any length are
    read whole. Other columns, whatever their names, are ignored. An empty table gives no row.
    """
    text, norm = text_of(), normalised()
    row = docs.select("doc_id", F.length(text).cast("long").alias("points"), norm.alias("norm"))
    row = row.select("doc_id", "points", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"))
    rows = written(row.withColumn("row", F.monotonically_increasing_id()), "texts")
    total, parts = rows.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block_bits = max(1, (max(total // BLOCK_HELD, 2 * parts) - 1).bit_length())
    repeats = written(repeated_fingerprints(rows, block_bits).select("fp"), "repeats")

    hashed = docs.select(norm.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    suspects = matched(hashed, repeats, ["fp"], 16, "left_semi", counted=rows)
    by_bytes = suspects.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    verified = written(by_bytes.select(F.sha2("norm", 256).alias("text_sha256"), "group_size"), "groups")
    first = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("absent"), "doc_id", "row"))
    of_group = matched(rows, verified, ["text_sha256"], 100).groupBy("text_sha256", "group_size").agg(first.alias("first"))
    names = [F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")]
    keepers = written(of_group.select("text_sha256", "group_size", *names), "keepers")
    alone = F.col("group_size").isNull()
    return matched(rows, keepers, ["text_sha256"], 120, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


ORACLE_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
  from documents
)
select doc_id,
       first_value(doc_id) over (partition by norm order by points desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over (partition by norm order by points desc, doc_id) = 1 as kept,
       sha256(norm) as text_sha256
from t
"""
