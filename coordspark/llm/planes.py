"""Token ids in bit-plane shuffled shards: fixed-size id blocks, transposed, each plane compressed by itself.

A shard is one row of a Parquet table (at most about ``SHARD_IDS`` ids, or one longer document), so any store
that Spark writes to will do and a reader needs no other row. It holds:

* ``docs``: for each document its doc_id, its first id's place in the shard and its number of ids;
* ``index``: for each chunk of ``BLOCK_IDS`` ids its first id, number of ids and the byte range of each plane;
* ``payload``: the planes, each a zstandard frame. ``byte`` planes hold the k-th byte of every id of the
  block, ``bit`` planes the k-th bit, eight to a byte; planes above the block's highest set one are left out.

Shards carry the number of the task that wrote them and the number of ids that task had written before, so
the place of any document in the whole stream follows from one small sum over tasks.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coordspark.llm.common import arrow_rows, give_back, new_path, per_worker, text_of

BLOCK_IDS, SHARD_IDS = 1 << 16, 1 << 20
SHARD_SCHEMA = (
    "task int, shard int, before long, n_ids long, plane string,"
    "docs array<struct<doc_id:long,at:long,n:long>>,"
    "index array<struct<at:long,n:int,offset:long,lengths:array<int>>>, payload binary"
)


class WordCache(dict):
    """Ids of a chunk between ASCII spaces, as little-endian 32-bit bytes; cleared when it holds ``limit``.

    Right for tokenizers whose normalizer and pre-tokenizer act on each side of white space by itself and
    give white space no ids.
    """

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.limit, self.tokenizer, self.words = limit, Tokenizer.from_file(path), {}
        self.model, self.letters = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        sample = ["Aé", "zu,", "b", "Übergröße", "l'été"]
        if self.encode_whole(" ".join(sample)) != b"".join(map(self.encode_whole, sample)) or any(self.encode_whole(w) != self.word(w) for w in ("Aé", "zu")):
            raise ValueError("this tokenizer does not treat words by themselves")

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, w: str) -> bytes:
        """A word of letters below U+0130, for which lower case and composed form are plain: the model alone."""
        w = w.lower()
        ids = self.words.get(w)
        if ids is None:
            if len(self.words) >= self.limit:
                self.words.clear()
            letters = w if w.isascii() else self.letters.pre_tokenize_str(w)[0][0]
            ids = self.words[w] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        text = chunk.decode("utf-8", "replace")
        core = text.rstrip(".,;:!?")
        if core.isalpha() and max(core) < "İ":
            ids = self.word(core)
            if len(core) < len(text):
                ids += self[text[len(core) :].encode()] if core else b""
        else:
            ids = self.encode_whole(text)
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


def pack_block(ids: np.ndarray, plane: str, compressor: zstandard.ZstdCompressor) -> list[bytes]:
    """The compressed planes of a block of ids, lowest first."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [compressor.compress(octets[:, k].tobytes()) for k in range((top + 7) // 8)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [compressor.compress(np.packbits(bits[:, k]).tobytes()) for k in range(top)]


def unpack_block(planes: list[bytes], n: int, plane: str, decompressor: zstandard.ZstdDecompressor) -> np.ndarray:
    if plane == "byte":
        octets = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            octets[:, k] = np.frombuffer(decompressor.decompress(p), np.uint8)
        return octets.view("<u4").ravel()
    bits = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(decompressor.decompress(p), np.uint8), count=n)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def pack_shard(ids: np.ndarray, plane: str, block: int, level: int) -> tuple[list[dict], bytes]:
    compressor, index, payload, offset = zstandard.ZstdCompressor(level=level), [], [], 0
    for at in range(0, len(ids), block):
        planes = pack_block(ids[at : at + block], plane, compressor)
        index.append({"at": at, "n": min(block, len(ids) - at), "offset": offset, "lengths": [len(p) for p in planes]})
        payload += planes
        offset += sum(map(len, planes))
    return index, b"".join(payload)


def unpack_shard(index: list[dict], payload: bytes, plane: str) -> np.ndarray:
    decompressor, parts = zstandard.ZstdDecompressor(), []
    for chunk in index:
        ends = chunk["offset"] + np.cumsum([0, *chunk["lengths"]])
        parts.append(unpack_block([payload[a:b] for a, b in zip(ends, ends[1:], strict=False)], chunk["n"], plane, decompressor))
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, plane: str = "byte", path: str | None = None, block: int = BLOCK_IDS, shard_ids: int = SHARD_IDS, level: int = 3, cached: int = 600_000) -> str:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order, each with ``end_id`` after it; gives the path.

    ``tokenizer`` is a file of the tokenizers library that every executor has. A null doc_id comes first;
    rows of one doc_id are ordered by a hash of their text. A null or empty text gives ``end_id`` alone. A worker
    keeps the ids of up to ``cached`` words.
    """
    from pyspark import TaskContext

    if plane not in ("byte", "bit"):
        raise ValueError("plane must be byte or bit")
    spark, end = docs.sparkSession, np.array([end_id], "<u4").tobytes()
    path = path or new_path(spark, "token-ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = per_worker(("tokenizer", tokenizer, cached), lambda: WordCache(tokenizer, cached))
        task, shard, before = TaskContext.get().partitionId(), 0, 0
        held, listed, n = [], [], 0
        schema = pa.schema([("task", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("plane", pa.string()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))), ("index", pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int32()), ("offset", pa.int64()), ("lengths", pa.list_(pa.int32()))]))), ("payload", pa.binary())])

        def close() -> pa.RecordBatch:
            index, payload = pack_shard(np.frombuffer(b"".join(held), "<u4"), plane, block, level)
            return pa.RecordBatch.from_pylist([{"task": task, "shard": shard, "before": before, "n_ids": n, "plane": plane, "docs": listed, "index": index, "payload": payload}], schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = cache.encode(text.as_py()) + end
                if n and n + len(ids) // 4 > shard_ids:
                    yield close()
                    shard, before, held, listed, n = shard + 1, before + n, [], [], 0
                listed.append({"doc_id": doc_id, "at": n, "n": len(ids) // 4})
                held.append(ids)
                n += len(ids) // 4
        if listed:
            yield close()
            held.clear()
        give_back(keep=True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    packed = ordered.select("doc_id", "text").mapInArrow(pack, SHARD_SCHEMA)
    with arrow_rows(spark, 1000):
        packed.write.option("parquet.block.size", 16 << 20).option("compression", "uncompressed").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """From the files: ``(doc_id, start, n_tokens, ids_crc32)``, where start counts the ids before the document."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                data = unpack_shard(row["index"], row["payload"], row["plane"])
                if len(data) != row["n_ids"]:
                    raise ValueError(f"shard {row['task']}-{row['shard']} holds {len(data)} ids, not {row['n_ids']}")
                docs = pd.DataFrame(row["docs"])
                crcs = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(docs["at"], docs["n"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["task"]] * len(docs), pa.int32()), pa.array([x["doc_id"] for x in row["docs"]], pa.int64()), pa.array(docs["at"] + row["before"], pa.int64()), pa.array(docs["n"], pa.int64()), pa.array(crcs, pa.int64())], ["task", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = shards.mapInArrow(unpack, "task int, doc_id long, at long, n_tokens long, ids_crc32 long")
    per_task = shards.groupBy("task").agg(F.sum("n_ids").alias("n"))  # as many rows as tasks that wrote
    starts = per_task.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("first"))
    return docs.join(F.broadcast(starts), "task").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def ids_of(spark: SparkSession, path: str) -> DataFrame:
    """From the files: ``(doc_id, ids)``."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                data = unpack_shard(row["index"], row["payload"], row["plane"])
                yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in row["docs"]], pa.int64()), pa.array([data[d["at"] : d["at"] + d["n"]].astype("i8") for d in row["docs"]], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return shards.mapInArrow(unpack, "doc_id long, ids array<long>")
