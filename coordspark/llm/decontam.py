"""Benchmark decontamination: rare n-gram seeds join training passages to test items, alignment scores them.

One scan of the corpus hashes words and keeps, of each text, the regions around n-grams that occur in the benchmark.
How often each n-gram was met tells which of an item's seeds are rare; regions and items meet on those in a join.
A passage is aligned if it has so many of the item's words, in whatever order, that its score could suffice.
Smith-Waterman over words (match 1, mismatch and gap -1) then scores the passage; its share of the item's length
is the score, so that edited and partly reworded copies count.

An item of L words leaves out its ``L * (1.5 * min_score - 0.5) - 3`` most frequent seeds. A passage with e changed
words that scores ``min_score`` holds more trigrams of the item than that, since e is at most
``L * (1 - min_score) / 2`` and each takes three; so for items of twelve words or more, at a score of a half, only a
passage with words put in after every second or third of its words can score so and be missed. Shorter items may
be missed where they are edited. The benchmark is a stated query set, taken in blocks of a bounded size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coordspark.llm.common import Shared, give_back, matched, pieces, scratch, small, text_of, written

#: Words of benchmark text that a block holds (16 bytes for each go to every task).
BLOCK_WORDS = 1_000_000
#: Characters of scripts that write no blanks between words; each counts as a word: Thai to Myanmar, Khmer, kana,
#: CJK ideographs and their extensions.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def plain(chunk: str) -> str:
    """A word without case and without what is neither letter nor digit."""
    return "".join(c for c in chunk.lower() if c.isalnum())


def chunks_of(text: str) -> list[str]:
    """What stands between any white space, and each character of a script without blanks."""
    return (text if text.isascii() else _UNSPACED.sub(r" \g<0> ", text)).split()


class Words(dict):
    """Chunk to the signed 64-bit hash of its plain word, 0 for none. Bounded like a cache."""

    def __init__(self, limit: int = 100_000):
        self.limit = limit

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        word = plain(chunk).encode("utf-8", "replace")
        number = self[chunk] = (xxhash.xxh64_intdigest(word) or 1) - (1 << 63) or 1 if word else 0
        return number

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts in a row, and the place of each one's text."""
        chunks = [chunks_of(t) for t in texts]
        lengths = [len(c) for c in chunks]
        flat = np.fromiter((self[c] for own in chunks for c in own), np.int64, sum(lengths))
        return flat[flat != 0], np.repeat(np.arange(len(texts)), lengths)[flat != 0]


def gram_keys(w: np.ndarray, words: int) -> np.ndarray:
    """A 64-bit key of each run of ``words`` words; the alignment settles the rare case of two runs with one key."""
    n = max(0, len(w) - words + 1)
    key = np.full(n, words, np.uint64)
    for i in range(words):
        key = (key ^ w[i : i + n].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


@dataclass
class Seeds:
    """The n-grams of a block of items: distinct keys, ascending, and the words that a region needs on either side.

    ``maybe`` has a bit for each low end of a key, so that most n-grams of a text are turned away by one look.
    """

    words: int
    keys: np.ndarray
    left: np.ndarray
    right: np.ndarray
    maybe: np.ndarray

    @classmethod
    def of(cls, table: pd.DataFrame, words: int) -> Seeds:
        """``table(key, item, offset, length, slack)`` with a row for each n-gram of each item."""
        reach = table.assign(left=table["offset"] + table["slack"], right=table["length"] - table["offset"] + table["slack"])
        most = reach.groupby("key")[["left", "right"]].max()
        keys = most.index.to_numpy(np.int64)
        bits = max(16, len(keys).bit_length() + 4)
        maybe = np.zeros(1 << bits, bool)
        maybe[keys & ((1 << bits) - 1)] = True
        return cls(words, keys, most["left"].to_numpy(np.int32), most["right"].to_numpy(np.int32), maybe)

    def met(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``key`` that are seeds, and which seeds they are."""
        at = np.flatnonzero(self.maybe[key & (len(self.maybe) - 1)])
        seed = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
        known = self.keys[seed] == key[at]
        return at[known], seed[known]

    def regions(self, w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(start, words, places of seeds, their keys) of each stretch of a text around seeds.

        A text of fewer words than a seed has is a seed by itself, and meets items that are the same.
        """
        at, seed = self.met(gram_keys(w, min(len(w), self.words)))
        if not len(at):
            return
        low, high = np.maximum(at - self.left[seed], 0), np.minimum(at + self.right[seed], len(w))
        order = np.argsort(low, kind="stable")
        ends = np.maximum.accumulate(high[order])
        cuts = np.flatnonzero(np.r_[True, low[order][1:] > ends[:-1]])
        for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
            own = order[a:b]
            yield int(low[own[0]]), w[low[own[0]] : ends[b - 1]], at[own], self.keys[seed[own]]


def shared_words(item: np.ndarray, passages: list[np.ndarray]) -> np.ndarray:
    """The item's words that each passage holds, in whatever order; no alignment scores more."""
    known, counts = np.unique(item, return_counts=True)
    flat = np.concatenate(passages)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    met = known[at] == flat
    cell = np.repeat(np.arange(len(passages)), [len(p) for p in passages])[met] * len(known) + at[met]
    held = np.bincount(cell, minlength=len(passages) * len(known)).reshape(len(passages), len(known))
    return np.minimum(held, counts).sum(axis=1)


def smith_waterman(item: np.ndarray, passages: list[np.ndarray]) -> np.ndarray:
    """The best local score of the item in each passage; word 0 matches nothing.

    One row of the table at a time for all passages: the gap along the row is a running maximum of scores
    that are raised by their place.
    """
    width = max(map(len, passages))
    table = np.zeros((len(passages), width), np.int64)
    for i, p in enumerate(passages):
        table[i, : len(p)] = p
    place = np.arange(width)
    row, best = np.zeros((len(passages), width), np.int32), np.zeros(len(passages), np.int32)
    for word in item:
        step = np.where(table == word, 1, -1).astype(np.int32)
        step[:, 1:] += row[:, :-1]
        np.maximum(step, row - 1, out=step)
        np.maximum(step, 0, out=step)
        row = (np.maximum.accumulate(step + place, axis=1) - place).astype(np.int32)
        np.maximum(best, row.max(axis=1), out=best)
    return best


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about ``BLOCK_WORDS`` words."""
    known = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = known.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-total // BLOCK_WORDS) or 1
    for i in range(n):
        own = known if n == 1 else known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], r["text"]) for r in own.collect()]


def seed_table(items: list[np.ndarray], words: int, min_score: float) -> pd.DataFrame:
    """``(key, item, offset, length, slack, dropped)``: a row for each n-gram of each item.

    slack is how many words a copy may have that the item lacks, dropped how many of the item's seeds, the most
    frequent ones, are left out. An item of fewer than ``words`` words is one seed.
    """
    parts = []
    for i, w in enumerate(items):
        if not len(w):
            continue
        key, slack = gram_keys(w, min(len(w), words)), math.ceil(len(w) * (1 - min_score))
        dropped = max(0, math.floor(len(w) * (1.5 * min_score - 0.5)) - 3)
        columns = {"item": i, "offset": np.arange(len(key)), "length": len(w), "slack": slack, "dropped": dropped}
        parts.append(pd.DataFrame({"key": key} | columns))
    names = ["key", "item", "offset", "length", "slack", "dropped"]
    return pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame({n: np.empty(0, np.int64) for n in names})


def _regions(docs: DataFrame, seeds: Seeds) -> DataFrame:
    """A written table ``(region, doc_id, version, start, words, hits)`` of the texts' regions around seeds."""
    shared = Shared(docs.sparkSession, seeds)  # BLOCK_WORDS bounds it

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = shared.value, Words()
        hit = pa.struct([("at", pa.int64()), ("key", pa.int64())])
        for b in batches:
            texts = b.column(2).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for first, last in pieces(texts):
                flat, owner = words.read(texts[first:last])
                ends = np.searchsorted(owner, np.arange(last - first + 1))
                for i in range(last - first):
                    for start, w, at, key in known.regions(flat[ends[i] : ends[i + 1]]):
                        hits = [{"at": a, "key": k} for a, k in zip(at.tolist(), key.tolist(), strict=True)]
                        row = (b.column(0)[first + i].as_py(), b.column(1)[first + i].as_py(), start, w, hits)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(hit)]
            names = ["doc_id", "version", "start", "words", "hits"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
        words.clear()
        give_back()

    doc = F.col("doc_id").cast("string").alias("doc_id")  # Arrow and pandas would make a float of a null among longs
    texts = docs.select(doc, F.xxhash64("text").alias("version"), text_of().alias("text"))
    schema = "doc_id string, version long, start long, words array<long>, hits array<struct<at:long,key:long>>"
    found = texts.mapInArrow(look, schema)
    return written(found.withColumn("region", F.monotonically_increasing_id()), "regions")


def _rare(spark: SparkSession, table: pd.DataFrame, hits: DataFrame) -> DataFrame:
    """A written table ``(key, places)`` with an array of (item, offset): the items' seeds but for the most frequent.

    Of seeds that are met equally often those with the smaller key are left out first.
    """
    kinds = "key long, item long, offset long, length long, slack long, dropped long"
    seeds = written(spark.createDataFrame(table, kinds), "seeds")
    counts = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    met = seeds.join(written(counts, "counts"), "key")  # what is never met would rank last and join nothing
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "key", "offset"))
    kept = met.withColumn("rank", rank).where("rank > dropped")
    by_key = kept.groupBy("key").agg(F.collect_list(F.struct("item", "offset", "length", "slack")).alias("places"))
    return written(by_key, "rare")


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 3, min_score: float = 0.5) -> DataFrame:
    """``docs(doc_id, text)`` and ``benchmark(item_id, text)`` to ``(doc_id, version, item_id, score, passages)``.

    A row for each document and item whose best passage scores at least ``min_score``; version is a hash of
    the text, score the best score over the item's words and passages how many reach ``min_score``. Words
    ignore case and punctuation, and stand between any white space; of scripts without blanks each character is one.
    An item of fewer than ``words`` words is found in texts that are nothing else. Null or empty texts and items
    match nothing. Rows that repeat doc_id and text give one row, as do items that repeat an item_id. Null ids stay
    null; ids are integers. Texts of any length are read whole; other columns, whatever their names, are ignored;
    an empty table on either side gives no row.
    """
    spark = docs.sparkSession
    found = None
    for rows in _blocks(benchmark):
        flat, owner = Words().read([text for _, text in rows])
        items = np.split(flat, np.searchsorted(owner, np.arange(1, len(rows)))) if rows else []
        table = seed_table(items, words, min_score)
        regions = _regions(docs, Seeds.of(table, words)) if len(table) else None
        if regions is not None:
            hits = written(regions.select("region", F.explode("hits").alias("h")).select("region", "h.at", "h.key"), "hits")
            rare = _rare(spark, table, hits)
            scored = _scored(spark, regions, hits, rare, items, [i for i, _ in rows], min_score)
            found = scored if found is None else found.unionAll(scored)
    if found is None:
        found = spark.createDataFrame([], "doc_id string, version long, item_id long, score double")
    best = found.withColumn("doc_id", F.col("doc_id").cast("long")).groupBy("doc_id", "version", "item_id")
    return best.agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("passages"))


def _scored(spark: SparkSession, regions: DataFrame, hits: DataFrame, rare: DataFrame, items: list[np.ndarray], ids: list[int | None], min_score: float) -> DataFrame:
    """``(doc_id, version, item_id, score)`` of each passage that reaches ``min_score``."""
    shared = Shared(spark, (items, ids))  # BLOCK_WORDS bounds it

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, names = shared.value
        for f in frames:
            for i, g in f.groupby("item"):
                item, slack = known[i], int(g["slack"].iloc[0])
                rows, passages = [], []
                for n, (places, low, w) in enumerate(zip(g["places"], g["low"], g["words"], strict=True)):
                    starts, ends = places - slack - low, places + len(item) + slack - low
                    cuts = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
                    for a, b in zip(cuts, [*cuts[1:], len(places)], strict=True):
                        rows.append(n)
                        passages.append(w[max(starts[a], 0) : ends[b - 1]])
                could = [shared_words(item, passages[at : at + 256]) >= min_score * len(item) for at in range(0, len(passages), 256)]
                left = np.flatnonzero(np.concatenate(could))
                left = left[np.argsort([len(passages[k]) for k in left], kind="stable")]
                for at in range(0, len(left), 256):  # of like lengths
                    part = left[at : at + 256]
                    best = smith_waterman(item, [passages[k] for k in part]) / len(item)
                    of_row = g.iloc[[rows[k] for k in part]]
                    item_id = pd.array([names[i]] * len(part), dtype="Int64")
                    yield of_row.assign(item_id=item_id, score=best)[["doc_id", "version", "item_id", "score"]]

    met = matched(hits, rare, ["key"], F.size("places") * 40 + 24)
    met = met.select("region", "at", F.explode("places").alias("p")).select("region", "at", "p.*")
    near = met.groupBy("region", "item", "length", "slack").agg(F.array_sort(F.collect_set(F.col("at") - F.col("offset"))).alias("places"))
    first, last = F.col("places")[0] - F.col("slack"), F.element_at("places", -1) + F.col("length") + F.col("slack")
    joined = near.join(regions.drop("hits"), "region").withColumn("low", F.greatest(first, F.col("start")))
    own = F.slice("words", (F.col("low") - F.col("start") + 1).cast("int"), F.greatest(last - F.col("low"), F.lit(0)).cast("int"))
    pairs = joined.select("doc_id", "version", "item", "slack", "places", "low", own.alias("words"))
    scored = pairs.mapInPandas(align, "doc_id string, version long, item_id long, score double")
    return scored.where(F.col("score") >= min_score)


def clean(docs: DataFrame, benchmark: DataFrame, words: int = 3, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns, whatever their names. Null and empty texts
    stay, as do all rows if the benchmark is empty; rows that repeat go or stay alike."""
    with scratch(docs.sparkSession):
        found = contaminated(docs, benchmark, words, min_score)
        bad = found.select(F.col("doc_id").alias("bad_doc"), F.col("version").alias("bad_version")).distinct()
        bad = written(bad, "contaminated", keep=True)
    bad = small(bad, 24)
    own = docs["doc_id"].eqNullSafe(bad["bad_doc"]) & (F.xxhash64(docs["text"]) == bad["bad_version"])
    return docs.join(bad, own, "left_anti")
