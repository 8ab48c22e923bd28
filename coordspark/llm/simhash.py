"""SimHash near-duplicates with a pigeonring candidate filter.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 values (seed 42) have it.
Two fingerprints within ``max_bits`` differing bits are found through the pigeonring principle: cut both into
a ring of segments; if the total difference is within the budget, then some segment starts a chain whose
differences, summed segment by segment, stay within the proportional budgets ``floor(l * max_bits / segments)``
for every length ``l``. The first budgets are zero, so fingerprints meet on an equal start of a chain (an
equi-join key); the longer chains prune the meeting pairs before the full Hamming check. More segments make the
equal start longer, up to nearly half of the bits, so their number follows the number of fingerprints.

A chain that more than ``bucket`` distinct fingerprints share would give a square of pairs. There the
rest of the budget is met at the midpoint instead: each fingerprint is listed under itself and under each
one-bit change outside the equal chain, and two that share a listing differ in two bits at most. A listing
holds 65 fingerprints at most, whose links form a star; so work grows with the fingerprints, not their square.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.llm.common import give_back, matched, scratch, small, text_of, written
from coordspark.llm.components import connected

SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, lower-cased in A-Z; of the whole sequence if there are fewer."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(w) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hash values: the bits set in over half of them; zero of none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4080):  # lanes of eight bits add up to 255 without a carry
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + 4080]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):
            counts += bits[b : b + 255].view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | Column = "text", words: int = 3) -> Column:
    """The fingerprint of a text column as a (signed) long; null counts as empty."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(majority(shingle_hashes(t, words))) for t in texts], dtype="int64")

    return of(text_of(text))


class Ring:
    """The 64 bits cut into segments, and what the budgets ``floor(l * max_bits / segments)`` ask of their chains."""

    def __init__(self, max_bits: int, segments: int):
        ends = [round(64 * i / segments) for i in range(segments + 1)]
        self.segments = [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]
        self.max_bits = max_bits
        lengths = range(1, segments + 1)
        #: Segments at the start of a chain that must be equal: their budget is zero.
        self.equal = max([n for n in lengths if n * max_bits // segments == 0], default=0)

    @classmethod
    def for_count(cls, max_bits: int, n: int) -> Ring:
        """The fewest segments whose equal start has a value for each of ``n`` fingerprints, or else 31."""
        for segments in range(max_bits + 1, 32):
            ring = cls(max_bits, segments)
            if min(width(ring.mask(i, ring.equal)) for i in range(segments)) >= n.bit_length():
                return ring
        return ring

    def mask(self, start: int, length: int) -> int:
        """The bits of the chain of ``length`` segments from ``start``, round the ring."""
        m = len(self.segments)
        parts = (self.segments[(start + i) % m] for i in range(length))
        return signed(sum(((1 << w) - 1) << s for s, w in parts))

    def keys(self) -> list[tuple[int, int]]:
        """(start, mask) of what has to be equal at each start."""
        return [(i, self.mask(i, self.equal)) for i in range(len(self.segments) if self.max_bits else 1)]

    def chains(self, start: Column, apart: Column) -> Column:
        """Whether differences ``apart`` keep the budgets of all longer chains from ``start``."""
        m, kept = len(self.segments), F.lit(True)
        for length in range(self.equal + 1, m):
            budget = length * self.max_bits // m
            if length < m - 1 and (length + 1) * self.max_bits // m == budget:
                continue  # the longer chain asks for more
            bits = [F.when(start == i, F.bit_count(apart.bitwiseAND(F.lit(self.mask(i, length))))) for i in range(m)]
            kept = kept & (F.coalesce(*bits) <= budget)
        return kept & (F.bit_count(apart) <= self.max_bits)


def width(mask: int) -> int:
    return (mask & (1 << 64) - 1).bit_count()


def links(prints: DataFrame, max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """``prints(fp)``, distinct, to links ``(u, v)`` that connect exactly the fingerprints within ``max_bits``.

    The ring is cut by the number of fingerprints, so that an equal chain is shared by few that are not alike:
    21 bits up to two million, 31 bits and more beyond a billion. All pairs within ``max_bits`` that share the
    chain are given. Where over ``bucket`` share one, as in crowds of near copies, links that connect the same
    components are given in place of their square of pairs.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    prints = written(prints.select("fp"), "distinct")
    ring = Ring.for_count(max_bits, prints.count())
    at = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("seg")) for i, mask in ring.keys()]
    keyed = written(prints.select("fp", F.explode(F.array(*at)).alias("k")).select("fp", "k.i", "k.seg"), "keyed")
    shared = keyed.groupBy("i", "seg").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(matched(keyed, written(shared, "shared"), ["i", "seg"], 40), "ring")

    few = members.where(F.col("n") <= bucket)
    a, b = (few.select("i", "seg", F.col("fp").alias(x)) for x in "uv")
    apart = F.col("u").bitwiseXOR(F.col("v"))
    pairs = a.join(b, ["i", "seg"]).where((F.col("u") < F.col("v")) & ring.chains(F.col("i"), apart)).select("u", "v")
    if max_bits == 0:
        return pairs

    # one budget is left on the way to a midpoint, and one behind it
    many = members.where(F.col("n") > bucket)
    free = [
        F.when(F.col("i") == i, F.array(*[F.lit(x) for x in (0, *(signed(1 << b) for b in range(64) if not mask >> b & 1))]))
        for i, mask in ring.keys()
    ]
    listed = many.select("fp", F.explode(F.coalesce(*free)).alias("flip"))
    listed = listed.select("fp", F.col("fp").bitwiseXOR(F.col("flip").cast("long")).alias("mid")).distinct()
    listings = listed.groupBy("mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    centre = F.array_min("fps") if max_bits == 2 else F.col("mid")
    with_centre = listings.where(F.lit(max_bits == 2) | F.array_contains("fps", F.col("mid")))
    stars = with_centre.select(F.explode("fps").alias("u"), centre.alias("v")).where("u <> v")
    return pairs.unionAll(stars)


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp, component_id)``, a row for each input row.

    component_id is the smallest doc_id whose fingerprint can be reached by links of up to ``max_bits`` bits.
    Null, empty and wordless texts have fingerprint zero, linked like any other. Rows that repeat are each
    returned. A null doc_id stays null and never names a component; a component of such rows has a null id.
    """
    rows = written(docs.select("doc_id", fingerprint("text", words).alias("fp")), "prints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = written(connected(links(rows.select("fp").distinct(), max_bits, bucket)), "roots")
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = written(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    classes = written(matched(rooted, named, ["root"], 32).select("fp", "component_id"), "classes")
    return matched(rows, classes, ["fp"], 32).select("doc_id", "fp", "component_id")


def print_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# De-duplication to a similarity. At a Jaccard similarity of 0.8 whole-text fingerprints differ in some ten
# bits, out of reach of any segment index, so texts also get fingerprints of small consistent samples: the
# VIEW_FEATURES smallest shingle hashes, dealt into VIEWS views. Most views of similar texts hold the same
# shingles and so the same fingerprint. Texts that share a view's fingerprint, or whose whole-text fingerprints
# are linked, make a bucket; all its pairs are held to the similarity, but for those already connected. Buckets
# of over PAIRED texts are cut into blocks of about BLOCK texts, and each two blocks meet in one group.
# Sketches of the SKETCH smallest hashes decide for texts they hold whole, and for others only where the estimate
# is MARGIN, six standard errors, or more away from the similarity asked for; all else is for the full sets.
VIEWS, VIEW_FEATURES, SKETCH = 16, 64, 256
PAIRED, BLOCK, BLOCK_HASHES, MARGIN = 64, 256, 1 << 18, 0.15
#: Sketches and sets, of which there are as many as texts in pairs, are broadcast only below this many bytes.
WIDE_BYTES = 1 << 20


def sketched(text: str | Column, words: int, views: int = VIEWS) -> Column:
    """A struct (fp, views, sketch, size): the whole text's fingerprint, each view's (null if it is empty), the
    ``SKETCH`` smallest distinct shingle hashes' leading 32 bits, ascending, and the number of distinct hashes."""

    @F.pandas_udf("fp long, views array<long>, sketch binary, size int")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = shingle_hashes(t, words)
            least = np.unique(hashes)
            sample = least[:VIEW_FEATURES]
            view = (sample * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(views)
            of_view = [signed(majority(part)) if len(part := sample[view == v]) else None for v in range(views)]
            rows.append((signed(majority(hashes)), of_view, (least[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes(), len(least)))
        give_back()
        return pd.DataFrame(rows, columns=["fp", "views", "sketch", "size"])

    return of(text_of(text))


def _jaccard(a: bytes, b: bytes) -> float:
    """Of two sketches: exact if both are whole, else estimated from the smallest of their union."""
    x, y = np.unique(np.frombuffer(a, "<u4")), np.unique(np.frombuffer(b, "<u4"))
    union = np.union1d(x, y)
    if max(len(a), len(b)) >= 4 * SKETCH:
        union = union[:SKETCH]
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True)) / len(union)


def _merges(sets: list[np.ndarray], roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of similar sets that connect all which similar pairs connect, beside those with one root already.

    Each set outside the largest component is held against all of other components at once, by the postings of
    its values; sets of the most common values come first, since a centre spares its copies the comparison.
    """
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    often = np.bincount(token, minlength=1)
    starts, ends = np.r_[0, np.cumsum(size)[:-1]], np.r_[0, np.cumsum(often)]
    posted = owner[np.argsort(token, kind="stable")]
    part = np.unique(roots, return_inverse=True)[1]
    common = np.bincount(owner, often[token], len(sets)) / np.maximum(size, 1)
    left = part != np.bincount(part).argmax()
    todo, found = np.ones(len(sets), bool), []
    for p in np.flatnonzero(left)[np.argsort(-common[left], kind="stable")]:
        todo[p] = False
        other = part != part[p]
        other &= todo
        if not other.any():
            continue
        own = token[starts[p] : starts[p] + size[p]]
        met = np.concatenate([posted[ends[t] : ends[t + 1]] for t in own]) if len(own) else np.empty(0, np.int64)
        shared = np.bincount(met, minlength=len(sets))
        union = size[p] + size - shared
        like = np.flatnonzero(other & (np.where(union > 0, shared / np.maximum(union, 1), 1.0) >= similarity))
        for q in like[np.unique(part[like], return_index=True)[1]]:
            found.append((int(p), int(q)))
            part[part == part[q]] = part[p]
    return found


def _full_sets(asked: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """A written table ``(version, values)`` of the texts ``asked(version)``: their distinct shingle hashes, ascending."""

    @F.pandas_udf("array<long>")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words).view(np.int64)) for t in texts], dtype="object")

    texts = docs.select(F.xxhash64(text_of()).alias("version"), text_of().alias("text"))
    known = texts.join(small(written(asked, "asked"), 16), "version", "left_semi").dropDuplicates(["version"])
    return written(known.select("version", whole("text").alias("values")), "sets")


def _block_links(large: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of ``large(view, vp, version, root, size)`` links ``(u, v)`` that connect what similar pairs of a bucket connect.

    Blocks are dealt by hash, of about ``BLOCK`` texts and ``BLOCK_HASHES`` shingles at most, those of the bucket's
    largest component apart from the others, so that blocks of one component alone, most of them in a crowd of
    copies, are never held against each other.
    """
    bucket = ["view", "vp"]
    weight = F.greatest(F.lit(1.0 / BLOCK), F.col("size") / BLOCK_HASHES)  # of a block, a text
    of_root = written(large.groupBy(*bucket, "root").agg(F.sum(weight).alias("n")), "roots-of-bucket")
    main = of_root.groupBy(*bucket).agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"))
    main = written(main.select(*bucket, F.col("main.root").alias("main"), F.col("main.n").alias("of_main"), "all"), "main")
    known = matched(large, main, bucket, 64)
    is_main = F.col("root") == F.col("main")
    n = F.when(is_main, F.col("of_main")).otherwise(F.col("all") - F.col("of_main"))
    dealt = F.pmod(F.xxhash64("version"), F.greatest(F.ceil(n), F.lit(1))) * 2 + F.when(is_main, 0).otherwise(1)
    blocks = written(known.select(*bucket, "version", "root", dealt.cast("long").alias("block")), "blocks")

    of_block = written(blocks.groupBy(*bucket, "block").agg(F.min("root").alias("low"), F.max("root").alias("high")), "of-block")
    a, b = (of_block.select(*bucket, *[F.col(c).alias(f"{c}_{x}") for c in ("block", "low", "high")]) for x in "ab")
    apart = F.least("low_a", "low_b") < F.greatest("high_a", "high_b")
    met = a.join(b, bucket).where((F.col("block_a") <= F.col("block_b")) & apart)
    both = F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block")
    sides = met.select(*bucket, "block_a", "block_b", both)

    sets = _full_sets(blocks.select("version").distinct(), docs, words)

    def link(g: pd.DataFrame) -> pd.DataFrame:
        version = g["version"].to_numpy()
        found = _merges(list(g["values"]), g["root"].to_numpy(), similarity)
        return pd.DataFrame([(version[i], version[j]) for i, j in found], columns=["u", "v"], dtype="int64")

    full = sides.join(blocks, [*bucket, "block"]).join(sets, "version")
    full = full.select(*bucket, "block_a", "block_b", "version", "root", "values")
    return full.groupBy(*bucket, "block_a", "block_b").applyInPandas(link, "u long, v long")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` to a written table ``(doc_id, version, group)``, a row for each input row.

    Rows of a group reach each other over links of texts whose ``words``-word shingles have a Jaccard
    similarity of ``similarity`` or more, by full shingle sets unless a sketch is whole or clear. version hashes the
    text; null counts as empty, and empty texts are equal.
    """
    row = docs.select("doc_id", F.xxhash64(text_of()).alias("version"), sketched("text", words).alias("s"))
    rows = written(row.select("doc_id", "version", "s.*"), "sketches")
    texts = written(rows.select("version", "fp", "views", "size").distinct(), "texts")

    def sketches(pairs: DataFrame) -> DataFrame:
        """``(version, sketch, size)`` of the texts that occur in the pairs."""
        asked = written(pairs.select(F.explode(F.array("u", "v")).alias("version")).distinct(), "asked")
        own = matched(rows.select("version", "sketch", "size"), asked, ["version"], 16, "left_semi")
        of_text = own.groupBy("version").agg(F.first(F.struct("sketch", "size")).alias("s"))
        return written(of_text.select("version", "s.*"), "sketch")

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("version <> other").select(F.least("version", "other").alias("u"), F.greatest("version", "other").alias("v"))
        pairs = written(pairs.distinct(), "pairs")
        sketch, met = sketches(pairs), pairs
        for x in "uv":  # a hub may be in any part of the pairs
            side = sketch.select(F.col("version").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("size").alias(f"size_{x}"))
            met = matched(met, side, [x], 4 * SKETCH + 32, counted=pairs, limit=WIDE_BYTES)
        told = F.greatest("size_u", "size_v") < SKETCH
        held = written(met.select("u", "v", told.alias("told"), _sketch_share("sketch_u", "sketch_v").alias("share")), "held")
        sure = held.where(F.col("share") >= F.when(F.col("told"), similarity).otherwise(similarity + MARGIN)).select("u", "v")
        unsure = written(held.where(~F.col("told") & (F.abs(F.col("share") - similarity) < MARGIN)).select("u", "v"), "unsure")
        full, sets = unsure, _full_sets(unsure.select(F.explode(F.array("u", "v")).alias("version")).distinct(), docs, words)
        for x, values in zip("uv", "ab", strict=True):
            side = sets.select(F.col("version").alias(x), F.col("values").alias(values))
            full = matched(full, side, [x], F.size(values) * 8 + 32, counted=unsure, limit=WIDE_BYTES)
        return sure.unionAll(full.where(_full_share("a", "b") >= similarity).select("u", "v"))

    prints = connected(links(texts.select("fp").distinct(), max_bits))
    prints = written(prints.select(F.col("node").alias("fp"), "root"), "print-roots")
    of_print = matched(texts.select("version", "size", "fp"), prints, ["fp"], 32, "left")
    of_print = of_print.select("version", "size", F.lit(-1).alias("view"), F.coalesce("root", "fp").alias("vp"))
    of_view = texts.select("version", "size", F.posexplode("views").alias("view", "vp")).where("vp is not null")
    listed = written(of_view.unionAll(of_print), "listed")
    bucket = ["view", "vp"]
    text = F.struct("version", "size")
    ends = listed.groupBy(*bucket).agg(F.min(text).alias("low"), F.max(text).alias("high"), F.count(F.lit(1)).alias("n"))
    met = written(matched(listed, written(ends.where("low.version < high.version"), "ends"), bucket, 80), "buckets")

    def sized(a: str, b: str) -> Column:
        """Whether texts with these numbers of shingles can be similar."""
        return F.least(a, b) + 1 >= F.greatest(a, b) * similarity

    # most copies are connected by the ends of their buckets; then the pairs of what is still apart
    pairs = met.select("version", "size", F.explode(F.array("low", "high")).alias("end")).where(sized("size", "end.size"))
    stars = written(connected(similar(pairs.select("version", F.col("end.version").alias("other")))), "stars")
    rooted = met.join(stars.withColumnRenamed("node", "version"), "version", "left")
    rooted = written(rooted.select(*bucket, "n", "version", "size", F.coalesce("root", "version").alias("root")), "rooted")
    split = rooted.groupBy(*bucket).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    apart = written(matched(rooted, written(split.select(*bucket), "split"), bucket, 32), "apart")
    few = apart.where(F.col("n") <= PAIRED)
    a, b = (few.select(*bucket, *[F.col(c).alias(f"{c}_{x}") for c in ("version", "root", "size")]) for x in "ab")
    other = (F.col("version_a") < F.col("version_b")) & (F.col("root_a") != F.col("root_b"))
    pairs = a.join(b, bucket).where(other & sized("size_a", "size_b"))
    rest = similar(pairs.select(F.col("version_a").alias("version"), F.col("version_b").alias("other")))
    large = written(apart.where(F.col("n") > PAIRED).select(*bucket, "version", "root", "size"), "large")
    if not large.isEmpty():
        rest = rest.unionAll(_block_links(large, docs, words, similarity))
    linked = stars.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(rest)
    roots = written(connected(linked).select(F.col("node").alias("version"), F.col("root").alias("group")), "groups")
    grouped = matched(rows.select("doc_id", "version"), roots, ["version"], 32, "left")
    return written(grouped.select("doc_id", "version", F.coalesce("group", "version").alias("group")), "grouped", keep=True)


def _sketch_share(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return share(a, b)


def _full_share(a: str, b: str) -> Column:
    """The Jaccard similarity of two full shingle sets; the sets are not empty."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each group the one with the smallest doc_id.

    A null doc_id comes last; of rows that repeat doc_id and text one stays. Null, empty and wordless texts are
    alike, a text of fewer than ``words`` words is one shingle, and texts of any length are compared whole. An
    empty table gives none; columns of any other names are kept as they are.
    """
    with scratch(docs.sparkSession):
        grouped = similar_groups(docs, words, similarity, max_bits)
    rank = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "version")).alias("first")
    first = grouped.groupBy("group").agg(rank)
    first = written(first.select("group", F.col("first.doc_id").alias("keep_doc"), F.col("first.version").alias("keep_version")), "first")
    counted = written(grouped.groupBy("group", "doc_id", "version").agg(F.count(F.lit(1)).alias("n")), "counted")
    counted = matched(counted, first, ["group"], 48)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("version") == F.col("keep_version"))
    marked = counted.select(F.col("doc_id").alias("gone_doc"), F.col("version").alias("gone_version"), stays.alias("stays"), "n")
    marked = written(marked.where("not stays or n > 1"), "gone")
    gone = marked.select("gone_doc", "gone_version")
    own = docs["doc_id"].eqNullSafe(gone["gone_doc"]) & (F.xxhash64(text_of(docs["text"])) == gone["gone_version"])
    kept = docs.join(small(gone, 24), own, "left_anti")
    repeated = marked.where("stays").select("gone_doc", "gone_version")
    if repeated.isEmpty():
        return kept
    again = docs["doc_id"].eqNullSafe(repeated["gone_doc"]) & (F.xxhash64(text_of(docs["text"])) == repeated["gone_version"])
    return kept.unionByName(docs.join(small(repeated, 24), again, "left_semi").dropDuplicates(["doc_id", "text"]))
