"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Source token shares p are raised to an exponent a and normalised: w is proportional to p**a, from equal
weights at a = 0 to the shares themselves at a = 1. Entropy falls and repetition of the rarest source falls
as a grows, so either target is met by bisection; each round evaluates the sums of several exponents in one
aggregate over the source table, however many sources it has. Each source is dealt into ``BLOCKS`` blocks by
a hash. Its budget gives every block a number of whole epochs; what is left is met by whole blocks in a
seeded permutation. Blocks are the only thing that is ordered, so a source of any size is ``BLOCKS`` rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coordspark.llm.common import small, text_of, written

BLOCKS, ROUNDS, PER_ROUND = 1024, 5, 16


def tokens(text: str | Column = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text; null counts as empty."""
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_key(source: str | Column = "source") -> Column:
    """A non-null key; null is a source of its own."""
    c = F.col(source) if isinstance(source, str) else source
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), c.cast("string")))


def block_of(doc_id: Column, blocks: int = BLOCKS) -> Column:
    return F.pmod(_hash(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(blocks)).cast("int")


def _hash(s: Column) -> Column:
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """The largest exponent in [0, 1] whose entropy is at least ``target_entropy`` (a share of the most
    possible), raised to the smallest that repeats no source over ``max_repeats`` times, to six decimals.

    ``sources(p)`` holds positive shares. Without a budget, repeats count against the budget at which no
    source is read less than once. No target gives 1; where no exponent will do, the nearest end is taken.
    """
    n, total = sources.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not n or n == 1:
        return 1.0

    def meets(grid: list[float]) -> list[tuple[bool, bool]]:
        sums = [c for a in grid for c in (F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p")), F.max(F.pow("p", F.lit(a - 1))), F.min(F.pow("p", F.lit(a - 1))))]
        row = sources.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        found = []
        for k, a in enumerate(grid):
            z, zl, most, least = row[4 * k : 4 * k + 4]
            entropy = math.log(z) - a * zl / z
            repeats = most / least if budget is None else most / z * budget / total
            found.append((target_entropy is None or entropy >= target_entropy * math.log(n) - 1e-12, max_repeats is None or repeats <= max_repeats + 1e-12))
        return found

    def bisect(which: int, wanted: bool) -> float:
        """The highest exponent that meets entropy, or the lowest that meets repeats."""
        low, high = 0.0, 1.0
        ends = meets([low, high])
        if wanted and ends[1][which]:
            return 1.0
        if not wanted and ends[0][which]:
            return 0.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / PER_ROUND for i in range(PER_ROUND + 1)]
            ok = [m[which] for m in meets(grid)]
            at = max([i for i, m in enumerate(ok) if m], default=0) if wanted else max([i for i, m in enumerate(ok) if not m], default=0)
            low, high = grid[at], grid[min(at + 1, PER_ROUND)]
        return low if wanted else high

    a = 1.0
    if target_entropy is not None:
        a = bisect(0, True)
    if max_repeats is not None:
        lowest = bisect(1, False)
        a = lowest if target_entropy is None else max(a, lowest)
    return round(a, 6)


def schedule(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, seed: int = 0, blocks: int = BLOCKS) -> tuple[DataFrame, float]:
    """``docs(doc_id, text, source)`` to the block table ``(key, block, block_tokens, block_rank, weight,
    source_tokens, source_budget, copies)`` and the exponent.

    Without ``budget`` (in tokens), the budget is the least at which every source is read at least once.
    Sources without tokens get a single copy and no weight.
    """
    sized = docs.select(source_key().alias("key"), block_of(F.col("doc_id"), blocks).alias("block"), tokens().alias("t"))
    table = written(sized.groupBy("key", "block").agg(F.sum("t").alias("block_tokens")), "blocks")
    totals = written(table.groupBy("key").agg(F.sum("block_tokens").alias("tokens")), "sources")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = written(totals.where("tokens > 0").select("key", "tokens", (F.col("tokens") / F.lit(max(total, 1))).alias("p")), "shares")
    a = exponent(shares, target_entropy, max_repeats, budget)
    z, least = shares.agg(F.sum(F.pow("p", F.lit(a))), F.min(F.pow("p", F.lit(a - 1)))).first()
    whole = F.lit(float(budget)) if budget is not None else F.lit(total * (z or 1.0) / (least or 1.0))
    weighted = shares.select("key", F.col("tokens").alias("source_tokens"), (F.pow("p", F.lit(a)) / F.lit(z or 1.0)).alias("weight")).withColumn("source_budget", F.round(F.col("weight") * whole).cast("long"))
    order = Window.partitionBy("key").orderBy("turn", "block")
    ranked = table.withColumn("turn", F.md5(F.concat_ws(":", F.lit(str(seed)), "key", F.col("block").cast("string")))).withColumn("block_rank", F.row_number().over(order) - 1).withColumn("upto", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = ranked.join(weighted, "key", "left")
    epochs = F.expr("source_budget div source_tokens")
    rest = F.expr("source_budget % source_tokens")
    copies = F.when(F.col("source_tokens").isNull(), F.lit(1)).otherwise(epochs + ((F.col("block_tokens") > 0) & (2 * F.col("upto") - F.col("block_tokens") <= 2 * rest)).cast("long"))
    return joined.select("key", "block", "block_tokens", F.col("block_rank").cast("long").alias("block_rank"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("source_budget", F.lit(0)).alias("source_budget"), copies.cast("long").alias("copies")), a


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, seed: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """Every row of ``docs`` with its block, the block's place in its source's permutation and its copies.

    Adds mix_block, mix_rank, mix_weight, mix_alpha and mix_copies (0: not in the mix; n: read n times).
    Null, empty and wordless texts have no tokens and go with their block. Rows that repeat share a block and
    are each returned. An empty table gives none. Other columns are kept, but those named like added ones.
    """
    docs = docs.drop("mix_key", "mix_block", "mix_rank", "mix_weight", "mix_alpha", "mix_copies")
    plan, a = schedule(docs, target_entropy, max_repeats, budget, seed, blocks)
    plan = small(written(plan.select(F.col("key").alias("mix_key"), F.col("block").alias("mix_block"), F.col("block_rank").alias("mix_rank"), F.col("weight").alias("mix_weight"), F.col("copies").alias("mix_copies")), "plan"), 100)
    keyed = docs.withColumn("mix_key", source_key()).withColumn("mix_block", block_of(F.col("doc_id"), blocks))
    return keyed.join(plan, ["mix_key", "mix_block"]).withColumn("mix_alpha", F.lit(a)).drop("mix_key")


def mixture(docs: DataFrame, max_repeats: float, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as their copies say, none less than once, with the columns of ``docs``."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    mixed = mix(whole, max_repeats=max_repeats, seed=seed)
    return mixed.select("row", F.explode(F.expr("sequence(1, greatest(1, mix_copies))"))).select("row.*")


#: With an entropy of 0.95 and at most 4 repeats: the exponent by twenty halvings on the same grid.
ORACLE_SQL = r"""
with recursive sized as (
  select doc_id, source, coalesce('=' || source, '-') as key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as tokens,
         (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % 1024)::int as block
  from documents
), blocks as (
  select key, block, sum(tokens)::bigint as block_tokens from sized group by 1, 2
), totals as (
  select key, sum(block_tokens)::bigint as source_tokens from blocks group by 1
), shares as (
  select key, source_tokens, source_tokens::double / (select sum(source_tokens) from totals)::double as p from totals where source_tokens > 0
), high(step, lo, hi) as (
  select 0, 0, 1048576
  union all
  select step + 1, case when ok then mid else lo end, case when ok then hi else mid end
  from (select step, lo, hi, (lo + hi) // 2 as mid,
               (select ln(sum(pow(p, a))) - any_value(a) * sum(pow(p, a) * ln(p)) / sum(pow(p, a)) >= 0.95 * ln(count(*)) - 1e-12
                from (select p, ((lo + hi) // 2) / 1048576.0::double as a from shares)) as ok
        from high where step < 20)
), ends as (
  select (select -sum(p * ln(p)) >= 0.95 * ln(count(*)) - 1e-12 from shares) as flat,
         (select max(p) / min(p) from shares) as spread
), alpha as (
  select case when (select count(*) from shares) < 2 then 1.0::double else round(greatest(
           case when flat then 1.0 else (select lo from high where step = 20) / 1048576.0 end,
           case when spread <= 4.0 then 0.0 else ceil((1 - ln(4.0) / ln(spread)) * 1048576.0) / 1048576.0 end), 6) end::double as a
  from ends
), weighted as (
  select key, source_tokens, pow(p, a) / (select sum(pow(p, a)) from shares, alpha) as weight,
         (select sum(source_tokens) from totals)::double * (select sum(pow(p, a)) from shares, alpha) / (select min(pow(p, a - 1)) from shares, alpha) as whole
  from shares, alpha
), budgets as (
  select *, round(weight * whole)::bigint as budget from weighted
), ranked as (
  select *, row_number() over w - 1 as block_rank, sum(block_tokens) over (w rows unbounded preceding) as upto
  from blocks window w as (partition by key order by md5('0:' || key || ':' || block), block)
), plan as (
  select r.key, block, block_rank, coalesce(weight, 0) as weight,
         case when source_tokens is null then 1
              else budget // source_tokens + case when block_tokens > 0 and 2 * upto - block_tokens <= 2 * (budget % source_tokens) then 1 else 0 end end::bigint as copies
  from ranked r left join budgets b on r.key = b.key
)
select doc_id, source, tokens, (select a from alpha) as alpha, round(weight, 6) as weight, s.block, block_rank, copies
from sized s join plan p on s.key = p.key and s.block = p.block
"""
