"""Secret scanning with multipart credential linking, in built-in SQL functions only.

Strong patterns are found on their own. Weak ones (an account name, an opaque token, an address) say little
alone; they are linked by an interval join: parts of one text meet where their intervals, widened by
``scope`` characters, overlap, and a weak candidate is reported only if its complementary parts are met.

* a weak secret needs an identifier (strong or weak) in its scope;
* a weak identifier needs a secret (strong or weak) in its scope;
* an endpoint needs both an identifier and a secret in its scope.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import fits, text_of, written


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    part: str  # secret, ident or endpoint
    strong: bool
    group: int  # whose length counts
    least: int


#: The strong kinds, in the order in which equal starts are listed, then the weak ones. A run of
#: one class that is too short holds no long enough match, so access and hex ask for the length in the pattern.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", "secret", True, 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", "ident", True, 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", "secret", True, 0, 24),
    Kind("ident", r"""(?i:\b(user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.@=-]+)""", "ident", False, 2, 3),
    Kind("opaque", r"[A-Za-z0-9+/=_-]{32,}", "secret", False, 0, 32),
    Kind("endpoint", r"""(?i:https?|ftp|jdbc:[a-z0-9]+|mongodb|postgres|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?""", "endpoint", False, 0, 10),
)
#: Characters by which an interval is widened.
SCOPE = 400


_SPAN = "struct<start:int,end:int,own:int>"


def _placed(steps: Column, start: Column) -> Column:
    """Spans of the steps (gap, len, own) one after another, the first gap from ``start``."""

    def place(done: Column, x: Column) -> Column:
        at = done["at"] + x["gap"]
        span = F.struct(at.alias("start"), (at + x["len"]).alias("end"), x["own"].alias("own"))
        return F.struct((at + x["len"]).alias("at"), F.array_append(done["spans"], span).alias("spans"))

    none = F.array().cast(f"array<{_SPAN}>")
    return F.aggregate(steps, F.struct(start.alias("at"), none.alias("spans")), place)["spans"]


def found(kind: Kind, number: int, text: Column) -> Column:
    """The kind's spans in the text, an array of (start, end, kind number), in code points, end exclusive.

    What lies between matches and the matches themselves give the positions. An array that grows is copied with
    each step, so n steps are summed in blocks of root n: the blocks' starts first, then each block from its own.
    A text without a match is read by the pattern once.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    sizes = matches if not kind.group else F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches))
    lengths = F.zip_with(matches, sizes, lambda m, s: F.struct(F.length(m).alias("len"), F.length(s).alias("own")))
    whole = F.zip_with(gaps, lengths, lambda g, n: F.struct(F.length(g).alias("gap"), n["len"].alias("len"), n["own"].alias("own")))

    def blocks_of(steps: Column) -> Column:
        n = F.size(steps)
        width = F.ceil(F.sqrt(n)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1, width), lambda i: F.slice(steps, i + 1, width))

    def starts_of(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
        none = F.array(F.lit(0))
        return F.aggregate(sums, none, lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    def spans_of(blocks: Column) -> Column:
        own = F.zip_with(blocks, F.slice(starts_of(blocks), F.lit(1), F.size(blocks)), _placed)
        kept = F.filter(F.flatten(own), lambda s: s["own"] >= kind.least)
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(number).alias("kind")))

    # a one-element transform names a value, so that what follows reads it instead of making it again
    named = F.transform(F.array(whole), lambda steps: blocks_of(steps))
    spans = F.flatten(F.transform(named, spans_of))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    return F.when(F.rlike(text, F.lit(kind.pattern)), spans).otherwise(none)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``parts(row, part, strong, span)`` to the reported weak spans ``(row, span)``.

    Parts are listed under each stretch of ``2 * scope`` characters that they touch when widened, and meet
    their complements of the same text there. Spans of a kind do not overlap, so a stretch holds a bounded
    number of parts and the pairs grow with the text, not with its square.
    """
    wide = 2 * scope
    bins = F.expr(f"sequence((greatest(span.start - {scope}, 0)) div {wide}, (span.end + {scope}) div {wide})")
    binned = parts.select("row", "part", "strong", "span", F.explode(bins).alias("bin"))
    weak = binned.where(~F.col("strong")).select("row", "bin", "span", "part")
    other = binned.select("row", "bin", F.col("part").alias("other"), F.col("span").alias("other_span")).where("other <> 'endpoint'").distinct()
    near = (F.col("other_span.start") - F.col("span.end") <= scope) & (F.col("span.start") - F.col("other_span.end") <= scope)
    # what overlaps a candidate is the same characters seen twice, not a complement
    apart = (F.col("other_span.start") >= F.col("span.end")) | (F.col("span.start") >= F.col("other_span.end"))
    met = weak.join(other, ["row", "bin"]).where((F.col("part") != F.col("other")) & near & apart)
    seen = met.groupBy("row", "span", "part").agg(F.count_distinct("other").alias("n"))
    return seen.where((F.col("part") != "endpoint") | (F.col("n") == 2)).select("row", "span")


def _tagged(kind: Kind, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind.part).alias("part"), F.lit(kind.strong).alias("strong"), s.alias("span")))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, base, spans)``, a row for each input row.

    base holds the spans of strong kinds and spans those with the linked weak ones, each an array of (start,
    end, kind number). Null counts as empty, an empty text has no span. Texts of any length are read whole. Rows
    that repeat are each returned; other columns, whatever their names, are ignored; no row gives none.
    """
    text = docs.select("doc_id", text_of().alias("text"))
    arrays = text.select("doc_id", *[found(k, i, F.col("text")).alias(f"k{i}") for i, k in enumerate(KINDS)])
    hits = written(arrays.withColumn("row", F.monotonically_increasing_id()), "hits")
    n_of = {p: sum((F.size(f"k{i}") for i, k in enumerate(KINDS) if k.part == p), F.lit(0)) for p in ("secret", "ident")}
    n_weak = sum((F.size(f"k{i}") for i, k in enumerate(KINDS) if not k.strong), F.lit(0))
    may = (n_weak > 0) & (n_of["secret"] > 0) & (n_of["ident"] > 0)
    tagged = F.concat(*[_tagged(k, F.col(f"k{i}")) for i, k in enumerate(KINDS)])
    parts = hits.where(may).select("row", F.explode(tagged).alias("p")).select("row", "p.*")
    weak = written(linked(parts, scope).groupBy("row").agg(F.collect_set("span").alias("weak")), "linked")
    base = F.concat(*[F.col(f"k{i}") for i, k in enumerate(KINDS) if k.strong])
    more = F.coalesce("weak", F.array().cast("array<struct<start:int,end:int,kind:int>>"))
    met = hits.join(fits(weak, F.size("weak") * 40 + 64), "row", "left")
    return met.select("doc_id", base.alias("base"), F.concat(base, more).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Of ``scan``: counts of strong spans, their SHA-256 and all spans as text."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.strong]
    return scanned.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The digest in DuckDB's SQL, from the same table of kinds."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = " union all ".join(
        f"select id, {i} as k, {quoted(k.part)} as part, {str(k.strong).lower()} as strong, {k.least} as least, regexp_extract_all(text, {quoted(k.pattern)}, 0) as ms, regexp_extract_all(text, {quoted(k.pattern)}, {k.group}) as own, string_split_regex(text, {quoted(k.pattern)}) as gaps from t"
        for i, k in enumerate(KINDS)
    )
    strong = ", ".join(f"count(*) filter (k = {i}) as n_{k.name}" for i, k in enumerate(KINDS) if k.strong)
    names = "[" + ", ".join(quoted(k.name) for k in KINDS) + "]"
    text = f"string_agg({names}[k + 1] || ':' || s || ':' || e, ',' order by s, k, e)"
    return f"""
with t as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
m as ({each}),
p as (select *, unnest(range(len(ms))) as i from m),
q as (select id, k, part, strong, list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) as s, length(ms[i + 1]) as n from p where length(own[i + 1]) >= least),
spans as (select id, k, part, strong, s::bigint as s, (s + n)::bigint as e from q),
met as (select distinct w.id, w.k, w.s, w.e, w.part, o.part as other from spans w join spans o on w.id = o.id and not w.strong and o.part <> 'endpoint' and w.part <> o.part
        and o.s - w.e <= {SCOPE} and w.s - o.e <= {SCOPE} and (o.s >= w.e or w.s >= o.e)),
linked as (select id, k, s, e from met group by id, k, s, e, part having part <> 'endpoint' or count(*) = 2),
base as (select id, {strong}, {text} as listed from spans where strong group by id),
every as (select id, {text} as listed from (select id, k, s, e from spans where strong union all select * from linked) group by id)
select doc_id, {", ".join(f"coalesce(n_{k.name}, 0)::bigint as n_{k.name}" for k in KINDS if k.strong)}, sha256(coalesce(base.listed, '')) as base_sha256, coalesce(every.listed, '') as spans
from t left join base on t.id = base.id left join every on t.id = every.id
"""


ORACLE_SQL = _sql()
