"""Line de-duplication over content-defined chunks of lines.

A window of three line hashes rolls over a text; where the middle one is the least, a chunk ends. So a chunk has two
lines at least and three on average, borders hang on the lines beside them only, and an inserted line moves no
border but its own. A chunk whose hash occurs more than once in the corpus is compared by its bytes with the others
of that hash; all copies but the first go. A repeated passage seldom begins and ends at borders, so what is left of
it beside a chunk that goes is compared line by line with what stands beside the first copy, and goes as far as the
lines are equal. Everything is built-in SQL functions; texts meet in a shuffle only where their chunks are suspected,
combined before it, so a chunk that a third of all documents share arrives once per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import fits, matched, small, text_of, written

#: \x01 is escaped as \x01\x02, so \x01\x03 marks a border and nothing else.
ESCAPE, ESCAPED, BORDER = "\x01", "\x01\x02", "\x01\x03"


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once: the element of an array that a transform walks over."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(text: str | Column = "text") -> Column:
    """The text's chunks (escaped) as an array; joined by newlines and unescaped they give the text back.

    A line ends a chunk if its hash is less than those of the lines beside it, but for the first line and the last
    but one. A text of one line is one chunk.
    """

    def marked(lines: Column, hashes: Column) -> Column:
        def end(line: Column, i: Column) -> Column:
            own, inside = F.get(hashes, i), (i > 0) & (i < F.size(hashes) - 2)
            least = inside & (own < F.get(hashes, i - 1)) & (own < F.get(hashes, i + 1))
            return F.concat(line, F.when(i == F.size(hashes) - 1, "").when(least, BORDER).otherwise("\n"))

        return F.array_join(F.transform(lines, end), "")

    lines = F.split(F.replace(text_of(text), F.lit(ESCAPE), F.lit(ESCAPED)), "\n")
    joined = _with(lines, lambda ls: _with(F.transform(ls, _line_hash), lambda hs: marked(ls, hs)))
    return F.split(joined, BORDER)


def _bytes(chunk: Column) -> Column:
    return F.octet_length(F.replace(chunk, F.lit(ESCAPED), F.lit(ESCAPE)))


def repeated_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: the multi-line chunks ``(doc_id, version, no, hash, len)`` and, of each repeated one proven by
    its bytes, ``(hash, len, first_doc, first_version, first_no, before, after)``.

    version is a hash of the text, so that rows which repeat a doc_id with another text stay apart. before and after
    are the chunks beside the first copy, null where there is none.
    """
    cut = docs.select("doc_id", F.xxhash64("text").alias("version"), chunks("text").alias("parts"))
    many_lines = F.contains(F.col("chunk"), F.lit("\n"))
    key = [F.xxhash64("chunk").alias("hash"), _bytes(F.col("chunk")).alias("len")]
    alone = cut.select("doc_id", "version", F.posexplode("parts").alias("no", "chunk")).where(many_lines)
    listed = written(alone.select("doc_id", "version", "no", *key), "chunks")
    counts = listed.groupBy("hash", "len").agg(F.count(F.lit(1)).alias("n"))
    suspects = written(counts.where("n > 1").select("hash", "len"), "suspects")

    beside = F.transform(
        "parts",
        lambda chunk, i: F.struct(
            i.alias("no"), chunk.alias("chunk"), F.get("parts", i - 1).alias("before"), F.get("parts", i + 1).alias("after")
        ),
    )
    exploded = cut.select("doc_id", "version", F.explode(beside).alias("c")).select("doc_id", "version", "c.*").where(many_lines)
    again = matched(exploded.select("*", *key), suspects, ["hash", "len"], 24, "left_semi", counted=listed)
    place = [F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("version"), F.col("no")]
    ends = [F.min(F.struct(*place, "before", "after")).alias("first"), F.max(F.struct(*place)).alias("last")]
    by_bytes = again.groupBy("hash", "len", "chunk").agg(*ends)
    of_hash = by_bytes.groupBy("hash", "len")
    of_hash = of_hash.agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.max("last").alias("last"))
    # rows that repeat have one place
    apart = [~F.col(f"first.{x}").eqNullSafe(F.col(f"last.{x}")) for x in ("doc_id", "version", "no")]
    names = {"doc_id": "first_doc", "version": "first_version", "no": "first_no", "before": "before", "after": "after"}
    firsts = [F.col(f"first.{a}").alias(b) for a, b in names.items()]
    proven = of_hash.where((F.col("texts") == 1) & (apart[0] | apart[1] | apart[2]))
    return listed, written(proven.select("hash", "len", *firsts), "proven")


def _equal_start(a: Column, b: Column) -> Column:
    """How many elements at the start of ``a`` equal those of ``b``, which may be null."""
    apart = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(b.isNull(), 0).when(apart == 0, F.size(a)).otherwise(apart.cast("int") - 1)


def _rest(parts: Column, marks: Column) -> Column:
    """The lines that stay, of a text's chunks and its proven ones ``marks(no, goes, before, after)`` in order."""
    none = F.array().cast("array<string>")

    def lines_of(chunk: Column) -> Column:
        return F.split(chunk, "\n")

    def between(k: Column) -> Column:
        prior, own = F.get(marks, k - 1), F.get(marks, k)
        first = F.coalesce(prior["no"] + 1, F.lit(0))
        n = F.coalesce(own["no"], F.size(parts)) - first
        lines = lines_of(F.array_join(F.slice(parts, first + 1, n), "\n"))
        after = F.when(prior["goes"], lines_of(prior["after"]))
        before = F.when(own["goes"], F.reverse(lines_of(own["before"])))

        def trimmed(ls: Column) -> Column:
            start, end = _equal_start(ls, after), _equal_start(F.reverse(ls), before)
            return F.slice(ls, start + 1, F.greatest(F.size(ls) - start - end, F.lit(0)))

        kept = F.when(n > 0, _with(lines, trimmed)).otherwise(none)
        return F.concat(kept, F.when(~own["goes"], lines_of(F.get(parts, own["no"]))).otherwise(none))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(marks)), between))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, text, removed_chunks, removed_lines, removed_bytes)``, a row for each.

    Of each repeated multi-line chunk the first copy stays: of the smallest doc_id (null last), then text hash, then
    place. With the others go the lines beside them that equal those beside the first copy, up to the end of the
    chunk there, but for lines of chunks that are repeated themselves. A text of one line stays. Rows that repeat
    both doc_id and text count as one document and are treated alike. A null text stays null, an empty one empty.
    Two different chunks that share hash and length are left. Texts of any length are cut whole; other columns,
    whatever their names, are ignored; an empty table gives no row.
    """
    listed, proven = repeated_chunks(docs)
    width = F.coalesce(F.octet_length("before"), F.lit(0)) + F.coalesce(F.octet_length("after"), F.lit(0)) + 80
    met = matched(listed, proven, ["hash", "len"], width)
    same = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("version") == F.col("first_version"))
    goes = ~(same & (F.col("no") == F.col("first_no")))
    beside = [F.when(goes, F.col(x)).alias(x) for x in ("before", "after")]
    marks = F.array_sort(F.collect_set(F.struct("no", goes.alias("goes"), *beside)))
    by_doc = met.groupBy(F.col("doc_id").alias("cut_doc"), F.col("version").alias("cut_version")).agg(marks.alias("marks"))
    cuts = written(by_doc.where(F.exists("marks", lambda m: m["goes"])), "cuts")

    held = F.aggregate("marks", F.lit(64), lambda a, m: a + 24 + F.coalesce(F.octet_length(m["before"]) + F.octet_length(m["after"]), F.lit(0)))
    own = F.col("doc_id").eqNullSafe(F.col("cut_doc")) & (F.col("version") == F.col("cut_version"))
    whole = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    changed = whole.join(fits(cuts, held, 8 << 20), own, "left")

    def stays(parts: Column) -> Column:
        return F.replace(F.array_join(_rest(parts, F.col("marks")), "\n"), F.lit(ESCAPED), F.lit(ESCAPE))

    def lines(of: Column) -> Column:
        return F.size(F.split(of, "\n"))

    rest = F.when(F.col("marks").isNull(), F.col("text")).otherwise(_with(chunks("text"), stays))
    out = changed.select("doc_id", "marks", "text", rest.alias("rest"))
    cut = F.col("marks").isNotNull()
    left = F.when(F.col("rest") == "", 0).otherwise(lines(F.col("rest")))
    return out.select(
        "doc_id",
        F.col("rest").alias("text"),
        F.when(cut, F.size(F.filter("marks", lambda m: m["goes"]))).otherwise(0).cast("long").alias("removed_chunks"),
        F.when(cut, lines(F.col("text")) - left).otherwise(0).cast("long").alias("removed_lines"),
        F.when(cut, F.octet_length("text") - F.octet_length("rest")).otherwise(0).cast("long").alias("removed_bytes"),
    )


ORACLE_SQL = r"""
with lines as (
  select doc_id, text is null as absent, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i
  from documents
), hashed as (
  select *, ('0x' || substr(md5(line), 1, 7))::bigint as h, max(i) over (partition by doc_id) as last from lines
), ended as (
  select *, (i > 0 and i < last - 1 and h < lag(h) over w and h < lead(h) over w)::int as b
  from hashed window w as (partition by doc_id order by i)
), numbered as (
  select *, coalesce(sum(b) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as no
  from ended
), placed as (
  select *, row_number() over (partition by doc_id, no order by i) as a, row_number() over (partition by doc_id, no order by i desc) as z
  from numbered
), parts as (
  select doc_id, no, count(*) as n_lines, string_agg(line, chr(10) order by i) as part from numbered group by 1, 2
), ranked as (
  select *, n_lines > 1 and count(*) over (partition by part) > 1 as proven, row_number() over w as r,
         first_value(doc_id) over w as first_doc, first_value(no) over w as first_no
  from parts window w as (partition by part order by doc_id, no)
), marked as (
  select *, proven and r > 1 as goes, sum(proven::int) over (partition by doc_id order by no) as seg from ranked
), rest as (
  select l.doc_id, l.i, l.line, m.seg, min(l.no) over s - 1 as prior_no, max(l.no) over s + 1 as next_no,
         row_number() over (s order by i) as a, row_number() over (s order by i desc) as z
  from placed l join marked m on l.doc_id = m.doc_id and l.no = m.no
  where not m.proven window s as (partition by l.doc_id, m.seg)
), starts as (
  select r.doc_id, r.i, bool_and(coalesce(f.line = r.line, false)) over (partition by r.doc_id, r.seg order by r.a) as equal
  from rest r join marked c on c.doc_id = r.doc_id and c.no = r.prior_no and c.goes
  left join placed f on f.doc_id = c.first_doc and f.no = c.first_no + 1 and f.a = r.a
), ends as (
  select r.doc_id, r.i, bool_and(coalesce(f.line = r.line, false)) over (partition by r.doc_id, r.seg order by r.z) as equal
  from rest r join marked c on c.doc_id = r.doc_id and c.no = r.next_no and c.goes
  left join placed f on f.doc_id = c.first_doc and f.no = c.first_no - 1 and f.z = r.z
), gone as (
  select doc_id, i from starts where equal union select doc_id, i from ends where equal
  union select l.doc_id, l.i from placed l join marked m on l.doc_id = m.doc_id and l.no = m.no where m.goes
), kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.i) filter (g.i is null) as text, count(g.i) as removed_lines
  from lines l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by 1
), cuts as (
  select doc_id, count(*) filter (goes) as removed_chunks from marked group by 1
)
select d.doc_id, case when d.text is not null then coalesce(k.text, '') end as text, c.removed_chunks, k.removed_lines,
       (strlen(coalesce(d.text, '')) - strlen(coalesce(k.text, '')))::bigint as removed_bytes
from documents d join kept k on d.doc_id = k.doc_id join cuts c on d.doc_id = c.doc_id
"""
