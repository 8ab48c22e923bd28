"""WARC archives: captures are written as request, response (or revisit) and metadata records, read back record
by record, and assembled into one nested row per capture through their WARC-Concurrent-To identifiers.

Archives are written by Spark's text writer, whose line separator is the record separator, so they land in any
store that Spark writes to. They are read by Spark's text reader with the same separator: a file of any size comes
as a stream of pieces, and Content-Length alone tells which of them make up a record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.llm.common import matched, new_path, text_of, written

CRLF, END = "\r\n", "\r\n\r\n"
#: The alphabets of 32 digits that conv() and base32 use.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLANK = END.encode()
RECORD_SCHEMA = "record_id string, kind string, concurrent_to array<string>, refers_to string, target_uri string, date string, digest string, payload_bytes long, payload binary, fields map<string,string>"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: each five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def urn(kind: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], content_type: str, body: Column) -> Column:
    """The record without its closing separator; a header whose value is null is left out."""
    lines = [F.lit("WARC/1.1")]
    for name, value in [*headers, ("Content-Type", content_type)]:
        lines.append(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(END), body)


def _line(value: Column) -> Column:
    """A value that stays on its header's line."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, path: str | None = None, date: str = "2024-01-01T00:00:00Z", rows_per_file: int = 10_000) -> str:
    """``pages(page_id, url, html)`` as WARC 1.1 archives (gzip); gives their path.

    Of pages with equal payloads (html in UTF-8, null as empty) of at least ``min_revisit_bytes`` bytes, the
    one with the largest page_id (null the smallest, then any one) is a response and the others are revisits
    of it; smaller payloads are all responses. The number of pages that share a payload is not bounded. Rows that
    repeat are each captured; pages of any length are written whole; other columns, whatever their names, are
    ignored; an empty table gives archives without a record.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    html = text_of("html")
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        html.alias("html"),
        sha1_base32(html).alias("digest"),
        F.sha2(html, 256).alias("same"),
        F.octet_length(html).cast("long").alias("n"),
        F.monotonically_increasing_id().alias("row"),
    )
    keyed = written(keyed, "pages")
    last = keyed.where(F.col("n") >= min_revisit_bytes).groupBy("same")
    last = last.agg(F.max(F.struct("page_id", "row")).alias("last"), F.count(F.lit(1)).alias("copies"))
    shared = written(last.where("copies > 1").select("same", F.col("last.row").alias("first_row")), "shared")
    met = matched(keyed, shared, ["same"], 112, "left")

    revisit = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row")) & (F.col("n") >= min_revisit_bytes)
    main, first = urn("response", F.col("row")), F.when(revisit, urn("response", F.col("first_row")))
    target, n = _line(F.col("url")), F.col("n").cast("string")
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "
    http = F.concat(F.lit(head), n, F.lit(END))
    common = [("WARC-Target-URI", target), ("WARC-Date", date)]
    kind = F.when(revisit, "revisit").otherwise("response")
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    about = [("WARC-Payload-Digest", digest), ("WARC-Refers-To", first), ("WARC-Profile", F.when(revisit, PROFILE))]
    response = _record(
        [("WARC-Type", kind), ("WARC-Record-ID", main), *common, *about],
        "application/http; msgtype=response",
        F.when(revisit, http).otherwise(F.concat(http, "html")),
    )
    asked = urn("request", F.col("row"))
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", asked), *common, ("WARC-Concurrent-To", main)],
        "application/http; msgtype=request",
        F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1" + END)),
    )
    page = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    own = urn("metadata", F.col("row"))
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", own), *common, ("WARC-Concurrent-To", asked)],
        "application/warc-fields",
        page,
    )
    records = met.select(F.explode(F.array(request, response, metadata)).alias("value"))
    writer = records.write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", 3 * rows_per_file).text(path)
    return path


def parse(pieces: Iterable[bytes], with_payload: bool) -> Iterator[tuple]:
    """The records of an archive that comes cut at blank lines, as rows of ``RECORD_SCHEMA``.

    Pieces are put together again until they hold a record by its ``Content-Length``; a cut may lie anywhere, since
    a body that ends in a line break makes blank lines of its own. One record and one piece are held.
    """
    held = bytearray()
    names: dict[str, str] = {}
    pairs: list[tuple[str, str]] = []
    for piece in pieces:
        held += piece
        held += _BLANK
        while True:
            if not pairs:
                blank = len(held) - len(held.lstrip(b"\r\n"))  # between records
                del held[:blank]
                if (end := held.find(_BLANK)) < 0:
                    break
                lines = held[:end].decode("utf-8", "replace").split(CRLF)
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record at {bytes(held[:40])!r}")
                pairs = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
                names = dict(pairs)
                del held[: end + len(_BLANK)]
            wanted = int(names["content-length"])
            if len(held) < wanted + len(_BLANK):
                break
            if held[wanted : wanted + len(_BLANK)] != _BLANK:
                raise ValueError(f"record {names['warc-record-id']} does not end where it says")
            body = bytes(held[:wanted])
            del held[: wanted + len(_BLANK)]
            yield _parsed(names, pairs, body, with_payload)
            pairs = []
    if pairs:
        raise ValueError(f"record {names['warc-record-id']} is cut short")


def _fields(lines: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.split(CRLF)) if k}


def _parsed(names: dict[str, str], pairs: list[tuple[str, str]], body: bytes, with_payload: bool) -> tuple:
    kind, fields, payload, size, digest = names["warc-type"], {}, None, None, None
    if kind in ("response", "revisit"):
        http, _, payload = body.partition(b"\r\n\r\n")
        fields = _fields(http.decode("latin-1").partition(CRLF)[2])
        said = names.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response":
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if said not in ("", digest):
                raise ValueError(f"payload of {names['warc-record-id']} has digest {digest}, not {said}")
        else:
            size, digest = int(fields["content-length"]), said
    elif kind == "metadata":
        fields = _fields(body.decode("utf-8", "replace"))
    concurrent = [v for k, v in pairs if k == "warc-concurrent-to"]
    known = (names.get(x) for x in ("warc-refers-to", "warc-target-uri", "warc-date"))
    kept = payload if with_payload and kind == "response" else None
    return names["warc-record-id"], kind, concurrent, *known, digest, size, kept, fields


#: ``RECORD_SCHEMA`` for Arrow, and the bytes of records that are given out at a time.
_ARROW = pa.schema([
    ("record_id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.list_(pa.string())),
    ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())),
])
_BATCH_BYTES = 8_000_000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns[-1] = [list(x.items()) for x in columns[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path`` (``*.gz``), one row each (``RECORD_SCHEMA``).

    A file is a stream for one task, however long it is; gzip files are not split, so records stay in order.
    """
    reader = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz")
    pieces = reader.schema("value string").text(path).select(F.col("value").cast("binary").alias("piece"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in parse((piece for b in batches for piece in b.column(0).to_pylist()), with_payload):
            held.append(r)
            size += len(r[8] or b"") + 500
            if size > _BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return pieces.mapInArrow(cut, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """Records to one nested row per capture: ``(capture_id, response, request, metadata)``.

    The capture is named by its response or revisit record. A record belongs to the response that it or that
    names it as concurrent, or to that of such a record (metadata may name the request). response holds the
    record; request and metadata are arrays, empty if there are none. Records that reach no response are
    captures of their own, with a null response.
    """
    body = [c for c in records.columns if c != "concurrent_to"]
    main_kinds = F.col("kind").isin("response", "revisit")
    # so that archives are read twice, not for each join
    ids = written(records.select("record_id", "kind", "concurrent_to"), "record-ids")
    named = ids.select("record_id", F.explode("concurrent_to").alias("other"))
    edges = named.unionAll(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    mains = ids.where(main_kinds).select(F.col("record_id").alias("main")).distinct()
    direct = edges.join(mains, edges.other == mains.main).groupBy("record_id").agg(F.min("main").alias("near"))
    through = direct.join(mains, direct.record_id == mains.main, "left_anti")
    through = through.select(F.col("record_id").alias("via"), F.col("near").alias("by_way"))
    second = edges.join(through, edges.other == through.via).groupBy("record_id").agg(F.min("by_way").alias("far"))
    placed = records.join(direct, "record_id", "left").join(second, "record_id", "left")
    own = F.when(main_kinds, F.col("record_id"))
    placed = placed.withColumn("capture_id", F.coalesce(own, "near", "far", "record_id"))
    whole = F.struct(*body)
    return placed.groupBy("capture_id").agg(
        F.first(F.when(main_kinds, whole), ignorenulls=True).alias("response"),
        F.collect_list(F.when(F.col("kind") == "request", whole)).alias("request"),
        F.collect_list(F.when(~main_kinds & (F.col("kind") != "request"), whole)).alias("metadata"),
    )


def page_rows(captures: DataFrame) -> DataFrame:
    """Captures of ``write_archives`` to ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""
    page = F.expr("try_cast(nullif(metadata[0].fields['page-id'], '') as bigint)").alias("page_id")
    names = {"payload_bytes": "payload_bytes", "digest": "payload_digest", "kind": "record_type", "refers_to": "to_record"}
    of_response = [F.col(f"response.{a}").alias(b) for a, b in names.items()]
    c = written(captures.select("capture_id", page, *of_response), "captures")
    wanted = c.where("to_record is not null").select(F.col("to_record").alias("capture_id")).distinct()
    firsts = c.join(wanted, "capture_id", "left_semi")
    firsts = written(firsts.select(F.col("capture_id").alias("to_record"), F.col("page_id").alias("refers_to")), "referred")
    met = matched(c, firsts, ["to_record"], 80, "left")
    return met.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages
), d as (
  select page_id, strlen(html)::bigint as payload_bytes,
         translate(concat(""" + ", ".join(f"to_base(('0x' || substr(h, {1 + 5 * i}, 5))::bigint, 32, 4)" for i in range(8)) + r"""),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
         max(page_id) over (partition by html) as last
  from p
)
select page_id, payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type,
       case when page_id <> last then last end as refers_to
from d
"""
