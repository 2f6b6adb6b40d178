"""Content-addressed web archive: payload bytes once by a verified strong digest, exact record headers beside them.

``write`` stores two things in a folder: ``records`` (Parquet: the exact header block of every record and the SHA-256 of its
payload) and ``warc`` (WARC files, one gzip member per record). A payload of at least ``REVISIT_BYTES`` bytes stands in the
archive once: of the records that share it, the one with the largest page_id is the response and the others are revisits that
refer to it; smaller ones are all responses. ``read_records`` rebuilds every record by joining headers to payloads, which are
read from the WARC files and verified by both digests; ``digest`` describes every record from the WARC files alone.

Files are written and read by Spark's text source, which commits whole tasks and knows every store: a row is one gzip member,
and the line separator is an empty gzip member, so a file is a plain multi-member gzip file that any reader of WARC takes and
that Spark splits between members.

Scale: only payloads that may be shared are shuffled, once, one copy per task and digest, so a page that a third of the crawl
repeats moves once per task; small payloads are written where they are read. Headers carry no payload. Joins run by digest
between written tables; adaptive execution splits a hot digest's header rows. A revisit takes the length and SHA-1 of its
payload from the response, so no payload is shipped to be hashed again.

Defined cases: null html is an empty payload; rows that repeat the largest page_id of their payload are all responses; a
null page_id is never the largest unless all are null, when all are responses; a null url is written as an empty target;
an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 1000
CRLF = "\r\n"
# Header lines of the archive's records.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Compression level of a member, and zlib's number for a gzip wrapper.
LEVEL, GZIP = 6, 31


def member(record: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return c.compress(record) + c.flush()


#: What stands between members: a member that holds nothing, as the text source spells separators.
BETWEEN = {"lineSep": member(b"").decode("latin-1"), "encoding": "ISO-8859-1"}


def _rows(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("payload"),
    ).select("page_id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("digest"), F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))


def _header(kind: Column, keeper: Column) -> Column:
    """The exact header block of a record, HTTP header included, up to where the payload begins."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    sha = lambda c: F.lower(F.hex(c))
    uid = lambda page: F.concat(F.lit("<urn:sha1:"), sha("sha1"), F.lit(":"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    http = F.octet_length(F.lit(HTTP))
    return F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", uid(F.col("page_id"))), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha("sha1"))), line("X-Payload-SHA256", sha("digest")),
        F.when(kind == "revisit", F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", uid(keeper)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (http + F.when(kind == "revisit", F.lit(0)).otherwise(F.col("bytes"))).cast("string")), F.lit(CRLF + HTTP),
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [member((h.as_py() + b"\r\n\r\n") if p.as_py() is None else b"".join((h.as_py(), p.as_py(), b"\r\n\r\n"))) for h, p in zip(batch.column(0), batch.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])


def write(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> str:
    """Store the pages under ``folder`` and return it."""
    spark = pages.sparkSession
    rows = _rows(pages)
    slim = rows.select("page_id", "url", "digest", "sha1", "bytes")
    shared, none = F.col("bytes") >= revisit_bytes, F.lit(None).cast("long")
    keepers = common.materialise(slim.filter(shared).groupBy("digest").agg(F.max("page_id").alias("keeper")), "keepers")
    heads = slim.filter(shared).join(keepers, "digest").withColumn("kind", F.when(F.col("page_id").eqNullSafe(F.col("keeper")), F.lit("response")).otherwise(F.lit("revisit")))
    heads = heads.unionByName(slim.filter(~shared).withColumns({"keeper": none, "kind": F.lit("response")}))
    heads = heads.select("page_id", "digest", "bytes", "kind", _header(F.col("kind"), F.col("keeper")).alias("header"), F.when(F.col("kind") == "revisit", F.col("keeper")).alias("refers_to"))
    heads.write.option("compression", "zstd").parquet(f"{folder}/records")
    kept = spark.read.schema(heads.schema).parquet(f"{folder}/records")
    once = rows.filter(shared).groupBy("digest").agg(F.first("payload").alias("payload"))
    full = kept.filter(shared & (F.col("kind") == "response")).select("digest", "header").join(once, "digest").select("header", "payload")
    small = rows.filter(~shared).select(_header(F.lit("response"), none).alias("header"), "payload")
    bare = kept.filter("kind = 'revisit'").select("header", F.lit(None).cast("binary").alias("payload"))
    records = full.unionAll(small).unionAll(bare).select(F.col("header").cast("binary").alias("header"), "payload")
    records.mapInArrow(_pack, "value binary").select(F.col("value").cast("string").alias("value")).write.options(**BETWEEN).text(f"{folder}/warc")
    return folder


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, exact header block and payload of one record. Bytes that do not fit their lengths or digests are an error."""
    top = raw.index(b"\r\n\r\n") + 4
    lines = raw[: top - 4].decode().split(CRLF)
    fields = dict(line.split(": ", 1) for line in lines[1:])
    end = top + int(fields["Content-Length"])
    begin = raw.index(b"\r\n\r\n", top) + 4
    if lines[0] != VERSION or raw[end:] != b"\r\n\r\n" or begin > end:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
    payload = raw[begin:end]
    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != fields["X-Payload-SHA256"] or f"sha1:{hashlib.sha1(payload).hexdigest()}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return fields, raw[:begin], payload


def members(spark: SparkSession, folder: str) -> DataFrame:
    """The gzip members of the WARC files, one a row."""
    return spark.read.schema("value string").options(**BETWEEN).text(f"{folder}/warc").select(F.col("value").cast("binary").alias("value"))


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload): every verified payload of the WARC files once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parsed(zlib.decompress(v.as_py(), GZIP)) for v in batch.column(0)]
            found = [(bytes.fromhex(f["X-Payload-SHA256"]), p) for f, _, p in found if f["WARC-Type"] == "response"]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([p for _, p in found], pa.binary())], names=["digest", "payload"])

    return members(spark, folder).mapInArrow(run, "digest binary, payload binary").groupBy("digest").agg(F.first("payload").alias("payload"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record again, header and payload bytes, revisits included, by joining the two stores."""
    return spark.read.parquet(f"{folder}/records").join(payloads(spark, folder), "digest")


def digest(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write WARC files, read them back, and describe each record by its own header and its (or its response's) payload bytes."""
    spark = pages.sparkSession
    if folder is None:
        folder = f"{common.scratch_dir(spark)}/factloom/archive-{common.uuid.uuid4().hex}"
        common._written.append((spark, folder))
    write(pages, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda uid: int(uid[1:-1].rpartition(":")[2]) if uid and uid[1:-1].rpartition(":")[2] else None
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for v in batch.column(0):
                f, _, payload = parsed(zlib.decompress(v.as_py(), GZIP))
                whole = f["WARC-Type"] == "response"
                row = (page(f["WARC-Record-ID"]), bytes.fromhex(f["X-Payload-SHA256"]), f["WARC-Type"], page(f.get("WARC-Refers-To")), len(payload) if whole else None, hashlib.sha1(payload).hexdigest() if whole else None)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["page_id", "digest", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    back = common.materialise(members(spark, folder).mapInArrow(run, "page_id long, digest binary, record_type string, refers_to long, payload_bytes long, payload_digest string"), "described")
    response, columns = F.col("record_type") == "response", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    facts = common.materialise(back.filter(response & (F.col("payload_bytes") >= REVISIT_BYTES)).groupBy("digest").agg(F.max("payload_bytes").alias("n"), F.max("payload_digest").alias("sha")), "facts")
    lost = F.raise_error(F.concat(F.lit("no response holds payload "), F.hex("digest")))
    revisits = back.filter(~response).join(facts, "digest", "left").withColumns({"payload_bytes": F.coalesce("n", lost.cast("long")), "payload_digest": F.coalesce("sha", lost.cast("string"))})
    return back.filter(response).select(*columns).unionByName(revisits.select(*columns))
