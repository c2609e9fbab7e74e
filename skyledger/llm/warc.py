"""WARC archives whose repeated payloads are revisit records.

Headers (page, digest, length) are shuffled by payload digest, never the payloads:
per digest the smallest page is the original, the other pages become revisits.  The
few revisit rows are written and joined to the pages (broadcast by the planner when
the written table is small, by shuffle otherwise).  Archives are written by Spark's
text writer, one record per row with the record separator as line separator, so the
commit protocol covers lost executors.  Each archive holds at most `archive_bytes`
plus one record.

Reading back parses whole records by Content-Length and then joins each revisit to
the response it refers to, which gives its payload length.

Defined cases: null html is an empty payload; payloads under `least` bytes are always
responses; a null url leaves the header out; a null page id is never an original, and
is a revisit when its payload has one; rows with the original's id and payload are
responses as well; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import Scratch, mapped, settle, table, work_dir

LEAST_BYTES = 100
ARCHIVE_BYTES = 16 << 20
WARC_DATE = "2026-01-01T00:00:00Z"
# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
SEPARATOR = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def revisits(pages: DataFrame, work: Scratch, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, original) of the pages whose payload an earlier page has."""
    headers = pages.select("page_id", F.octet_length("html").alias("bytes"), F.sha2("html", 256).alias("digest")).where(F.col("bytes") >= least)
    originals = headers.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    # Written before the join, so that the join of a hot payload can be split.
    originals = work.settle(originals.where("n > 1 and original is not null").drop("n"), "originals")
    later = headers.join(originals, "digest").where("page_id is null or page_id > original")
    return later.select("page_id", "digest", "original").distinct()


def records(pages: DataFrame, found: DataFrame, date: str = WARC_DATE) -> DataFrame:
    """One WARC record per page as text, without the closing separator."""
    digest = F.sha2("html", 256)
    joined = pages.withColumn("digest", digest).alias("p").join(found.alias("r"), F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest")), "left")
    original = F.col("r.original")
    crlf = "\r\n"
    uri = F.regexp_replace(F.col("p.url"), "[\r\n]", " ")
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("p.page_id").cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + crlf + "Content-Type: text/html; charset=utf-8" + crlf + "Content-Length: "), F.octet_length(F.col("p.html")).cast("string"), F.lit(crlf * 2))
    block = F.when(original.isNull(), F.concat(http, F.col("p.html"))).otherwise(http)
    head = F.concat_ws(
        crlf,
        F.lit(VERSION),
        F.when(original.isNull(), F.lit("WARC-Type: response")).otherwise(F.lit("WARC-Type: revisit")),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("p.digest")),
        F.when(original.isNotNull(), F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), original.cast("string"), F.lit(">")),
        F.lit(f"Content-Type: {HTTP_TYPE}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return joined.select(F.concat(head, F.lit(crlf * 2), block).alias("value"))


def _numbered(limit: int):
    """Add the number of the archive within its task: a new one after `limit` bytes."""

    def number(batches):
        archive, held = 0, 0
        for batch in batches:
            numbers = []
            for size in pc.binary_length(batch.column("value")).to_pylist():
                if held and held + size > limit:
                    archive, held = archive + 1, 0
                held += size
                numbers.append(archive)
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(numbers, pa.int32())], ["value", "archive"])

    return number


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the deduplicated archives of `pages` as gzip files below `path`."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    with Scratch(pages.sparkSession, "warc-work") as work:
        found = work.settle(revisits(pages, work, least), "revisits")
        numbered = mapped(records(pages, found), _numbered(archive_bytes), "value string, archive int")
        numbered.write.partitionBy("archive").option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


def parse(content: bytes):
    """Yield (headers, payload) of every record of one archive."""
    data = gzip.decompress(content)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield headers, data[data.index(b"\r\n\r\n", start) + 4 : stop]
        at = stop + len(SEPARATOR)


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _scan(batches):
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for headers, payload in parse(content.as_py()):
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                response = headers["WARC-Type"] == "response"
                if response and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
                rows.append((_page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], len(payload) if response else None, digest, _page(headers.get("WARC-Refers-To"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all records, revisits resolved to the response they refer to."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt.gz").load(path)
    heads = settle(mapped(files.select("content"), _scan, READ), "warc-headers")
    asked = heads.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    answers = heads.where("record_type = 'response'").join(asked, ["page_id", "payload_digest"], "left_semi").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full"))
    answers = settle(answers, "warc-answers")
    return heads.join(answers, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


SQL = """
with t as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), o as (
  select payload_digest, min(page_id) as original from t where payload_bytes >= 100 group by 1
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when page_id <> original then 'revisit' else 'response' end as record_type,
       case when page_id <> original then original end as refers_to
from t left join o using (payload_digest)
"""
