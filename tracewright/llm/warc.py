"""WARC archives with revisit resolution.

Payload digests are shuffled as headers only and give each repeated payload its original; the archives are then
written with response records for originals and revisit records (identical payload digest) for the rest, each with fresh headers: the time of
writing, its own record ID, digest and lengths. Spark's text writer puts out the records, its line separator being the end of a WARC record, so
archives commit like any Spark output and live in any file system; they are cut by records so that the average archive has ``ARCHIVE_BYTES`` at most. Reading takes
archives apart record by record, computes size and digest of each response's payload anew, and resolves revisits by a join on the digest.

Payloads under ``LEAST`` bytes are always responses. Null html is an empty payload; null urls give an empty target. Of equal payloads the smallest
``page_id`` is the original, null ids last; of repeated rows exactly one is. An empty table gives an empty result. Other columns are not read, so
clashing names do no harm.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, bounded_batches, hot_join, new_path, remove, salted_join, stage, tidy, with_row_id

LEAST = 100
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in one archive at most, and bytes before compression on average: an archive is read as a whole.
RECORDS, ARCHIVE_BYTES = 20_000, 128 << 20
#: Bytes of headers that a record has about.
HEADER_BYTES = 600


def _page(page_id: Column) -> Column:
    return F.coalesce(F.url_encode(page_id.cast("string")), F.lit("~"))


def _original_id(page_id: Column, digest: Column) -> Column:
    """The record ID of an original, which its revisits name: a digest has one original."""
    h = F.sha2(F.concat_ws(":", _page(page_id), digest), 256)
    parts = [F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def originals(pages: DataFrame) -> DataFrame:
    """digest, refers_to, n (records) and m (rows of the original's id) of payloads that repeat."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    heads = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n_bytes")).where(F.col("n_bytes") >= LEAST)
    order = F.struct(F.col("page_id").isNull(), "page_id")
    per_page = heads.groupBy("digest", "page_id").agg(F.count("*").alias("c"))
    groups = per_page.groupBy("digest").agg(F.sum("c").alias("n"), F.min_by(F.struct("page_id", "c"), order).alias("first"))
    return groups.where("n > 1").select("digest", F.col("first.page_id").alias("refers_to"), "n", F.col("first.c").alias("m"))


def write_archives(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Write one record per row of ``pages`` (page_id, url, html); ``date`` is that of the records, now unless it is given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    found = stage(originals(pages), "originals")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    total = found.agg(F.sum("n")).first()[0] or 0
    placed = salted_join(rows, found.select("digest", "refers_to", "m", "n", F.lit(True).alias("repeats")), "digest", "n", total, F.col("page_id"))
    is_first = F.col("page_id").eqNullSafe(F.col("refers_to"))
    revisit = F.coalesce("repeats", F.lit(False)) & ~is_first
    again = F.coalesce(F.col("m") > 1, F.lit(False)) & is_first
    placed = placed.withColumn("revisit", revisit).withColumn("again", again)
    if not found.where("m > 1").isEmpty():  # repeated rows of one original: the first by url stays; payloads meet their row's number alone
        tied = stage(with_row_id(placed.where("again")), "tied")
        first = tied.groupBy("digest").agg(F.min(F.struct("url", "row_id"))["row_id"].alias("first_row")).select("first_row")
        tied = tied.join(first, F.col("row_id") == F.col("first_row"), "left").withColumn("revisit", F.col("first_row").isNull())
        placed = placed.where(~F.col("again")).unionByName(tied.select(*placed.columns))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), F.col("http")).otherwise(F.concat("http", "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(F.col("original"), _original_id(F.col("page_id"), F.col("digest"))).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        line("X-Page-ID", _page(F.col("page_id"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _original_id(F.col("refers_to"), F.col("digest"))), line("WARC-Refers-To-Date", F.lit(date)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    original = F.coalesce("repeats", F.lit(False)) & ~F.col("revisit")
    written = placed.withColumn("http", http).withColumn("block", block).withColumn("original", original).select(record.alias("value"))
    mean = pages.agg(F.avg(F.octet_length(payload))).first()[0] or 0
    per_file = int(max(1, min(RECORDS, ARCHIVE_BYTES // (mean + HEADER_BYTES))))
    written.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


_HEADER = re.compile(rb"^([A-Za-z-]+): ?(.*?)\r\n", re.M)


def records(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; blocks are taken by their length, whatever bytes they hold."""
    while True:
        version = archive.readline()
        if not version:
            return
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        raw = b""
        while (line := archive.readline()) not in (b"\r\n", b""):
            raw += line
        headers = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(raw)}
        block = archive.read(int(headers["content-length"]))
        if archive.read(len(END)) != END.encode():
            raise ValueError("a record does not end where its length says")
        yield headers, block


def _page_id(page: str | None) -> str | None:
    return None if page in (None, "~") else unquote_plus(page)


_READ = "page_id string, url string, record_type string, record_id string, digest string, refers_to_record string, payload_bytes long, payload_digest string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; size and digest are those of the payload as read, null for revisits."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for headers, block in records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    payload = block.partition(END.encode())[2] if headers["warc-type"] == "response" else None
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
                    measured = (len(payload), hashlib.sha256(payload).hexdigest()) if payload is not None else (None, None)
                    out.append((_page_id(headers.get("x-page-id")), headers.get("warc-target-uri"), headers["warc-type"], headers["warc-record-id"], digest, headers.get("warc-refers-to"), *measured))
                yield arrow_batch(out, _READ)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, _READ)


def resolve(read: DataFrame) -> DataFrame:
    """The records of ``read_archives``, revisits with size, digest and page (``refers_to``) of the response that has their digest."""
    heads = stage(read, "heads")
    revisits = heads.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    responses = heads.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("string"))
    uses = revisits.groupBy("digest").agg(F.count("*").alias("uses"))
    kept = responses.where(F.col("payload_bytes") >= LEAST).groupBy(F.col("payload_digest").alias("digest")).agg(F.min_by(F.struct("payload_bytes", "page_id"), "record_id").alias("of"))
    kept = kept.select("digest", F.col("of.payload_bytes").alias("payload_bytes"), F.col("of.page_id").alias("refers_to"))
    sizes = stage(uses.join(kept, "digest").withColumn("payload_digest", F.col("digest")), "sizes")
    total = sizes.agg(F.sum("uses")).first()[0] or 0
    return responses.unionByName(hot_join(revisits, sizes, ["digest"], "uses", total, "left"))


@tidy
def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and resolve: page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id.

    Without a ``path`` the archives go when they are read.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    own = path is None
    path = path or new_path(spark, "warc")
    try:
        write_archives(pages, path)
        kind = pages.schema["page_id"].dataType
        done = resolve(read_archives(spark, path))
        return done.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind), "url", "record_id")
    finally:
        if own:
            remove(spark, [path])
