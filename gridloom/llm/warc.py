r"""WARC archives with revisit resolution.

Only headers (page, url, digest, size) are shuffled by payload digest; of records with equal payloads of at
least 1000 bytes the one with the largest page_id is the response, and the others become revisit
records that refer to it and carry no payload. Pages meet their resolution by page, then every record gets
fresh headers. Records go into archives of bounded size (FILE_BYTES, or a single larger record) behind a
warcinfo record each, and Spark's text writer makes them: a row is a record, the line separator is the
blank lines that end one. So archives are made, compressed and read through Spark alone, wherever the
shared folder is. Reading back unpacks each archive as a stream, parses records by their Content-Length,
digests payloads and blocks anew, and finds the page a revisit refers to by that record's id.

A null html is an empty payload, a null url a urn. Rows that repeat a page_id with the same payload have
the same record each. Records without a page_id never serve as originals while another can. Of equal
page_ids with equal payloads all are responses. Very long payloads are one record like any other. No pages:
no archives, an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import fresh_path, small_batches, table, written

LEAST_BYTES = 1000
#: Bytes of records, not compressed, after which an archive ends; rows that a reader puts out at once.
FILE_BYTES, READ_ROWS = 64 << 20, 4000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NL, DATE = "\r\n", "2024-01-01T00:00:00Z"


def resolved(pages: DataFrame) -> DataFrame:
    """pages as (page_id, url, payload, bytes, digest, origin, origin_url); origin: the response a page revisits."""
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select("page_id", url.alias("url"), html.alias("payload"), F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("digest"))
    heads = written(rows.filter(F.col("bytes") >= LEAST_BYTES).select("page_id", "url", "digest"), "heads")
    last = F.max(F.struct("page_id", "url"))
    first = heads.groupBy("digest").agg(last["page_id"].alias("origin"), last["url"].alias("origin_url"), F.count("*").alias("n")).filter("n > 1 and origin is not null")
    # written, so that the adaptive planner can split the pages of a frequent payload where they meet it
    first = written(first.drop("n"), "originals")
    again = heads.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("origin"))).select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "origin", "origin_url").distinct()
    # hashing the few revisits of a partition spares sorting payloads
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest"))
    return rows.join(again.hint("shuffle_hash"), same, "left").select("page_id", "url", "payload", "bytes", "digest", "origin", "origin_url")


def _record_id(page, digest):
    h = F.sha1(F.concat_ws(" ", F.lit("page"), page.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(rows: DataFrame, date: str = DATE) -> DataFrame:
    """One string for each row of resolved(): a WARC record without the blank lines at its end."""
    revisit = F.col("origin").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), F.col("bytes").cast("string"), F.lit(NL + NL))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(NL))
    head = F.concat(
        F.lit(f"WARC/1.1{NL}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("origin"), F.col("digest"))), line("WARC-Refers-To-Target-URI", F.col("origin_url")), line("WARC-Refers-To-Date", F.lit(date)))).otherwise(F.lit("")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block.cast("binary")))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(NL),
    )
    return rows.select(F.concat(head, block).alias("value"))


def _about(name: str, date: str = DATE) -> str:
    """The warcinfo record that begins an archive."""
    block = f"software: gridloom{NL}format: WARC File Format 1.1{NL}"
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields", "Content-Length": str(len(block))}
    return f"WARC/1.1{NL}" + "".join(f"{k}: {v}{NL}" for k, v in head.items()) + NL + block


def _dealt(limit: int):
    """(archive, seq, value): each partition's records in archives that end once they hold limit bytes."""

    def run(batches):
        from pyspark import TaskContext

        part, archive, seq, room = TaskContext.get().partitionId(), -1, 0, 0
        names = ["archive", "seq", "value"]
        for batch in batches:
            archives, starts = [], []
            for n in pc.binary_length(batch.column(0)).to_pylist():
                if room <= 0:
                    archive, room = archive + 1, limit
                    starts.append(archive)
                archives.append(archive)
                room -= n
            if starts:
                yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([-1] * len(starts), pa.int64()), pa.array([_about(f"part-{part:05}-{k:05}") for k in starts])], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(archives, pa.int32()), pa.array(range(seq, seq + len(archives)), pa.int64()), batch.column(0)], names=names)
            seq += len(archives)

    return run


def write(pages: DataFrame, path: str) -> None:
    small_batches(pages.sparkSession)
    dealt = records(resolved(pages)).mapInArrow(_dealt(FILE_BYTES), "archive int, seq long, value string")
    dealt = dealt.sortWithinPartitions("archive", "seq").select("archive", "value")
    dealt.write.partitionBy("archive").option("lineSep", NL + NL).option("compression", "gzip").text(path)


def parsed(data: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive that is not compressed, one record in memory at a time."""
    while first := data.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError(f"no record: {first[:20]!r}")
        head = {}
        while (row := data.readline()) not in (b"\r\n", b""):
            name, _, value = row.decode().partition(": ")
            head[name] = value.removesuffix(NL)
        block = data.read(int(head["Content-Length"]))
        if data.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        yield head, block


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers string"


def _row(head: dict[str, str], block: bytes) -> tuple:
    page, kind, size, digest = head.get("X-Page-Id"), head["WARC-Type"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Block-Digest"].removeprefix("sha1:") != hashlib.sha1(block).hexdigest():
        raise ValueError(f"damaged record of page {page}")
    if kind == "response":
        payload = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
        if (size, digest) != (len(payload), hashlib.sha1(payload).hexdigest()):
            raise ValueError(f"damaged payload of page {page}")
    return None if page is None else int(page), size, digest, kind, head["WARC-Record-ID"], head.get("WARC-Refers-To")


def _rows(batches):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = [c.split()[0] for c in _READ.split(", ")]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)
    for batch in batches:
        for blob in batch.column(0):
            out: list[tuple] = []
            for head, block in parsed(gzip.GzipFile(fileobj=io.BytesIO(blob.as_py()))):
                if head["WARC-Type"] == "warcinfo":
                    continue
                out.append(_row(head, block))
                if len(out) == READ_ROWS:
                    yield made(out)
                    out = []
            yield made(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under path, refers_to found by the record that is referred to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row is a whole archive here
    try:
        got = written(files.mapInArrow(_rows, _READ), "warc")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    origins = got.filter("record_type = 'response'").select(F.col("record_id").alias("__id"), F.col("page_id").alias("refers_to")).dropDuplicates(["__id"])
    again = got.filter("record_type = 'revisit'").join(origins, F.col("refers") == F.col("__id"), "left")
    return got.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*names).union(again.select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).drop("record_id")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS origin FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> origin THEN origin END AS refers_to FROM o
"""
