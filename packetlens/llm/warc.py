"""A content-addressed WARC archive: payload bytes once per SHA-256 digest, exact record headers apart.

An archive is a folder with two Parquet tables. ``payloads`` has a row per digest with the bytes, and ``records`` a
row per record with its header block, byte for byte as in a WARC file, and the digest of its payload. Records
are put together again by a join on the digest; ``export`` writes them as WARC files.

Digests are verified: on writing, all payloads of a digest must agree in length and in a second hash; on
reading, the digest is taken again from the stored bytes or, where records are put together (``rebuilt``), from each
record's own block, whose length must be the stated one. Any of these failing ends the job.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest page id is the response
and the others are revisits of it; smaller payloads give responses only. The aggregate by digest combines copies
in each task before the shuffle, so a page copied a million times is one row a task.

Defined results: null html is an empty payload. A null page id is written as ``null``; it is larger than any number,
and a group of null ids only has responses only. Rows repeating the smallest id are all responses (one payload is
stored). Line breaks in an url are percent-encoded; a null url has no target line. An empty table gives an
empty archive.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.llm.common import shared_folder, table, to_batch

MIN_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
_ID = "urn:x-page:"
#: Bytes of an exported file, unless one record is larger, and the sizes up to which records share files.
FILE_BYTES = 512 * 1024 * 1024
SIZE_CLASSES = (16 * 1024, 256 * 1024, 4 * 1024 * 1024, 64 * 1024 * 1024)
READ_BYTES = 8 * 1024 * 1024
BATCH_RECORDS = 10_000


def _payloads(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").alias("url"),
        body.alias("payload"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
    )


def _lines(*lines) -> F.Column:
    """Header lines; a null line is left out."""
    return F.concat_ws("\r\n", *lines)


def _head(row_type, page_id, url, digest, refers_to, size) -> F.Column:
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    field = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    revisit = row_type == "revisit"
    uri = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), field("Content-Length", size.cast("string"))),
        F.lit(END),
    )
    block = F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + size)
    warc = _lines(
        F.lit("WARC/1.1"),
        field("WARC-Type", row_type),
        field("WARC-Record-ID", name(page_id)),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex(digest)))),
        F.when(revisit, field("WARC-Profile", F.lit(PROFILE))),
        F.when(revisit, field("WARC-Refers-To", name(refers_to))),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", block.cast("string")),
    )
    return F.concat(warc, F.lit(END), http)


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write the archive of ``pages`` (page_id, url, html) below ``path``."""
    rows = _payloads(pages)
    second, size = F.xxhash64("payload"), F.octet_length("payload")
    same = (F.min(second) == F.max(second)) & (F.min(size) == F.max(size))
    once = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"),
        F.min("page_id").alias("first_id"),
        F.max(size).cast("long").alias("size"),
        same.alias("same"),
    )
    kept = F.when(F.col("same"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads have one digest")))
    once = once.select("digest", kept.alias("payload"), "first_id", "size")
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")

    known = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first_id", "size")
    each = rows.drop("payload").join(known, "digest")
    other = (F.col("size") >= min_revisit) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(other, F.lit("revisit")).otherwise(F.lit("response"))
    head = _head(kind, F.col("page_id"), F.col("url"), F.col("digest"), F.col("first_id"), F.col("size"))
    each.select("digest", head.alias("head")).write.option("compression", "zstd").parquet(f"{path}/records")


def _field(name: str) -> F.Column:
    found = F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _page(name: str) -> F.Column:
    return F.regexp_extract(_field(name), rf"^<{_ID}(.*)>$", 1).try_cast("long")


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records: page_id, url, record_type, refers_to, head, digest, payload_bytes and, if wanted, the payload.

    Each stored payload is verified against its digest before the join, once however many records share it.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    check = F.when(F.sha2("payload", 256) == F.lower(F.hex("digest")), F.octet_length("payload").cast("long"))
    size = F.coalesce(check, F.raise_error(F.lit("a payload differs from its digest")).cast("long"))
    bodies = stored.select("digest", size.alias("payload_bytes"), *["payload"] * payload)
    heads = spark.read.parquet(f"{path}/records")
    return heads.join(bodies, "digest").select(
        _page("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"),
        "head",
        F.lower(F.hex("digest")).alias("digest"),
        "payload_bytes",
        *["payload"] * payload,
    )


def rebuilt(spark: SparkSession, path: str, above: int = -1, most: int | None = None) -> DataFrame:
    """The records put together again: head, block (HTTP head, then a response's payload) and what was read from them.

    ``above`` and ``most`` bound the payloads' sizes, so that only these payloads are read.

    Every block must have the length that its head states, and a response's payload, taken from its own block, the
    digest that its head states; else the job fails. A revisit has no payload: its ``payload_bytes`` are those of the
    stored payload, which the response that it refers to is verified with.
    """
    stored = spark.read.parquet(f"{path}/payloads").filter(F.col("size") > above)
    if most is not None:
        stored = stored.filter(F.col("size") <= most)
    stored = stored.select("digest", "payload")
    rows = spark.read.parquet(f"{path}/records").join(stored, "digest").select(
        "head", "payload", F.substring_index("head", END, 1).alias("warc"), _field("WARC-Type").alias("record_type")
    )
    http = F.expr(f"substring(head, char_length(warc) + {len(END) + 1})").cast("binary")
    revisit = F.col("record_type") == "revisit"
    rows = rows.withColumn("http_bytes", F.octet_length(http)).withColumn(
        "block", F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    )
    stated = F.regexp_extract("warc", r"\r\nContent-Length: (\d+)$", 1).cast("long")
    stated_digest = F.regexp_extract("warc", r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1)
    body = F.expr("substring(block, http_bytes + 1)")
    digest = F.when(revisit, stated_digest).otherwise(F.sha2(body, 256))
    return rows.select(
        _page("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        "record_type",
        _page("WARC-Refers-To").alias("refers_to"),
        "head",
        F.when(F.octet_length("block") == stated, F.col("block"))
        .otherwise(F.raise_error(F.lit("a block differs from its stated length")).cast("binary"))
        .alias("block"),
        F.when(digest == stated_digest, digest)
        .otherwise(F.raise_error(F.lit("a payload differs from its digest")))
        .alias("digest"),
        F.when(revisit, F.octet_length("payload")).otherwise(F.octet_length(body)).cast("long").alias("payload_bytes"),
    )


def records(spark: SparkSession, path: str, above: int = -1, most: int | None = None) -> DataFrame:
    """(page_id, record): each original record but its closing line ends; a revisit has no payload."""
    warc = F.concat(F.substring_index("head", END, 1), F.lit(END))
    rows = rebuilt(spark, path, above, most)
    return rows.select("page_id", F.concat(warc, F.col("block").cast("string")).alias("record"))


def export(spark: SparkSession, path: str, out: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the records as WARC files below ``out``; the line separator is the end that WARC asks for.

    Files are bounded by bytes of payloads: each class of payload sizes is written by a job of its own, as many records
    a file as fit at the class's largest size. Payloads beyond the last class have a file each.
    """
    above = -1
    for most in (*SIZE_CLASSES, None):
        per_file = 1 if most is None else max(1, file_bytes // most)
        lines = records(spark, path, above, most).select("record").write.mode("append").option("lineSep", END)
        lines.option("maxRecordsPerFile", per_file).text(out)
        above = most


def _parse(source):
    """(head, block) of each record of an open file, which is read forward; one record is held at a time.

    The first empty line ends the WARC head; the block begins with the HTTP head.
    """
    held = b""
    while True:
        while (stop := held.find(END.encode())) < 0:
            more = source.read(READ_BYTES)
            if not more:
                if held.strip():
                    raise ValueError("a record's head has no end")
                return
            held += more
        stop += len(END)
        head = held[:stop]
        stated = re.search(rb"\r\nContent-Length: (\d+)", head)
        if stated is None:
            raise ValueError("a record's head states no length")
        size = int(stated[1])
        missing = stop + size + len(END) - len(held)
        if missing > 0:
            held += source.read(max(missing, READ_BYTES))
        if len(held) < stop + size + len(END) or held[stop + size : stop + size + len(END)] != END.encode():
            raise ValueError("a record is cut off or longer than stated")
        yield head.decode(), held[stop : stop + size]
        held = held[stop + size + len(END) :]


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """(head, block) of every record in WARC files of any size: ``head`` is the WARC head with its empty line.

    A task reads its files forward, a record at a time. A file that is cut off or misstates a length ends the job.
    """

    def opened(path: str):
        files, inner = pafs.FileSystem.from_uri(path)
        return files.open_input_stream(inner)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                heads, blocks, size = [], [], 0
                with opened(path) as source:
                    for head, block in _parse(source):
                        heads.append(head)
                        blocks.append(block)
                        size += len(block)
                        if size >= READ_BYTES or len(heads) == BATCH_RECORDS:
                            yield to_batch({"head": (heads, pa.string()), "block": (blocks, pa.binary())})
                            heads, blocks, size = [], [], 0
                yield to_batch({"head": (heads, pa.string()), "block": (blocks, pa.binary())})

    files = spark.read.format("binaryFile").load(out).select("path")
    return files.mapInArrow(run, "head string, block binary")


def op3(spark, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return rebuilt(spark, path).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


OP3_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, payload_bytes >= {MIN_REVISIT} AND page_id <> min(page_id) OVER (PARTITION BY payload_digest) AS again,
    min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to FROM r
"""
