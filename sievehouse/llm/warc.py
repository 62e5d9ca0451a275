"""WARC archives with revisit records, written and read by Spark."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four characters."""
    digest = F.sha1(value.cast("binary"))
    quarters = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quarters), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _records(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html), F.lit(""))
    return pages.select(
        F.col(page).cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("about:blank")), "[\\x00-\\x20\\x7F]", "%20").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )


def resolve_revisits(pages: DataFrame, least_bytes: int = 0, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The records to write: page_id, url, payload, payload_bytes,
    payload_digest, record_type, refers_to, refers_to_url.

    Only headers are shuffled by payload digest (summed up before the shuffle)
    to find the payloads that occur again; these digests are joined back.
    Spark broadcasts that table only where the files written for it are below
    its threshold; else it shuffles by digest and splits hot digests. A null
    html counts as empty. Rows that share the smallest page_id of a payload
    are all responses; a null page_id counts as larger than any other. A null
    url is written as about:blank. Payloads below least_bytes are never
    revisits.
    """
    records = _records(pages, page, url, html)
    again = written(
        records.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")),
        "warc-digests",
    )
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return records.join(again, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("refers_to_url"),
    )


#: (largest payload, most records of one archive, a power of two) by classes of payloads: an
#: archive holds some 256 MB at most, or one record above the class before the last.
SIZES = [(1 << 14, 1 << 14), (1 << 20, 1 << 8), (1 << 25, 1 << 3), (1 << 31, 1)]
_ROW_BITS = (1 << 33) - 1


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes gzipped WARC/1.1 files, one or more a task, and returns the folder.

    A revisit holds the HTTP header but no payload. The text sink writes the
    records; its line separator is the blank lines that end each record. In one
    pass, records go to subfolders by class of payload size and by the number
    of their row in its task, so that archives are bounded by bytes.
    """
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(
            F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to")),
            F.lit("\r\nWARC-Refers-To-Target-URI: "), F.col("refers_to_url"),
            F.lit(f"\r\nWARC-Refers-To-Date: {date}"),
        )).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length, F.lit(END),
    )
    text = F.concat(header, http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    bytes_kept = F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    size_class = sum((bytes_kept > most).cast("int") for most, _ in SIZES[:-1])
    bits = F.element_at(F.array(*[F.lit(n.bit_length() - 1) for _, n in SIZES]), size_class + 1)
    # Rows of a task are numbered in its low bits, so a part has at most as many rows of a class as an archive may hold.
    part = F.expr("shiftright(row, bits)")
    rows = records.select(text.alias("value"), size_class.alias("size"), bits.alias("bits"), F.monotonically_increasing_id().bitwiseAND(_ROW_BITS).alias("row"))
    options = {"lineSep": END, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    rows.select("value", "size", part.alias("part")).write.partitionBy("size", "part").options(**options).text(folder)
    return folder


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of one gzipped archive."""
    plain = []
    while data:
        member = zlib.decompressobj(31)
        plain.append(member.decompress(data))
        data = member.unused_data
    raw, at = b"".join(plain), 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        lines = raw[at:stop].decode("utf-8").split("\r\n")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        begin = stop + 4
        at = begin + int(fields["content-length"])
        yield fields, raw[begin:at]
        at += 4


HEADERS = "page_id bigint, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint"


def read_archives(spark, folder: str) -> DataFrame:
    """One row for each record: page_id, record_type, payload_digest,
    payload_bytes (null for revisits), refers_to. Digest and length of a
    response are taken from the payload itself. An archive is held whole by
    the task that reads it; write_archives bounds it by bytes, and a payload
    above 32 MiB has an archive of its own."""

    def number(uri: str | None) -> int | None:
        value = (uri or "").rpartition(":")[2].rstrip(">")
        return int(value) if value.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])
        for batch in batches:
            for value in batch.column(0):
                rows = []
                for fields, block in parse_archive(value.as_py()):
                    kind, digest, length = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2], None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    rows.append((number(fields["warc-record-id"]), kind, digest, length, number(fields.get("warc-refers-to"))))
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(folder)
    return files.select("content").mapInArrow(run, HEADERS)


def deduplicate_archives(pages: DataFrame, least_bytes: int = 0) -> tuple[str, DataFrame]:
    """Writes pages as deduplicated archives into the shared folder and reads
    them back: (folder, headers). Each revisit is joined to the response it
    refers to, for the length of the full payload. An empty table makes no
    rows; the archives stay."""
    spark = pages.sparkSession
    folder = write_archives(resolve_revisits(pages, least_bytes), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    records = written(read_archives(spark, folder), "warc-headers")
    responses = records.where("record_type = 'response'")
    originals = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(originals, ["refers_to", "payload_digest"], "left")
    return folder, responses.unionByName(revisits.select(responses.columns))
