"""Content-addressed WARC archive.

`archive` keeps each payload once in a payload table under its SHA-256, and the exact header of every
record in a header table; `records` rebuilds records by joining the two on the digest, and checks the
payload against it. `write_warc` lays records out as real WARC/1.1 files through Spark's text writer
(a record's text ends in the separator CRLF CRLF), so they can go to any store Spark writes to;
`read_warc` reads such files by Content-Length. Each record has an id of its own, made of a row number and the page
id. Among equal payloads the record with the largest page id holds the payload, the others revisit it by its record
id; the choice is a partial aggregate, so a payload that a third of all pages share leaves each task once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, stored

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes that one WARC file holds before compression, about.
FILE_BYTES = 32 << 20


def base32(hex_digits: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string: five hex digits are four base32 digits."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.conv(F.substring(hex_digits, i * 5 + 1, 5), 16, 32), 4, "0"))
    return F.translate(F.lower(F.array_join(groups, "")), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(row: Column, page_id: Column) -> Column:
    """An id of the form urn:uuid: its last 16 digits are those of the page id, those before tell the row, and the 14th
    whether the page id is null. row is at least 0 and below 2^59."""
    own = F.concat(F.lpad(F.hex(F.shiftrightunsigned(row, 8)), 12, "0"), F.lit("8"), F.when(page_id.isNull(), "1").otherwise("0"), F.lpad(F.hex(row.bitwiseAND(F.lit(255).cast("long"))), 2, "0"))
    digits = F.lower(F.concat(own, F.lpad(F.hex(F.coalesce(page_id, F.lit(0).cast("long"))), 16, "0")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; null without a value."""
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def header(own_id: Column, url: Column, digest: Column, n: Column, refers_to: Column) -> Column:
    """The exact header of a record, its closing empty line included; refers_to, a record id, is null for a response."""
    revisit = refers_to.isNotNull()
    target = F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")
    lines = [
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", own_id), _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", target), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", refers_to), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(n).cast("string")), F.lit(CRLF),
    ]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in lines])


@dataclass
class Archive:
    headers: DataFrame  # page_id, digest (SHA-256), holds (is a response), header
    payloads: DataFrame  # digest, payload


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> Archive:
    """A null payload is empty. Records of payloads of fewer than least_bytes are all responses.

    A null page id stays null and is smaller than any other. Of repeated rows of the holding page one is the response and the others
    revisit it. Other columns are ignored; an empty table gives empty tables.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    payloads = stored(rows.groupBy("digest").agg(F.max("payload").alias("payload")), "warc-payloads")
    n = F.octet_length("payload").cast("long")
    # The row number has to be below 2^59: 2^26 partitions of 2^33 rows.
    slim = stored(rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "digest", base32(F.sha1(F.col("payload"))).alias("sha1"), n.alias("n")), "warc-rows")
    holders = slim.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("holder"))
    both = slim.join(holders, "digest").withColumn("holds", (F.col("row") == F.col("holder.row")) | (F.col("n") < least_bytes))
    refers = F.when(~F.col("holds"), record_id(F.col("holder.row"), F.col("holder.page_id")))
    headers = both.select("page_id", "digest", "holds", header(record_id(F.col("row"), F.col("page_id")), F.col("url"), F.col("sha1"), F.col("n"), refers).alias("header"))
    return Archive(stored(headers, "warc-headers"), payloads)


def records(kept: Archive) -> DataFrame:
    """(page_id, header, payload): the original records, revisits with the payload they refer to; a payload
    that doesn't have its digest stops the job."""
    checked = kept.payloads.select("digest", F.when(F.col("digest") == F.sha2("payload", 256), F.col("payload")).otherwise(F.raise_error(F.lit("payload and digest differ"))).alias("payload"))
    return kept.headers.join(checked, "digest").select("page_id", "header", "payload")


def write_warc(kept: Archive, path: str) -> None:
    """Writes the archive as gzipped WARC files: responses with their payload, revisits without."""
    responses = kept.headers.where("holds").join(kept.payloads.select("digest", "payload"), "digest").select(F.concat("header", "payload").alias("value"))
    size = kept.payloads.agg(F.count(F.lit(1)), F.sum(F.octet_length("payload"))).first()
    rows = max(1, int(FILE_BYTES / max(1, (size[1] or 0) / max(1, size[0]))))
    revisits = kept.headers.where("NOT holds").select(F.col("header").alias("value"))
    options = {"lineSep": CRLF * 2, "compression": "gzip"}
    responses.write.options(**options).option("maxRecordsPerFile", rows).text(f"{path}/responses")
    revisits.write.options(**options).option("maxRecordsPerFile", 100_000).text(f"{path}/revisits")


_LENGTH = re.compile(rb"^Content-Length: (\d+)\r$", re.M)


def parsed(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header, payload) of each record of an uncompressed WARC stream; at most one record is held."""
    held, more = b"", True
    while True:
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            head = held[: end + 4]
            n = int(_LENGTH.search(head)[1])
        while more and (end < 0 or len(held) < end + 8 + n):
            if (chunk := next(chunks, None)) is None:
                more = False
            else:
                held += chunk
            if end < 0:
                break
        if end < 0:
            if more:
                continue
            if held.strip():
                raise ValueError("a record is cut short")
            return
        if held[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield head, held[end + 4 : end + 4 + n]
        held = held[end + 8 + n :]


def _inflated(data: bytes, step: int = 4 << 20) -> Iterator[bytes]:
    while data:
        unzip = zlib.decompressobj(31)
        yield unzip.decompress(data, step)
        while not unzip.eof:
            if not (chunk := unzip.decompress(unzip.unconsumed_tail, step)) and not unzip.unconsumed_tail:
                raise ValueError("a file is cut short")
            yield chunk
        data = unzip.unused_data


def _field(head: bytes, name: str) -> str | None:
    hit = re.search(rf"^{name}: (.*)\r$".encode(), head, re.M)
    return hit[1].decode() if hit else None


def _page(record: str | None) -> int | None:
    """The page id in a record id; null where it says so."""
    digits = (record or "").strip("<>").replace("-", "")
    if not digits or digits[-19] == "1":
        return None
    n = int(digits[-16:], 16)
    return n - (1 << 64) if n >> 63 else n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_id, record_type, uri, declared, refers_to, refers_id, payload_bytes, payload_digest): a row per record;
    payload_bytes and payload_digest are those of the bytes in the file, declared is the header's digest, refers_id
    the record id that a revisit names and refers_to the page id in it."""
    names = ["page_id", "record_id", "record_type", "uri", "declared", "refers_to", "refers_id", "payload_bytes", "payload_digest"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, payload in parsed(_inflated(content.as_py())):
                    declared = (_field(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    own, refers = _field(head, "WARC-Record-ID"), _field(head, "WARC-Refers-To")
                    rows.append((_page(own), own, _field(head, "WARC-Type"), _field(head, "WARC-Target-URI"), declared, _page(refers), refers, len(payload), digest))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), types)], names)

    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "page_id long, record_id string, record_type string, uri string, declared string, refers_to long, refers_id string, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives pages, writes WARC files, reads them back: (page_id, payload_bytes, payload_digest, record_type,
    refers_to). What a revisit's payload is comes from the response it refers to; a digest that differs from
    the declared one stops the job. A revisit's refers_to is null where the response's page id is."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(archive(pages), path)
    read = stored(read_warc(spark, path), "warc-read")
    responses = read.where("record_type = 'response'")
    held = responses.select(F.col("record_id").alias("refers_id"), F.col("payload_bytes").alias("held_bytes"), F.col("payload_digest").alias("held_digest"))
    revisits = read.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(held, "refers_id", "left")
    whole = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "declared").unionAll(
        revisits.select("page_id", "held_bytes", "held_digest", "record_type", "refers_to", "declared")
    )
    digest = F.when(F.col("payload_digest") == F.col("declared"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload and declared digest differ")))
    return whole.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
