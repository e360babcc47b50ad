"""Content-addressed WARC archive: payload bytes once per digest, record headers apart, records back by joins.

Archives are written and read by Spark's text format, compressed, with the
record end as the line separator: a file holds whole records, so a reader task
passes over it once and keeps one record at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.llm.base import prepare

# Fixed values of the format.
RECORD_END = "\r\n\r\n"
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)


def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), key.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null. Line ends in a value are escaped."""
    value = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))


def write_archive(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 1000,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record per row into ``folder``, gzip-compressed.

    Of rows with equal payloads of at least ``least_bytes``, the one with the
    largest key (then url) is a response; the others are revisits of it and hold
    no payload. Smaller payloads are all responses. A null payload is empty. Rows
    that equal the chosen one in key, url and payload are responses too. A null key
    comes before all others and has no record id.
    """
    prepare(pages.sparkSession)
    content = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"), content.alias("payload")
    ).withColumns({"size": F.length("payload"), "digest": F.sha2("payload", 256)})
    # One row per payload that occurs more than once; its partial counts are what is shuffled.
    kept = (
        rows.where(F.col("size") >= least_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("key", F.coalesce("url", F.lit("")).alias("url"))).alias("top"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(F.col("digest").alias("of"), "top")
    )
    same = F.col("key").eqNullSafe(F.col("top.key")) & (F.coalesce("url", F.lit("")) == F.col("top.url"))
    again = F.col("top").isNotNull() & ~same
    header = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("key"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(again, F.lit(SAME_PAYLOAD))),
        _line("WARC-Refers-To", F.when(again, _record_id(F.col("top.key")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("size")).cast("string")),
    )
    block = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    rows.join(kept, F.col("digest") == F.col("of"), "left").select(
        F.concat(header, F.lit(RECORD_END), block).alias("value")
    ).write.option("lineSep", RECORD_END).option("compression", "gzip").text(folder)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in ``folder``: ``header`` (exact bytes) and ``block``.

    Blocks are cut by their stated length, so they may hold the record end
    themselves, or end in part of it. A file that breaks off or holds other bytes raises an error.
    """
    prepare(spark)
    end = RECORD_END.encode()

    def begun(piece: bytes) -> tuple[bytes, int, list[bytes], int]:
        found = LENGTH.search(piece)
        if not piece.startswith(VERSION.encode()) or not found:
            raise ValueError(f"no record begins with {piece[:40]!r}")
        return piece, int(found[1]), [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, size, parts, have = None, 0, [], 0
        for batch in batches:
            headers, blocks = [], []
            for value in batch.column(0):
                piece = value.as_py()
                if header is None:
                    header, size, parts, have = begun(piece)
                    continue
                parts.append(piece)
                have += len(piece) + (len(end) if len(parts) > 1 else 0)
                if have > size and len(parts) > 1 and have - len(piece) == size + 2 and piece.startswith(b"\r\n"):
                    # A block that ends in a line end of its own: the split fell two bytes early.
                    headers.append(header)
                    blocks.append(end.join(parts[:-1]) + b"\r\n")
                    header, piece = None, piece[2:]
                    if piece:  # else the file ends here
                        header, size, parts, have = begun(piece)
                    continue
                if have > size:
                    raise ValueError(f"a record is longer than stated: {header[:200]!r}")
                if have == size:
                    headers.append(header)
                    blocks.append(end.join(parts))
                    header = None
            yield pa.RecordBatch.from_arrays([pa.array(headers, pa.binary()), pa.array(blocks, pa.binary())], names=["header", "block"])
        if header is not None:
            raise ValueError(f"the archive breaks off in {header[:200]!r}")

    pieces = spark.read.option("lineSep", RECORD_END).text(folder).select(F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(run, "header binary, block binary")


def field(name: str, header: str = "header") -> Column:
    """A field of a record header; null where it has none."""
    value = F.regexp_extract(F.col(header).cast("string"), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def headers_of(records: DataFrame) -> DataFrame:
    """Exact headers with the digest that names their payload."""
    return records.select(
        "header", F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("digest"), field("WARC-Type").alias("record_type")
    )


def payloads_of(records: DataFrame) -> DataFrame:
    """Payload bytes, once per digest, with length and SHA-1; a payload whose digest is not the stated one raises an error."""
    stated = F.substring_index(field("WARC-Payload-Digest"), ":", -1)
    true = F.sha2("block", 256)
    return (
        records.where(field("WARC-Type") == "response")
        .select(
            F.when(stated == true, true).otherwise(F.raise_error(F.concat(F.lit("payload is not "), stated))).alias("digest"),
            "block",
            F.length("block").cast("long").alias("payload_bytes"),
            F.sha1("block").alias("sha1"),
        )
        .groupBy("digest")
        .agg(*[F.any_value(c).alias(c) for c in ("block", "payload_bytes", "sha1")])
        .withColumnRenamed("block", "payload")
    )


def restore(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every record with its payload again, revisits with that of the response they refer to."""
    return headers.join(payloads, "digest", "left")
