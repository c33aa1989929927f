"""WARC archives written with Spark's writer, and read by verifying the chain of record boundaries.

A reader task emits, for every place that looks like a record's start, its offset and its successor's, wherever they
are: also inside payloads. Pointer jumping from the start of each file then keeps the records that the chain of
boundaries reaches; what only looks like a record is never reached.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import SALTS, dropped, small_batches, written, written_at

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 1000  # bytes of a payload from which equal ones are stored once
FILE_RECORDS = 500  # records in a file at most: files are read whole, and chains stay short
RECORD_BYTES = 1 << 16  # payloads of twice, four times... as many bytes go to files of half, a quarter... as many records

RECORD = "file long, offset long, next long, size long, page_id long, type string, refers_to long, stated_digest string, payload_bytes long, payload_digest string"


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for null. Line ends in values become percent codes."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages with digest, bytes, and refers_to: the largest id of an equal payload of MIN_REVISIT bytes or more, where that is another's."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    told = pages.withColumns({"__digest": F.sha1(payload.cast("binary")), "__bytes": F.octet_length(payload).cast("long")})
    # a payload that many pages share is dealt over parts, so that no task gets all its rows
    told = told.withColumn("__salt", F.pmod(F.xxhash64(F.lit("salt"), id_col), F.lit(SALTS)).cast("int"))
    parts = told.where(F.col("__bytes") >= MIN_REVISIT).groupBy("__digest", "__salt").agg(F.max(id_col).alias("__l"), F.count(F.lit(1)).alias("__k"))
    whole = Window.partitionBy("__digest")
    last = parts.select("__digest", "__salt", F.max("__l").over(whole).alias("__last"), F.sum("__k").over(whole).alias("__n")).where("__n > 1").drop("__n")
    joined = told.join(last, ["__digest", "__salt"], "left").drop("__salt")
    other = F.col(id_col).isNull() | (F.col("__last") != F.col(id_col))
    return joined.withColumn("__refers", F.when(other, F.col("__last"))).drop("__last")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every row of pages to gzipped WARC files under path.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of MIN_REVISIT bytes or more the one
    with the largest id is a response and the others, also those without an id, are revisits without a payload; rows
    that repeat the largest id are responses too. Payloads need not be free of WARC's own marks. A file holds at most
    FILE_RECORDS records and FILE_RECORDS * RECORD_BYTES bytes of payload, or one record. Other columns are ignored; an
    empty table writes no record.
    """
    marked = revisits(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "id", "html")
    again = F.col("__refers").isNotNull()
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("__digest"))),
        _header("WARC-Profile", F.when(again, REVISIT_PROFILE)),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("__refers").cast("string"), F.lit(">"))),
        _header("Payload-Length", F.col("__bytes")),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("__bytes"))),
        F.lit(CRLF),
    )
    body = F.when(again, F.lit("")).otherwise(F.coalesce(F.col("html"), F.lit("")))
    # the class of a size halves the records of a file; most corpora have class 0 only
    size = F.greatest(F.ceil(F.log2(F.octet_length(F.coalesce("html", F.lit(""))) / RECORD_BYTES)), F.lit(0)).cast("int")
    classes = [r[0] for r in pages.select(F.col(html_col).alias("html")).select(F.coalesce(size, F.lit(0))).distinct().collect()]  # 16 at most
    for k in sorted({0, *classes}):
        # the writer's line separator is the blank lines that end a record
        chosen = marked.where(F.coalesce(size, F.lit(0)) == k).select(F.concat(head, body).alias("value"))
        chosen.write.mode("append").option("lineSep", CRLF * 2).option("maxRecordsPerFile", max(1, FILE_RECORDS >> k)).option("compression", "gzip").text(path)


_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\r\n]*)\r\n")
_PAGE = re.compile(rb"<urn:page:(-?\d+)>")


def _candidates(with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["file"], batch["content"], strict=True):
                rows = []
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                for mark in _MAGIC.finditer(data):
                    at, fields = mark.end(), {}
                    while field := _FIELD.match(data, at):
                        fields[field[1].lower()] = field[2]
                        at = field.end()
                    if data[at : at + 2] != b"\r\n" or not fields.get(b"content-length", b"").isdigit():
                        continue
                    body, size = at + 2, int(fields[b"content-length"])
                    end = body + size + 4
                    if end > len(data) or data[end - 4 : end] != b"\r\n\r\n":
                        continue
                    ids = [int(m[1]) if (m := _PAGE.match(fields.get(k, b""))) else None for k in (b"warc-record-id", b"warc-refers-to")]
                    stated = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace") or None
                    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
                    payload = data[body : end - 4]
                    full = fields.get(b"payload-length", b"")
                    again = kind == "revisit"
                    rows.append((file, mark.start(), end, len(data), ids[0], kind, ids[1], stated, int(full) if again and full.isdigit() else size, stated if again else hashlib.sha1(payload).hexdigest(), payload))
                out = pd.DataFrame(rows, columns=["file", "offset", "next", "size", "page_id", "type", "refers_to", "stated_digest", "payload_bytes", "payload_digest", "payload"])
                out = out.astype({"page_id": "Int64", "refers_to": "Int64"})
                yield out if with_payload else out.drop(columns="payload")

    return run


def reachable(records: DataFrame) -> DataFrame:
    """The (file, offset) that the chain of successors from offset 0 of each file reaches.

    records: file, offset, next. Every round doubles the distance that pointers span and marks what a marked record's
    pointer meets, so a chain of n records takes about log2(n) rounds.
    """
    spark, at = records.sparkSession, None
    state = records.select("file", "offset", "next", (F.col("offset") == 0).alias("met"))
    while True:
        hops = state.select("file", F.col("offset").alias("next"), F.col("next").alias("far"))
        hit = state.where("met").select("file", F.col("next").alias("offset")).withColumn("hit", F.lit(True))
        ahead = state.join(hops, ["file", "next"], "left").join(hit, ["file", "offset"], "left")
        state, now = written_at(ahead.select("file", "offset", F.col("far").alias("next"), (F.col("met") | F.col("hit").isNotNull()).alias("met")), "chain")
        if at:
            dropped(spark, at)
        at = now
        if state.where(F.col("next").isNotNull()).isEmpty():
            # a last pointer may still have met something in this round
            return state.where("met").select("file", "offset")


def _found(spark: SparkSession, path: str, with_payload: bool) -> DataFrame:
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    chunks = files.where("length > 0").select(F.xxhash64("path").alias("file"), "content")
    return written(chunks.mapInPandas(_candidates(with_payload), RECORD + (", payload binary" if with_payload else "")), "records")


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, read_bytes) of each archive under path whose chain of records does not reach its end; file is xxhash64 of its path.

    A file in which nothing looks like a record has null bytes and 0 read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    found = _found(spark, path, False)
    read = found.join(reachable(found), ["file", "offset"], "left_semi").groupBy("file").agg(F.max("next").alias("read_bytes"))
    sizes = files.where("length > 0").select(F.xxhash64("path").alias("file")).join(found.groupBy("file").agg(F.max("size").alias("bytes")), "file", "left")
    return sizes.join(read, "file", "left").select("file", "bytes", F.coalesce("read_bytes", F.lit(0)).alias("read_bytes")).where("bytes IS NULL OR read_bytes < bytes")


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives under path, in RECORD's columns (and payload, if asked for).

    Files may be plain or gzipped; offsets are of the plain bytes. Only records that the chain of boundaries reaches from
    their file's start count. payload_bytes and payload_digest
    are of the payload that is stored, or for a revisit of the full one as its record states them. A file is read
    whole by one task. A record that breaks the chain (cut off, or no valid length) ends what is read of its file;
    broken_files names such files.
    """
    found = _found(spark, path, with_payload)
    return found.join(reachable(found), ["file", "offset"], "left_semi")
