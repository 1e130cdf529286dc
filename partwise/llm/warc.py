"""WARC records over a content-addressed archive.

The archive is two tables: ``payloads`` holds the bytes of every distinct payload once, under
their SHA-256, which is checked when they are stored and again when they are read; ``heads``
holds the exact header bytes of every record. Joining them gives the original records, which are
written as WARC files with one record per row: the blank lines that end a WARC record are the
line separator of Spark's text writer. Files are read back by their own length fields.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm.common import written
from partwise.session import scratch_path

#: Fixed values of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION, LINE, END = "WARC/1.1", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Number of keys that may be called hot: a key is hot if it has more than this share of the rows.
HOT_KEYS = 1000
FILE_BYTES = 64 << 20
RECORDS = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("record_key", pa.string()),
                     ("target_uri", pa.string()), ("payload_digest", pa.string()), ("head", pa.binary()), ("payload", pa.binary())])


def base32(hex_col: str) -> Column:
    """Upper-case base32 of a column of 40 hex digits: five hex digits make four characters."""
    return F.expr(f"array_join(transform(sequence(0, 31), i -> substring('{BASE32}', cast(shiftright(cast(conv(substring({hex_col}, (i div 4) * 5 + 1, 5), 16, 10)"
                  f" AS bigint), cast(15 - i % 4 * 5 AS int)) & 31 AS int) + 1, 1)), '')")


def joined(rows: DataFrame, of_key: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``of_key``, which has one row per key and the number ``n`` of its rows.

    Keys of more than a thousandth of all rows, so fewer than a thousand keys, are broadcast; the
    others, none of them hot, are joined by a shuffle. ``n`` is dropped.
    """
    bound = of_key.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HOT_KEYS
    hot, cold = F.broadcast(of_key.filter(F.col("n") > bound).drop("n")), of_key.filter(F.col("n") <= bound).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def _uri(url: Column) -> Column:
    """The URL as a header value: control characters and spaces are percent-encoded, so that it stays on its line."""
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), F.array_join(F.transform(F.split(url, ""), lambda c: F.when(
        c.rlike(r"^[\x00-\x20\x7F]$"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")).otherwise(url)


def _heads(records: DataFrame, date: str) -> Column:
    """The exact bytes before the payload: WARC headers, a blank line, and the HTTP head that opens the block."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(HTTP_HEAD), F.col("bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    return F.concat(
        F.lit(VERSION + LINE), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", _uri(F.col("url"))), _line("X-Record-Key", F.col("key").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}{LINE}")).otherwise(""),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), "first_id", F.lit(">")))),
        F.lit(f"Content-Type: application/http;msgtype=response{LINE}"), _line("Content-Length", length.cast("string")), F.lit(LINE), http)


class Archive:
    """A content-addressed archive in a folder that all executors share.

    ``payloads`` and the heads of the responses are bucketed by digest alike, so they are joined
    without shuffling a payload again; other heads (revisits and small payloads) can have any
    number of rows per digest and lie apart.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.names = spark, folder, {}

    def _bucketed(self, rows: DataFrame, name: str) -> None:
        # As many buckets as shuffle partitions: a task of the aggregation by digest writes its own buckets only.
        self.names[name] = f"archive_{name}_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.folder}/{name}").bucketBy(
            int(self.spark.conf.get("spark.sql.shuffle.partitions")), "sha256").saveAsTable(self.names[name])

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name]) if name in self.names else self.spark.read.parquet(f"{self.folder}/{name}")

    def close(self) -> None:
        """Forget the tables' names; their files stay and can be opened by their folder."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = {}

    @staticmethod
    def store(pages: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> "Archive":
        """One record per row of ``pages``. Of rows with equal payloads of at least ``least_bytes`` bytes the one with the
        smallest id is a response and the others revisit it; rows with smaller payloads are all responses.

        A null payload is the empty one; a null URL or id leaves its header out; rows without an id come
        after those with one; of repeated rows with the smallest id any one is the response. Long
        payloads are kept whole; an empty table gives an empty archive; other columns are ignored.
        """
        payload = F.col(payload_col) if dict(pages.dtypes)[payload_col] == "binary" else F.col(payload_col).cast("string").cast("binary")
        payload = F.coalesce(payload, F.lit("").cast("binary"))
        rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.monotonically_increasing_id().alias("no"),
                            F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("hex"), F.octet_length(payload).cast("long").alias("bytes"))
        rows = written(rows.withColumns({"sha1": base32("hex"), "record_id": F.regexp_replace(
            F.md5(F.concat(F.col("no").cast("string"), F.lit(":"), F.col("sha256"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "urn:uuid:$1-$2-$3-$4-$5")}).drop("hex"), "records")
        first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "no", "record_id"))
        # Equal SHA-256 of unequal payloads would show in their lengths or SHA-1; then nothing is stored.
        same = F.assert_true((F.min("sha1") == F.max("sha1")) & (F.min("bytes") == F.max("bytes")), "one SHA-256 of different payloads")
        groups = rows.groupBy("sha256").agg(first.alias("first"), F.count("*").alias("n"), F.coalesce(same.cast("boolean"), F.lit(True)).alias("same"))
        groups = written(groups, "digests").select("sha256", F.col("first.no").alias("first_no"), F.col("first.record_id").alias("first_id"), "n")
        heads = joined(rows, groups, "sha256")
        heads = heads.withColumn("record_type", F.when((F.col("no") == F.col("first_no")) | (F.col("bytes") < least_bytes), "response").otherwise("revisit"))
        heads = written(heads.select("no", "sha256", "record_type", (F.col("bytes") < least_bytes).alias("small"), _heads(heads, date).alias("head"),
                                     F.when(F.col("record_type") == "response", F.col("bytes")).otherwise(0).alias("bytes")), "all_heads")
        heads = heads.withColumn("size", F.octet_length("head") + F.col("bytes")).drop("bytes")
        archive = Archive(pages.sparkSession, folder)
        archive._bucketed(heads.filter("record_type = 'response' AND NOT small").repartition("sha256"), "heads")
        heads.filter("record_type = 'revisit' OR small").write.parquet(f"{folder}/other_heads")
        payloads = pages.select(F.sha2(payload, 256).alias("sha256"), payload.alias("payload")).groupBy("sha256").agg(F.first("payload").alias("payload"))
        archive._bucketed(payloads, "payloads")
        return archive

    def payloads(self) -> DataFrame:
        """(sha256, payload), one row per distinct payload, each checked against its digest."""
        bad = F.raise_error(F.concat(F.lit("payload does not match its digest "), "sha256"))
        return self.table("payloads").select("sha256", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(bad).alias("payload"))

    def records(self) -> DataFrame:
        """(no, record): the original bytes of every record, up to the blank lines that end it."""
        other = self.table("other_heads")
        whole = self.table("heads").join(self.payloads(), "sha256").select("no", F.concat(F.col("head").cast("binary"), "payload").alias("record"))
        small = other.filter("small")
        if not small.isEmpty():
            # Any number of records has the same small payload; the hot ones are small and few.
            counted = small.groupBy("sha256").agg(F.count("*").alias("n")).join(self.payloads(), "sha256")
            whole = whole.unionByName(joined(small, written(counted, "small"), "sha256").select("no", F.concat(F.col("head").cast("binary"), "payload").alias("record")))
        return whole.unionByName(other.filter("NOT small").select("no", F.col("head").cast("binary").alias("record")))

    def export(self, folder: str) -> None:
        """All records as gzipped WARC files of about 64 MB of records each."""
        sizes = self.table("heads").select("size").unionByName(self.table("other_heads").select("size"))
        mean = sizes.agg(F.avg("size")).first()[0] or 1
        self.records().select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option(
            "maxRecordsPerFile", max(1, int(FILE_BYTES / mean))).text(folder)


def _unpacked(content: bytes) -> io.BufferedReader | io.BytesIO:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def parse(stream) -> Iterator[dict]:
    """The records of one WARC file, by their Content-Length; a broken file raises."""
    while True:
        line = stream.readline()
        while line == b"\r\n":
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC version line where a record should begin")
        head, fields = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            head.append(line)
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("WARC record ends before its Content-Length")
        http, payload = (b"", block)
        if fields.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n") + 4
            http, payload = block[:cut], block[cut:]
        yield {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id", "").strip("<>") or None,
               "refers_to_id": fields.get("warc-refers-to", "").strip("<>") or None, "record_key": fields.get("x-record-key"),
               "target_uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
               "head": b"".join(head) + b"\r\n" + http, "payload": payload}


def read(spark: SparkSession, folder: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the (gzipped) WARC files in ``folder``; a file is read by one task, a few MB of records at a time."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for r in parse(_unpacked(content.as_py())):
                    held.append(r)
                    size += len(r["payload"]) + 1000
                    if size > batch_bytes:
                        yield pa.RecordBatch.from_pylist(held, RECORDS)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, RECORDS)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(records, "record_type string, record_id string, refers_to_id string, record_key string, target_uri string, payload_digest string, head binary, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """(record_key, payload_bytes, payload_digest, record_type, refers_to) of records that were read back.

    A response's digest is computed from its payload and must be the one in its header; a revisit
    takes the length of the response that it names.
    """
    bad = F.raise_error(F.concat(F.lit("payload does not match the digest of record "), "record_id"))
    seen = records.select("record_type", "record_id", "refers_to_id", "record_key", "payload_digest", F.octet_length("payload").cast("long").alias("bytes"),
                          F.when(F.col("record_type") == "response", F.sha1("payload")).alias("hex"))
    right = (F.col("record_type") != "response") | (base32("hex") == F.col("payload_digest"))
    seen = written(seen.withColumn("payload_digest", F.when(right, F.col("payload_digest")).otherwise(bad)).drop("hex"), "read")
    responses = seen.filter("record_type = 'response'").select("record_key", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to"))
    revisits = seen.filter("record_type = 'revisit'").select("record_key", "payload_digest", "record_type", F.col("refers_to_id").alias("record_id"))
    named = seen.filter("record_type = 'response'").select("record_id", F.col("bytes").alias("payload_bytes"), F.col("record_key").alias("refers_to"))
    named = written(revisits.groupBy("record_id").agg(F.count("*").alias("n")).join(named, "record_id"), "revisited")
    return responses.unionByName(joined(revisits, named, "record_id").drop("record_id"))


def round_trip(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """``pages`` archived, written as WARC files and read back: (id, payload_bytes, payload_digest, record_type, refers_to) per row; see ``Archive.store``."""
    spark = pages.sparkSession
    archive = Archive.store(pages, scratch_path(spark, "archive"), id_col, url_col, payload_col, least_bytes)
    files = scratch_path(spark, "warc")
    archive.export(files)
    archive.close()
    kind = dict(pages.dtypes)[id_col]
    return resolved(read(spark, files)).select(F.col("record_key").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
