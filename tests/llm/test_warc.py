import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from partwise.llm import warc as W
from partwise.llm.queries import REGISTRY
from tests.llm.cases import awkward, documents, empty

TRICKY = "a\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\nß中 \x00 end\r\n\r\n"
PAGES = [(5, "http://a/", "copy"), (3, "http://b/\r\nX: 1", "copy"), (9, "http://c/", "copy"), (4, None, None), (2, "http://e/", ""), (7, "http://f/ü ", TRICKY),
         (8, "http://f/", TRICKY), (None, "http://g/", "copy"), (None, "http://h/", "alone"), (6, "http://i/", "same row"), (6, "http://i/", "same row"), (1, "x", "long " * 200_000)]
SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[2] or "", []).append(r[0])
    for body, ids in groups.items():
        b = body.encode()
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            first = k == 0 or len(b) < least
            out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else ids[0]))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 1, 5])
def test_round_trip_against_brute_force(spark, least):
    df = spark.createDataFrame(PAGES, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "no", "n", "sha256", "payload", "bytes", "record_type")})
    assert got(W.round_trip(df, "page_id", "url", "html", least)) == brute(PAGES, least)


def test_records_payloads_and_files(spark, tmp_path):
    """Every distinct payload is stored once, the records of the archive are those of the files, and a plain parser reads them."""
    df = spark.createDataFrame(PAGES, SCHEMA)
    archive = W.Archive.store(df, str(tmp_path / "archive"), "page_id", "url", "html")
    assert sorted(bytes(r.payload).decode() for r in archive.payloads().collect()) == sorted({p[2] or "" for p in PAGES})
    archive.export(str(tmp_path / "files"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "files").glob("part-*")))
    records = [bytes(r.record) for r in archive.records().collect()]
    assert len(data) == sum(map(len, records)) + 4 * len(records) and all(r + b"\r\n\r\n" in data for r in records)
    parsed = list(W.parse(io.BytesIO(data)))
    assert sorted(p["head"] + p["payload"] for p in parsed) == sorted(records)
    by_id = {p["record_id"]: p for p in parsed}
    assert len(by_id) == len(PAGES)
    for p in parsed:
        of = p if p["record_type"] == "response" else by_id[p["refers_to_id"]]
        assert base64.b32encode(hashlib.sha1(of["payload"]).digest()).decode() == p["payload_digest"]
    assert {p["target_uri"] for p in parsed} >= {None, "http://b/%0D%0AX:%201", "http://f/ü%20"}


def test_damaged_payloads_and_files_raise(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:2], SCHEMA)
    archive = W.Archive.store(df, str(tmp_path / "a"), "page_id", "url", "html")
    archive.close()
    spark.createDataFrame([(r.sha256, bytearray(b"cop1")) for r in archive.payloads().collect()], "sha256 string, payload binary").write.mode("overwrite").parquet(archive.folder + "/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        archive.records().collect()
    with pytest.raises(ValueError, match="ends before"):
        list(W.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    with pytest.raises(ValueError, match="version line"):
        list(W.parse(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n")))


def test_hot_keys_join_like_the_others(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    of_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    assert sorted(W.joined(rows, of_key, "k").select("k", "id", "least").collect()) == sorted(rows.join(of_key, "k").select("k", "id", "least").collect())


def test_pages_and_awkward_rows(spark, tmp_path):
    pages = documents(spark, "pages")
    assert got(REGISTRY["op12_warc_round_trip"].run(spark, "/root/testdata/sf0.001")) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])
    df = awkward(spark)
    assert got(W.round_trip(df, "doc_id", "source", "text")) == brute([(r.doc_id, None, r.text) for r in df.collect()])
    assert got(W.round_trip(empty(spark), "doc_id", "source", "text")) == []
