"""Sources, sinks and the streaming form of triage on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partwise.operators import sync as Y
from partwise.session import scratch_path
from partwise.sources import readers as R
from partwise.sources import writers as W
from partwise.sources.adapters import load_standard
from partwise.streaming import changefeed as C


def test_tolerant_csv_in_gbk(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes(" 物料编码 ;物料名称;规格\n1;球阀;DN25;extra\n ; ; \n2;法兰\n".encode("gbk"))
    df = R.read_csv_tolerant(spark, str(path))
    assert df.columns == ["物料编码", "物料名称", "规格"]
    assert [tuple(r) for r in df.orderBy("物料编码").collect()] == [("1", "球阀", "DN25"), ("2", "法兰", "")]


def test_tolerant_csv_in_mixed_encodings(spark, tmp_path):
    """Plain text for more than 64 KiB, then Chinese: each file by all of its bytes."""
    plain = "".join(f"{i},item {i},x\n" for i in range(6000))
    for name, encoding, sep in (("a", "utf-8", ","), ("b", "gbk", ","), ("c", "utf-8-sig", ";")):
        text = "code,name,spec\n" + plain + f"{name},不锈钢球阀,DN25\n"
        (tmp_path / f"{name}.csv").write_bytes(text.replace(",", sep).encode(encoding))
    df = R.read_csv_tolerant(spark, str(tmp_path))
    assert df.count() == 18_003
    assert {(r.code, r.name) for r in df.filter("code IN ('a', 'b', 'c')").collect()} == {(c, "不锈钢球阀") for c in "abc"}
    (tmp_path / "d.csv").write_bytes(b"code,name,spec\n1,\xff\xff\xff,x\n")
    with pytest.raises(ValueError):
        R.read_csv_tolerant(spark, str(tmp_path))


def test_multi_line_json_array(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text('[{"a": 1},\n {"a": 2}]')
    assert {r.a for r in R.read_json_records(spark, str(path), "a int", multi_line=True).collect()} == {1, 2}


def test_jdbc_table_sink_and_ranged_read(spark):
    jdbc = {"url": "jdbc:derby:memory:partwise;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark._jvm.java.lang.Class.forName(jdbc["driver"])
    except Exception:
        pytest.skip("no embedded database on the class path")
    df = spark.range(100).select(F.col("id").alias("K"), (F.col("id") % 3).alias("G"))
    assert W.write_jdbc(df, jdbc["url"], "T1", "replace", {"driver": jdbc["driver"]}) == 100
    assert R.read_table(spark, "T1", {"G": 1}, jdbc).count() == 33
    parts = R.read_partitioned(spark, jdbc, "T1", "K", 0, 100, 4)
    assert parts.count() == 100 and parts.rdd.getNumPartitions() == 4


def test_empty_frame_is_not_written(spark, tmp_path):
    assert W.write_file(spark.range(0), str(tmp_path / "x")) is None


def test_byte_order_mark_leads_the_file(spark, tmp_path):
    path = W.write_file(spark.range(1), str(tmp_path / "bom"))
    assert R.file_head(spark, path).startswith(b"\xef\xbb\xbf")


def test_unreadable_source_raises(spark, tmp_path):
    with pytest.raises(Exception):
        R.read_parquet(spark, str(tmp_path / "none")).count()
    with pytest.raises(ValueError):
        load_standard(spark, "query", "SELECT 1 AS a WHERE false")


def test_stream_equals_batch_rules(spark):
    base = [(1, "a", "ERP", "h1", "2024-01-01 00:00:00"), (2, "b", "ERP", "h1", "2024-01-01 00:00:00"), (3, "", "ERP", "h", "2024-01-01 00:00:00")]
    nxt = [(4, "a", "ERP", "h2", "2024-01-01 00:02:00"), (5, "b", "ERP", "h2", "2024-01-01 01:00:00"), (6, "c", "ERP", "h1", "2024-01-01 01:00:00")]
    schema = "seq bigint, code string, source string, content_hash string, last_modified timestamp"
    src = scratch_path(spark, "feed")
    frame = lambda rows: spark.createDataFrame([(*r[:4],) + (r[4],) for r in rows], "seq bigint, code string, source string, content_hash string, t string").select(
        "seq", "code", "source", "content_hash", F.col("t").cast("timestamp").alias("last_modified"))
    out, cp = (scratch_path(spark, x) for x in ("out", "cp"))
    for rows in (base, nxt):
        frame(rows).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(T._parse_datatype_string(schema)).parquet(src)
        C.write_outcomes(C.stream_triage(stream, 10 * 86_400), out, cp).awaitTermination()
    ok, bad = (C.written_outcomes(spark, out, k) for k in ("accepted", "conflicts"))
    accepted = {(r.seq, r.status, r.version) for r in ok.collect()}
    assert accepted == {(1, "new", 1), (2, "new", 1), (5, "updated", 2), (6, "new", 1)}
    assert {(r.seq, r.status) for r in bad.collect()} == {(4, "conflict")}
    state = C.current_state(ok)
    assert {(r.code, r.version) for r in state.collect()} == {("a", 1), ("b", 2), ("c", 1)}

    ntz = lambda df: df.withColumn("last_modified", F.col("last_modified").cast("timestamp_ntz"))
    old = ntz(frame(base)).filter("code <> ''").withColumn("version", F.lit(1))
    batch = ntz(frame(nxt)).withColumn("payload", F.lit(""))
    assert {(r.seq, r.status, r.version) for r in Y.triage(old, batch).collect()} == {(4, "conflict", 1), (5, "updated", 2), (6, "new", 1)}


def test_late_rows_have_their_own_table(spark):
    """A row a day behind its key's newest row changes nothing, one within the delay is judged like any other, and a key is forgotten after a year."""
    src, out, cp = (scratch_path(spark, x) for x in ("late_feed", "late_out", "late_cp"))
    schema = "seq bigint, code string, source string, content_hash string, last_modified timestamp"
    for rows in ([(1, "a", "ERP", "h1", "2024-01-10 00:00:00")], [(2, "a", "ERP", "h2", "2024-01-08 00:00:00"), (3, "a", "ERP", "h3", "2024-01-09 12:00:00"), (4, None, "ERP", "h", "2024-01-09 12:00:00")],
                 [(5, "b", "ERP", "h1", "2025-06-01 00:00:00")], [(6, "a", "ERP", "h3", "2025-06-02 00:00:00"), (7, "b", "ERP", "h1", "2023-01-01 00:00:00")]):
        spark.createDataFrame(rows, "seq bigint, code string, source string, content_hash string, t string").select(
            "seq", "code", "source", "content_hash", F.col("t").cast("timestamp").alias("last_modified")).coalesce(1).write.mode("append").parquet(src)
        C.write_outcomes(C.stream_triage(spark.readStream.schema(T._parse_datatype_string(schema)).parquet(src)), out, cp).awaitTermination()
    assert {(r.seq, r.status, r.kind, r.version) for r in C.written_outcomes(spark, out).collect()} == {(1, "new", "accepted", 1), (2, "late", "late", 1), (3, "updated", "accepted", 2),
        (5, "new", "accepted", 1), (6, "new", "accepted", 1), (7, "late", "late", 1)}


def test_runs_of_equal_rows_decide_like_single_rows():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 12))
        hashes, micros = rng.choice(np.array(["x", "y", "z"], object), n), np.sort(rng.integers(0, 2_000, n)) * 1_000_000
        held = None if rng.random() < 0.3 else ("y", int(rng.integers(0, 1_500)) * 1_000_000, 4, 1_200 * 1_000_000)
        status, version, state = C.outcomes(held, hashes, micros, 600 * 1_000_000)
        want, now = [], held
        for h, m in zip(hashes, micros):
            if held and m < held[3] - 600 * 1_000_000:
                want.append(("late", held[2]))
                continue
            if now is None:
                now, s = (h, m, 1), "new"
            elif now[0] == h:
                s = "unchanged"
            elif abs(m - now[1]) <= 300 * 1_000_000:
                s = "conflict"
            else:
                now, s = (h, m, now[2] + 1), "updated"
            want.append((s, now[2]))
        assert list(zip(status, version.tolist())) == want and tuple(state[:3]) == tuple(now[:3])


def test_commits_rewrite_touched_buckets_only(spark, tmp_path):
    rows = lambda pairs: spark.createDataFrame(pairs, "k long, v string, at int")
    t = W.KeyedTable(spark, str(tmp_path), ["k"], 8)
    t.create(rows([(i, "old", 0) for i in range(40)] + [(None, "none", 0)]))
    files = lambda: {p.relative_to(tmp_path) for p in (tmp_path / "rows").rglob("*.parquet")}
    before = files()
    assert t.commit("b1", rows([(3, "new", 1), (3, "newer", 2), (99, "added", 1)]), [F.col("at")]) in (1, 2)
    kept = before & files()
    assert len(before) - len(kept) <= 2 and len(kept) >= 6
    assert t.commit("b1", rows([(3, "again", 9)]), [F.col("at")]) == 0
    assert t.commit("b2", rows([]), [F.col("at")]) == 0
    got = {r.k: r.v for r in t.read().collect()}
    assert got == {**{i: "old" for i in range(40)}, 3: "newer", 99: "added", None: "none"}
