from __future__ import annotations

from pyspark.sql import functions as F

from partwise.operators import sync as Y
from partwise.plans.registry import query
from partwise.session import scratch_path, table
from partwise.streaming import changefeed as C

CODE = "CASE WHEN value < 0.5 THEN '' ELSE user_id || '-' || CAST(floor(value) AS BIGINT) END"
CUT = "2024-01-15 00:00:00"
DAY2 = "2024-01-22 00:00:00"
PRIOR = f"""prior AS (SELECT event_id AS seq, {CODE} AS code, event_type AS source, md5(props) AS content_hash, ts AS last_modified, 1 AS version FROM events
 WHERE ts < TIMESTAMP '{CUT}' AND value >= 0.5 QUALIFY row_number() OVER (PARTITION BY code, source ORDER BY ts DESC, event_id DESC) = 1)"""
BATCH = f"""batch AS (SELECT event_id AS seq, {CODE} AS code, event_type AS source,
 CASE WHEN ts >= TIMESTAMP '{CUT}' OR user_id % 4 = 0 THEN props ELSE 'changed' END AS payload,
 CASE WHEN ts >= TIMESTAMP '{CUT}' THEN ts ELSE ts + to_seconds(CAST(floor(value * 20) AS BIGINT)) END AS last_modified FROM events),
hashed AS (SELECT *, md5(payload) AS content_hash FROM batch)"""
TRIAGE = f"""{PRIOR}, {BATCH}, lastb AS (SELECT *, count(*) OVER (PARTITION BY source, code) - 1 AS repeats FROM hashed WHERE code <> ''
 QUALIFY row_number() OVER (PARTITION BY source, code ORDER BY last_modified DESC, seq DESC) = 1),
tri AS (SELECT b.*, p.content_hash AS old_hash, p.last_modified AS old_modified, CASE WHEN p.code IS NULL THEN 'new' WHEN p.content_hash = b.content_hash THEN 'unchanged'
  WHEN abs(epoch_us(b.last_modified) - epoch_us(p.last_modified)) <= 300000000 THEN 'conflict' ELSE 'updated' END AS status FROM lastb b LEFT JOIN prior p USING (source, code)
 UNION ALL SELECT *, 0, NULL, NULL, 'error' FROM hashed WHERE code = '')"""


def events(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.expr(CODE).alias("code"), F.col("event_type").alias("source"), F.col("props").alias("payload"),
        F.md5("props").alias("content_hash"), F.col("ts").alias("last_modified"), "value", "user_id")


def prior(spark, d):
    old = events(spark, d).filter(F.expr(f"last_modified < timestamp_ntz'{CUT}' AND code <> ''"))
    return Y._latest(old).select("seq", "code", "source", "content_hash", "last_modified", F.lit(1).alias("version"))


def batch(spark, d):
    e = events(spark, d)
    late = F.expr(f"last_modified >= timestamp_ntz'{CUT}'")
    moved = F.when(late, F.col("last_modified")).otherwise(F.expr("timestampadd(SECOND, CAST(floor(value * 20) AS INT), last_modified)"))
    out = e.withColumn("payload", F.when(late | (F.col("user_id") % 4 == 0), F.col("payload")).otherwise("changed"))
    return out.withColumn("last_modified", moved).withColumn("content_hash", F.md5("payload")).drop("value", "user_id")


def triaged(spark, d):
    return Y.triage(prior(spark, d), batch(spark, d))


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def sql_stamp(e, name):
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S') AS {name}"


@query("y01_high_water_scan", f"""
WITH cp AS (SELECT event_type AS source, max(ts) AS hw FROM events WHERE ts < TIMESTAMP '{CUT}' AND event_type <> 'error' GROUP BY 1)
SELECT event_id AS seq, event_type AS source FROM events LEFT JOIN cp ON source = event_type WHERE hw IS NULL OR ts > hw""")
def y01(spark, d):
    e = events(spark, d)
    cp = e.filter(F.expr(f"last_modified < timestamp_ntz'{CUT}' AND source <> 'error'")).groupBy("source").agg(F.max("last_modified").alias("high_water"))
    return Y.changed_since(e, cp).select("seq", "source")


@query("y02_checkpoints", f"SELECT event_type AS source, {sql_stamp('max(ts)', 'high_water')} FROM events WHERE event_type <> 'error' OR ts < TIMESTAMP '{CUT}' GROUP BY 1")
def y02(spark, d):
    e = events(spark, d)
    before = e.filter(F.expr(f"last_modified < timestamp_ntz'{CUT}'")).groupBy("source").agg(F.max("last_modified").alias("high_water"))
    return Y.advance_checkpoints(before, e.filter("source <> 'error'")).select("source", stamp("high_water"))


LOG = f"""{PRIOR}, snap AS (SELECT event_id AS seq, {CODE} AS code, event_type AS source, md5(props) AS content_hash, ts AS last_modified FROM events
 WHERE ts >= TIMESTAMP '{CUT}' AND value >= 0.5 QUALIFY row_number() OVER (PARTITION BY code, source ORDER BY ts DESC, event_id DESC) = 1)"""


def snapshot(spark, d):
    return Y._latest(events(spark, d).filter(F.expr(f"last_modified >= timestamp_ntz'{CUT}' AND code <> ''")))


@query("y03_hash_verification", f"WITH {LOG} SELECT s.seq, s.code, s.source FROM snap s LEFT JOIN prior p USING (code, source) WHERE s.content_hash IS DISTINCT FROM p.content_hash")
def y03(spark, d):
    return Y.real_changes(snapshot(spark, d), prior(spark, d)).select("seq", "code", "source")


@query("y04_change_type", f"WITH {LOG} SELECT s.code, s.source, CASE WHEN p.code IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS change_type FROM snap s LEFT JOIN prior p USING (code, source) WHERE s.content_hash IS DISTINCT FROM p.content_hash")
def y04(spark, d):
    return Y.real_changes(snapshot(spark, d), prior(spark, d)).select("code", "source", "change_type")


@query("y05_deletions", f"WITH {LOG} SELECT p.code, p.source, p.content_hash, 'DELETE' AS change_type FROM prior p ANTI JOIN snap USING (code, source)")
def y05(spark, d):
    return Y.deletions(prior(spark, d), snapshot(spark, d)).select("code", "source", "content_hash", "change_type")


@query("y06_change_statistics", f"""
WITH {LOG}, c AS (SELECT s.source, CASE WHEN p.code IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS change_type, CASE WHEN p.code IS NULL THEN 0.0 ELSE 0.5 END AS cs
 FROM snap s LEFT JOIN prior p USING (code, source) WHERE s.content_hash IS DISTINCT FROM p.content_hash
 UNION ALL SELECT source, 'DELETE', 1.0 FROM (SELECT p.source FROM prior p ANTI JOIN snap USING (code, source)))
SELECT source, change_type, count(*) AS n, avg(cs)::DOUBLE AS avg_conflict_score FROM c GROUP BY 1, 2""")
def y06(spark, d):
    changes = Y.real_changes(snapshot(spark, d), prior(spark, d)).withColumn(
        "conflict_score", F.when(F.col("change_type") == "INSERT", 0.0).otherwise(0.5)).select("source", "change_type", "conflict_score")
    gone = Y.deletions(prior(spark, d), snapshot(spark, d)).select("source", "change_type", F.lit(1.0).alias("conflict_score"))
    return Y.change_statistics(changes.unionByName(gone))


@query("y07_batch_triage", f"""WITH {TRIAGE} SELECT seq, code, source, status, repeats, CAST(CASE status WHEN 'new' THEN 1 WHEN 'updated' THEN 2 WHEN 'error' THEN NULL ELSE 1 END AS INTEGER) AS version FROM tri""")
def y07(spark, d):
    return triaged(spark, d).select("seq", "code", "source", "status", "repeats", "version")


@query("y08_temporal_conflicts", f"WITH {TRIAGE} SELECT code, source, epoch_us(last_modified) - epoch_us(old_modified) AS micros FROM tri WHERE status = 'conflict'")
def y08(spark, d):
    t = triaged(spark, d).filter("status = 'conflict'")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return t.select("code", "source", (us("last_modified") - us("old_modified")).alias("micros"))


def conflicts(spark, d, strategy="latest_wins"):
    return Y.conflict_records(triaged(spark, d), prior(spark, d), strategy)


@query("y09_conflict_records", f"""WITH {TRIAGE} SELECT code, source, source || ',' || source AS sources,
 '{{"content_hash":"' || old_hash || '","last_modified":"' || strftime(old_modified, '%Y-%m-%d %H:%M:%S') || '","version":1}}' AS local_record,
 '{{"content_hash":"' || content_hash || '","last_modified":"' || strftime(last_modified, '%Y-%m-%d %H:%M:%S') || '","payload":"' || replace(payload, '"', '\\"') || '"}}' AS remote_record,
 false AS resolved FROM tri WHERE status = 'conflict'""")
def y09(spark, d):
    return conflicts(spark, d).select("code", "source", F.array_join("conflicting_sources", ",").alias("sources"), "local_record", "remote_record", "resolved")


CAND = f"""{TRIAGE}, cand AS (SELECT code, CASE source WHEN 'click' THEN 'ERP' WHEN 'view' THEN 'PLM' WHEN 'error' THEN 'WMS' ELSE source END AS source, is_local, lm, seq FROM (
 SELECT code, source, true AS is_local, last_modified AS lm, seq FROM prior UNION ALL SELECT code, source, false, last_modified, seq FROM lastb)),
conf AS (SELECT DISTINCT code FROM tri WHERE status = 'conflict')"""
PRI = "CASE source WHEN 'ERP' THEN 1 WHEN 'PLM' THEN 2 WHEN 'WMS' THEN 5 ELSE 99 END"


def candidates(spark, d):
    """Local and incoming rows of every source, sources named so that priorities apply."""
    last = triaged(spark, d).filter("status <> 'error'")
    both = prior(spark, d).select("code", "source", F.lit(True).alias("is_local"), "last_modified", "seq").unionByName(
        last.select("code", "source", F.lit(False).alias("is_local"), "last_modified", "seq"))
    return both.withColumn("source", F.expr("CASE source WHEN 'click' THEN 'ERP' WHEN 'view' THEN 'PLM' WHEN 'error' THEN 'WMS' ELSE source END"))


def in_conflict(spark, d):
    return candidates(spark, d).join(triaged(spark, d).filter("status = 'conflict'").select("code").distinct(), "code", "left_semi")


@query("y10_resolve_latest", f"WITH {CAND} SELECT code, source, is_local, seq FROM cand WHERE code IN (FROM conf) QUALIFY row_number() OVER (PARTITION BY code ORDER BY lm DESC, is_local DESC, seq DESC) = 1")
def y10(spark, d):
    return Y.resolve(in_conflict(spark, d), "latest_wins").select("code", "source", "is_local", "seq")


@query("y11_resolve_priority", f"WITH {CAND} SELECT code, source, is_local, seq FROM cand WHERE code IN (FROM conf) QUALIFY row_number() OVER (PARTITION BY code ORDER BY {PRI}, lm DESC, is_local DESC, seq DESC) = 1")
def y11(spark, d):
    return Y.resolve(in_conflict(spark, d), "source_priority").select("code", "source", "is_local", "seq")


@query("y12_apply_winners", f"""WITH {CAND}, win AS (SELECT code, source, lm, seq FROM cand WHERE code IN (FROM conf) QUALIFY row_number() OVER (PARTITION BY code ORDER BY lm DESC, is_local DESC, seq DESC) = 1),
mas AS (SELECT code, 'master' AS source, max(last_modified) AS lm, max(seq) AS seq FROM prior GROUP BY 1)
SELECT code, source, {sql_stamp('lm', 'last_modified')}, seq FROM win UNION ALL SELECT code, source, {sql_stamp('lm', 'last_modified')}, seq FROM mas WHERE code NOT IN (SELECT code FROM win)""")
def y12(spark, d):
    master = prior(spark, d).groupBy("code").agg(F.max("last_modified").alias("last_modified"), F.max("seq").alias("seq")).select(
        "code", F.lit("master").alias("source"), "last_modified", "seq")
    applied, _ = Y.auto_resolve(conflicts(spark, d), candidates(spark, d), master)
    return applied.select("code", "source", stamp("last_modified"), "seq")


HIST = f"""{TRIAGE}, hist AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'updated') AS updated,
 count(*) FILTER (WHERE status = 'conflict') AS conflict, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'error') AS error,
 CAST(sum(repeats) AS BIGINT) AS repeats, CASE WHEN count(*) FILTER (WHERE status = 'error') > 0 THEN 'partial' ELSE 'success' END AS outcome, max(last_modified) AS done FROM tri GROUP BY 1)"""


@query("y13_sync_history", f"WITH {HIST} SELECT source, total, new, updated, conflict, unchanged, error, repeats, outcome AS status FROM hist")
def y13(spark, d):
    return Y.sync_history(triaged(spark, d)).drop("completed_at")


@query("y14_status_report", f"WITH {TRIAGE} SELECT source, count(*) AS total_records, {sql_stamp('max(last_modified)', 'last_sync')}, count(*) FILTER (WHERE status IN ('new', 'updated')) AS success_count, count(*) FILTER (WHERE status = 'error') AS failed_count FROM tri GROUP BY 1")
def y14(spark, d):
    return Y.status_report(triaged(spark, d)).withColumn("last_sync", stamp("last_sync"))


@query("y15_open_conflicts", f"WITH {TRIAGE} SELECT code, source, old_hash AS local_hash, payload AS remote_payload FROM tri WHERE status = 'conflict' ORDER BY last_modified DESC, source, code LIMIT 10")
def y15(spark, d):
    return Y.open_conflicts(conflicts(spark, d, "manual"), 10).select("code", "source", F.col("local.content_hash").alias("local_hash"), F.col("remote.payload").alias("remote_payload"))


@query("y16_history_filter", f"WITH {HIST} SELECT source, total FROM hist WHERE outcome = 'partial' ORDER BY done DESC, source LIMIT 2")
def y16(spark, d):
    return Y.history(Y.sync_history(triaged(spark, d)), status="partial", limit=2).select("source", "total")


@query("y17_multi_source_sync", f"""WITH {HIST} SELECT source, total, new, CAST(sum(total) OVER w AS BIGINT) AS running_total, CAST(sum(new) OVER w AS BIGINT) AS running_new,
 CAST(sum(updated) OVER w AS BIGINT) AS running_updated, CAST(sum(conflict) OVER w AS BIGINT) AS running_conflict FROM hist WINDOW w AS (ORDER BY source)""")
def y17(spark, d):
    out = Y.sync_sources(prior(spark, d), batch(spark, d))
    return out.select("source", "total", "new", "running_total", "running_new", "running_updated", "running_conflict")


FOLD = """list_reduce(list_sort(list({'m': micros, 's': seq, 'h': content_hash})), lambda a, x: CASE
  WHEN a.h IS NULL THEN {'h': x.h, 'm': x.m, 'v': 1, 'o': list_append(a.o, {'seq': x.s, 'status': 'new', 'version': 1})}
  WHEN a.h = x.h THEN {'h': a.h, 'm': a.m, 'v': a.v, 'o': list_append(a.o, {'seq': x.s, 'status': 'unchanged', 'version': a.v})}
  WHEN abs(x.m - a.m) <= 300000000 THEN {'h': a.h, 'm': a.m, 'v': a.v, 'o': list_append(a.o, {'seq': x.s, 'status': 'conflict', 'version': a.v})}
  ELSE {'h': x.h, 'm': x.m, 'v': a.v + 1, 'o': list_append(a.o, {'seq': x.s, 'status': 'updated', 'version': a.v + 1})} END,
  {'h': NULL::VARCHAR, 'm': 0::BIGINT, 'v': 0, 'o': []::STRUCT(seq BIGINT, status VARCHAR, version INTEGER)[]})"""
# Contents change less often than rows come, so every outcome occurs.
FEED_HASH = "md5(CAST(floor(value / 40) AS VARCHAR))"


@query("y18_streaming_triage", f"""
WITH f AS (SELECT event_id AS seq, CAST(user_id % 7 AS VARCHAR) AS code, event_type AS source, {FEED_HASH} AS content_hash, epoch_us(ts) AS micros FROM events WHERE value >= 0.5),
r AS (SELECT source, code, {FOLD} AS a FROM f GROUP BY source, code), o AS (SELECT source, code, unnest(a.o) AS x FROM r)
SELECT source, code, x.seq AS seq, x.status AS status, x.version AS version FROM o""")
def y18(spark, d):
    schema = table(spark, d, "events").schema
    code = F.when(F.col("value") >= 0.5, F.pmod("user_id", F.lit(7)).cast("string")).otherwise("")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select(
        F.col("event_id").alias("seq"), code.alias("code"), F.col("event_type").alias("source"), F.md5(F.floor(F.col("value") / 40).cast("string")).alias("content_hash"),
        F.col("ts").cast("timestamp").alias("last_modified"))
    folder = scratch_path(spark, "triaged")
    C.write_outcomes(C.stream_triage(rows), folder, scratch_path(spark, "stream")).awaitTermination()
    return C.written_outcomes(spark, folder).select("source", "code", "seq", "status", "version")
