"""Change capture and synchronisation: one keyed join decides a whole batch.

State is (source, code, content_hash, last_modified, version), one row per key; a batch adds a
payload and ``seq``, its input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.rules import sync as R
from partwise.sources.writers import latest_per_key, upsert

KEY = ["source", "code"]


def changed_since(rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Rows newer than their source's high-water mark; a source without one passes whole."""
    return rows.join(checkpoints.select("source", "high_water"), "source", "left").filter(
        F.col("high_water").isNull() | (F.col("last_modified") > F.col("high_water"))).drop("high_water")


def advance_checkpoints(checkpoints: DataFrame, rows: DataFrame) -> DataFrame:
    seen = rows.groupBy("source").agg(F.max("last_modified").alias("high_water"))
    return upsert(checkpoints, seen, ["source"], [F.col("high_water")])


def _latest(log: DataFrame) -> DataFrame:
    return latest_per_key(log, KEY, [F.col("last_modified"), F.col("seq")])


def real_changes(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows whose hash differs from the latest logged one, marked INSERT when the key was never logged."""
    last = _latest(log).select(*KEY, F.col("content_hash").alias("logged"), F.lit(True).alias("seen"))
    kept = rows.join(last, KEY, "left").filter(~F.col("content_hash").eqNullSafe(F.col("logged")))
    return kept.withColumn("change_type", F.when(F.col("seen").isNull(), "INSERT").otherwise("UPDATE")).drop("seen", "logged")


def deletions(log: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Keys whose latest logged row is not itself a deletion and which the snapshot lacks."""
    return _latest(log).join(snapshot.select(*KEY), KEY, "left_anti").withColumn("change_type", F.lit("DELETE"))


def change_statistics(changes: DataFrame) -> DataFrame:
    return changes.groupBy("source", "change_type").agg(F.count("*").alias("n"), F.avg("conflict_score").alias("avg_conflict_score"))


def temporal_conflict(old: Column, new: Column, window: int = R.CONFLICT_WINDOW_SECONDS) -> Column:
    micros = F.expr("INTERVAL 1 SECOND") * window
    return (new >= old - micros) & (new <= old + micros)


def triage(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Every batch key's outcome: new, updated (version + 1), conflict or unchanged; blank codes are errors.

    The last row of a repeated key counts; ``repeats`` says how many others it replaced.
    """
    valid = F.coalesce(F.trim("code"), F.lit("")) != ""
    ok = batch.filter(valid)
    last = latest_per_key(ok, KEY, [F.col("last_modified"), F.col("seq")])
    counts = ok.groupBy(*KEY).agg((F.count("*") - 1).alias("repeats"))
    old = state.select(*KEY, F.col("content_hash").alias("old_hash"), F.col("last_modified").alias("old_modified"), F.col("version").alias("old_version"))
    joined = last.join(counts, KEY).join(old, KEY, "left")
    status = (F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("content_hash"), "unchanged")
              .when(temporal_conflict(F.col("old_modified"), F.col("last_modified")), "conflict").otherwise("updated"))
    out = joined.withColumn("status", status).withColumn("version", F.when(F.col("status") == "new", 1).when(
        F.col("status") == "updated", F.col("old_version") + 1).otherwise(F.col("old_version")))
    bad = batch.filter(~valid).withColumns({"status": F.lit("error"), "repeats": F.lit(0).cast("bigint"), "version": F.lit(None).cast("int"),
                                           "old_hash": F.lit(None).cast("string"), "old_modified": F.lit(None).cast("timestamp_ntz"),
                                           "old_version": F.lit(None).cast("int")})
    return out.unionByName(bad)


def conflict_records(triaged: DataFrame, state: DataFrame, strategy: str = "latest_wins") -> DataFrame:
    """Both sides of each conflict as JSON, unresolved."""
    local = state.select(*KEY, F.to_json(F.struct("content_hash", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified"), "version")).alias("local_record"))
    remote = F.to_json(F.struct("content_hash", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified"), "payload"))
    hits = triaged.filter("status = 'conflict'").withColumn("remote_record", remote).join(local, KEY)
    return hits.select(
        "code", "source", F.array("source", "source").alias("conflicting_sources"), F.lit("timestamp_hash_mismatch").alias("conflict_type"),
        "local_record", "remote_record", F.lit(strategy).alias("strategy"), F.lit(False).alias("resolved"), F.col("last_modified").alias("created_at"))


def priority(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in R.SOURCE_PRIORITY.items() for x in kv])
    return F.coalesce(table[source], F.lit(R.SOURCE_PRIORITY["unknown"]))


def resolve(candidates: DataFrame, strategy: str) -> DataFrame:
    """Winner per code among candidate rows (code, source, is_local, last_modified, ...).

    latest_wins takes the newest, the local row on a tie; source_priority the best-ranked source, then the newest.
    """
    newest = [F.col("last_modified"), F.col("is_local"), F.col("seq")]
    if strategy == "latest_wins":
        return latest_per_key(candidates, ["code"], newest)
    if strategy == "source_priority":
        return latest_per_key(candidates, ["code"], [-priority(F.col("source")), *newest])
    raise ValueError(f"{strategy} is settled by hand")


def auto_resolve(conflicts: DataFrame, candidates: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Winners of the automatic strategies go into the master by code; their conflicts are marked resolved."""
    winners = None
    for s in ("latest_wins", "source_priority"):
        part = resolve(candidates.join(conflicts.filter(F.col("strategy") == s).select("code").distinct(), "code", "left_semi"), s)
        winners = part if winners is None else winners.unionByName(part)
    applied = upsert(master, winners.select(*master.columns), ["code"], [F.col("last_modified")])
    done = conflicts.withColumn("resolved", F.col("resolved") | F.col("strategy").isin("latest_wins", "source_priority"))
    return applied, done


STATUSES = ["new", "updated", "conflict", "unchanged", "error"]


def sync_history(triaged: DataFrame) -> DataFrame:
    """One result row per source; success unless a row failed."""
    out = triaged.groupBy("source").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.sum("repeats").alias("repeats"), F.max("last_modified").alias("completed_at"))
    return out.withColumn("status", F.when(F.col("error") > 0, "partial").otherwise("success"))


def status_report(state: DataFrame) -> DataFrame:
    return state.groupBy("source").agg(F.count("*").alias("total_records"), F.max("last_modified").alias("last_sync"),
                                       F.count_if(F.col("status").isin("new", "updated")).alias("success_count"),
                                       F.count_if(F.col("status") == "error").alias("failed_count"))


def open_conflicts(conflicts: DataFrame, limit: int | None = None) -> DataFrame:
    """Unresolved conflicts, newest first, with the payloads parsed."""
    found = conflicts.filter(~F.col("resolved")).withColumns({
        "local": F.from_json("local_record", "content_hash string, last_modified string, version int"),
        "remote": F.from_json("remote_record", "content_hash string, last_modified string, payload string"),
    }).orderBy(F.col("created_at").desc(), "source", "code")
    return found.limit(limit) if limit is not None else found


def history(log: DataFrame, source: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    for name, value in (("source", source), ("status", status)):
        if value is not None:
            log = log.filter(F.col(name) == value)
    return log.orderBy(F.col("completed_at").desc(), "source").limit(limit)


def sync_sources(state: DataFrame, batch: DataFrame) -> DataFrame:
    """All sources at once, each against its own state, listed by priority with running totals."""
    per_source = sync_history(triage(state, batch)).withColumn("priority", priority(F.col("source")))
    # One row per source, so the running window stays small.
    run = "OVER (ORDER BY priority, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return per_source.withColumns({f"running_{c}": F.expr(f"sum({c}) {run}") for c in ("total", "new", "updated", "conflict")})
