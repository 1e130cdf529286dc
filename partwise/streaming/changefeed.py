"""Streaming form of triage: what was last accepted of each key is state in RocksDB.

The same rules as the batch form give new, updated, conflict and unchanged; conflicts leave the
accepted state alone. A row that is older than the newest row of its key by more than the
allowed delay is late; it touches no state and has a table of its own, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from partwise.rules.sync import CONFLICT_WINDOW_SECONDS
from partwise.sources.writers import latest_per_key

OUTPUT = "source string, code string, seq bigint, content_hash string, micros bigint, status string, version int"
STATE = "content_hash string, micros bigint, version int, newest bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TABLES = {"new": "accepted", "updated": "accepted", "conflict": "conflicts", "late": "late", "unchanged": "unchanged"}


def outcomes(held: tuple | None, hashes: np.ndarray, micros: np.ndarray, delay: int, window: int = CONFLICT_WINDOW_SECONDS * 1_000_000) -> tuple[list[str], np.ndarray, tuple]:
    """(status, version, state) of a key's rows in event-time order; ``held`` is (hash, micros, version, newest) or None.

    Equal hashes that follow each other are decided together, so a hot key costs one step per
    change of its content and not one per row.
    """
    n = len(hashes)
    status, version = np.full(n, "unchanged", dtype=object), np.zeros(n, np.int32)
    # Rows ascend, so only those before the newest row of earlier batches can be late.
    first = int(np.searchsorted(micros, held[3] - delay)) if held else 0
    status[:first], version[:first] = "late", held[2] if held else 0
    starts = first + np.flatnonzero(np.r_[True, hashes[first + 1:] != hashes[first:-1]]) if first < n else []
    for i, end in zip(starts, [*starts[1:], n]):
        if held is None:
            status[i], held = "new", (hashes[i], int(micros[i]), 1, int(micros[i]))
        elif held[0] != hashes[i]:
            # Conflicts up to the end of the window around the accepted row, then an update.
            clear = np.abs(micros[i:end] - held[1]) > window
            at = i + int(clear.argmax()) if clear.any() else end
            status[i:at], version[i:at] = "conflict", held[2]
            if at == end:
                continue
            status[at], held, i = "updated", (hashes[at], int(micros[at]), held[2] + 1, held[3]), at
        version[i:end] = held[2]
    return status.tolist(), version, (*held[:3], max(held[3], int(micros[-1])))


class Triage(StatefulProcessor):
    """Decides a key's rows of one micro-batch. A key whose newest row the watermark has passed is forgotten."""

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["micros", "seq"], kind="stable")
        held = tuple(self.last.get()) if self.last.exists() else None
        status, version, now = outcomes(held, batch["content_hash"].to_numpy(object), batch["micros"].to_numpy(np.int64), self.delay)
        self.last.update(now)
        if held is None or held[3] != now[3]:
            if held is not None:
                self.handle.deleteTimer(held[3] // 1000)
            self.handle.registerTimer(now[3] // 1000)
        yield pd.DataFrame({"source": key[0], "code": key[1], "seq": batch["seq"].to_numpy(), "content_hash": batch["content_hash"].to_numpy(),
                            "micros": batch["micros"].to_numpy(), "status": status, "version": version})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_triage(rows: DataFrame, delay_seconds: int = 86_400, keep_days: int = 365) -> DataFrame:
    """Streaming rows (source, code, seq, content_hash, last_modified timestamp) to triaged rows.

    Blank and null codes and rows without a time are left out, a null hash reads as blank. State
    lives in RocksDB, not on the heap, and expires by event-time timers: a key whose newest row
    is ``keep_days`` behind the newest of all is new again. The watermark drives these timers
    only; the time reaches the keys as a plain number, so late rows are judged and not dropped.
    How many rows make a micro-batch is set at the source (files or bytes per trigger).
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = rows.filter("trim(code) <> '' AND last_modified IS NOT NULL").withWatermark("last_modified", f"{keep_days} days").select(
        "source", "code", "seq", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.unix_micros("last_modified").alias("micros"))
    return keyed.groupBy("source", "code").transformWithStateInPandas(Triage(delay_seconds * 1_000_000), OUTPUT, "Append", "EventTime")


def write_outcomes(triaged: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Accepted, conflicting, late and unchanged rows as partitions of one table: a micro-batch is computed and written once."""
    kinds = F.create_map(*[F.lit(x) for kv in TABLES.items() for x in kv])

    def put(batch: DataFrame, epoch: int) -> None:
        # The epoch names the folder, so a replayed batch replaces what it wrote before.
        batch.withColumn("kind", kinds[F.col("status")]).write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/epoch={epoch}")

    return triaged.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written_outcomes(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    found = spark.read.schema(OUTPUT + ", kind string").option("basePath", folder).parquet(folder)
    return found.filter(F.col("kind") == kind) if kind else found


def current_state(accepted: DataFrame) -> DataFrame:
    return latest_per_key(accepted, ["source", "code"], [F.col("version")])
