"""Structured Streaming counterparts: windows over events, ingest of new files,
mentions kept once, names that go from pending to resolved."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per window of event time; with `late` set,
    rows later than that are dropped and closed windows leave the state. Works
    on streams and on tables."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, n) of each user's sessions."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def new_files(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the rows of files that have not been read yet."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: list[str], order: str):
    """Upsert micro-batches into a table of keys: each batch keeps the newest
    row of a key and is appended under its own number, so that a batch run
    again overwrites itself; readers take the newest row of each key."""

    def put(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in (*key, order)]
        newest = batch.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("r"))
        newest.select(*key, "r.*").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """Each key once within the watermark: repeated mentions are not new."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def _step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, status = state.get if state.exists else (0, "pending")
    for b in batches:
        seen += len(b)
        if (b["source_id"].notna()).any():
            status = "resolved"
    state.update((seen, status))
    yield pd.DataFrame({"name_key": [key[0]], "n_seen": [seen], "status": [status]})


def lifecycle(names: DataFrame) -> DataFrame:
    """(name_key, n_seen, status) after each batch of a stream of names: once
    resolved, a name stays so."""
    return names.groupBy("name_key").applyInPandasWithState(_step, "name_key string, n_seen long, status string", "n long, status string", "update", GroupStateTimeout.NoTimeout)
