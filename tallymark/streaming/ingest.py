"""Continuous ingest. The batch operators run unchanged on each micro-batch.

A document arrives whole in one micro-batch, so everything per document is batch work inside
``foreachBatch``; only the replay filter and the counters keep state, and both are bounded by a
watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallymark.functions import fixed as K
from tallymark.functions.predicates import incoming_path


def read_incoming(
    spark: SparkSession,
    path: str,
    glob: str = "*",
    archive: str | None = None,
    max_files: int = 10000,
) -> DataFrame:
    """Whole-text stream of a folder. With ``archive`` finished files are moved there by Spark.

    A file that is gone before it is read is skipped, not an error.
    """
    reader = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .option("ignoreMissingFiles", True)
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_id"),
        F.col("_metadata.file_modification_time").alias("ts"),
        F.col("value").alias("text"),
    )


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give every micro-batch of what is there to ``work`` and stop."""
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_once(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Process what is there and stop. A replayed batch rewrites its own folder, nothing else."""

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(stream, write, checkpoint)


def append_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def updates_once(stream: DataFrame, out: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run a windowed count over what is there and return every window, also those that the watermark
    hasn't closed: each micro-batch writes the windows it changed, the last word on each window counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*").select(stream.columns)


def dedupe_events(events: DataFrame, in_flight: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Drop an event whose (path, eTag) is still in flight; a later replay passes again."""
    return events.withWatermark(ts, in_flight).dropDuplicatesWithinWatermark(["path", "eTag"])


def in_flight_processor(ttl_ms: int | None = None) -> type:
    """Per key: a start passes unless the key is in flight; a finish frees the key."""
    # Defined here so that it travels to the workers by value.
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class InFlight(StatefulProcessor):
        def init(self, handle):
            self.since = handle.getValueState("since", "since timestamp", ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows, timer_values):
            rows = list(rows)
            out = rows[0] if len(rows) == 1 else pd.concat(rows)
            if len(out) > 1:
                out = out.sort_values(["ts", "seq"], kind="stable")
            kinds = out["kind"].tolist()
            # A call to the state store costs more than the rows: none to learn what a finish makes irrelevant,
            # none to free a key that isn't held.
            held = True if kinds[0] == "finish" else self.since.exists()
            busy, last, passed = held, None, []
            for i, kind in enumerate(kinds):
                if kind == "finish":
                    busy, last = False, None
                elif not busy:
                    busy, last = True, i
                    passed.append(i)
            if not busy:
                if held:
                    self.since.clear()
            elif last is not None:
                self.since.update((out["ts"].iloc[last].to_pydatetime(),))
            if passed:
                some = out.iloc[passed]
                yield pd.DataFrame({"path": key[0], "eTag": key[1], "ts": some["ts"].to_numpy(), "seq": some["seq"].to_numpy()})

        def close(self):
            pass

    return InFlight


def dedupe_in_flight(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Starts that may run, from a stream of (path, eTag, kind 'start' or 'finish', ts, seq).

    A key is held from the start that passes until its finish, not for a set time: a replay before the finish
    is dropped, one after it passes. State is one timestamp for each key in flight; a finish removes it,
    and ``ttl_ms`` also frees keys whose finish never comes. Events of a key are taken in order of (ts, seq)
    within a micro-batch. Needs the RocksDB state store (:func:`use_rocksdb`).
    """
    processor = in_flight_processor(ttl_ms)
    return events.groupBy("path", "eTag").transformWithStateInPandas(
        statefulProcessor=processor(),
        outputStructType="path string, eTag string, ts timestamp, seq long",
        outputMode="append",
        timeMode="processingTime" if ttl_ms else "none",
    )


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that arbitrary state needs; a setting of the session that streams take over."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def incoming_events(events: DataFrame) -> DataFrame:
    """Events for the incoming folder with their path."""
    return events.withColumn("path", incoming_path("subject", "url")).where(F.col("path").isNotNull())


def call_report(calls: DataFrame, ts: str = "ts", quota: int = K.CALLS_PER_MINUTE, late: str = "5 minutes") -> DataFrame:
    """Calls per fixed minute against the quota; batch or stream."""
    counted = calls.withWatermark(ts, late).groupBy(F.window(ts, "60 seconds")).agg(F.count("*").alias("calls"))
    return counted.select(
        F.col("window.start").alias("window_start"),
        "calls",
        (F.col("calls") >= quota).alias("quota_exceeded"),
    )


def status_counts(outputs: DataFrame, ts: str = "ts", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Finished files per window and outcome code."""
    return (
        outputs.withWatermark(ts, late)
        .groupBy(F.window(ts, every), "code")
        .agg(F.count("*").alias("files"))
        .select(F.col("window.start").alias("window_start"), "code", "files")
    )
