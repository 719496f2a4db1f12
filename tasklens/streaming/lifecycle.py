"""Streams of lifecycle events: counters and gauges by window, deduplication, leases, invariants, sessions.

Every function takes a streaming DataFrame and returns one; `finished` runs it over what is there now and returns the
result as a table, for tests and backfills.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

LATE = "10 minutes"
LEASES = "job_id string, at timestamp, event string, token string"


def files(spark: SparkSession, path: str, schema: str, per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def finished(stream: DataFrame, folder: str, keys: list[str] | None = None, mode: str = "append") -> DataFrame:
    """The stream over all that is there now. Each batch is written below its own number, so a batch that is run again
    replaces itself; with keys, the last batch's row of a key counts (mode update)."""
    spark, run = stream.sparkSession, f"{folder.rstrip('/')}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{run}/rows/n={number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{run}/checkpoint").foreachBatch(write).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{run}/rows")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{run}/rows") if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else spark.createDataFrame([], schema)
    if not keys:
        return rows.drop("batch")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys] or [F.lit(1).alias("_")]), "batch").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}") for c in stream.columns if c not in keys])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """began, event, kind, n and the sum of durations, by tumbling window."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event", "kind")
    return grouped.agg(F.count("*").alias("n"), F.sum("duration_us").alias("total_us")).select(F.col("window.start").alias("began"), "event", "kind", "n", "total_us")


def windowed_lag(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """began, queue and the greatest duration seen, by tumbling window."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "queue")
    return grouped.agg(F.max("duration_us").alias("most_us")).select(F.col("window.start").alias("began"), "queue", "most_us")


def windowed_buckets(events: DataFrame, bounds: tuple[int, ...], width: str = "1 hour", late: str = LATE) -> DataFrame:
    """began, kind and the number of finishes of each bound or less, by tumbling window."""
    grouped = events.where("event = 'finish'").withWatermark("ts", late).groupBy(F.window("ts", width), "kind")
    return grouped.agg(*[F.count_if(F.col("duration_us") <= b).alias(f"le_{b}") for b in bounds], F.count("*").alias("n")).select(F.col("window.start").alias("began"), "kind", *[f"le_{b}" for b in bounds], "n")


def sessions(denials: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """queue, began, ended, n of denials in a row without a pause of `gap`."""
    grouped = denials.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "queue")
    return grouped.agg(F.count("*").alias("n")).select("queue", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n")


def first_ever(jobs: DataFrame) -> DataFrame:
    """One row of each unique_key for ever: its state grows with the keys."""
    return jobs.dropDuplicates(["unique_key"])


def first_in_bucket(events: DataFrame, bucket: Column, late: str = LATE) -> DataFrame:
    """One row of each kind and time bucket; state ends with the watermark."""
    return events.withColumn("bucket", bucket).withWatermark("ts", late).dropDuplicatesWithinWatermark(["kind", "bucket"])


def run_invariants(events: DataFrame) -> DataFrame:
    """run_id, starts, ends, ok: exactly one finish or supersede behind a start, and a retry only behind a finish."""
    sums = events.groupBy("run_id").agg(*[F.count_if(F.col("event").isin(*names)).alias(n) for n, names in (("starts", ("start",)), ("ends", ("finish", "supersede")), ("finishes", ("finish",)), ("retries", ("retry",)))])
    ok = (F.col("starts") == 1) & (F.col("ends") <= 1) & (F.col("retries") <= F.col("finishes"))
    return sums.select("run_id", "starts", "ends", ok.alias("ok"))


def _by_time(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values("at", kind="stable")


def leases(events: DataFrame, lease_s: int, late: str = "0 seconds") -> DataFrame:
    """What becomes of claims, heartbeats and finishes (job_id, at, event, token): job_id, at, token, verdict.

    A claim or a heartbeat under the job's token holds it for lease_s. A finish under the token in time is accepted, any
    other is superseded; a lease that ends before either is reclaimed when the watermark passes it, and its token is void.
    """

    def step(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        token, until = state.get if state.exists else (None, None)
        held = (token, until)

        def reclaim() -> None:
            nonlocal held
            out.append((key[0], pd.Timestamp(held[1], unit="ms"), held[0], "reclaimed"))
            held = (None, None)

        if state.hasTimedOut:
            if held[0] is not None:
                reclaim()
            state.remove()
        else:
            for row in _by_time(parts).itertuples(index=False):
                ms = int(row.at.timestamp() * 1000)
                if held[0] is not None and ms > held[1]:
                    reclaim()
                if row.event == "claim":
                    held = (row.token, ms + lease_s * 1000)
                elif row.event == "heartbeat" and row.token == held[0]:
                    held = (held[0], ms + lease_s * 1000)
                elif row.event == "finish":
                    out.append((key[0], row.at, row.token, "accepted" if row.token == held[0] else "superseded"))
                    held = (None, None) if row.token == held[0] else held
            if held[0] is None:
                if state.exists:
                    state.remove()
            else:
                state.update(held)
                state.setTimeoutTimestamp(max(held[1], state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "at", "token", "verdict"])

    grouped = events.withWatermark("at", late).groupBy("job_id")
    return grouped.applyInPandasWithState(step, "job_id string, at timestamp, token string, verdict string", "token string, until bigint", "append", GroupStateTimeout.EventTimeTimeout)


def first_while_active(events: DataFrame) -> DataFrame:
    """Enqueues (job_id, at, event, unique_active_key) that land: a key is free again once the job that has it has ended."""

    def step(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, out = (state.get[0] if state.exists else None), []
        for row in _by_time(parts).itertuples(index=False):
            if row.event == "enqueue" and owner is None:
                owner = row.job_id
                out.append((row.job_id, row.at, key[0]))
            elif row.event == "end" and row.job_id == owner:
                owner = None
        if owner is None:
            if state.exists:
                state.remove()
        else:
            state.update((owner,))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "at", "unique_active_key"])

    return events.groupBy("unique_active_key").applyInPandasWithState(step, "job_id string, at timestamp, unique_active_key string", "owner string", "append", GroupStateTimeout.NoTimeout)


def poll(spark: SparkSession, ticks: DataFrame, batch, folder: str) -> None:
    """A dispatch loop: each trigger's rows go to batch(rows, number), one trigger at a time; it drains what is there and ends."""
    query = ticks.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(batch).start()
    query.awaitTermination()
