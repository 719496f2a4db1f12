"""Seeded workloads: rows of a mix as a function of seed and ordinal, so any task makes its own part, again and again alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def drawn(stream: str, seed: int, ordinal: Column | str = "ordinal", below: int = 1 << 31) -> Column:
    """A whole number from 0 to below - 1; streams of other names are independent of each other."""
    return F.pmod(F.xxhash64(F.lit(f"{stream}:{seed}"), F.col(ordinal) if isinstance(ordinal, str) else ordinal), F.lit(below))


def planned(spark: SparkSession, mix: str, rows: int, seed: int, children: int = 0, base_ms: int = 10, slow_times: int = 20) -> DataFrame:
    """ordinal, parent_ordinal, kind, priority, work_ms, payload of a mix; mixed-speed has one slow job in ten."""
    made = spark.range(rows).withColumnRenamed("id", "ordinal")
    slow = (drawn("work", seed, below=10) == 0) if mix == "mixed-speed" else F.lit(False)
    made = made.select(
        "ordinal", F.lit(None).cast("bigint").alias("parent_ordinal"), F.lit(mix).alias("kind"), (100 + drawn("priority", seed, below=5)).cast("int").alias("priority"),
        (F.lit(base_ms) * F.when(slow, slow_times).otherwise(1)).alias("work_ms"), F.concat(F.lit("p"), drawn("payload", seed).cast("string")).alias("payload"),
    )
    if children < 1:
        return made
    kids = made.select(F.col("ordinal").alias("parent_ordinal"), F.explode(F.sequence(F.lit(0), F.lit(children - 1))).alias("k"), "kind", "priority", "work_ms", "payload")
    return made.unionByName(kids.withColumn("ordinal", F.lit(rows) + F.col("parent_ordinal") * children + F.col("k")).drop("k"))


def digest(jobs: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """sha256 of a workload: of the digests of its chunks of ordinals, each of its rows in order, fields by length and text."""
    fields = ["ordinal", "parent_ordinal", "kind", "priority", "work_ms", "payload"]
    part = lambda c: F.concat(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = jobs.select("ordinal", F.concat(*[part(c) for c in fields]).alias("text"))
    chunks = rows.groupBy(F.expr(f"ordinal div {chunk}").alias("c")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda r: r["text"]), "\n"), 256).alias("d"))
    return chunks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "d"))), lambda r: r["d"]), ""), 256).alias("digest"))


def claimable_spread(spark: SparkSession, rows: int, queues: int, classes: tuple[str, ...]) -> DataFrame:
    """Ready jobs dealt in turn over queues and classes, with priorities 100 to 104."""
    i = F.col("i")
    return spark.range(rows).withColumnRenamed("id", "i").select(
        "i", F.concat(F.lit("q"), (i % queues).cast("string")).alias("queue"), F.element_at(F.array(*map(F.lit, classes)), (i % len(classes) + 1).cast("int")).alias("executor_class"), (100 + i % 5).cast("int").alias("priority")
    )


def series(spark: SparkSession, n: int, states: tuple[str, ...]) -> DataFrame:
    """g from 1 to n with a state from a list, in turn."""
    return spark.range(1, n + 1).withColumnRenamed("id", "g").select("g", F.element_at(F.array(*map(F.lit, states)), (F.lit(1) + F.col("g") % len(states)).cast("int")).alias("state"))


def faulted(results: DataFrame, fault: str, fraction: float, seed: int) -> DataFrame:
    """results as a fault leaves them: a killed runner's are lost, a paused database's come late, an outage's fail. Rows are hit by a hash."""
    hit = drawn("fault", seed, F.col("job_id"), 1000) < int(1000 * fraction)
    if fault == "kill-runner":
        return results.where(~hit)
    if fault == "pause-database":
        return results.withColumn("finished_at", F.when(hit, F.timestamp_add("SECOND", F.lit(60), F.col("finished_at"))).otherwise(F.col("finished_at")))
    if fault == "outage":
        return results.withColumn("error_message", F.when(hit, F.lit("outage")).otherwise(F.col("error_message")))
    raise ValueError(f"unknown fault {fault!r}")
