"""Schedules as a relation: views, checks, upserts, ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklens.functions import schedule
from tasklens.functions.scalars import bucket_key, cadence_text
from tasklens.operators.enqueue import landed

TICK_LIMIT = 10


def periodic_view(schedules: DataFrame) -> DataFrame:
    """Schedules by slug; no cron expression is the empty text, no interval is 0."""
    return schedules.orderBy("slug").select("slug", "kind", "queue", F.coalesce("cron_expr", F.lit("")).alias("cron_expr"), F.coalesce("interval_seconds", F.lit(0)).alias("interval_seconds"), "next_run_at", "is_active", cadence_text("interval_seconds", "cron_expr").alias("cadence"))


def invalid(schedules: DataFrame) -> DataFrame:
    """slug, problem of schedules without a slug or kind, with both or none of cron and interval, or an interval below a second."""
    cron, every = F.coalesce("cron_expr", F.lit("")) != "", F.coalesce("interval_seconds", F.lit(0))
    problem = (
        F.when(F.coalesce("slug", F.lit("")) == "", "no slug").when(F.coalesce("kind", F.lit("")) == "", "no kind")
        .when(cron & (every != 0), "both cron and interval").when(~cron & (every == 0), "neither cron nor interval").when(every < 0, "interval below a second")
    )
    return schedules.select("slug", problem.alias("problem")).where("problem IS NOT NULL")


def upserted(schedules: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """The schedules after wanted (slug, kind, queue, cron_expr, interval_seconds) is written over them, by slug.

    The cursor starts anew, at now, only where the cadence changes or the schedule is new; unmentioned ones stay.
    """
    old = schedules.select("slug", *[F.col(c).alias(f"_{c}") for c in ("kind", "queue", "cron_expr", "interval_seconds", "next_run_at", "is_active")])
    new = wanted.select("slug", "kind", "queue", "cron_expr", "interval_seconds", F.lit(True).alias("_new"))
    both = old.join(new, "slug", "full_outer")
    same = F.col("cron_expr").eqNullSafe(F.col("_cron_expr")) & F.col("interval_seconds").eqNullSafe(F.col("_interval_seconds"))
    take = F.coalesce("_new", F.lit(False))
    columns = {c: F.when(take, F.col(c)).otherwise(F.col(f"_{c}")) for c in ("kind", "queue", "cron_expr", "interval_seconds")}
    cursor = F.when(take & (F.col("_next_run_at").isNull() | ~same), now).otherwise(F.col("_next_run_at"))
    return both.select("slug", *[v.alias(k) for k, v in columns.items()], cursor.alias("next_run_at"), F.coalesce("_is_active", F.lit(True)).alias("is_active"))


def toggled(schedules: DataFrame, slugs: DataFrame, active: bool) -> DataFrame:
    """slug, is_active of all schedules after those named are switched."""
    named = F.broadcast(slugs.select("slug").distinct().withColumn("_named", F.lit(True)))
    return schedules.join(named, "slug", "left").select("slug", F.when(F.col("_named"), F.lit(active)).otherwise(F.col("is_active")).alias("is_active"))


def without(schedules: DataFrame, slugs: DataFrame) -> DataFrame:
    return schedules.join(F.broadcast(slugs.select("slug").distinct()), "slug", "left_anti")


def orphans(schedules: DataFrame, configured: DataFrame) -> DataFrame:
    """Active schedules that the configuration no longer names."""
    return without(schedules.where("is_active"), configured).select("slug")


def tick_jobs(schedules: DataFrame, jobs: DataFrame, now: Column, limit: int = TICK_LIMIT) -> DataFrame:
    """A job for each missed interval of active schedules, keyed by slug and time, so that a second tick adds none."""
    due = schedule.missed(schedules, now, limit).join(F.broadcast(schedules.select("slug", "kind", "queue")), "slug")
    rows = due.select(bucket_key("slug", "bucket").alias("unique_key"), "kind", "queue", F.col("bucket").alias("scheduled_at"), F.lit("available").alias("state"), F.lit(None).cast("string").alias("unique_active_key"), "slug")
    rows = rows.withColumn("id", F.col("unique_key")).withColumn("pos", F.col("unique_key"))
    return landed(rows, jobs).select("unique_key", "slug", "kind", "queue", "scheduled_at", "state")


def ticked(schedules: DataFrame, jobs: DataFrame, now: Column, limit: int = TICK_LIMIT) -> DataFrame:
    """slug, next_run_at, last_enqueued_at of active schedules after a tick: the cursor moves on, even where every key was taken."""
    fired = tick_jobs(schedules, jobs, now, limit).select("slug").distinct().withColumn("_fired", F.lit(True))
    old = schedules.select("slug", "last_enqueued_at")
    joined = schedule.next_runs(schedules, now).join(old, "slug").join(fired, "slug", "left")
    return joined.select("slug", "next_run_at", F.when(F.col("_fired"), now).otherwise(F.col("last_enqueued_at")).alias("last_enqueued_at"))
