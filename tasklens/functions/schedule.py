"""Periodic schedules: missed buckets, next times, five-field cron expressions (UTC)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (least, greatest) of minute, hour, day of the month, month, day of the week (0 and 7 are Sunday): fixed values.
FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
#: Days after which a cron expression that has not fired never will: 29 February falls once in eight years at worst.
HORIZON_DAYS = 366 * 8


def due(schedules: DataFrame, now: Column) -> DataFrame:
    return schedules.where(F.col("is_active") & (F.col("interval_seconds") > 0) & (F.col("next_run_at") <= now))


def _last(now: Column) -> Column:
    """The number of the last interval that is due at now."""
    return F.floor(F.timestamp_diff("SECOND", F.col("next_run_at"), now) / F.col("interval_seconds")).cast("long")


def _at(k: Column) -> Column:
    return F.timestamp_add("SECOND", (k * F.col("interval_seconds")).cast("int"), F.col("next_run_at"))


def missed(schedules: DataFrame, now: Column, limit: int) -> DataFrame:
    """(slug, bucket): the most recent `limit` intervals that are due at now, for active schedules; 0 or less is no limit."""
    first = F.greatest(F.lit(0).cast("long"), _last(now) + 1 - limit) if limit > 0 else F.lit(0).cast("long")
    steps = due(schedules, now).withColumn("k", F.explode(F.sequence(first, _last(now))))
    return steps.select("slug", _at(F.col("k")).alias("bucket"))


def next_runs(schedules: DataFrame, now: Column) -> DataFrame:
    """slug, next_run_at: the first interval after now; schedules that lie ahead or have no interval stay as they are."""
    passed = F.when((F.col("interval_seconds") > 0) & (F.col("next_run_at") <= now), _at(_last(now) + 1)).otherwise(F.col("next_run_at"))
    return schedules.where("is_active").select("slug", passed.alias("next_run_at"))


def _field(text: str, least: int, most: int) -> frozenset[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        every = int(step) if step else 1
        if every < 1:
            raise ValueError(f"step of {part!r}")
        if span == "*":
            low, high = least, most
        else:
            a, _, b = span.partition("-")
            low = int(a)
            high = int(b) if b else (most if step else low)
        if not least <= low <= high <= most:
            raise ValueError(f"{part!r} is not within {least}-{most}")
        out.update(range(low, high + 1, every))
    return frozenset(out)


class Cron:
    """minute, hour, day of the month, month, day of the week: numbers, *, lists, ranges and steps.

    Where both days are restricted, a day that fits either counts. Raises ValueError for anything else.
    """

    def __init__(self, text: str):
        fields = text.split()
        if len(fields) != 5:
            raise ValueError(f"{text!r} has not five fields")
        self.minutes, self.hours, self.days, self.months, week = (_field(f, a, b) for f, (a, b) in zip(fields, FIELDS))
        self.weekdays = frozenset(d % 7 for d in week)
        self.any_day, self.any_weekday = fields[2][0] == "*", fields[4][0] == "*"

    def _day(self, day: dt.date) -> bool:
        if day.month not in self.months:
            return False
        in_month, in_week = day.day in self.days, day.isoweekday() % 7 in self.weekdays
        return (in_month and in_week) if self.any_day or self.any_weekday else (in_month or in_week)

    def after(self, when: dt.datetime) -> dt.datetime | None:
        """The first time that is later than `when`; None if there is none."""
        start = when.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
        hours, minutes = sorted(self.hours), sorted(self.minutes)
        for k in range(HORIZON_DAYS):
            day = start.date() + dt.timedelta(days=k)
            if self._day(day):
                for h in hours:
                    for m in minutes:
                        at = dt.datetime(day.year, day.month, day.day, h, m)
                        if at >= start:
                            return at
        return None

    def due(self, start: dt.datetime, now: dt.datetime, limit: int) -> tuple[list[dt.datetime], dt.datetime | None]:
        """The most recent `limit` times from start to now, and the next one; a ring of `limit` times is all that is held."""
        from collections import deque

        ring: deque[dt.datetime] = deque(maxlen=limit if limit > 0 else None)
        at: dt.datetime | None = start if start <= now else None
        if at is None:
            return [], start
        while at is not None and at <= now:
            ring.append(at)
            at = self.after(at)
        return list(ring), at


def cron_table(spark, limit: int = 10):
    """Registers the table function cron_buckets(slug, cron_expr, next_run_at, now): rows (slug, bucket, next_run_at, error)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="slug string, bucket timestamp_ntz, next_run_at timestamp_ntz, error string")
    class CronBuckets:
        def eval(self, slug: str, cron: str, start: dt.datetime, now: dt.datetime) -> Iterator[tuple]:
            try:
                buckets, following = Cron(cron).due(start, now, limit)
            except ValueError as e:
                yield slug, None, start, str(e)
                return
            for b in buckets:
                yield slug, b, following, None

    spark.udtf.register("cron_buckets", CronBuckets)
    return CronBuckets
