"""What the query tables share: relations by name, instants, literal frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklens.sources.project import ctes, relation

NOW_TEXT, TICK_TEXT = "TIMESTAMP '1999-01-01 00:00:00'", "TIMESTAMP '2024-01-01 02:00:00'"
CLAIM, DONE = "state IN ('available', 'retryable', 'scheduled')", "state IN ('succeeded', 'cancelled', 'discarded')"
ACTIVE = "state IN ('available', 'running', 'retryable', 'scheduled', 'paused')"
READY = f"deleted_at IS NULL AND {CLAIM} AND scheduled_at <= {NOW_TEXT}"
COUNTS = "string_agg(state || '=' || n, ',' ORDER BY state || '=' || n)"
#: A parent, and one with several terminal children.
PARENT, BUSY = "p0000000001", "p0000000000"


def at(text: str) -> Column:
    return F.expr(text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))


def now() -> Column:
    return at(NOW_TEXT)


def tick() -> Column:
    return at(TICK_TEXT)


def on(*names: str):
    """A query of the named relations."""
    return lambda f: lambda spark, sf_dir: f(*(relation(spark, sf_dir, n) for n in names))


def frame(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def alone(f):
    """A query of literals alone."""
    return lambda spark, sf_dir: f(spark)


J, R, L, P, A, S = ctes("jobs"), ctes("job_runs"), ctes("lifecycle"), ctes("job_periodics"), ctes("arrivals", "jobs"), ctes("storage_samples")
JR = ctes("jobs", "job_runs")
H, C = ctes("limiter_holds"), ctes("limiter_calls")
