"""Enqueueing: rows with defaults, bulk inserts that skip taken keys, follow-ups and barriers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklens.operators.reads import ACTIVE, is_terminal, live

#: Defaults of a new job, and the bounds of a bulk insert: columns of a row, parameters of a statement by dialect.
QUEUE, PRIORITY, MAX_ATTEMPTS, CHUNK = "default", 100, 25, 1000
COLUMNS, PARAMETERS = 24, {"postgres": 65535, "sqlite": 32766}
MOST_FOLLOW_UPS = 10_000


def with_defaults(rows: DataFrame, now: Column) -> DataFrame:
    """New rows (pos, id, kind, queue, priority, keys) as jobs: a blank queue and a priority of 0 take the defaults."""
    return rows.select(
        "pos", "id", "kind", F.coalesce(F.nullif("queue", F.lit("")), F.lit(QUEUE)).alias("queue"), F.coalesce(F.nullif("priority", F.lit(0)), F.lit(PRIORITY)).alias("priority"),
        F.lit("available").alias("state"), F.lit(0).alias("attempt"), F.lit(MAX_ATTEMPTS).alias("max_attempts"), now.alias("scheduled_at"), F.lit("{}").alias("args"), "unique_key", "unique_active_key",
    )


def chunk_size(dialect: str, asked: int) -> int:
    """Rows of a statement: the default for 0 or less, never more than the dialect's parameters hold."""
    most = PARAMETERS[dialect] // COLUMNS
    return min(CHUNK if asked <= 0 else asked, most)


def _free(rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """rows whose key is null or not taken."""
    return rows.join(taken.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def _first(rows: DataFrame, key: str) -> DataFrame:
    """rows without those whose key an earlier row has; rows without a key don't go through the window."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    keyed = rows.where(F.col(key).isNotNull()).withColumn("_rn", rank).where("_rn = 1").drop("_rn")
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def landed(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """The rows (pos, id, unique_key, unique_active_key, ...) that a bulk insert takes in.

    A unique_key that any job has, deleted ones too, or a unique_active_key that a job not terminal has, is skipped; in
    the batch the first row of a key wins, by unique_key and then by unique_active_key.
    """
    some = _free(_free(rows, jobs, "unique_key"), jobs.where(F.col("state").isin(*ACTIVE)), "unique_active_key")
    return _first(_first(some, "unique_key"), "unique_active_key")


def insert_account(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """inserted and skipped rows of a batch."""
    sums = rows.agg(F.count("*").alias("asked")).crossJoin(landed(rows, jobs).agg(F.count("*").alias("inserted")))  # one row each
    return sums.select("inserted", (F.col("asked") - F.col("inserted")).alias("skipped"))


def read_back(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """pos, id, landed of each row, in step with the input."""
    return rows.join(landed(rows, jobs).select("id", F.lit(True).alias("_in")), "id", "left").select("pos", "id", F.coalesce("_in", F.lit(False)).alias("landed"))


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """chunk, n, first_pos of a batch whose pos counts from 1."""
    return rows.groupBy(F.expr(f"(pos - 1) div {size}").alias("chunk")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def first_of_unique(jobs: DataFrame) -> DataFrame:
    """The earliest row of each unique_key, and all rows without one."""
    rank = F.row_number().over(Window.partitionBy("unique_key").orderBy("created_at", "id"))
    keyed = jobs.where("unique_key IS NOT NULL").withColumn("rn", rank).where("rn = 1").drop("rn")
    return keyed.select("id", "unique_key").unionByName(jobs.where("unique_key IS NULL").select("id", "unique_key"))


def seeded_runs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Audit rows for jobs that ended without one: attempt at least 1, its span and duration from the job's times."""
    none = live(jobs).where(is_terminal() & F.col("job_key").isNotNull()).join(runs.select("job_key"), "job_key", "left_anti")
    outcome = F.when(F.col("state") == "succeeded", "success").when(F.col("state") == "cancelled", "cancelled").otherwise("error")
    return none.select(F.col("id").alias("job_id"), F.greatest(F.lit(1), "attempt").alias("attempt"), outcome.alias("outcome"), F.col("scheduled_at").alias("started_at"), F.col("finalized_at").alias("finished_at"), F.expr("timestampdiff(MILLISECOND, scheduled_at, finalized_at)").alias("duration_ms"))


# follow-ups and barriers


def follow_ups(finished: DataFrame, per_job: Column, most: int = MOST_FOLLOW_UPS) -> DataFrame:
    """A child for each of the per_job follow-ups of succeeded jobs (id, queue); a job that asks for more than `most` gets none."""
    asked = finished.withColumn("_n", per_job.cast("int")).where(F.col("_n").between(1, most))
    made = asked.select(F.col("id").alias("parent_job_id"), "queue", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("k"))
    return made.select(F.concat_ws("-", "parent_job_id", F.col("k").cast("string")).alias("id"), "parent_job_id", "queue", F.lit("available").alias("state"))


def refused_follow_ups(finished: DataFrame, per_job: Column, most: int = MOST_FOLLOW_UPS) -> DataFrame:
    return finished.where(per_job > most).select("id", per_job.cast("bigint").alias("asked"))


def barrier_problems(declared: DataFrame, most: int = MOST_FOLLOW_UPS) -> DataFrame:
    """parent_job_id, problem of barriers (parent_job_id, barrier_kind, children) that can't be declared."""
    problem = F.when(F.nullif("barrier_kind", F.lit("")).isNull(), "no kind").when(F.col("children") < 1, "no children").when(F.col("children") > most, "too many children")
    return declared.select("parent_job_id", problem.alias("problem")).where("problem IS NOT NULL")


def complete_parents(jobs: DataFrame) -> DataFrame:
    """parent_job_id, children of live parents whose live children are all terminal: one conditional sum, no second join."""
    sums = live(jobs).where("parent_job_id IS NOT NULL").groupBy("parent_job_id").agg(F.count("*").alias("children"), F.count_if(~is_terminal()).alias("pending"))
    return sums.where("pending = 0").select("parent_job_id", "children")


def fired_barriers(jobs: DataFrame) -> DataFrame:
    """The continuation of each barrier whose children are all terminal, as a child of the parent; its key lets it exist once only.

    This is the form by state: it does not ask which child ended last.
    """
    parents = live(jobs).where("barrier_kind IS NOT NULL").select(F.col("id").alias("parent_job_id"), "barrier_kind", F.get_json_object("barrier_spec", "$.queue").alias("queue"))
    made = parents.join(complete_parents(jobs), "parent_job_id").withColumn("unique_key", F.concat(F.lit("barrier:"), "parent_job_id"))
    return _free(made, jobs, "unique_key").select(F.col("barrier_kind").alias("kind"), F.coalesce(F.nullif("queue", F.lit("")), F.lit(QUEUE)).alias("queue"), "parent_job_id", "unique_key", F.lit("available").alias("state"))


def unknown_kinds(jobs: DataFrame, kinds: DataFrame) -> DataFrame:
    """id, kind, error_class of live jobs whose kind no worker has registered (kind): a permanent error."""
    return live(jobs).join(F.broadcast(kinds.select("kind").distinct()), "kind", "left_anti").select("id", "kind", F.lit("permanent").alias("error_class"))
