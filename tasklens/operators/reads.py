"""Inspection of jobs and attempts: health, lists, progress, selections. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklens.operators.ordering import numbered

#: The wire strings of the enumerations, fixed values.
STATES = ("available", "running", "retryable", "scheduled", "paused", "succeeded", "cancelled", "discarded")
CLAIMABLE, TERMINAL = ("available", "retryable", "scheduled"), ("succeeded", "cancelled", "discarded")
ACTIVE = ("available", "running", "retryable", "scheduled", "paused")
OUTCOMES = ("started", "success", "error", "snooze", "cancelled", "timeout", "crashed")
ERROR_CLASSES = ("transient", "permanent", "validation", "timeout")
DEFAULT_LIST, DEFAULT_FAILURES = 50, 20


def live(jobs: DataFrame) -> DataFrame:
    return jobs.where("deleted_at IS NULL")


def is_terminal(state: Column | str = "state") -> Column:
    return (F.col(state) if isinstance(state, str) else state).isin(*TERMINAL)


def seconds(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)


def age(now: Column, since: Column) -> Column:
    """Whole seconds, never below 0; 0 where there is no since."""
    return F.coalesce(F.greatest(F.lit(0), seconds(now, since)), F.lit(0)).cast("long")


def ready(now: Column) -> Column:
    return F.col("state").isin(*CLAIMABLE) & (F.col("scheduled_at") <= now)


def _counts(state: str = "state", n: str = "n") -> Column:
    """Counts by state as one sorted text, state=n."""
    return F.array_join(F.array_sort(F.collect_list(F.concat(F.col(state), F.lit("="), F.col(n).cast("string")))), ",")


# views and lists


def job_view(jobs: DataFrame) -> DataFrame:
    """What the outside sees of a job; no parent is the empty text."""
    return jobs.select(
        "id", "kind", "queue", "state", "priority", "attempt", "max_attempts", F.coalesce("parent_job_id", F.lit("")).alias("parent_job_id"),
        F.col("created_at").alias("enqueued_at"), "scheduled_at", "finalized_at",
    )


def run_view(runs: DataFrame) -> DataFrame:
    """What the outside sees of an attempt; an empty output is none."""
    return runs.select("id", "job_id", "attempt", "outcome", "error_class", "error_message", F.nullif("output", F.lit("")).alias("output"), "started_at", "finished_at", "duration_ms")


def find_job(jobs: DataFrame, job_id: str) -> DataFrame:
    return job_view(live(jobs).where(F.col("id") == job_id))


def list_jobs(jobs: DataFrame, state: str | None = None, kind: str | None = None, limit: int = 0) -> DataFrame:
    """The newest jobs, of a state or a kind if one is named; a limit of 0 or less is the default."""
    found = live(jobs)
    for name, value in (("state", state), ("kind", kind)):
        found = found if not value else found.where(F.col(name) == value)
    return job_view(found.orderBy(F.desc("created_at"), F.desc("id")).limit(limit if limit > 0 else DEFAULT_LIST))


def list_runs(runs: DataFrame, job_id: str, before: Column | None = None, limit: int = 0) -> DataFrame:
    """A job's attempts, the last ones first; strictly before a time if one is given; a limit of 0 or less is none."""
    found = runs.where(F.col("job_id") == job_id)
    found = found if before is None else found.where(F.col("created_at") < before)
    found = found.orderBy(F.desc("created_at"), F.desc("id"))
    return run_view(found.limit(limit) if limit > 0 else found)


def active_of_kind(jobs: DataFrame, kind: str) -> DataFrame:
    return live(jobs).where((F.col("kind") == kind) & F.col("state").isin(*ACTIVE)).select("id", "state", "args")


def terminal_outside(jobs: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """Terminal jobs in none of the target states."""
    return live(jobs).where(is_terminal() & ~F.col("state").isin(*targets)).select("id", "state")


def routed(jobs: DataFrame, executor_class: str | None) -> DataFrame:
    """Jobs that an executor of a class may take: its own and those without one; no class named is any."""
    return jobs if executor_class is None else jobs.where((F.col("executor_class") == executor_class) | (F.col("executor_class") == ""))


def invalid_rows(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """(relation, id, problem) of rows that break an enumeration or lack a required field."""
    def broken(rows: DataFrame, name: str, problems: dict[str, Column]) -> DataFrame:
        found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(p)) for p, ok in problems.items()]), lambda x: x.isNotNull())
        return rows.select(F.lit(name).alias("relation"), "id", F.explode(found).alias("problem"))

    of_jobs = {"state": F.col("state").isin(*STATES), "kind": F.col("kind") != "", "lease": (F.col("state") == "running") == F.col("lease_token").isNotNull()}
    of_runs = {"outcome": F.col("outcome").isin(*OUTCOMES), "error_class": F.col("error_class").isNull() | F.col("error_class").isin(*ERROR_CLASSES), "end": (F.col("outcome") == "started") == F.col("finished_at").isNull()}
    return broken(jobs, "jobs", of_jobs).unionByName(broken(runs, "job_runs", of_runs))


def duplicate_attempts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("job_id", "attempt").agg(F.count("*").alias("n")).where("n > 1")


# counts and health


def state_counts(jobs: DataFrame, with_total: bool = True, kind: str | None = None) -> DataFrame:
    """state, n, of one kind if it is named; the row of a null state is the grand total."""
    jobs = jobs if kind is None else jobs.where(F.col("kind") == kind)
    grouped = jobs.rollup("state") if with_total else jobs.groupBy("state")
    return grouped.agg(F.count("*").alias("n"))


def queue_health(jobs: DataFrame, now: Column) -> DataFrame:
    """ready, inflight, scheduled_ahead, the oldest ready age in seconds (0 if none is ready) and the counts by state."""
    claimable = F.col("state").isin(*CLAIMABLE)
    grouped = live(jobs).groupBy("state").agg(
        F.count("*").alias("n"), F.count_if(ready(now)).alias("ready"), F.count_if(claimable & (F.col("scheduled_at") > now)).alias("ahead"),
        F.min(F.when(ready(now), F.col("scheduled_at"))).alias("oldest"),
    )
    return grouped.agg(
        F.coalesce(F.sum("ready"), F.lit(0)).alias("ready"), F.coalesce(F.sum(F.when(F.col("state") == "running", F.col("n"))), F.lit(0)).alias("inflight"),
        F.coalesce(F.sum("ahead"), F.lit(0)).alias("scheduled_ahead"), age(now, F.min("oldest")).alias("oldest_ready_age_s"), _counts().alias("counts"),
    )


def global_counts(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """runs, active_jobs and pending_jobs; pending ones are those not terminal, soft-deleted ones included."""
    of_jobs = jobs.agg(F.count_if(F.col("deleted_at").isNull() & F.col("state").isin(*ACTIVE)).alias("active_jobs"), F.count_if(~is_terminal()).alias("pending_jobs"))
    return runs.agg(F.count("*").alias("runs")).crossJoin(of_jobs)  # two frames of one row


# progress


def _children(jobs: DataFrame, key: str) -> DataFrame:
    """total, terminal, pending, counts of each key; states are folded twice, so a large batch is summed before it moves."""
    by_state = live(jobs).where(F.col(key).isNotNull()).groupBy(key, "state").agg(F.count("*").alias("n"))
    done = F.coalesce(F.sum(F.when(is_terminal(), F.col("n"))), F.lit(0))
    return by_state.groupBy(key).agg(F.sum("n").alias("total"), done.alias("terminal"), (F.sum("n") - done).alias("pending"), _counts().alias("counts"))


def _parent_states(jobs: DataFrame) -> DataFrame:
    return live(jobs).select(F.col("id").alias("parent_job_id"), F.col("state").alias("parent_state"))


def progress_by_parent(jobs: DataFrame) -> DataFrame:
    """total, terminal, pending, counts of each parent, and the parent's state ('' if it is missing or deleted)."""
    joined = _children(jobs, "parent_job_id").join(_parent_states(jobs), "parent_job_id", "left")
    return joined.withColumn("parent_state", F.coalesce("parent_state", F.lit("")))


def progress(jobs: DataFrame, parent: str, now: Column) -> DataFrame:
    """One parent's row of progress, with the age of its oldest child that is not terminal; all 0 for a parent without children."""
    children = live(jobs).where(F.col("parent_job_id") == parent)
    oldest = children.where(~is_terminal()).agg(F.min("scheduled_at").alias("oldest"))
    state = live(jobs).where(F.col("id") == parent).agg(F.coalesce(F.first("state"), F.lit("")).alias("parent_state"))
    sums = children.groupBy("state").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(is_terminal(), F.col("n"))), F.lit(0)).alias("terminal"), _counts().alias("counts")
    )
    return sums.crossJoin(oldest).crossJoin(state).select(  # three frames of one row
        F.lit(parent).alias("parent_job_id"), "total", "terminal", (F.col("total") - F.col("terminal")).alias("pending"), "counts", age(now, F.col("oldest")).alias("oldest_pending_age_s"), "parent_state"
    )


def _asked(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terminal", "pending")} | {c: F.coalesce(c, F.lit("")).alias(c) for c in ("counts", "parent_state")}
    joined = wanted.select(key).distinct().join(found, key, "left")
    return joined.select(key, *[zero[c] for c in zero if c in joined.columns])


def progress_many(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row for each wanted parent_job_id, all 0 where it has no children."""
    some = jobs.join(F.broadcast(wanted.select("parent_job_id").distinct()), "parent_job_id", "left_semi")
    parents = _parent_states(jobs).join(F.broadcast(wanted.select("parent_job_id").distinct()), "parent_job_id", "left_semi")
    found = wanted.select("parent_job_id").distinct().join(_children(some, "parent_job_id"), "parent_job_id", "left").join(parents, "parent_job_id", "left")
    return _asked(wanted, found, "parent_job_id")


def progress_by_kind(jobs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """A row for each kind, or for each wanted one, all 0 where it has no jobs."""
    found = _children(jobs, "kind")
    return found if wanted is None else _asked(wanted, found, "kind")


# selections


def claim_batch(jobs: DataFrame, now: Column, limit: int, queues: tuple[str, ...] = (), executor_class: str | None = None) -> DataFrame:
    """The jobs that a claim takes, of some queues (none named: all): by priority, then time, then id."""
    found = routed(live(jobs).where(ready(now)), executor_class)
    found = found if not queues else found.where(F.col("queue").isin(*queues))
    return found.orderBy("priority", "scheduled_at", "id").limit(limit).select("id", "priority", "scheduled_at")


def fair_batch(jobs: DataFrame, now: Column, limit: int, best_only: bool = False) -> DataFrame:
    """Claims that take turns between parents: rank inside each parent, then priority, rank, time and id.

    best_only keeps the jobs of the least priority number that is ready, before they are ranked.
    """
    found = live(jobs).where(ready(now))
    if best_only:
        found = found.join(F.broadcast(found.agg(F.min("priority").alias("best"))), F.col("priority") <= F.col("best")).drop("best")
    group = Window.partitionBy(F.coalesce("parent_job_id", "id")).orderBy("priority", "scheduled_at", "id")
    ranked = found.withColumn("rn", F.row_number().over(group)).where(F.col("rn") <= limit)
    return ranked.orderBy("priority", "rn", "scheduled_at", "id").limit(limit).select("id", "priority", "rn", "scheduled_at")


def priority_bands(jobs: DataFrame, base: int = 100) -> DataFrame:
    """Priorities that interleave parents: base, plus a job's rank among its parent's children."""
    rank = F.row_number().over(Window.partitionBy("parent_job_id").orderBy("id"))
    return live(jobs).where("parent_job_id IS NOT NULL").select("id", (rank + base - 1).alias("band"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The highest attempt of each job. job_key, of which job_id is a text, keeps the partitioning of the numbered attempts."""
    picked = F.max_by(F.struct("id", "attempt", "outcome", "error_class", "error_message", "output"), "attempt")
    return runs.groupBy("job_key", "job_id").agg(picked.alias("r")).select("job_key", "job_id", F.col("r.id").alias("run_id"), "r.attempt", "r.outcome", "r.error_class", "r.error_message", "r.output")


def _latest_of(top: DataFrame, runs: DataFrame) -> DataFrame:
    """top with its jobs' latest attempts; only those jobs' attempts are numbered, for the semi join passes the window."""
    some = runs.join(F.broadcast(top.select("job_key")), "job_key", "left_semi")
    return top.join(latest_runs(some).withColumnRenamed("attempt", "last_attempt").drop("job_id"), "job_key", "left")


def recent_failures(jobs: DataFrame, runs: DataFrame, limit: int = 0, since: Column | None = None) -> DataFrame:
    """The last discarded jobs with their latest attempt, or their own where they have none; a limit of 0 or less is the default."""
    top = live(jobs).where("state = 'discarded' AND finalized_at IS NOT NULL")
    top = top if since is None else top.where(F.col("finalized_at") >= since)
    top = top.orderBy(F.desc("finalized_at"), F.desc("id")).limit(limit if limit > 0 else DEFAULT_FAILURES).select("id", "job_key", "kind", "attempt", "finalized_at")
    return _latest_of(top, runs).select("id", "kind", "finalized_at", F.coalesce("last_attempt", "attempt").alias("attempt"), "outcome", "error_class", "error_message")


def child_outputs(jobs: DataFrame, runs: DataFrame, parent: str, limit: int) -> DataFrame:
    """A parent's terminal children, the first by id, with the output of their latest attempt; attempt 0 where there is none."""
    top = live(jobs).where((F.col("parent_job_id") == parent) & is_terminal()).orderBy("id").limit(limit).select("id", "job_key", "state")
    return _latest_of(top, runs).select("id", "state", F.coalesce("last_attempt", F.lit(0)).alias("attempt"), F.nullif("output", F.lit("")).alias("output"))


def without_runs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    return live(jobs).join(runs, "job_key", "left_anti").where("job_key IS NOT NULL").select("id", "state")


def keyset_pages(jobs: DataFrame, size: int, letters: int = 7) -> DataFrame:
    """Pages of `size` terminal jobs by id, as counts and borders; the first letters of an id are its bucket."""
    ids = numbered(jobs.where(is_terminal()).select("id"), F.substring("id", 1, letters), "id")
    return ids.groupBy(F.expr(f"pos div {size}").alias("page")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def bounded_prefix(jobs: DataFrame, size: int, batches: int) -> DataFrame:
    """The first `batches` pages of terminal ids; a cap of 0 batches is none."""
    ids = jobs.where(is_terminal()).select("id")
    return ids.orderBy("id").limit(size * batches) if batches > 0 else ids
