"""State transitions as pure functions of a snapshot of jobs: each returns the rows that change, or an account of them.

Times are in columns, never the clock's; `merged` makes the next snapshot of changed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklens.functions.scalars import backoff_s
from tasklens.operators.ordering import numbered
from tasklens.operators.reads import TERMINAL, claim_batch, is_terminal, live

PAUSABLE, CANCELLABLE = ("available", "retryable", "scheduled"), ("available", "retryable", "scheduled", "paused")
#: Delay in seconds of a first retry, the longest, and the least lease.
RETRY_BASE_S, RETRY_MOST_S = 1, 60


def _no(kind: str) -> Column:
    return F.lit(None).cast(kind)


def later(when: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), when)


def merged(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """The next snapshot: the columns of changed (id, ...) take the place of the jobs' own, where there is a row."""
    new = [c for c in changed.columns if c != "id"]
    marked = changed.select("id", *[F.col(c).alias(f"_{c}") for c in new], F.lit(True).alias("_hit"))
    joined = jobs.join(marked, "id", "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


# claim, finalize, renew, sweep


def claim(jobs: DataFrame, now: Column, limit: int, lease_s: int, token: str, queues: tuple[str, ...] = (), executor_class: str | None = None) -> DataFrame:
    """The claimed jobs: running, one attempt more, leased, each with a token of its own."""
    top = claim_batch(jobs, now, limit, queues, executor_class).select("id")
    return jobs.join(F.broadcast(top), "id").select(
        "id", F.lit("running").alias("state"), (F.col("attempt") + 1).alias("attempt"), later(now, F.lit(lease_s)).alias("leased_until"), F.concat(F.lit(f"{token}-"), "id").alias("lease_token")
    )


def run_stubs(claimed: DataFrame, now: Column) -> DataFrame:
    """An attempt row for each claimed job, written before its work begins."""
    return claimed.select(
        F.concat_ws("-", F.lit("r"), "id", F.col("attempt").cast("string")).alias("id"), F.col("id").alias("job_id"), "attempt", F.lit("started").alias("outcome"), now.alias("started_at"), _no("timestamp_ntz").alias("finished_at")
    )


def finalize_plan(results: DataFrame) -> DataFrame:
    """What each result (with its job's attempt, max_attempts, scheduled_at, finalized_at) makes of the job and of the attempt.

    The first that holds counts: cancel, snooze (which costs no attempt), an error, success. An error without a class is
    transient; a permanent or invalid one, or one of the last attempt, discards the job.
    """
    failed = F.col("error_message").isNotNull()
    kind = F.coalesce(F.nullif("error_class", F.lit("")), F.lit("transient"))
    dead = failed & (kind.isin("permanent", "validation") | (F.col("attempt") >= F.col("max_attempts")))
    snoozed, cancelled, end = F.col("snooze_s").isNotNull(), F.coalesce("cancel", F.lit(False)), F.col("finished_at")
    wait = F.coalesce("delay_s", backoff_s("attempt", RETRY_BASE_S, RETRY_MOST_S))
    failure = F.when(kind == "timeout", "timeout").otherwise("error")

    def first(*cases: Column) -> Column:
        of_cancel, of_snooze, of_dead, of_retry, of_success = cases
        return F.when(cancelled, of_cancel).when(snoozed, of_snooze).when(dead, of_dead).when(failed, of_retry).otherwise(of_success)

    text = lambda *x: first(*(F.lit(y) if isinstance(y, str) else y for y in x))
    keep_s, keep_f = F.col("scheduled_at"), F.col("finalized_at")
    return results.withColumns({
        "new_state": text("cancelled", "scheduled", "discarded", "retryable", "succeeded"),
        "outcome": text("cancelled", "snooze", failure, failure, "success"),
        "new_scheduled_at": first(keep_s, later(end, F.col("snooze_s")), keep_s, later(end, wait), keep_s),
        "new_finalized_at": first(end, keep_f, end, keep_f, end),
        "new_max_attempts": F.when(~cancelled & snoozed, F.col("max_attempts") + 1).otherwise(F.col("max_attempts")),
        "run_class": F.when(~cancelled & ~snoozed & failed, kind),
    })


def finalize(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Every result with its plan and whether it was superseded: its job no longer runs under its token.

    A superseded result leaves the job unchanged, but its attempt row is written all the same.
    """
    held = jobs.select(F.col("id").alias("job_id"), "state", "lease_token", "attempt", "max_attempts", "scheduled_at", "finalized_at")
    planned = finalize_plan(results.join(held, "job_id", "left"))
    fence = F.coalesce((F.col("state") == "running") & (F.col("lease_token") == F.col("token")), F.lit(False))
    return planned.select(
        "job_id", "token", (~fence).alias("superseded"), "outcome", "run_class", *[F.when(fence, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("state", "scheduled_at", "finalized_at", "max_attempts")],
        F.when(~fence, F.col("lease_token")).alias("lease_token"),
    )


def renewed(jobs: DataFrame, beats: DataFrame, until: Column) -> DataFrame:
    """Jobs whose lease a heartbeat (job_id, token) extends: those that still run under that token."""
    fence = beats.select(F.col("job_id").alias("id"), F.col("token").alias("lease_token")).distinct()
    return jobs.where("state = 'running'").join(fence, ["id", "lease_token"], "left_semi").select("id", until.alias("leased_until"))


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    return live(jobs).where((F.col("state") == "running") & (F.col("leased_until") < now))


def _reclaimed(late: DataFrame) -> DataFrame:
    return late.select("id", F.lit("available").alias("state"), _no("timestamp_ntz").alias("leased_until"), _no("string").alias("lease_token"), "scheduled_at", "attempt")


def sweep(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease ran out go back to available; attempt and time stay."""
    return _reclaimed(expired(jobs, now))


def sweep_batch(jobs: DataFrame, now: Column, size: int) -> DataFrame:
    """The oldest leases first, `size` at most."""
    return _reclaimed(expired(jobs, now).orderBy("leased_until", "id").limit(size))


def crashed_stubs(runs: DataFrame, swept: DataFrame, now: Column) -> DataFrame:
    """Attempts still started of swept jobs (id): crashed, ended now, without a duration or an error class."""
    stuck = runs.where("outcome = 'started'").join(swept.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return stuck.select("id", "job_id", F.lit("crashed").alias("outcome"), now.alias("finished_at"), F.lit(None).cast("bigint").alias("duration_ms"), _no("string").alias("error_class"))


def expired_by_fault(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease a fault ends one second ago."""
    return live(jobs).where("state = 'running'").select("id", later(now, F.lit(-1)).alias("leased_until"))


# pause, resume, cancel by parent, with accounts


def of_parent(parent: str) -> Column:
    return F.col("parent_job_id") == parent


def _move(jobs: DataFrame, sources: tuple[str, ...], target: str, scope: Column) -> DataFrame:
    return live(jobs).where(scope & F.col("state").isin(*sources)).select("id", F.col("state").alias("was"), F.lit(target).alias("state"))


def pause(jobs: DataFrame, scope: Column) -> DataFrame:
    return _move(jobs, PAUSABLE, "paused", scope)


def resume(jobs: DataFrame, scope: Column) -> DataFrame:
    return _move(jobs, ("paused",), "available", scope)


def cancel(jobs: DataFrame, scope: Column, now: Column) -> DataFrame:
    moved = _move(jobs, CANCELLABLE, "cancelled", scope)
    return moved.withColumns({"finalized_at": now, "leased_until": _no("timestamp_ntz"), "lease_token": _no("string")})


def account(jobs: DataFrame, scope: Column, sources: tuple[str, ...], batch: int = 500) -> DataFrame:
    """changed, skipped_terminal, skipped_running and batches, counted on the snapshot before a move."""
    sums = live(jobs).where(scope).agg(
        F.count_if(F.col("state").isin(*sources)).alias("changed"), F.count_if(is_terminal()).alias("skipped_terminal"), F.count_if(F.col("state") == "running").alias("skipped_running")
    )
    return sums.withColumn("batches", F.expr(f"(changed + {batch - 1}) div {batch}"))


# retry, cancel one, replay


def budgeted(attempt: Column, max_attempts: Column, budget: int) -> Column:
    """Room for budget more attempts, or for max_attempts more if budget is 0 or less; attempt itself never changes."""
    return attempt + (F.lit(budget) if budget > 0 else max_attempts)


def retry(jobs: DataFrame, ids: DataFrame, now: Column, force: bool = False, budget: int = 0, delay_s: int = 0) -> DataFrame:
    """Named jobs (id) that are discarded or cancelled, and with force succeeded ones too, made available again."""
    states = ("discarded", "cancelled") + (("succeeded",) if force else ())
    found = live(jobs).where(F.col("state").isin(*states)).join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")
    return found.select("id", F.lit("available").alias("state"), later(now, F.lit(delay_s)).alias("scheduled_at"), _no("timestamp_ntz").alias("finalized_at"), budgeted(F.col("attempt"), F.col("max_attempts"), budget).alias("max_attempts"))


def cancel_jobs(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Named jobs that are not terminal, running ones too, cancelled; their tokens go."""
    found = live(jobs).where(~is_terminal()).join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")
    return found.select("id", F.lit("cancelled").alias("state"), now.alias("finalized_at"), _no("timestamp_ntz").alias("leased_until"), _no("string").alias("lease_token"))


def misses(jobs: DataFrame, ids: DataFrame, may_change: Column) -> DataFrame:
    """id, problem of named jobs that nothing is done to: not found, or in a state that forbids it."""
    held = live(jobs).select("id", F.col("state"))
    joined = ids.select("id").distinct().join(held, "id", "left")
    return joined.where(F.col("state").isNull() | ~may_change).select("id", F.when(F.col("state").isNull(), "not found").otherwise(F.concat(F.lit("is "), "state")).alias("problem"))


def replay(
    jobs: DataFrame, scope: Column | None, now: Column, states: tuple[str, ...] = ("discarded",), stagger_s: int = 0, delay_s: int = 0, budget: int = 0, force: bool = False, failed_since: Column | None = None, letters: int = 7
) -> DataFrame:
    """Terminal jobs of a scope made available again, the k-th of n by id at now + delay + stagger * k div n.

    A replay without a scope or a bound in time is refused, and so is one of succeeded jobs without force.
    """
    if scope is None and failed_since is None:
        raise ValueError("a replay needs a scope or a time")
    if any(s not in TERMINAL for s in states) or ("succeeded" in states and not force):
        raise ValueError("only terminal states can be replayed, and succeeded ones need force")
    found = live(jobs).where(F.col("state").isin(*states))
    found = found if scope is None else found.where(scope)
    found = found if failed_since is None else found.where(F.col("finalized_at") >= failed_since)
    placed = numbered(found.select("id", "attempt", "max_attempts"), F.substring("id", 1, letters), "id")
    n = found.agg(F.count("*").alias("n"))
    when = later(now, F.expr(f"{delay_s} + ({stagger_s} * pos) div n"))
    return placed.crossJoin(F.broadcast(n)).select("id", F.lit("available").alias("state"), when.alias("scheduled_at"), budgeted(F.col("attempt"), F.col("max_attempts"), budget).alias("max_attempts"))


def replay_account(jobs: DataFrame, scope: Column, states: tuple[str, ...] = ("discarded",), failed_since: Column | None = None, batch: int = 500) -> DataFrame:
    """As account; terminal jobs outside the target states are skipped, and the time narrows the changed ones alone."""
    hit = F.col("state").isin(*states)
    hit = hit if failed_since is None else hit & (F.col("finalized_at") >= failed_since)
    sums = live(jobs).where(scope).agg(
        F.count_if(hit).alias("changed"), F.count_if(is_terminal() & ~F.col("state").isin(*states)).alias("skipped_terminal"), F.count_if(F.col("state") == "running").alias("skipped_running")
    )
    return sums.withColumn("batches", F.expr(f"(changed + {batch - 1}) div {batch}"))


# retention


def cutoff(now: Column, max_age_s: int) -> Column | None:
    """No cutoff at an age of 0: retention is off."""
    return later(now, F.lit(-max_age_s)) if max_age_s > 0 else None


def _finished(before: Column) -> Column:
    return F.coalesce(is_terminal() & (F.col("finalized_at") < before), F.lit(False))


def retained(jobs: DataFrame, before: Column) -> DataFrame:
    """What retention keeps: all but terminal jobs finalized before the cutoff, deleted ones included."""
    return jobs.where(~_finished(before)).select("id", "state")


def retained_runs(jobs: DataFrame, runs: DataFrame, before: Column) -> DataFrame:
    """Attempts whose job retention keeps, and those without a job."""
    return runs.join(jobs.where(_finished(before)).select("job_key"), "job_key", "left_anti")


def pruned_batches(jobs: DataFrame, before: Column, size: int, batches: int) -> DataFrame:
    """ids that a retention of `batches` pages of `size` removes, the first by id; 0 batches is no cap."""
    gone = jobs.where(_finished(before)).select("id")
    return gone.orderBy("id").limit(size * batches) if batches > 0 else gone


def stopped_on_ceiling(jobs: DataFrame, before: Column, size: int, batches: int) -> DataFrame:
    """n removed, and whether that is all the pages allowed."""
    return pruned_batches(jobs, before, size, batches).agg(F.count("*").alias("n")).withColumn("on_ceiling", (F.lit(batches) > 0) & (F.col("n") == size * batches))
