"""Audits of attempts and runs of a load: budgets, overlaps, exactly once, fairness, utilization, storage samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklens.operators.ordering import numbered, with_previous, with_runs
from tasklens.operators.reads import ACTIVE, is_terminal, live

#: Rows of a bucket of positions, and claims of a fairness window.
BUCKET, WINDOW = 1 << 16, 64


def over_budget(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """most: the greatest number of attempts beyond a job's budget; 0 if there are no jobs with attempts."""
    counts = runs.groupBy("job_key", "job_id").agg(F.count("*").alias("cnt"))
    over = jobs.join(counts, "job_key").agg(F.max(F.col("cnt") - F.col("max_attempts")).alias("most"))
    return over.select(F.coalesce("most", F.lit(0).cast("long")).alias("most"))


def superseded_residue(jobs: DataFrame, runs: DataFrame, outcome: str = "success", state: str = "succeeded") -> DataFrame:
    """n: attempts of an outcome whose job is not in the state that goes with it."""
    return runs.where(F.col("outcome") == outcome).join(jobs.select("job_key", "state"), "job_key").where(F.col("state") != state).agg(F.count("*").alias("n"))


def overlapping_attempts(runs: DataFrame) -> DataFrame:
    """Pairs of one job's finished, uncrashed attempts whose spans overlap.

    A job's attempts, which its budget bounds, meet in one array, so the attempts are numbered and moved once.
    """
    done = runs.where("finished_at IS NOT NULL AND outcome <> 'crashed'")
    grouped = done.groupBy("job_key", "job_id").agg(F.collect_list(F.struct("attempt", "started_at", "finished_at")).alias("r")).where(F.size("r") > 1)
    met = "flatten(transform(r, a -> transform(filter(r, b -> a.attempt < b.attempt AND a.started_at < b.finished_at AND b.started_at < a.finished_at), b -> struct(a.attempt AS first, b.attempt AS second))))"
    pairs = grouped.select("job_id", F.explode(F.expr(met)).alias("p"))
    return pairs.select("job_id", F.col("p.first").alias("first_attempt"), F.col("p.second").alias("second_attempt"))


def with_facts(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """A host's facts (run_id, ...) with the attempt that they are of."""
    return facts.join(runs.select(F.col("id").alias("run_id"), "job_id", "outcome"), "run_id")


def crash_loops(runs: DataFrame) -> DataFrame:
    """Jobs that crashed more than once, the most frequent ones first."""
    return runs.where("outcome = 'crashed'").groupBy("job_id").agg(F.count("*").alias("crashes")).where("crashes > 1").orderBy(F.desc("crashes"), "job_id")


def exactly_once(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Success rows less succeeded jobs, attempts still started, and finished ones without an end."""
    succeeded = jobs.agg(F.count_if(F.col("state") == "succeeded").alias("jobs"))
    sums = runs.agg(
        F.count_if(F.col("outcome") == "success").alias("successes"), F.count_if(F.col("outcome") == "started").alias("still_started"),
        F.count_if((F.col("outcome") != "started") & F.col("finished_at").isNull()).alias("without_end"),
    )
    return sums.crossJoin(succeeded).select((F.col("successes") - F.col("jobs")).alias("extra_successes"), "still_started", "without_end")  # one row each


def due_counts(jobs: DataFrame, now: Column) -> DataFrame:
    """In one pass: jobs still to do, those due, and the first and last time of the ones that lie ahead."""
    waits = F.col("state").isin("available", "retryable", "scheduled")
    ahead = F.when(waits & (F.col("scheduled_at") > now), F.col("scheduled_at"))
    return jobs.agg(F.count_if(F.col("state").isin(*ACTIVE)).alias("left"), F.count_if(waits & (F.col("scheduled_at") <= now)).alias("due"), F.min(ahead).alias("first_ahead"), F.max(ahead).alias("last_ahead"))


# fairness


def _claims(claims: DataFrame) -> DataFrame:
    return numbered(claims.select("seq", "parent_ordinal"), F.expr(f"seq div {BUCKET}"), "seq")


def parent_shares(claims: DataFrame, width: int = WINDOW) -> DataFrame:
    """parent_ordinal, claims, min_share: the least share of a window of a parent that still had work when it began.

    A parent has work left up to its last window, so it has share 0 if it is absent from one before that.
    """
    counts = _claims(claims).groupBy(F.expr(f"pos div {width}").alias("w"), "parent_ordinal").agg(F.count("*").alias("cnt"))
    widths = counts.groupBy("w").agg(F.sum("cnt").alias("width"))
    shares = counts.join(widths, "w").groupBy("parent_ordinal").agg(
        F.sum("cnt").alias("claims"), F.count("*").alias("present"), F.max("w").alias("last_w"), F.min(F.col("cnt") / F.col("width")).alias("least")
    )
    return shares.select("parent_ordinal", "claims", F.when(F.col("present") < F.col("last_w") + 1, F.lit(0.0)).otherwise(F.col("least")).alias("min_share"))


def fairness(claims: DataFrame, width: int = WINDOW) -> DataFrame:
    """min_share over all parents; 0 for no claims."""
    return parent_shares(claims, width).agg(F.coalesce(F.min("min_share"), F.lit(0.0)).alias("min_share"))


def longest_run(claims: DataFrame) -> DataFrame:
    """longest: the most claims of one parent in a row; 0 for no claims."""
    runs = with_runs(claims.select("seq", "parent_ordinal"), F.expr(f"seq div {BUCKET}"), "seq", "parent_ordinal")
    return runs.groupBy("run").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest"))


# streaks


def denial_streaks(events: DataFrame, least: int) -> DataFrame:
    """kind, first_seq, last_seq, n of `least` or more events of one kind in a row, in the order of seq."""
    runs = with_runs(events.select("seq", "event"), F.expr(f"seq div {BUCKET}"), "seq", "event")
    return runs.groupBy("run").agg(F.first("event").alias("event"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run")


def skip_streaks(events: DataFrame, skipped: Column) -> DataFrame:
    """seq, streak of each skipped tick: how many in a row up to it; one that is not skipped starts anew."""
    runs = with_runs(events.select("seq", skipped.alias("skipped")), F.expr(f"seq div {BUCKET}"), "seq", "skipped")
    return runs.where("skipped").select("seq", F.row_number().over(Window.partitionBy("run").orderBy("seq")).alias("streak"))


# measures of a load


def utilization(runs: DataFrame, runners: int, workers: int, wall_ms: int) -> DataFrame:
    return runs.agg((F.coalesce(F.sum("duration_ms"), F.lit(0)) / F.lit(runners * workers * wall_ms)).alias("utilization"))


def throughput(events: DataFrame, seconds: int) -> DataFrame:
    """terminal: finished less retried; per_second: over so many seconds."""
    done = events.agg((F.count_if(F.col("event") == "finish") - F.count_if(F.col("event") == "retry")).alias("terminal"))
    return done.select("terminal", (F.col("terminal") / F.lit(seconds)).alias("per_second"))


def drained(jobs: DataFrame) -> DataFrame:
    """fraction of jobs that are terminal, from 0 to 1; 0 for no jobs."""
    share = F.count_if(is_terminal()) / F.nullif(F.count("*"), F.lit(0))
    return jobs.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)))).alias("fraction"))


def peaks(samples: DataFrame, high_water: int = 0) -> DataFrame:
    """The greatest of each gauge; the resident size is that of the samples or of the system's own high-water mark."""
    return samples.agg(F.greatest(F.max("rss"), F.lit(high_water).cast("long")).alias("peak_rss"), F.max("max_xact_age").alias("peak_xact_age"), F.max("lock_waits").alias("peak_lock_waits"), F.max("longest_lock_wait").alias("peak_lock_wait"))


def wal_deltas(samples: DataFrame) -> DataFrame:
    """seq, delta: bytes written since the sample before, 0 for the first one and after the counter has gone back."""
    made = with_previous(samples.select("seq", "wal_bytes"), F.expr(f"seq div {BUCKET}"), "seq", "wal_bytes")
    return made.select("seq", F.greatest(F.lit(0), F.coalesce(F.col("wal_bytes") - F.col("previous"), F.lit(0))).cast("long").alias("delta"))


def distinct_errors(runs: DataFrame, most: int) -> DataFrame:
    """message, n of the first `most` error messages in the order in which they were first seen, with their counts."""
    found = runs.where("error_message IS NOT NULL").groupBy(F.col("error_message").alias("message")).agg(F.count("*").alias("n"), F.min(F.struct("started_at", "id")).alias("first"))
    return found.orderBy("first").limit(most).select("message", "n")


def reconvergence(before: DataFrame, after: DataFrame, runs: DataFrame) -> DataFrame:
    """Succeeded jobs before and after a replay, and attempts beyond budgets after it."""
    done = lambda jobs, name: jobs.agg(F.count_if(F.col("state") == "succeeded").alias(name))
    return done(before, "before").crossJoin(done(after, "after")).crossJoin(over_budget(after, runs).withColumnRenamed("most", "over_budget"))  # one row each


def backoff_account(runs: DataFrame) -> DataFrame:
    """cohort, attempts, attempts_per_job and the span in seconds of jobs with failed attempts."""
    failed = runs.where("outcome IN ('error', 'timeout')")
    sums = failed.agg(F.count_distinct("job_id").alias("cohort"), F.count("*").alias("attempts"), F.min("started_at").alias("a"), F.max("started_at").alias("b"))
    return sums.select("cohort", "attempts", (F.col("attempts") / F.nullif(F.col("cohort"), F.lit(0))).alias("attempts_per_job"), F.expr("timestampdiff(SECOND, a, b)").alias("span_s"))


def admission_cost(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """rows: attempts for each job that has succeeded."""
    sums = runs.agg(F.count("*").alias("runs")).crossJoin(jobs.agg(F.count_if(F.col("state") == "succeeded").alias("drained")))  # one row each
    return sums.select("runs", "drained", (F.col("runs") / F.nullif(F.col("drained"), F.lit(0))).alias("rows_per_job"))


def deficit(jobs: DataFrame, target: int) -> DataFrame:
    """missing: jobs that a closed loop must add to hold its target."""
    return live(jobs).agg(F.greatest(F.lit(0), F.lit(target) - F.count_if(F.col("state").isin(*ACTIVE))).cast("long").alias("missing"))


def gate_sums(gates: DataFrame) -> DataFrame:
    """blocked, orphaned: claims held back and finalizes lost, over all gates (blocked, orphaned)."""
    return gates.agg(F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"), F.coalesce(F.sum("orphaned"), F.lit(0)).alias("orphaned"))


def oldest_transaction(sessions: DataFrame, now: Column) -> DataFrame:
    """age_s of the oldest open transaction of sessions (xact_start, null if idle); 0 if none is open."""
    return sessions.agg(F.coalesce(F.greatest(F.lit(0), F.max(F.timestamp_diff("SECOND", F.col("xact_start"), now))), F.lit(0)).cast("long").alias("age_s"))


def lock_waits(locks: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """waits, longest_s of locks (pid, granted) not granted, with their sessions (pid, wait_start)."""
    waiting = locks.where("NOT granted").join(sessions, "pid")
    longest = F.coalesce(F.max(F.timestamp_diff("SECOND", F.col("wait_start"), now)), F.lit(0)).cast("long")
    return waiting.agg(F.count("*").alias("waits"), longest.alias("longest_s"))


def sampled_bloat(samples: DataFrame, every: int = 10) -> DataFrame:
    """seq, dead_share of every tenth sample (seq, live, dead)."""
    share = F.coalesce(F.col("dead") / F.nullif(F.col("live") + F.col("dead"), F.lit(0)), F.lit(0.0))
    return samples.where(F.col("seq") % every == 0).select("seq", share.alias("dead_share"))
