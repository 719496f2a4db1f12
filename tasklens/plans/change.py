"""Queries of state transitions, enqueueing, schedules and limits, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasklens.functions import schedule
from tasklens.operators import enqueue, limiter, schedules, transitions, workload
from tasklens.operators.reads import is_terminal
from tasklens.plans.base import ACTIVE, CLAIM, DONE, JR, now, NOW_TEXT, PARENT, READY, tick, TICK_TEXT, A, C, H, J, P, at, frame, on
from tasklens.sources.project import ctes

jobs, both, arrivals, finals, periodics, ticks = on("jobs"), on("jobs", "job_runs"), on("arrivals", "jobs"), on("jobs", "results"), on("job_periodics"), on("job_periodics", "jobs")
holds, calls = on("limiter_holds"), on("limiter_calls")
JF = ctes("jobs", "results")
PJ = ctes("job_periodics", "jobs")

_EXPIRED = f"deleted_at IS NULL AND state = 'running' AND leased_until < {NOW_TEXT}"
_LANDED = f"""a AS (SELECT * FROM arrivals x WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.unique_key = x.unique_key) AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.unique_active_key = x.unique_active_key AND j.{ACTIVE})),
  b AS (SELECT * FROM a QUALIFY unique_key IS NULL OR row_number() OVER (PARTITION BY unique_key ORDER BY pos) = 1),
  landed AS (SELECT * FROM b QUALIFY unique_active_key IS NULL OR row_number() OVER (PARTITION BY unique_active_key ORDER BY pos) = 1)"""
# the truth table of a finalize, a row for each case, joined by the number of the first case that holds
_FINAL = """f AS (SELECT r.*, j.state, j.lease_token, j.attempt, j.max_attempts, j.scheduled_at, j.finalized_at, j.state = 'running' AND j.lease_token = r.token AS fence,
    CASE WHEN r.cancel THEN 1 WHEN r.snooze_s IS NOT NULL THEN 2 WHEN r.error_message IS NULL THEN 5 WHEN r.error_class IN ('permanent', 'validation') OR j.attempt >= j.max_attempts THEN 3 ELSE 4 END AS k,
    CASE WHEN r.error_class = '' THEN 'transient' ELSE r.error_class END AS cls
  FROM results r JOIN jobs j ON j.id = r.job_id),
  rule(k, to_state, kept, ends, free) AS (VALUES (1, 'cancelled', true, true, 0), (2, 'scheduled', false, false, 1), (3, 'discarded', true, true, 0), (4, 'retryable', false, false, 0), (5, 'succeeded', true, true, 0)),
  done AS (SELECT f.*, to_state, CASE f.k WHEN 1 THEN 'cancelled' WHEN 2 THEN 'snooze' WHEN 5 THEN 'success' ELSE CASE WHEN cls = 'timeout' THEN 'timeout' ELSE 'error' END END AS outcome,
    CASE WHEN kept THEN scheduled_at WHEN f.k = 2 THEN finished_at + to_seconds(snooze_s) ELSE finished_at + to_seconds(coalesce(delay_s, least(60, 1 << (greatest(attempt, 1) - 1)))) END AS new_s,
    CASE WHEN ends THEN finished_at ELSE finalized_at END AS new_f, CAST(max_attempts + free AS INT) AS new_m, CASE WHEN f.k IN (3, 4) THEN cls END AS run_class FROM f JOIN rule USING (k))"""
_NAMED = "('j0000000004'), ('j0000000008'), ('j0000000001'), ('j0000000014'), ('nowhere')"
_MISSED = f"""due AS (SELECT *, date_diff('second', next_run_at, {TICK_TEXT}) // interval_seconds AS last FROM job_periodics WHERE is_active AND next_run_at <= {TICK_TEXT}),
  buckets AS (SELECT slug, kind, queue, next_run_at + to_seconds(k * interval_seconds) AS bucket FROM (SELECT *, unnest(range(greatest(0, last - 9), last + 1)) AS k FROM due))"""


def _ids(j):
    return frame(j.sparkSession, "id string", ("j0000000004",), ("j0000000008",), ("j0000000001",), ("j0000000014",), ("nowhere",))


def _configured(p):
    return p.where("interval_seconds <= 420").select("slug")


def _wanted(p):
    """Half of the schedules with a new interval or as they are, and a new one."""
    some = p.where("interval_seconds % 120 = 0").select("slug", "kind", "queue", "cron_expr", F.when(F.col("interval_seconds") % 240 == 0, F.col("interval_seconds") + 60).otherwise(F.col("interval_seconds")).alias("interval_seconds"))
    return some.unionByName(frame(p.sparkSession, "slug string, kind string, queue string, cron_expr string, interval_seconds int", ("slug-new", "kind-1", "periodic", "0 * * * *", None)))


_PSQL = f"parent_job_id = '{PARENT}'"
_LIMITS = limiter.Limits(rate=2, interval_s=3600.0, burst=5, most_held=40)

TABLE = {
    "st01_landed": (arrivals(lambda a, j: enqueue.landed(a, j).select("id", "unique_key", "unique_active_key")), A + f", {_LANDED} SELECT id, unique_key, unique_active_key FROM landed"),
    "st01_unique_enqueue": (jobs(enqueue.first_of_unique), J + "SELECT id, unique_key FROM jobs QUALIFY unique_key IS NULL OR row_number() OVER (PARTITION BY unique_key ORDER BY created_at, id) = 1"),
    "jn12_free_keys": (arrivals(lambda a, j: a.where("unique_key IS NOT NULL").join(j.where("unique_key IS NOT NULL").select("unique_key"), "unique_key", "left_anti").select("id")), A + "SELECT id FROM arrivals WHERE unique_key IS NOT NULL AND unique_key NOT IN (SELECT unique_key FROM jobs WHERE unique_key IS NOT NULL)"),
    "jn13_read_back": (arrivals(enqueue.read_back), A + f", {_LANDED} SELECT pos, id, id IN (SELECT id FROM landed) AS landed FROM arrivals"),
    "sc24_defaults": (arrivals(lambda a, j: enqueue.with_defaults(a, now())), A + f"SELECT pos, id, kind, CASE WHEN queue = '' THEN 'default' ELSE queue END AS queue, CAST(CASE WHEN priority = 0 THEN 100 ELSE priority END AS INT) AS priority, 'available' AS state, 0 AS attempt, 25 AS max_attempts, {NOW_TEXT} AS scheduled_at, '{{}}' AS args, unique_key, unique_active_key FROM arrivals"),
    "sc25_insert_account": (arrivals(enqueue.insert_account), A + f", {_LANDED} SELECT (SELECT count(*) FROM landed) AS inserted, (SELECT count(*) FROM arrivals) - (SELECT count(*) FROM landed) AS skipped"),
    "sc25_chunks": (arrivals(lambda a, j: enqueue.chunks(a, 64)), A + "SELECT (pos - 1) // 64 AS chunk, count(*) AS n, min(pos) AS first_pos FROM arrivals GROUP BY 1"),
    "sc26_chunk_sizes": (lambda spark, sf: frame(spark, "dialect string, asked int, size int", *[(d, a, enqueue.chunk_size(d, a)) for d in ("postgres", "sqlite") for a in (-1, 0, 250, 1365, 99999)]), "SELECT dialect, asked, CAST(least(CASE WHEN asked <= 0 THEN 1000 ELSE asked END, most // 24) AS INT) AS size FROM (VALUES ('postgres', 65535), ('sqlite', 32766)) d(dialect, most), (VALUES (-1), (0), (250), (1365), (99999)) a(asked)"),
    "sc27_seeded_runs": (both(enqueue.seeded_runs), JR + f"""SELECT id AS job_id, CAST(greatest(1, attempt) AS INT) AS attempt, CASE state WHEN 'succeeded' THEN 'success' WHEN 'cancelled' THEN 'cancelled' ELSE 'error' END AS outcome, scheduled_at AS started_at, finalized_at AS finished_at, date_diff('millisecond', scheduled_at, finalized_at) AS duration_ms
  FROM jobs WHERE deleted_at IS NULL AND {DONE} AND id LIKE 'j%' AND id NOT IN (SELECT job_id FROM job_runs)"""),
    "sc28_run_stubs": (jobs(lambda j: transitions.run_stubs(transitions.claim(j, now(), 50, 30, "w"), now())), J + f"SELECT 'r-' || id || '-' || (attempt + 1) AS id, id AS job_id, attempt + 1 AS attempt, 'started' AS outcome, {NOW_TEXT} AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at FROM (SELECT * FROM jobs WHERE {READY} ORDER BY priority, scheduled_at, id LIMIT 50)"),
    "st02_claim": (jobs(lambda j: transitions.claim(j, now(), 80, 30, "w", ("q1", "q2"), "loadtest")), J + f"SELECT id, 'running' AS state, attempt + 1 AS attempt, {NOW_TEXT} + INTERVAL 30 SECOND AS leased_until, 'w-' || id AS lease_token FROM (SELECT * FROM jobs WHERE {READY} AND queue IN ('q1', 'q2') AND executor_class IN ('loadtest', '') ORDER BY priority, scheduled_at, id LIMIT 80)"),
    "jn05_claimed_snapshot": (jobs(lambda j: transitions.merged(j, transitions.claim(j, now(), 80, 30, "w")).select("id", "state", "attempt", "leased_until", "lease_token")), J + f""", c AS (SELECT id AS cid FROM jobs WHERE {READY} ORDER BY priority, scheduled_at, id LIMIT 80)
  SELECT id, CASE WHEN cid IS NULL THEN state ELSE 'running' END AS state, CAST(attempt + (cid IS NOT NULL)::INT AS INT) AS attempt, CASE WHEN cid IS NULL THEN leased_until ELSE {NOW_TEXT} + INTERVAL 30 SECOND END AS leased_until, CASE WHEN cid IS NULL THEN lease_token ELSE 'w-' || id END AS lease_token FROM jobs LEFT JOIN c ON cid = id"""),
    "st03_finalize_plan": (finals(lambda j, r: transitions.finalize_plan(r.join(j.select(F.col("id").alias("job_id"), "attempt", "max_attempts", "scheduled_at", "finalized_at"), "job_id")).select("job_id", "new_state", "outcome", "new_scheduled_at", "new_finalized_at", "new_max_attempts", "run_class")), JF + f", {_FINAL} SELECT job_id, to_state AS new_state, outcome, new_s AS new_scheduled_at, new_f AS new_finalized_at, new_m AS new_max_attempts, run_class FROM done"),
    "st04_finalize": (finals(transitions.finalize), JF + f""", {_FINAL} SELECT job_id, token, NOT fence AS superseded, outcome, run_class, CASE WHEN fence THEN to_state ELSE state END AS state, CASE WHEN fence THEN new_s ELSE scheduled_at END AS scheduled_at,
  CASE WHEN fence THEN new_f ELSE finalized_at END AS finalized_at, CASE WHEN fence THEN new_m ELSE max_attempts END AS max_attempts, CASE WHEN NOT fence THEN lease_token END AS lease_token FROM done"""),
    "pf11_fenced": (finals(lambda j, r: j.where("state = 'running'").join(r.select(F.col("job_id").alias("id"), F.col("token").alias("lease_token")), ["id", "lease_token"], "left_semi").select("id")), JF + "SELECT j.id FROM jobs j JOIN results r ON r.job_id = j.id AND r.token = j.lease_token WHERE j.state = 'running'"),
    "st05_renewed": (finals(lambda j, r: transitions.renewed(j, r, now())), JF + f"SELECT j.id, {NOW_TEXT} AS leased_until FROM jobs j JOIN results r ON r.job_id = j.id AND r.token = j.lease_token WHERE j.state = 'running'"),
    "st06_sweep": (jobs(lambda j: transitions.sweep(j, now())), J + f"SELECT id, 'available' AS state, CAST(NULL AS TIMESTAMP) AS leased_until, CAST(NULL AS VARCHAR) AS lease_token, scheduled_at, attempt FROM jobs WHERE {_EXPIRED}"),
    "pf10_expired": (jobs(lambda j: transitions.expired(j, now()).select("id", "leased_until")), J + f"SELECT id, leased_until FROM jobs WHERE {_EXPIRED}"),
    "sl08_sweep_batch": (jobs(lambda j: transitions.sweep_batch(j, now(), 40).select("id")), J + f"SELECT id FROM jobs WHERE {_EXPIRED} ORDER BY leased_until, id LIMIT 40"),
    "jn06_swept_snapshot": (jobs(lambda j: transitions.merged(j, transitions.sweep(j, now())).select("id", "state", "leased_until")), J + f"SELECT id, CASE WHEN {_EXPIRED} THEN 'available' ELSE state END AS state, CASE WHEN {_EXPIRED} THEN NULL ELSE leased_until END AS leased_until FROM jobs"),
    "jn16_crashed_stubs": (both(lambda j, r: transitions.crashed_stubs(r, transitions.sweep(j, now()), now())), JR + f"SELECT id, job_id, 'crashed' AS outcome, {NOW_TEXT} AS finished_at, CAST(NULL AS BIGINT) AS duration_ms, CAST(NULL AS VARCHAR) AS error_class FROM job_runs WHERE outcome = 'started' AND job_id IN (SELECT id FROM jobs WHERE {_EXPIRED})"),
    "st07_follow_ups": (jobs(lambda j: enqueue.follow_ups(j.where("state = 'succeeded'"), F.col("attempt"), 2)), J + "SELECT id || '-' || k AS id, id AS parent_job_id, queue, 'available' AS state FROM (SELECT id, queue, unnest(range(1, attempt + 1)) AS k FROM jobs WHERE state = 'succeeded' AND attempt BETWEEN 1 AND 2)"),
    "st07_refused": (jobs(lambda j: enqueue.refused_follow_ups(j.where("state = 'succeeded'"), F.col("attempt"), 2)), J + "SELECT id, CAST(attempt AS BIGINT) AS asked FROM jobs WHERE state = 'succeeded' AND attempt > 2"),
    "st08_barrier_problems": (jobs(lambda j: enqueue.barrier_problems(j.where("kind = 'coordinator'").select(F.col("id").alias("parent_job_id"), "barrier_kind", (F.length("id") - 10 + F.col("max_attempts") - 26).alias("children")))), J + "SELECT id AS parent_job_id, CASE WHEN barrier_kind IS NULL THEN 'no kind' ELSE 'no children' END AS problem FROM jobs WHERE kind = 'coordinator'"),
    "jn14_complete_parents": (jobs(lambda j: enqueue.complete_parents(j.withColumn("state", F.when(F.col("parent_job_id").like("%3"), "succeeded").otherwise(F.col("state"))))), J + f"SELECT parent_job_id, count(*) AS children FROM jobs j WHERE deleted_at IS NULL AND parent_job_id IS NOT NULL AND (parent_job_id LIKE '%3' OR NOT EXISTS (SELECT 1 FROM jobs k WHERE k.parent_job_id = j.parent_job_id AND k.deleted_at IS NULL AND NOT {DONE})) GROUP BY parent_job_id"),
    "st09_fired_barriers": (jobs(lambda j: enqueue.fired_barriers(j.withColumn("state", F.when(F.col("parent_job_id").like("%3"), "succeeded").otherwise(F.col("state"))))), J + f"""SELECT barrier_kind AS kind, 'default' AS queue, id AS parent_job_id, 'barrier:' || id AS unique_key, 'available' AS state FROM jobs p WHERE deleted_at IS NULL AND barrier_kind IS NOT NULL
  AND (SELECT count(*) FROM jobs c WHERE c.parent_job_id = p.id AND c.deleted_at IS NULL) > 0 AND NOT EXISTS (SELECT 1 FROM jobs c WHERE c.parent_job_id = p.id AND c.deleted_at IS NULL AND NOT (c.{DONE} OR c.parent_job_id LIKE '%3'))"""),
    "st10_pause": (jobs(lambda j: transitions.pause(j, transitions.of_parent(PARENT))), J + f"SELECT id, state AS was, 'paused' AS state FROM jobs WHERE deleted_at IS NULL AND {_PSQL} AND {CLAIM}"),
    "st11_resume": (jobs(lambda j: transitions.resume(j, F.col("queue") == "q1")), J + "SELECT id, state AS was, 'available' AS state FROM jobs WHERE deleted_at IS NULL AND queue = 'q1' AND state = 'paused'"),
    "st12_cancel": (jobs(lambda j: transitions.cancel(j, F.col("queue") == "q1", now())), J + f"SELECT id, state AS was, 'cancelled' AS state, {NOW_TEXT} AS finalized_at, CAST(NULL AS TIMESTAMP) AS leased_until, CAST(NULL AS VARCHAR) AS lease_token FROM jobs WHERE deleted_at IS NULL AND queue = 'q1' AND ({CLAIM} OR state = 'paused')"),
    "st13_account": (jobs(lambda j: transitions.account(j, F.col("queue") == "q1", transitions.CANCELLABLE, 100)), J + f"SELECT count(*) FILTER ({CLAIM} OR state = 'paused') AS changed, count(*) FILTER ({DONE}) AS skipped_terminal, count(*) FILTER (state = 'running') AS skipped_running, CAST(ceil(count(*) FILTER ({CLAIM} OR state = 'paused') / 100) AS BIGINT) AS batches FROM jobs WHERE deleted_at IS NULL AND queue = 'q1'"),
    "st14_retry": (jobs(lambda j: transitions.retry(j, j.where("job_key % 3 = 0").select("id"), now(), True, 4, 90)), J + f"SELECT id, 'available' AS state, {NOW_TEXT} + INTERVAL 90 SECOND AS scheduled_at, CAST(NULL AS TIMESTAMP) AS finalized_at, attempt + 4 AS max_attempts FROM jobs WHERE deleted_at IS NULL AND {DONE} AND job_key % 3 = 0"),
    "st15_cancel_jobs": (jobs(lambda j: transitions.cancel_jobs(j, j.where("job_key % 3 = 0").select("id"), now())), J + f"SELECT id, 'cancelled' AS state, {NOW_TEXT} AS finalized_at, CAST(NULL AS TIMESTAMP) AS leased_until, CAST(NULL AS VARCHAR) AS lease_token FROM jobs WHERE deleted_at IS NULL AND {ACTIVE} AND job_key % 3 = 0"),
    "st16_misses": (jobs(lambda j: transitions.misses(j, _ids(j), ~is_terminal())), J + f"SELECT k AS id, CASE WHEN state IS NULL THEN 'not found' ELSE 'is ' || state END AS problem FROM (VALUES {_NAMED}) w(k) LEFT JOIN (SELECT * FROM jobs WHERE deleted_at IS NULL) ON id = k WHERE state IS NULL OR {DONE}"),
    "st17_replay": (jobs(lambda j: transitions.replay(j, F.col("kind") == "kind-3", now(), ("discarded", "cancelled"), 3600, 30)), J + f"""SELECT id, 'available' AS state, {NOW_TEXT} + to_seconds(30 + 3600 * (row_number() OVER (ORDER BY id) - 1) // count(*) OVER ()) AS scheduled_at, attempt + max_attempts AS max_attempts
  FROM jobs WHERE deleted_at IS NULL AND kind = 'kind-3' AND state IN ('discarded', 'cancelled')"""),
    "st17_replay_since": (jobs(lambda j: transitions.replay(j, None, now(), budget=2, failed_since=at("TIMESTAMP '1996-01-01 00:00:00'"))), J + f"SELECT id, 'available' AS state, {NOW_TEXT} AS scheduled_at, attempt + 2 AS max_attempts FROM jobs WHERE deleted_at IS NULL AND state = 'discarded' AND finalized_at >= TIMESTAMP '1996-01-01 00:00:00'"),
    "st17_replay_account": (jobs(lambda j: transitions.replay_account(j, F.col("kind") == "kind-3", ("discarded",), at("TIMESTAMP '1996-01-01 00:00:00'"), 50)), J + "SELECT c AS changed, t AS skipped_terminal, r AS skipped_running, CAST(ceil(c / 50) AS BIGINT) AS batches FROM (SELECT count(*) FILTER (state = 'discarded' AND finalized_at >= TIMESTAMP '1996-01-01 00:00:00') AS c, count(*) FILTER (state IN ('succeeded', 'cancelled')) AS t, count(*) FILTER (state = 'running') AS r FROM jobs WHERE deleted_at IS NULL AND kind = 'kind-3')"),
    "wn07_staggered": (jobs(lambda j: transitions.replay(j, F.col("queue") == "q2", now(), ("cancelled",), 86_400).select("id", "scheduled_at")), J + f"SELECT id, {NOW_TEXT} + to_seconds(86400 * (row_number() OVER (ORDER BY id) - 1) // count(*) OVER ()) AS scheduled_at FROM jobs WHERE deleted_at IS NULL AND queue = 'q2' AND state = 'cancelled'"),
    "st18_retention": (jobs(lambda j: transitions.retained(j, at("TIMESTAMP '1996-01-01 00:00:00'"))), J + f"SELECT id, state FROM jobs WHERE NOT coalesce({DONE} AND finalized_at < TIMESTAMP '1996-01-01 00:00:00', false)"),
    "jn15_retained_runs": (both(lambda j, r: transitions.retained_runs(j, r, at("TIMESTAMP '1996-01-01 00:00:00'")).select("id")), JR + f"SELECT id FROM job_runs WHERE job_id NOT IN (SELECT id FROM jobs WHERE {DONE} AND finalized_at < TIMESTAMP '1996-01-01 00:00:00')"),
    "sl09_pruned_batches": (jobs(lambda j: transitions.pruned_batches(j, now(), 50, 2)), J + f"SELECT id FROM jobs WHERE {DONE} AND finalized_at < {NOW_TEXT} ORDER BY id LIMIT 100"),
    "pf24_on_ceiling": (jobs(lambda j: transitions.stopped_on_ceiling(j, now(), 50, 2)), J + f"SELECT least(100, count(*)) AS n, count(*) >= 100 AS on_ceiling FROM jobs WHERE {DONE} AND finalized_at < {NOW_TEXT}"),
    "pf25_cutoff": (jobs(lambda j: transitions.retained(j, transitions.cutoff(now(), 94_608_000))), J + f"SELECT id, state FROM jobs WHERE NOT coalesce({DONE} AND finalized_at < {NOW_TEXT} - INTERVAL 94608000 SECOND, false)"),
    "st25_expired_by_fault": (jobs(lambda j: transitions.expired_by_fault(j, now())), J + f"SELECT id, {NOW_TEXT} - INTERVAL 1 SECOND AS leased_until FROM jobs WHERE deleted_at IS NULL AND state = 'running'"),
    "st27_faulted": (finals(lambda j, r: workload.faulted(r, "outage", 0.3, 5).select("job_id", "error_message")), None),
    "jn18_unknown_kinds": (jobs(lambda j: enqueue.unknown_kinds(j, frame(j.sparkSession, "kind string", ("kind-0",), ("kind-1",), ("coordinator",)))), J + "SELECT id, kind, 'permanent' AS error_class FROM jobs WHERE deleted_at IS NULL AND kind IN ('kind-2', 'kind-3', 'kind-4')"),
    "pf20_periodic_view": (periodics(schedules.periodic_view), P + "SELECT slug, kind, queue, '' AS cron_expr, interval_seconds, next_run_at, is_active, 'every ' || interval_seconds || 's' AS cadence FROM job_periodics"),
    "pf21_invalid_schedules": (periodics(lambda p: schedules.invalid(p.withColumn("interval_seconds", F.when(F.col("interval_seconds") > 300, F.col("interval_seconds"))).withColumn("kind", F.when(F.col("slug").like("%2"), F.lit("")).otherwise(F.col("kind"))))), P + "SELECT slug, CASE WHEN slug LIKE '%2' THEN 'no kind' ELSE 'neither cron nor interval' END AS problem FROM job_periodics WHERE slug LIKE '%2' OR interval_seconds <= 300"),
    "st19_upserted": (periodics(lambda p: schedules.upserted(p, _wanted(p), tick())), P + f"""SELECT slug, kind, queue, cron_expr, CAST(CASE WHEN interval_seconds % 240 = 0 THEN interval_seconds + 60 ELSE interval_seconds END AS INT) AS interval_seconds,
  CASE WHEN interval_seconds % 240 = 0 THEN {TICK_TEXT} ELSE next_run_at END AS next_run_at, is_active FROM job_periodics UNION ALL SELECT 'slug-new', 'kind-1', 'periodic', '0 * * * *', NULL, {TICK_TEXT}, true"""),
    "st20_toggled": (periodics(lambda p: schedules.toggled(p, _configured(p), False)), P + "SELECT slug, CASE WHEN interval_seconds <= 420 THEN false ELSE is_active END AS is_active FROM job_periodics"),
    "st20_deleted": (periodics(lambda p: schedules.without(p, _configured(p)).select("slug")), P + "SELECT slug FROM job_periodics WHERE interval_seconds > 420"),
    "jn17_orphans": (periodics(lambda p: schedules.orphans(p, _configured(p))), P + "SELECT slug FROM job_periodics WHERE is_active AND interval_seconds > 420"),
    "fn07_missed_intervals": (periodics(lambda s: schedule.missed(s, tick(), 10)), P + f", {_MISSED} SELECT slug, bucket FROM buckets"),
    "fn07_missed_unlimited": (periodics(lambda s: schedule.missed(s, tick(), 0)), P + f"SELECT slug, unnest(generate_series(next_run_at, {TICK_TEXT}, to_seconds(interval_seconds))) AS bucket FROM job_periodics WHERE is_active AND next_run_at <= {TICK_TEXT}"),
    "fn06_next_runs": (periodics(lambda s: schedule.next_runs(s, tick())), P + f"SELECT slug, CASE WHEN next_run_at <= {TICK_TEXT} THEN next_run_at + to_seconds((date_diff('second', next_run_at, {TICK_TEXT}) // interval_seconds + 1) * interval_seconds) ELSE next_run_at END AS next_run_at FROM job_periodics WHERE is_active"),
    "st21_tick_jobs": (ticks(lambda p, j: schedules.tick_jobs(p, j, tick())), PJ + f", {_MISSED} SELECT slug || '@' || CAST(epoch(bucket) AS BIGINT) AS unique_key, slug, kind, queue, bucket AS scheduled_at, 'available' AS state FROM buckets"),
    "st21_ticked": (ticks(lambda p, j: schedules.ticked(p, j, tick())), PJ + f", {_MISSED} SELECT slug, CASE WHEN next_run_at <= {TICK_TEXT} THEN next_run_at + to_seconds((date_diff('second', next_run_at, {TICK_TEXT}) // interval_seconds + 1) * interval_seconds) ELSE next_run_at END AS next_run_at, CASE WHEN slug IN (SELECT slug FROM buckets) THEN {TICK_TEXT} END AS last_enqueued_at FROM job_periodics WHERE is_active"),
    "ag11_live_holds": (holds(lambda h: limiter.live_holds(h, at("TIMESTAMP '1996-01-01 00:00:00'"))), H + "SELECT resource, CAST(sum(n) AS BIGINT) AS held FROM limiter_holds WHERE expires_at >= TIMESTAMP '1996-01-01 00:00:00' AND n > 0 GROUP BY resource"),
    "st24_swept_holds": (holds(lambda h: limiter.swept_holds(h, at("TIMESTAMP '1996-01-01 00:00:00'"))), H + "SELECT token, resource FROM limiter_holds WHERE expires_at < TIMESTAMP '1996-01-01 00:00:00' OR n <= 0"),
    "pf15_coalesced": (holds(lambda h: h.where("n > 99").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))), H + "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total, coalesce(max(n), 0) AS most FROM limiter_holds WHERE n > 99"),
    "st22_local_limiter": (calls(lambda c: limiter.folded(c, _LIMITS)), None),
    "st23_shared_limiter": (calls(lambda c: limiter.folded(c, _LIMITS, ttl_s=7200.0)), None),
    "st22_call_counts": (calls(lambda c: limiter.folded(c, limiter.Limits(0, 1.0, 0)).groupBy("resource").agg(F.count("*").alias("calls"))), C + "SELECT resource, count(*) AS calls FROM limiter_calls GROUP BY resource"),
}
