"""Queries of scans, views, selections, progress and audits, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasklens.operators import audit, reads, workload
from tasklens.plans.base import ACTIVE, BUSY, CLAIM, COUNTS, DONE, JR, L, now, NOW_TEXT, PARENT, READY, J, R, S, alone, at, frame, on

jobs, runs, both, events, samples = on("jobs"), on("job_runs"), on("jobs", "job_runs"), on("lifecycle"), on("storage_samples")

_VIEW = "id, kind, queue, state, priority, attempt, max_attempts, coalesce(parent_job_id, '') AS parent_job_id, created_at AS enqueued_at, scheduled_at, finalized_at"
_RUN = "id, job_id, attempt, outcome, error_class, error_message, nullif(output, '') AS output, started_at, finished_at, duration_ms"
_LAST = "last AS (SELECT * FROM job_runs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY attempt DESC) = 1)"
_POS = "t AS (SELECT parent_ordinal AS g, seq, (row_number() OVER (ORDER BY seq) - 1) // 64 AS w FROM lifecycle)"
_GRID = f"""{_POS}, c AS (SELECT g, w, count(*) AS cnt FROM t GROUP BY ALL),
  grid AS (SELECT g, w, width FROM (SELECT DISTINCT g FROM t), (SELECT w, count(*) AS width FROM t GROUP BY w)),
  d AS (SELECT grid.g, width, coalesce(cnt, 0) AS cnt, sum(coalesce(cnt, 0)) OVER (PARTITION BY grid.g ORDER BY grid.w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM grid LEFT JOIN c USING (g, w))"""


def _wanted(spark, schema, *values):
    return frame(spark, schema, *[(v,) for v in values])


def _progress(key: str, wanted: str, state: str = "") -> str:
    """Zero-filled progress of wanted keys; correlated, unlike the operator."""
    n = f"(SELECT count(*) FROM jobs j WHERE j.deleted_at IS NULL AND j.{key} = w.k"
    return f"""SELECT k AS {key}, {n}) AS total, {n} AND {DONE}) AS terminal, {n} AND NOT {DONE}) AS pending,
  coalesce((SELECT {COUNTS} FROM (SELECT state, count(*) AS n FROM jobs j WHERE j.deleted_at IS NULL AND j.{key} = w.k GROUP BY state)), '') AS counts{state} FROM (VALUES {wanted}) w(k)"""


_STATE = ", coalesce((SELECT state FROM jobs p WHERE p.id = w.k AND p.deleted_at IS NULL), '') AS parent_state"

TABLE = {
    "sc01_live_jobs": (jobs(lambda j: reads.live(j).select("id", "state")), J + "SELECT id, state FROM jobs WHERE deleted_at IS NULL"),
    "sc02_all_jobs": (jobs(lambda j: j.select("id", "state", F.col("deleted_at").isNotNull().alias("deleted"))), J + "SELECT id, state, deleted_at IS NOT NULL AS deleted FROM jobs"),
    "sc03_find_job": (jobs(lambda j: reads.find_job(j, "j0000000011")), J + f"SELECT {_VIEW} FROM jobs WHERE id = 'j0000000011' AND deleted_at IS NULL"),
    "sc16_series": (alone(lambda s: workload.series(s, 1000, reads.STATES)), "SELECT g, (['available', 'running', 'retryable', 'scheduled', 'paused', 'succeeded', 'cancelled', 'discarded'])[1 + g % 8] AS state FROM (SELECT unnest(range(1, 1001)) AS g)"),
    "sc31_claimable_spread": (alone(lambda s: workload.claimable_spread(s, 500, 3, ("", "a", "b", "c"))), "SELECT i, 'q' || (i % 3) AS queue, CASE i % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS executor_class, CAST(100 + i % 5 AS INT) AS priority FROM (SELECT unnest(range(500)) AS i)"),
    "pf01_job_view": (jobs(lambda j: reads.job_view(reads.live(j))), J + f"SELECT {_VIEW} FROM jobs WHERE deleted_at IS NULL"),
    "pf02_run_view": (runs(reads.run_view), R + f"SELECT {_RUN} FROM job_runs"),
    "pf03_filtered_jobs": (jobs(lambda j: reads.list_jobs(j, "succeeded", "kind-2", 30)), J + f"SELECT {_VIEW} FROM jobs WHERE deleted_at IS NULL AND state = 'succeeded' AND kind = 'kind-2' ORDER BY created_at DESC, id DESC LIMIT 30"),
    "pf04_in_states": (jobs(lambda j: j.where(F.col("state").isin("paused", "running")).select("id")), J + "SELECT id FROM jobs WHERE state IN ('paused', 'running')"),
    "pf05_terminal_outside": (jobs(lambda j: reads.terminal_outside(j, ("discarded",))), J + "SELECT id, state FROM jobs WHERE deleted_at IS NULL AND state IN ('succeeded', 'cancelled')"),
    "pf07_finalized": (jobs(lambda j: j.where(F.col("finalized_at").isNotNull()).select("id", "finalized_at")), J + "SELECT id, finalized_at FROM jobs WHERE finalized_at IS NOT NULL"),
    "pf08_routed": (jobs(lambda j: reads.routed(j, "loadtest").select("id", "executor_class")), J + "SELECT id, executor_class FROM jobs WHERE executor_class IN ('loadtest', '')"),
    "pf09_claimable": (jobs(lambda j: reads.claim_batch(j, now(), 1 << 30, ("q0", "q2"), "loadtest-b").select("id")), J + f"SELECT id FROM jobs WHERE {READY} AND queue IN ('q0', 'q2') AND executor_class IN ('loadtest-b', '')"),
    "pf17_terminal_flags": (jobs(lambda j: j.select("id", reads.is_terminal().alias("terminal"))), J + f"SELECT id, {DONE} AS terminal FROM jobs"),
    "pf18_invalid_rows": (both(lambda j, r: reads.invalid_rows(j.withColumn("state", F.when(F.col("job_key") % 100 == 3, "lost").otherwise(F.col("state"))), r)), JR + """, b AS (SELECT * REPLACE (CASE WHEN job_key % 100 = 3 THEN 'lost' ELSE state END AS state) FROM jobs)
  SELECT 'jobs' AS relation, id, 'state' AS problem FROM b WHERE state = 'lost' UNION ALL SELECT 'jobs', id, 'lease' FROM b WHERE (state = 'running') <> (lease_token IS NOT NULL)
  UNION ALL SELECT 'job_runs', id, 'end' FROM job_runs WHERE (outcome = 'started') <> (finished_at IS NULL)"""),
    "pf19_active_of_kind": (jobs(lambda j: reads.active_of_kind(j, "kind-1")), J + f"SELECT id, state, args FROM jobs WHERE deleted_at IS NULL AND kind = 'kind-1' AND {ACTIVE}"),
    "jn01_recent_failures": (both(lambda j, r: reads.recent_failures(j, r, 40, at("TIMESTAMP '1995-06-01 00:00:00'"))), JR + f""", {_LAST} SELECT j.id, j.kind, finalized_at, coalesce(last.attempt, j.attempt) AS attempt, outcome, error_class, error_message
  FROM (SELECT * FROM jobs WHERE deleted_at IS NULL AND state = 'discarded' AND finalized_at >= TIMESTAMP '1995-06-01 00:00:00' ORDER BY finalized_at DESC, id DESC LIMIT 40) j LEFT JOIN last ON last.job_id = j.id"""),
    "jn02_child_outputs": (both(lambda j, r: reads.child_outputs(j, r, BUSY, 20)), JR + f""", {_LAST} SELECT j.id, j.state, coalesce(last.attempt, 0) AS attempt, nullif(output, '') AS output
  FROM (SELECT * FROM jobs WHERE deleted_at IS NULL AND {DONE} AND parent_job_id = '{BUSY}' ORDER BY id LIMIT 20) j LEFT JOIN last ON last.job_id = j.id"""),
    "jn03_progress_many": (jobs(lambda j: reads.progress_many(j, _wanted(j.sparkSession, "parent_job_id string", PARENT, "p0000000010", "p9999999999"))), J + _progress("parent_job_id", f"('{PARENT}'), ('p0000000010'), ('p9999999999')", _STATE)),
    "jn04_progress_of_kinds": (jobs(lambda j: reads.progress_by_kind(j, _wanted(j.sparkSession, "kind string", "kind-1", "absent"))), J + _progress("kind", "('kind-1'), ('absent')")),
    "jn07_over_budget": (both(audit.over_budget), JR + "SELECT coalesce(max(cnt - max_attempts), 0) AS most FROM jobs JOIN (SELECT job_id, count(*) AS cnt FROM job_runs GROUP BY job_id) ON job_id = id"),
    "jn08_superseded": (both(audit.superseded_residue), JR + "SELECT count(*) AS n FROM job_runs r JOIN jobs j ON j.id = r.job_id WHERE r.outcome = 'success' AND j.state <> 'succeeded'"),
    "jn09_overlapping_attempts": (runs(audit.overlapping_attempts), R + """, d AS (SELECT * FROM job_runs WHERE finished_at IS NOT NULL AND outcome <> 'crashed')
  SELECT a.job_id, a.attempt AS first_attempt, b.attempt AS second_attempt FROM d a JOIN d b ON a.job_id = b.job_id AND a.attempt < b.attempt AND a.started_at < b.finished_at AND b.started_at < a.finished_at"""),
    "jn10_with_facts": (runs(lambda r: audit.with_facts(r.where("cost_micros % 7 = 0").select(F.col("id").alias("run_id"), F.col("cost_micros").alias("fact")), r)), R + "SELECT id AS run_id, cost_micros AS fact, job_id, outcome FROM job_runs WHERE cost_micros % 7 = 0"),
    "ag01_state_counts": (jobs(lambda j: reads.state_counts(reads.live(j))), J + "SELECT state, count(*) AS n FROM jobs WHERE deleted_at IS NULL GROUP BY ROLLUP (state)"),
    "ag01_state_counts_of_kind": (jobs(lambda j: reads.state_counts(reads.live(j), True, "kind-3")), J + "SELECT state, count(*) AS n FROM jobs WHERE deleted_at IS NULL AND kind = 'kind-3' GROUP BY state UNION ALL SELECT NULL, count(*) FROM jobs WHERE deleted_at IS NULL AND kind = 'kind-3'"),
    "ag02_state_counts_all": (jobs(lambda j: reads.state_counts(j, False)), J + "SELECT state, count(*) AS n FROM jobs GROUP BY state"),
    "ag03_queue_health": (jobs(lambda j: reads.queue_health(j, now())), J + f"""SELECT count(*) FILTER ({READY}) AS ready, count(*) FILTER (state = 'running') AS inflight, count(*) FILTER ({CLAIM} AND scheduled_at > {NOW_TEXT}) AS scheduled_ahead,
  coalesce(greatest(0, date_diff('second', min(scheduled_at) FILTER ({READY}), {NOW_TEXT})), 0) AS oldest_ready_age_s,
  (SELECT {COUNTS} FROM (SELECT state, count(*) AS n FROM jobs WHERE deleted_at IS NULL GROUP BY state)) AS counts FROM jobs WHERE deleted_at IS NULL"""),
    "ag04_progress": (jobs(lambda j: reads.progress(j, PARENT, now())), J + f"""SELECT '{PARENT}' AS parent_job_id, count(*) AS total, count(*) FILTER ({DONE}) AS terminal, count(*) FILTER (NOT {DONE}) AS pending,
  (SELECT {COUNTS} FROM (SELECT state, count(*) AS n FROM jobs WHERE deleted_at IS NULL AND parent_job_id = '{PARENT}' GROUP BY state)) AS counts,
  coalesce(greatest(0, date_diff('second', min(scheduled_at) FILTER (NOT {DONE}), {NOW_TEXT})), 0) AS oldest_pending_age_s, coalesce((SELECT state FROM jobs WHERE id = '{PARENT}' AND deleted_at IS NULL), '') AS parent_state
  FROM jobs WHERE deleted_at IS NULL AND parent_job_id = '{PARENT}'"""),
    "ag05_progress_by_parent": (jobs(lambda j: reads.progress_by_parent(j).drop("counts")), J + f"""SELECT c.parent_job_id, count(*) AS total, count(*) FILTER (c.{DONE}) AS terminal, count(*) FILTER (NOT c.{DONE}) AS pending, coalesce(any_value(p.state), '') AS parent_state
  FROM jobs c LEFT JOIN jobs p ON p.id = c.parent_job_id AND p.deleted_at IS NULL WHERE c.deleted_at IS NULL AND c.parent_job_id IS NOT NULL GROUP BY c.parent_job_id"""),
    "ag06_progress_by_kind": (jobs(reads.progress_by_kind), J + f"""SELECT kind, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER ({DONE}), 0) AS BIGINT) AS terminal, CAST(coalesce(sum(n) FILTER (NOT {DONE}), 0) AS BIGINT) AS pending, {COUNTS} AS counts
  FROM (SELECT kind, state, count(*) AS n FROM jobs WHERE deleted_at IS NULL GROUP BY ALL) GROUP BY kind"""),
    "ag08_global_counts": (both(reads.global_counts), JR + f"SELECT (SELECT count(*) FROM job_runs) AS runs, count(*) FILTER (deleted_at IS NULL AND {ACTIVE}) AS active_jobs, count(*) FILTER (NOT {DONE}) AS pending_jobs FROM jobs"),
    "ag09_due_counts": (jobs(lambda j: audit.due_counts(j, now())), J + f"SELECT count(*) FILTER ({ACTIVE}) AS \"left\", count(*) FILTER ({CLAIM} AND scheduled_at <= {NOW_TEXT}) AS due, min(scheduled_at) FILTER ({CLAIM} AND scheduled_at > {NOW_TEXT}) AS first_ahead, max(scheduled_at) FILTER ({CLAIM} AND scheduled_at > {NOW_TEXT}) AS last_ahead FROM jobs"),
    "ag10_crash_loops": (runs(audit.crash_loops), R + "SELECT job_id, count(*) AS crashes FROM job_runs WHERE outcome = 'crashed' GROUP BY job_id HAVING count(*) > 1"),
    "ag13_parents": (jobs(lambda j: j.select("parent_job_id").where("parent_job_id IS NOT NULL").distinct()), J + "SELECT DISTINCT parent_job_id FROM jobs WHERE parent_job_id IS NOT NULL"),
    "ag27_utilization": (runs(lambda r: audit.utilization(r, 4, 8, 10**12)), R + "SELECT sum(duration_ms) / (4 * 8 * 1000000000000.0::DOUBLE) AS utilization FROM job_runs"),
    "ag28_throughput": (events(lambda e: audit.throughput(e, 3600)), L + "SELECT count(*) FILTER (event = 'finish') - count(*) FILTER (event = 'retry') AS terminal, (count(*) FILTER (event = 'finish') - count(*) FILTER (event = 'retry')) / 3600 AS per_second FROM lifecycle"),
    "ag29_drained": (jobs(audit.drained), J + f"SELECT count(*) FILTER ({DONE}) / count(*) AS fraction FROM jobs"),
    "ag30_peaks": (samples(lambda s: audit.peaks(s)), S + "SELECT max(rss) AS peak_rss, max(max_xact_age) AS peak_xact_age, max(lock_waits) AS peak_lock_waits, max(longest_lock_wait) AS peak_lock_wait FROM storage_samples"),
    "ag31_distinct_errors": (runs(lambda r: audit.distinct_errors(r, 10)), R + "SELECT error_message AS message, count(*) AS n FROM job_runs WHERE error_message IS NOT NULL GROUP BY error_message ORDER BY min(struct_pack(a := started_at, b := id)) LIMIT 10"),
    "ag32_reconvergence": (both(lambda j, r: audit.reconvergence(j, j.withColumn("state", F.when(F.col("state") == "discarded", "succeeded").otherwise(F.col("state"))), r)), JR + """SELECT count(*) FILTER (state = 'succeeded') AS before, count(*) FILTER (state IN ('succeeded', 'discarded')) AS after,
  (SELECT max((SELECT count(*) FROM job_runs r WHERE r.job_id = j.id) - max_attempts) FROM jobs j WHERE EXISTS (SELECT 1 FROM job_runs r WHERE r.job_id = j.id)) AS over_budget FROM jobs"""),
    "ag33_backoff_account": (runs(audit.backoff_account), R + "SELECT count(DISTINCT job_id) AS cohort, count(*) AS attempts, count(*) / count(DISTINCT job_id) AS attempts_per_job, date_diff('second', min(started_at), max(started_at)) AS span_s FROM job_runs WHERE outcome IN ('error', 'timeout')"),
    "ag34_admission_cost": (both(audit.admission_cost), JR + "SELECT r AS runs, d AS drained, r / d AS rows_per_job FROM (SELECT (SELECT count(*) FROM job_runs) AS r, (SELECT count(*) FROM jobs WHERE state = 'succeeded') AS d)"),
    "ag35_exactly_once": (both(audit.exactly_once), JR + """SELECT count(*) FILTER (outcome = 'success') - (SELECT count(*) FROM jobs WHERE state = 'succeeded') AS extra_successes,
  count(*) FILTER (outcome = 'started') AS still_started, count(*) FILTER (outcome <> 'started' AND finished_at IS NULL) AS without_end FROM job_runs"""),
    "ag37_status": (both(lambda j, r: reads.queue_health(j, now()).select(F.lit("health").alias("part"), F.lit("ready").alias("name"), F.col("ready").cast("string").alias("value")).unionByName(reads.state_counts(reads.live(j), False).select(F.lit("overview").alias("part"), F.col("state").alias("name"), F.col("n").cast("string").alias("value"))).unionByName(reads.recent_failures(j, r, 5).select(F.lit("failures").alias("part"), F.col("id").alias("name"), F.col("attempt").cast("string").alias("value")))), JR + f""", {_LAST}
  SELECT 'health' AS part, 'ready' AS name, CAST(count(*) AS VARCHAR) AS value FROM jobs WHERE {READY} UNION ALL SELECT 'overview', state, CAST(count(*) AS VARCHAR) FROM jobs WHERE deleted_at IS NULL GROUP BY state
  UNION ALL SELECT 'failures', j.id, CAST(coalesce(last.attempt, j.attempt) AS VARCHAR) FROM (SELECT * FROM jobs WHERE deleted_at IS NULL AND state = 'discarded' ORDER BY finalized_at DESC, id DESC LIMIT 5) j LEFT JOIN last ON last.job_id = j.id"""),
    "ag38_deficit": (jobs(lambda j: audit.deficit(j, 10**6)), J + f"SELECT greatest(0, 1000000 - count(*)) AS missing FROM jobs WHERE deleted_at IS NULL AND {ACTIVE}"),
    "ag40_gate_sums": (samples(lambda s: audit.gate_sums(s.select(F.col("lock_waits").alias("blocked"), F.col("dead_tuples").alias("orphaned")))), S + "SELECT CAST(sum(lock_waits) AS BIGINT) AS blocked, CAST(sum(dead_tuples) AS BIGINT) AS orphaned FROM storage_samples"),
    "ag41_peak_rss": (samples(lambda s: audit.peaks(s, 10**12).select("peak_rss")), S + "SELECT greatest(max(rss), 1000000000000) AS peak_rss FROM storage_samples"),
    "sc13_lock_waits": (samples(lambda s: audit.lock_waits(s.select(F.col("seq").alias("pid"), (F.col("lock_waits") == 0).alias("granted")), s.select(F.col("seq").alias("pid"), F.col("at").alias("wait_start")), at("TIMESTAMP '2024-02-01 00:00:00'"))), S + "SELECT count(*) AS waits, max(date_sub('second', \"at\", TIMESTAMP '2024-02-01 00:00:00')) AS longest_s FROM storage_samples WHERE lock_waits <> 0"),
    "sc14_oldest_transaction": (runs(lambda r: audit.oldest_transaction(r.select(F.when(F.col("outcome") == "started", F.col("started_at")).alias("xact_start")), now())), R + f"SELECT coalesce(greatest(0, max(date_diff('second', started_at, {NOW_TEXT}))), 0) AS age_s FROM job_runs WHERE outcome = 'started'"),
    "sc15_sampled_bloat": (samples(lambda s: audit.sampled_bloat(s.select("seq", F.col("dead_tuples").alias("dead"), F.lit(100).alias("live")))), S + "SELECT seq, coalesce(dead_tuples / nullif(100 + dead_tuples, 0), 0.0) AS dead_share FROM storage_samples WHERE seq % 10 = 0"),
    "wn01_latest_runs": (runs(lambda r: reads.latest_runs(r).drop("job_key")), R + "SELECT job_id, id AS run_id, attempt, outcome, error_class, error_message, output FROM job_runs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY attempt DESC) = 1"),
    "wn02_fair_batch": (jobs(lambda j: reads.fair_batch(j, now(), 200)), J + f"""SELECT id, priority, rn, scheduled_at FROM (SELECT *, CAST(row_number() OVER (PARTITION BY coalesce(parent_job_id, id) ORDER BY priority, scheduled_at, id) AS INT) AS rn FROM jobs WHERE {READY})
  ORDER BY priority, rn, scheduled_at, id LIMIT 200"""),
    "wn03_fair_batch_best": (jobs(lambda j: reads.fair_batch(j, now(), 200, True)), J + f"""SELECT id, priority, rn, scheduled_at FROM (SELECT *, CAST(row_number() OVER (PARTITION BY coalesce(parent_job_id, id) ORDER BY scheduled_at, id) AS INT) AS rn FROM jobs WHERE {READY} AND priority = (SELECT min(priority) FROM jobs WHERE {READY}))
  ORDER BY rn, scheduled_at, id LIMIT 200"""),
    "wn04_wal_deltas": (samples(audit.wal_deltas), S + "SELECT seq, greatest(0, coalesce(wal_bytes - lag(wal_bytes) OVER (ORDER BY seq), 0)) AS delta FROM storage_samples"),
    "wn05_fairness": (events(audit.fairness), L + f", {_GRID} SELECT coalesce(min(cnt / width), 0.0) AS min_share FROM d WHERE remaining > 0"),
    "wn05_parent_shares": (events(lambda e: audit.parent_shares(e, 64)), L + f", {_GRID} SELECT g AS parent_ordinal, CAST(sum(cnt) AS BIGINT) AS claims, min(cnt / width) FILTER (remaining > 0) AS min_share FROM d GROUP BY g"),
    "wn06_longest_run": (events(audit.longest_run), L + f", {_POS} SELECT max(n) AS longest FROM (SELECT count(*) AS n FROM (SELECT g, row_number() OVER (ORDER BY seq) - row_number() OVER (PARTITION BY g ORDER BY seq) AS island FROM t) GROUP BY g, island)"),
    "wn10_priority_bands": (jobs(reads.priority_bands), J + "SELECT id, CAST(99 + row_number() OVER (PARTITION BY parent_job_id ORDER BY id) AS INT) AS band FROM jobs WHERE deleted_at IS NULL AND parent_job_id IS NOT NULL"),
    "wn11_keyset_pages": (jobs(lambda j: reads.keyset_pages(j, 500)), J + f"SELECT (rn - 1) // 500 AS page, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM jobs WHERE {DONE}) GROUP BY 1"),
    "wn12_skip_streaks": (events(lambda e: audit.skip_streaks(e, F.col("event") == "claim")), L + """, t AS (SELECT seq, event = 'claim' AS skipped, count(*) FILTER (event <> 'claim') OVER (ORDER BY seq) AS resets FROM lifecycle)
  SELECT seq, CAST(row_number() OVER (PARTITION BY resets, skipped ORDER BY seq) AS INT) AS streak FROM t WHERE skipped"""),
    "wn13_denial_streaks": (events(lambda e: audit.denial_streaks(e, 4)), L + """, t AS (SELECT seq, event, row_number() OVER (ORDER BY seq) - row_number() OVER (PARTITION BY event ORDER BY seq) AS island FROM lifecycle)
  SELECT event, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM t GROUP BY event, island HAVING count(*) >= 4"""),
    "sl01_newest": (jobs(reads.list_jobs), J + f"SELECT {_VIEW} FROM jobs WHERE deleted_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 50"),
    "sl02_runs_of_job": (runs(lambda r: reads.list_runs(r, "j0000000011", at("TIMESTAMP '2030-01-01 00:00:00'"), 5)), R + f"SELECT {_RUN} FROM job_runs WHERE job_id = 'j0000000011' ORDER BY created_at DESC, id DESC LIMIT 5"),
    "sl05_claim_batch": (jobs(lambda j: reads.claim_batch(j, now(), 100)), J + f"SELECT id, priority, scheduled_at FROM jobs WHERE {READY} ORDER BY priority, scheduled_at, id LIMIT 100"),
    "sl10_bounded_prefix": (jobs(lambda j: reads.bounded_prefix(j, 50, 3)), J + f"SELECT id FROM jobs WHERE {DONE} ORDER BY id LIMIT 150"),
}
