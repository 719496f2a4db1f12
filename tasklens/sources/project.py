"""The job-runtime relations as projections of the star-schema tables; SQL that runs on Spark and on DuckDB.

job_key is the number in a job's id: grouping and joining on it keeps the partitioning that numbering its attempts has
made. attempt stands in for the dequeue counter without a second scan. JSON columns (args, metadata, tags, output) are
strings, as they are at rest.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

JOBS = """
SELECT concat('j', lpad(CAST(o_orderkey AS VARCHAR(20)), 10, '0')) AS id, o_orderkey AS job_key,
  o_orderdate AS created_at, o_orderdate AS updated_at,
  concat('kind-', CAST(o_orderkey % 5 AS VARCHAR(20))) AS kind,
  concat('q', CAST(o_orderkey % 3 AS VARCHAR(20))) AS queue,
  99 + CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
  CASE o_orderstatus
    WHEN 'F' THEN CASE o_orderkey % 4 WHEN 0 THEN 'discarded' WHEN 1 THEN 'cancelled' ELSE 'succeeded' END
    WHEN 'O' THEN CASE o_orderkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'retryable' ELSE 'scheduled' END
    ELSE CASE o_orderkey % 2 WHEN 0 THEN 'running' ELSE 'paused' END END AS state,
  CAST(o_orderkey % 4 AS INT) AS attempt, CAST(3 + o_orderkey % 3 AS INT) AS max_attempts,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(1000 * (o_orderkey % 3) AS INT) END AS timeout_ms,
  o_orderdate AS scheduled_at,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL '30' SECOND END AS leased_until,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN concat('t', CAST(o_orderkey AS VARCHAR(20))) END AS lease_token,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('u-', CAST(o_orderkey % 700 AS VARCHAR(20))) END AS unique_key,
  CASE WHEN o_orderkey % 11 = 0 THEN concat('a-', CAST(o_orderkey % 1100 AS VARCHAR(20))) END AS unique_active_key,
  CASE WHEN o_orderkey % 20 <> 0 THEN concat('p', lpad(CAST(o_custkey AS VARCHAR(20)), 10, '0')) END AS parent_job_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'loadtest' WHEN 1 THEN '' WHEN 2 THEN 'loadtest-b' ELSE 'loadtest-c' END AS executor_class,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' DAY END AS finalized_at,
  CAST(NULL AS VARCHAR(20)) AS barrier_kind, CAST(NULL AS VARCHAR(20)) AS barrier_spec,
  concat('{"n":', CAST(o_orderkey % 100 AS VARCHAR(20)), '}') AS args, concat('{"request_id":"r', CAST(o_orderkey AS VARCHAR(20)), '"}') AS metadata,
  concat('["t', CAST(o_orderkey % 4 AS VARCHAR(20)), '","all"]') AS tags,
  CASE WHEN o_orderkey % 50 = 7 THEN o_orderdate END AS deleted_at
FROM orders
UNION ALL
SELECT concat('p', lpad(CAST(c_custkey AS VARCHAR(20)), 10, '0')), CAST(NULL AS BIGINT), TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '1995-01-01 00:00:00', 'coordinator', 'default', 100,
  CASE WHEN c_acctbal < 0 THEN 'running' ELSE 'succeeded' END, 1, 25, CAST(NULL AS INT), TIMESTAMP '1995-01-01 00:00:00',
  CASE WHEN c_acctbal < 0 THEN TIMESTAMP '1995-01-01 00:00:30' END, CASE WHEN c_acctbal < 0 THEN concat('p', CAST(c_custkey AS VARCHAR(20))) END, NULL, NULL, NULL, '',
  CASE WHEN c_acctbal >= 0 THEN TIMESTAMP '1995-01-02 00:00:00' END,
  CASE WHEN c_custkey % 3 = 0 THEN 'merge' END, CASE WHEN c_custkey % 3 = 0 THEN '{"queue":"default"}' END, '{}', '{}', '[]', NULL
FROM customer WHERE c_custkey % 10 <> 0"""

JOB_RUNS = """
SELECT concat('r', lpad(CAST(l_orderkey AS VARCHAR(20)), 10, '0'), '-', lpad(CAST(a AS VARCHAR(20)), 3, '0')) AS id,
  concat('j', lpad(CAST(l_orderkey AS VARCHAR(20)), 10, '0')) AS job_id, l_orderkey AS job_key, CAST(a AS INT) AS attempt, outcome,
  CASE WHEN outcome = 'timeout' THEN 'timeout' WHEN outcome = 'error' AND l_quantity > 40 THEN 'permanent'
       WHEN outcome = 'error' THEN 'transient' END AS error_class,
  CASE WHEN outcome IN ('error', 'timeout') THEN concat('boom ', CAST(CAST(l_quantity AS INT) AS VARCHAR(20))) END AS error_message,
  CASE WHEN outcome = 'success' THEN concat('{"n":', CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), '}') WHEN outcome = 'snooze' THEN '' END AS output,
  l_shipdate AS created_at, l_shipdate AS started_at,
  CASE WHEN outcome <> 'started' THEN l_shipdate + INTERVAL '1' DAY END AS finished_at,
  CASE WHEN outcome NOT IN ('started', 'crashed') THEN CAST(l_quantity AS BIGINT) * 3600000 END AS duration_ms,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_micros
FROM (SELECT l_orderkey, l_quantity, l_extendedprice, l_shipdate,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS a,
    CASE WHEN l_returnflag = 'A' THEN 'success' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'error'
         WHEN l_returnflag = 'R' THEN 'timeout' WHEN l_linestatus = 'O' THEN 'snooze'
         WHEN l_linenumber = 7 THEN 'started' ELSE 'crashed' END AS outcome
  FROM lineitem) t"""

LIFECYCLE = """
SELECT event_id AS seq, ts,
  CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish'
       WHEN 'error' THEN 'finish' ELSE 'retry' END AS event,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' END AS outcome,
  concat('kind-', CAST(user_id % 5 AS VARCHAR(20))) AS kind,
  concat('q', CAST(user_id % 3 AS VARCHAR(20))) AS queue,
  user_id % 10 AS parent_ordinal,
  CAST(round(value * 1000) AS BIGINT) AS duration_us
FROM events"""

JOB_PERIODICS = """
SELECT concat('slug-', lpad(CAST(s_suppkey AS VARCHAR(20)), 6, '0')) AS slug,
  concat('kind-', CAST(s_suppkey % 5 AS VARCHAR(20))) AS kind, 'periodic' AS queue,
  CAST(60 * (1 + s_suppkey % 12) AS INT) AS interval_seconds,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(s_suppkey % 90 AS INT) AS next_run_at,
  s_acctbal >= 0 AS is_active, CAST(NULL AS VARCHAR(20)) AS cron_expr, CAST(NULL AS TIMESTAMP) AS last_enqueued_at
FROM supplier"""

#: What workers report of running jobs; one token in thirteen is no longer the job's.
RESULTS = """
SELECT concat('j', lpad(CAST(o_orderkey AS VARCHAR(20)), 10, '0')) AS job_id,
  concat('t', CAST(o_orderkey AS VARCHAR(20)), CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE '' END) AS token,
  o_orderdate + INTERVAL '20' SECOND AS finished_at, o_orderkey % 11 = 0 AS cancel,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(60 AS BIGINT) END AS snooze_s,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('boom ', CAST(o_orderkey % 4 AS VARCHAR(20))) END AS error_message,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'permanent' WHEN 1 THEN 'validation' WHEN 2 THEN 'timeout' ELSE '' END END AS error_class,
  CASE WHEN o_orderkey % 9 = 0 THEN CAST(90 AS BIGINT) END AS delay_s
FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0"""

#: A batch of new jobs, in input order; some keys repeat in it and some are taken.
ARRIVALS = """
SELECT p_partkey AS pos, concat('n', lpad(CAST(p_partkey AS VARCHAR(20)), 10, '0')) AS id, concat('kind-', CAST(p_partkey % 5 AS VARCHAR(20))) AS kind,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('q', CAST(p_partkey % 3 AS VARCHAR(20))) END AS queue, CAST(p_size % 3 AS INT) AS priority,
  CASE WHEN p_partkey % 3 = 0 THEN concat('u-', CAST(p_partkey % 800 AS VARCHAR(20))) END AS unique_key,
  CASE WHEN p_partkey % 5 = 0 THEN concat('a-', CAST(p_partkey % 1300 AS VARCHAR(20))) END AS unique_active_key
FROM part"""

LIMITER_HOLDS = """
SELECT concat('h', CAST(o_orderkey AS VARCHAR(20))) AS token, concat('res-', CAST(o_orderkey % 20 AS VARCHAR(20))) AS resource,
  CAST(o_orderkey % 4 AS INT) AS n, o_orderdate AS expires_at
FROM orders"""

LIMITER_CALLS = """
SELECT event_id AS seq, ts, concat('res-', CAST(user_id % 7 AS VARCHAR(20))) AS resource,
  CASE WHEN event_type = 'error' THEN 'release' ELSE 'acquire' END AS op, CAST(1 + event_id % 3 AS INT) AS n,
  concat('k', CAST(CASE WHEN event_type = 'error' THEN event_id - 7 ELSE event_id END AS VARCHAR(20))) AS token
FROM events"""

STORAGE_SAMPLES = """
SELECT event_id AS seq, ts AS at, CAST(event_id * 1000 + (event_id % 7) * 300 * (event_id % 2) AS BIGINT) AS wal_bytes, user_id % 5 AS lock_waits,
  value AS longest_lock_wait, value / 2 AS max_xact_age, CAST(round(value * 1000) AS BIGINT) AS rss, CAST(user_id AS BIGINT) AS dead_tuples
FROM events"""

RELATIONS = {
    "jobs": (JOBS, ("orders", "customer")), "job_runs": (JOB_RUNS, ("lineitem",)), "lifecycle": (LIFECYCLE, ("events",)), "job_periodics": (JOB_PERIODICS, ("supplier",)),
    "results": (RESULTS, ("orders",)), "arrivals": (ARRIVALS, ("part",)), "limiter_holds": (LIMITER_HOLDS, ("orders",)), "limiter_calls": (LIMITER_CALLS, ("events",)),
    "storage_samples": (STORAGE_SAMPLES, ("events",)),
}


def projected(spark: SparkSession, name: str, frames: dict[str, DataFrame]) -> DataFrame:
    """One relation of frames of its tables, which may be streams."""
    sql, tables = RELATIONS[name]
    sql = sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)").replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: frames[t] for t in tables})


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One relation as a DataFrame; only the columns and rows that a query needs are read."""
    return projected(spark, name, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in RELATIONS[name][1]})


def ctes(*names: str) -> str:
    """A WITH clause of the named relations for an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({RELATIONS[n][0]})" for n in names) + " "
