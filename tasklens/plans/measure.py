"""Queries of metrics, scalar functions, definitions, workloads, workers and streams, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasklens.functions import scalars as fn
from tasklens.functions import workers
from tasklens.operators import catalog, metrics, workload
from tasklens.plans.base import A, J, L, P, R, S, alone, frame, on
from tasklens.sources import store
from tasklens.sources.project import projected
from tasklens.streaming import lifecycle

jobs, runs, events, samples, arrivals = on("jobs"), on("job_runs"), on("lifecycle"), on("storage_samples"), on("arrivals", "jobs")
BOUNDS = (0.005, 0.05, 0.25, 1.0, 5.0)

_B = "CASE WHEN ns < 1024 THEN 0 WHEN ns >= 137438953472 THEN 82 ELSE 1 + (e - 10) * 3 + (((ns - (1::BIGINT << e)) * 3) >> e) END"
_HIST = f"""h AS (SELECT kind, CAST({_B} AS INT) AS bucket, count(*) AS n, CAST(sum(ns) AS BIGINT) AS total, min(ns) AS low, max(ns) AS high
  FROM (SELECT kind, duration_us * 1000 AS ns, length(format('{{:b}}', duration_us * 1000)) - 1 AS e FROM lifecycle) WHERE ns >= 0 GROUP BY ALL)"""
_WALK = """w AS (SELECT *, sum(n) OVER (PARTITION BY kind ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY kind) AS alln, sum(total) OVER (PARTITION BY kind) AS allt,
  min(low) OVER (PARTITION BY kind) AS lo, max(high) OVER (PARTITION BY kind) AS hi,
  CASE bucket WHEN 0 THEN 1023 WHEN 82 THEN 137438953472 ELSE CAST(round(sqrt(
    ((1::BIGINT << (10 + (bucket - 1) // 3)) + ceil((1::BIGINT << (10 + (bucket - 1) // 3)) * ((bucket - 1) % 3) / 3.0::DOUBLE))::DOUBLE *
    ((1::BIGINT << (10 + (bucket - 1) // 3)) + ceil((1::BIGINT << (10 + (bucket - 1) // 3)) * ((bucket - 1) % 3 + 1) / 3.0::DOUBLE)))) AS BIGINT) END AS mid FROM h)"""
_Q = "CAST(greatest(min(lo), least(min(hi), arg_min(mid, bucket) FILTER (cum >= greatest(1, ceil({} * alln))))) AS BIGINT) AS p{}"
_QS = f"{_Q.format('0.5::DOUBLE', 50)}, {_Q.format('0.95::DOUBLE', 95)}, {_Q.format('0.99::DOUBLE', 99)}"
_MEASURED = """m AS (SELECT seq, 'counter' AS kind_of, 'jobs_claimed' AS name, 'queue' || chr(0) || queue AS t, 1.0::DOUBLE AS value FROM lifecycle WHERE event = 'claim'
  UNION ALL SELECT seq, 'counter', 'jobs_started', 'kind' || chr(0) || kind || chr(0) || 'queue' || chr(0) || queue, 1.0 FROM lifecycle WHERE event = 'start'
  UNION ALL SELECT seq, 'counter', 'jobs_finished', 'kind' || chr(0) || kind || chr(0) || 'outcome' || chr(0) || outcome, 1.0 FROM lifecycle WHERE event = 'finish'
  UNION ALL SELECT seq, 'histogram', 'job_seconds', 'kind' || chr(0) || kind, duration_us / 1e6 FROM lifecycle WHERE event = 'finish'
  UNION ALL SELECT seq, 'counter', 'jobs_retried', 'kind' || chr(0) || kind, 1.0 FROM lifecycle WHERE event = 'retry'), s AS (SELECT *, name || chr(0) || t AS series FROM m)"""
_CELLS = "cells AS (SELECT series, b AS bound, count(*) FILTER (value <= b) AS cumulative, count(*) AS total FROM s, (VALUES (0.005), (0.05), (0.25), (1.0), (5.0), ('infinity'::DOUBLE)) v(b) WHERE kind_of = 'histogram' GROUP BY ALL)"
_TEXTS = ("ok (×3)", "plain", "two\nlines (×12)", "(×x)")


def _spans(e):
    return e.select("kind", (F.col("duration_us") * 1000).alias("ns"))


def _hist(e):
    return metrics.taxonomy(e).where("kind_of = 'histogram'")


def _texts(schema: str, *values):
    return alone(lambda s: frame(s, schema, *[v if isinstance(v, tuple) else (v,) for v in values]))


def _with(query, make):
    return lambda spark, sf: make(query(spark, sf))


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    made = projected(spark, "lifecycle", {"events": spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")})
    return made.withColumn("ts", F.col("ts").cast("timestamp"))


def _order_stream(spark, sf):
    tables = {t: spark.readStream.schema(spark.read.parquet(f"{sf}/{t}.parquet").schema).parquet(f"{sf}/{t}.parquet*") for t in ("orders", "customer")}
    return projected(spark, "jobs", tables)


def _ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def _done(spark, stream, keys=None, mode="append"):
    return lifecycle.finished(stream, store.scratch(spark), keys, mode)


def sm02_leases(spark, sf):
    e = _stream(spark, sf).where("event IN ('claim', 'start', 'finish')")
    job, token = F.concat(F.lit("j"), (F.col("seq") % 40).cast("string")), F.concat(F.lit("t"), F.when(F.col("event") == "claim", F.col("seq")).otherwise(F.col("seq") - 40).cast("string"))
    kind = F.when(F.col("event") == "start", "heartbeat").otherwise(F.col("event"))
    return _ntz(_done(spark, lifecycle.leases(e.select(job.alias("job_id"), F.col("ts").alias("at"), kind.alias("event"), token.alias("token")), 86_400)), "at")


def sm06_first_while_active(spark, sf):
    e = _stream(spark, sf).where("event IN ('claim', 'finish')")
    rows = e.select(F.concat(F.lit("j"), (F.col("seq") % 40).cast("string")).alias("job_id"), F.col("ts").alias("at"), F.when(F.col("event") == "claim", "enqueue").otherwise("end").alias("event"), F.concat(F.lit("k"), (F.col("seq") % 40 % 9).cast("string")).alias("unique_active_key"))
    return _ntz(_done(spark, lifecycle.first_while_active(rows)), "at")


class _Doubler:
    kind, timeout_ms = "kind-1", 500

    def work(self, args, attempt):
        if args["n"] % 7 == 0:
            raise ValueError(f"bad {args['n']}")
        return workers.Result(output=2 * args["n"], follow_ups=[{"n": 1}] * (args["n"] % 3))


def _registry():
    made = workers.Registry()
    made.register(_Doubler())
    return made


_N = "CAST(json_extract(args, '$.n') AS BIGINT)"
_SECONDS = ("30s", "24h", "14d", "2w", "", "not-a-duration", "-5m", "1.5h30m", "90", "250ms")
_DDL_A = [("a", "CREATE INDEX a ON jobs USING btree (state, \"kind\")"), ("b", "create index b on public.jobs (id)"), ("c", "CREATE UNIQUE INDEX c ON jobs (slug) WHERE x = 'y'::text")]
_DDL_B = [("a", "create index IF NOT EXISTS a on public.jobs (state , kind);"), ("b", "CREATE INDEX b ON jobs (id, kind)"), ("d", "CREATE INDEX d ON jobs (id)")]
_PLAN = (
    "Limit  (cost=0.42..1.10 rows=8 width=40) (actual time=0.020..0.059 rows=8 loops=1)", "  Buffers: shared hit=12", "  CTE picked", "    ->  Index Scan using jobs_claim on jobs  (cost=0.42..9.10 rows=80 width=40) (actual time=0.010..0.031 rows=8 loops=1)",
    "          Buffers: shared hit=9", "  ->  Sort  (cost=5.10..5.20 rows=8 width=40) (actual time=0.040..0.050 rows=8 loops=1)", "        ->  CTE Scan on picked  (cost=0.00..0.16 rows=8 width=40) (actual time=0.011..0.033 rows=8 loops=1)", "Planning Time: 0.210 ms", "Execution Time: 0.301 ms",
)


def _plan(spark):
    return frame(spark, "cell string, line_no int, text string", *[(c, k, t) for c in ("a", "b") for k, t in enumerate(_PLAN)])


TABLE = {
    "ag15_counters": (events(metrics.counters), L + "SELECT kind, queue, event, count(*) AS n, CAST(sum(duration_us) AS BIGINT) AS total_us FROM lifecycle GROUP BY ALL"),
    "ag16_gauges": (events(metrics.gauges), L + "SELECT kind, queue, arg_max(duration_us, seq) AS last_us FROM lifecycle GROUP BY ALL"),
    "ag17_summaries": (events(lambda e: metrics.summaries(metrics.taxonomy(e).where("kind_of = 'counter'"))), L + f", {_MEASURED} SELECT series, count(*) AS n, sum(value) AS total FROM s WHERE kind_of = 'counter' GROUP BY series"),
    "ag18_bucketed": (events(lambda e: metrics.bucketed(_hist(e), BOUNDS)), L + f", {_MEASURED}, {_CELLS} SELECT series, CASE bound WHEN 0.005 THEN '0.005' WHEN 0.05 THEN '0.05' WHEN 0.25 THEN '0.25' WHEN 1 THEN '1' WHEN 5 THEN '5' ELSE '+Inf' END AS le, cumulative FROM cells"),
    "ag19_series": (events(lambda e: metrics.taxonomy(e).groupBy(metrics.series_key().alias("series")).agg(F.count("*").alias("n"))), L + f", {_MEASURED} SELECT series, count(*) AS n FROM s GROUP BY series"),
    "ag20_admitted": (events(lambda e: metrics.admitted(metrics.taxonomy(e), 20)), L + f", {_MEASURED}, f AS (SELECT series, count(*) AS n, min(seq) AS first FROM s GROUP BY series) SELECT series, n, row_number() OVER (ORDER BY first, series) > 20 AS refused FROM f"),
    "ag21_taxonomy": (events(lambda e: metrics.taxonomy(e).groupBy("kind_of", "name").agg(F.count("*").alias("n"))), L + f", {_MEASURED} SELECT kind_of, name, count(*) AS n FROM s GROUP BY ALL"),
    "ag22_histogram": (events(lambda e: metrics.histogram(_spans(e))), L + f", {_HIST} SELECT * FROM h"),
    "ag24_latency": (events(lambda e: metrics.latency(_spans(e))), L + f", {_HIST}, {_WALK} SELECT kind, CAST(min(alln) AS BIGINT) AS n, min(lo) AS min_ns, min(hi) AS max_ns, CAST(min(allt) // min(alln) AS BIGINT) AS mean_ns, {_QS} FROM w GROUP BY kind"),
    "ag24_latency_of_none": (events(lambda e: metrics.latency_or_zero(_spans(e).where("ns > 1000000000000"))), "SELECT 0::BIGINT AS n, 0::BIGINT AS min_ns, 0::BIGINT AS max_ns, 0::BIGINT AS mean_ns, 0::BIGINT AS p50, 0::BIGINT AS p95, 0::BIGINT AS p99"),
    "ag25_error_bound": (alone(lambda s: metrics.error_bound(s).select(F.round("bound", 6).alias("bound"))), "SELECT round(max(greatest((m - lo) / lo, (hi - 1 - m) / (hi - 1))), 6) AS bound FROM (SELECT lo, hi, round(sqrt(lo::DOUBLE * hi)) AS m FROM (SELECT (1::BIGINT << e) + ceil((1::BIGINT << e) * s / 3.0::DOUBLE)::BIGINT AS lo, (1::BIGINT << e) + ceil((1::BIGINT << e) * (s + 1) / 3.0::DOUBLE)::BIGINT AS hi FROM (SELECT unnest(range(10, 37))::INT AS e), (SELECT unnest(range(3)) AS s)))"),
    "fn26_bucket_bounds": (alone(metrics.bucket_table), "SELECT CAST(1 + (e - 10) * 3 + s AS INT) AS bucket, (1::BIGINT << e) + ceil((1::BIGINT << e) * s / 3.0::DOUBLE)::BIGINT AS low, (1::BIGINT << e) + ceil((1::BIGINT << e) * (s + 1) / 3.0::DOUBLE)::BIGINT AS high FROM (SELECT unnest(range(10, 37))::INT AS e), (SELECT unnest(range(3)) AS s)"),
    "ag26_interpolated_p90": (events(lambda e: metrics.interpolated_quantile(metrics.bucketed(_hist(e), BOUNDS), 0.9).select("series", F.round("value", 9).alias("value"))), L + f""", {_MEASURED}, {_CELLS}, h AS (SELECT *, coalesce(lag(cumulative) OVER (PARTITION BY series ORDER BY bound), 0) AS below, coalesce(lag(bound) OVER (PARTITION BY series ORDER BY bound), 0) AS start FROM cells),
  f AS (SELECT * FROM h WHERE cumulative >= 0.9::DOUBLE * total QUALIFY row_number() OVER (PARTITION BY series ORDER BY bound) = 1)
  SELECT series, round(CASE WHEN isinf(bound) THEN start ELSE start + (bound - start) * (0.9::DOUBLE * total - below) / (cumulative - below) END, 9) AS value FROM f"""),
    "ag39_out_of_range": (events(lambda e: metrics.out_of_range(_spans(e))), L + "SELECT count(*) FILTER (duration_us * 1000 < 1024) AS under, count(*) FILTER (duration_us * 1000 >= 137438953472) AS over FROM lifecycle WHERE duration_us >= 0"),
    "fn28_width_tolerance": (events(lambda e: e.where("duration_us >= 0").select("seq", metrics.width_tolerance(F.col("duration_us") * 1000).alias("width"))), L + "SELECT seq, CASE WHEN ns < 1024 THEN 1024 WHEN ns >= 137438953472 THEN 0 ELSE CAST(ceil((1::BIGINT << (length(format('{:b}', ns)) - 1)) / 3.0::DOUBLE) AS BIGINT) END AS width FROM (SELECT seq, duration_us * 1000 AS ns FROM lifecycle WHERE duration_us >= 0)"),
    "sc19_exposition": (events(lambda e: metrics.exposition(metrics.taxonomy(e).where("name IN ('jobs_claimed', 'jobs_retried')"), BOUNDS)), L + """, c AS (SELECT 'jobs_claimed' AS name, 'queue="' || queue || '"' AS labels, count(*) AS n FROM lifecycle WHERE event = 'claim' GROUP BY queue UNION ALL SELECT 'jobs_retried', 'kind="' || kind || '"', count(*) FROM lifecycle WHERE event = 'retry' GROUP BY kind),
  l AS (SELECT name, labels || '0' AS sub, name || '{' || labels || '} ' || n AS line FROM c UNION ALL SELECT DISTINCT name, '', '# TYPE ' || name || ' counter' FROM c) SELECT CAST(row_number() OVER (ORDER BY name, sub, line) - 1 AS INT) AS place, line FROM l"""),
    # scalars
    "fn01_truncated": (runs(lambda r: r.select("id", fn.truncated(F.concat(F.lit("é汉😀"), F.coalesce("error_message", F.lit(""))), 8).alias("t"))), R + "SELECT id, CASE WHEN coalesce(error_message, '') = '' THEN 'é汉' ELSE 'é汉' END AS t FROM job_runs"),
    "fn02_shown": (jobs(lambda j: j.select("id", fn.shown("metadata", 20).alias("t"))), J + "SELECT id, CASE WHEN length(metadata) > 20 THEN substr(metadata, 1, 19) || '…' ELSE metadata END AS t FROM jobs"),
    "fn03_backoff": (alone(lambda s: s.range(-5, 70).select("id", fn.backoff_s("id", 1, 60).alias("s"), fn.backoff_s("id", 3, 10**9).alias("t"))), "SELECT id, CASE WHEN id <= 1 THEN 1 WHEN id >= 7 THEN 60 ELSE 1 << (id - 1) END::BIGINT AS s, CASE WHEN id <= 1 THEN 3 WHEN id >= 30 THEN 1000000000 ELSE least(1000000000, 3 * (1::BIGINT << (id - 1))) END::BIGINT AS t FROM (SELECT unnest(range(-5, 70)) AS id)"),
    "fn04_jittered": (alone(lambda s: s.range(2000).select("id", fn.jittered(F.lit(10_000), "id").alias("ms"))), None),
    "fn05_poll_ladder": (alone(lambda s: s.range(20).select("id", fn.poll_ladder("id", 100, 5000)[0].alias("ms"), fn.poll_ladder("id", 100, 5000)[1].alias("at_most"))), "SELECT id, least(5000, 100 * (1::BIGINT << greatest(id - 1, 0))) AS ms, 100 * (1::BIGINT << greatest(id - 1, 0)) >= 5000 AS at_most FROM (SELECT unnest(range(20)) AS id)"),
    "fn09_bucket_keys": (jobs(lambda j: j.select("id", fn.bucket_key("kind", "created_at").alias("k"))), J + "SELECT id, kind || '@' || CAST(epoch(created_at) AS BIGINT) AS k FROM jobs"),
    "fn10_time_buckets": (jobs(lambda j: j.groupBy(F.date_trunc("MONTH", "created_at").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"))), J + "SELECT date_trunc('month', created_at)::TIMESTAMP AS month, count(*) AS n FROM jobs GROUP BY 1"),
    "fn11_human_seconds": (_with(_texts("t string", *_SECONDS), lambda d: d.select("t", fn.human_seconds("t").alias("s"))), "SELECT * FROM (VALUES ('30s', 30.0::DOUBLE), ('24h', 86400), ('14d', 1209600), ('2w', 1209600), ('', 0), ('not-a-duration', NULL), ('-5m', -300), ('1.5h30m', 7200), ('90', NULL), ('250ms', 0.25)) v(t, s)"),
    "fn12_durations_ms": (runs(lambda r: r.select("id", F.expr("timestampdiff(MILLISECOND, started_at, finished_at)").alias("ms"))), R + "SELECT id, date_diff('millisecond', started_at, finished_at) AS ms FROM job_runs"),
    "fn13_error_json": (runs(lambda r: r.where("error_message IS NOT NULL").select("id", fn.error_json("error_message").alias("j"))), R + "SELECT id, '{\"message\":\"' || error_message || '\"}' AS j FROM job_runs WHERE error_message IS NOT NULL"),
    "fn14_typed_args": (jobs(lambda j: j.select("id", F.from_json("args", "n bigint")["n"].alias("n"))), J + f"SELECT id, {_N} AS n FROM jobs"),
    "fn15_tags": (jobs(lambda j: j.select("id", F.explode(F.from_json("tags", "array<string>")).alias("tag"))), J + "SELECT id, unnest(from_json(tags, '[\"VARCHAR\"]')) AS tag FROM jobs"),
    "fn16_request_ids": (jobs(lambda j: j.select("id", F.get_json_object("metadata", "$.request_id").alias("request_id"))), J + "SELECT id, json_extract_string(metadata, '$.request_id') AS request_id FROM jobs"),
    "fn17_defaults": (arrivals(lambda a, j: a.select("id", fn.or_default("queue", "default", "").alias("q"), fn.or_default("priority", 100, 0).alias("p"), fn.positive_or(F.col("priority") - 1, 7).alias("x"))), A + "SELECT id, CASE WHEN queue = '' THEN 'default' ELSE queue END AS q, CAST(CASE priority WHEN 0 THEN 100 ELSE priority END AS INT) AS p, CAST(CASE WHEN priority > 1 THEN priority - 1 ELSE 7 END AS INT) AS x FROM arrivals"),
    "fn18_monotone_ids": (jobs(lambda j: j.select("id", fn.monotone_id(F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', created_at)"), "id").alias("uuid"))), None),
    "fn19_failing": (alone(lambda s: s.range(5000).select("id", fn.failing("id", 42, 0.1).alias("fails"))), None),
    "fn20_normalized": (alone(lambda s: frame(s, "name string, ddl string", *_DDL_A).select("name", catalog.normalized_definition(F.col("ddl")).alias("ddl"))), "SELECT * FROM (VALUES ('a', 'create index a on jobs state, kind'), ('b', 'create index b on jobs id'), ('c', 'create unique index c on jobs slug where x = ''y''')) v(name, ddl)"),
    "fn21_storage_parameters": (_with(_texts("`table` string, options string", ("jobs", "fillfactor=85, Autovacuum_Scale_Factor = '0.02'"), ("runs", "")), catalog.storage_parameters), "SELECT 'jobs' AS \"table\", unnest(['fillfactor', 'autovacuum_scale_factor']) AS parameter, unnest(['85', '0.02']) AS value"),
    "fn22_redacted": (_with(_texts("dsn string", "postgres://u:secret@h:5432/db?sslmode=off", "postgres://u@h/db", "postgres://h/db?password=x", "host=h password=x user=u", "what is this", ""), lambda d: d.select("dsn", fn.redacted_dsn("dsn").alias("r"))), "SELECT * FROM (VALUES ('postgres://u:secret@h:5432/db?sslmode=off', 'postgres://u:xxxxx@h:5432/db?sslmode=off'), ('postgres://u@h/db', 'postgres://u@h/db'), ('postgres://h/db?password=x', 'postgres://h/db?password=xxxxx'), ('host=h password=x user=u', 'host=h password=xxxxx user=u'), ('what is this', '[redacted]'), ('', '')) v(dsn, r)"),
    "fn23_plan_nodes": (alone(lambda s: catalog.plan_nodes(_plan(s))), "SELECT cell, line_no, depth, node, \"rows\", index, time_ms, buffers FROM (VALUES ('a'), ('b')) c(cell), (VALUES (0, 0, 'Limit', 8::BIGINT, NULL, 0.059::DOUBLE, 12::BIGINT), (3, 4, 'Index Scan', 8, 'jobs_claim', 0.031, 9), (5, 2, 'Sort', 8, NULL, 0.05, NULL), (6, 8, 'CTE Scan', 8, NULL, 0.033, NULL)) v(line_no, depth, node, \"rows\", index, time_ms, buffers)"),
    "fn23_plan_summary": (alone(lambda s: catalog.plan_summary(_plan(s))), "SELECT cell, 'Limit' AS root, 'CTE Scan,Index Scan' AS scans, true AS sorted, 0.21::DOUBLE AS planning_ms, 0.301::DOUBLE AS execution_ms FROM (VALUES ('a'), ('b')) c(cell)"),
    "fn23_cte_lines": (alone(lambda s: catalog.cte_lines(_plan(s), "picked")), "SELECT cell, line_no FROM (VALUES ('a'), ('b')) c(cell), (VALUES (3), (4)) v(line_no)"),
    "fn24_sql_texts": (_with(_texts("t string", "it's", "a AND (executor_class = $1 OR executor_class = '') b", "token = $token"), lambda d: d.select("t", catalog.quoted(F.col("t")).alias("q"), catalog.any_class(F.col("t")).alias("c"), catalog.pinned_token(F.col("t"), "x'y").alias("p"))), "SELECT t, '''' || replace(t, '''', '''''') || '''' AS q, CASE WHEN t LIKE 'a AND%' THEN 'a b' ELSE t END AS c, replace(t, '$token', '''x''''y''') AS p FROM (VALUES ('it''s'), ('a AND (executor_class = $1 OR executor_class = '''') b'), ('token = $token')) v(t)"),
    "fn25_labels": (_with(_texts("t string", 'a"b', "back\\slash", "two\nlines"), lambda d: d.select("t", metrics.escaped_label(F.col("t")).alias("e"))), "SELECT t, replace(replace(replace(t, '\\', '\\\\'), chr(10), '\\n'), '\"', '\\\"') AS e FROM (VALUES ('a\"b'), ('back\\slash'), ('two' || chr(10) || 'lines')) v(t)"),
    "fn27_texts": (alone(lambda s: frame(s, "n bigint, statm string", (512, "100 25 3"), (1536, "x"), (5 << 20, "7 9"), (3 << 30, "")).select("n", fn.bytes_text("n").alias("b"), fn.thousands("n").alias("t"), fn.resident_bytes("statm").alias("rss"))), "SELECT * FROM (VALUES (512::BIGINT, '512 B', '512', 102400::BIGINT), (1536, '1.5 KiB', '1,536', NULL), (5242880, '5.0 MiB', '5,242,880', 36864), (3221225472, '3.0 GiB', '3,221,225,472', NULL)) v(n, b, t, rss)"),
    "fn29_lags": (samples(lambda s: s.select("seq", fn.lag_text(F.col("lock_waits") - 2).alias("t"))), S + "SELECT seq, CASE WHEN lock_waits <= 2 THEN 'none' ELSE (lock_waits - 2) || 's' END AS t FROM storage_samples"),
    "fn30_leases": (runs(lambda r: r.select("id", fn.lease_ms("attempt", F.col("attempt") * 500).alias("ms"))), R + "SELECT id, CAST(greatest(5000, 4 * attempt * 501) AS INT) AS ms FROM job_runs"),
    "fn31_heartbeats": (jobs(lambda j: j.select("id", fn.heartbeat_ms(F.col("attempt") - 1, F.col("max_attempts") * 2500).cast("bigint").alias("ms"))), J + "SELECT id, CAST(CASE sign(attempt - 1) WHEN -1 THEN 0 WHEN 1 THEN attempt - 1 ELSE greatest(1000, max_attempts * 2500 // 3) END AS BIGINT) AS ms FROM jobs"),
    "fn32_timeouts": (jobs(lambda j: j.select("id", fn.resolved_timeout_ms("timeout_ms", F.when(F.col("kind") == "kind-1", 700), 60_000).alias("ms"))), J + "SELECT id, CAST(CASE WHEN timeout_ms > 0 THEN timeout_ms WHEN kind = 'kind-1' THEN 700 ELSE 60000 END AS INT) AS ms FROM jobs"),
    "fn33_http_success": (alone(lambda s: s.range(100, 600, 7).select("id", fn.is_success_status("id").alias("plain"), fn.is_success_status("id", F.array(F.lit(107).cast("bigint"), F.lit(200).cast("bigint"))).alias("listed"))), "SELECT id, id BETWEEN 200 AND 299 AS plain, id IN (107, 200) AS listed FROM (SELECT unnest(range(100, 600, 7)) AS id)"),
    "fn34_exit_classes": (alone(lambda s: s.range(6).select("id", fn.class_of_exit("id", F.array(F.lit(2).cast("bigint"), F.lit(5).cast("bigint"))).alias("c"))), "SELECT * FROM (VALUES (0::BIGINT, NULL), (1, 'transient'), (2, 'permanent'), (3, 'transient'), (4, 'transient'), (5, 'permanent')) v(id, c)"),
    "fn35_total_jobs": (jobs(lambda j: j.select("id", catalog.total_jobs(F.col("priority"), F.col("attempt"), F.col("barrier_kind").isNotNull()).alias("n"))), J + "SELECT id, CAST(priority + priority * attempt + CASE WHEN barrier_kind IS NULL THEN 0 ELSE priority END AS INT) AS n FROM jobs"),
    "fn36_connections": (jobs(lambda j: j.select("id", catalog.connections(F.col("attempt"), F.col("max_attempts"), 5).alias("n"))), J + "SELECT id, CAST(attempt * max_attempts + attempt + 5 AS INT) AS n FROM jobs"),
    "fn37_error_counts": (_with(_texts("t string", *_TEXTS), lambda d: d.select("t", fn.error_count("t")[0].alias("m"), fn.error_count("t")[1].alias("n"))), "SELECT * FROM (VALUES ('ok (×3)', 'ok', 3::BIGINT), ('plain', 'plain', 1), ('two' || chr(10) || 'lines (×12)', 'two' || chr(10) || 'lines', 12), ('(×x)', '(×x)', 1)) v(t, m, n)"),
    "fn38_fault_specs": (_with(_texts("t string", "kill-runner", "outage@0.25", "pause-database@1:30s", "expire:5m", "@0.5", "Bad"), lambda d: d.select("t", *[c.alias(n) for c, n in zip(fn.fault_spec("t"), ("name", "fraction", "lasts"))])), "SELECT * FROM (VALUES ('kill-runner', 'kill-runner', 0.5::DOUBLE, NULL), ('outage@0.25', 'outage', 0.25, NULL), ('pause-database@1:30s', 'pause-database', 1, '30s'), ('expire:5m', 'expire', 0.5, '5m'), ('@0.5', NULL, NULL, NULL), ('Bad', NULL, NULL, NULL)) v(t, name, fraction, lasts)"),
    "fn39_schema_names": (_with(_texts("t string", "jobs_2", "2jobs", "Jobs", "", "x" * 64), lambda d: d.select("t", fn.valid_schema_name("t").alias("ok"), catalog.in_schema(F.lit("postgres://h/d?a=b"), "s").alias("dsn"))), "SELECT t, t = 'jobs_2' AS ok, 'postgres://h/d?a=b&search_path=s' AS dsn FROM (VALUES ('jobs_2'), ('2jobs'), ('Jobs'), (''), (repeat('x', 64))) v(t)"),
    "fn41_cadences": (on("job_periodics")(lambda p: p.select("slug", fn.cadence_text(F.when(F.col("interval_seconds") > 300, F.col("interval_seconds")), F.lit("0 * * * *")).alias("t"))), P + "SELECT slug, CASE WHEN interval_seconds > 300 THEN 'every ' || interval_seconds || 's' ELSE '0 * * * *' END AS t FROM job_periodics"),
    "fn42_capped": (jobs(lambda j: j.select("id", F.decode(fn.capped("id", 5), "UTF-8").alias("t"))), J + "SELECT id, substr(id, 1, 5) AS t FROM jobs"),
    # definitions and grids
    "jn11_drift": (alone(lambda s: catalog.drift(frame(s, "name string, ddl string", *_DDL_A), frame(s, "name string, ddl string", *_DDL_B))), "SELECT * FROM (VALUES ('a', 'ok'), ('b', 'drifted'), ('c', 'absent'), ('d', 'retired')) v(name, status)"),
    "st26_reconciled": (alone(lambda s: catalog.reconciled(catalog.drift(frame(s, "name string, ddl string", *_DDL_A), frame(s, "name string, ddl string", *_DDL_B)))), "SELECT * FROM (VALUES ('b', 'drifted', 'report'), ('c', 'absent', 'create'), ('d', 'retired', 'drop')) v(name, status, action)"),
    "sc08_installed_columns": (jobs(lambda j: catalog.table_schema(j.select("id", "attempt"), "jobs")), "SELECT * FROM (VALUES ('jobs.id', 'string'), ('jobs.attempt', 'int')) v(name, ddl)"),
    "sc11_table_sizes": (lambda spark, sf: catalog.table_sizes(spark, {t: f"{sf}/{t}.parquet" for t in ("orders", "lineitem")}), None),
    "jn19_benchmark_cells": (alone(lambda s: catalog.benchmark_cells(s, (10_000, 100_000))), "SELECT mix, depth, workers, index, mix || '_d' || depth || '_w' || workers || '_' || index AS cell FROM (VALUES ('drain'), ('enqueue'), ('steady')) a(mix), (VALUES (10000), (100000)) b(depth), (VALUES (8), (16)) c(workers), (VALUES ('full'), ('correctness-only')) d(index)"),
    "jn20_explained_cells": (alone(lambda s: catalog.explained_cells(frame(s, "variant string, only string", ("v1", None), ("v2", "claim")), frame(s, "statement string", ("claim",), ("sweep",)))), "SELECT * FROM (VALUES ('v1', 'claim'), ('v1', 'sweep'), ('v2', 'claim')) v(variant, statement)"),
    "sc30_workload": (alone(lambda s: workload.planned(s, "mixed-speed", 200, 1, 3).groupBy("kind").agg(F.count("*").alias("n"), F.count("parent_ordinal").alias("children"))), "SELECT 'mixed-speed' AS kind, 800::BIGINT AS n, 600::BIGINT AS children"),
    "ag36_workload_digest": (alone(lambda s: workload.digest(workload.planned(s, "drain", 2000, 1))), None),
    "sc23_json_lines": (jobs(lambda j: store.json_lines(j.select("id", "state", "unique_key"))), J + "SELECT '{\"id\":\"' || id || '\",\"state\":\"' || state || '\"' || coalesce(',\"unique_key\":\"' || unique_key || '\"', '') || '}' AS line FROM jobs"),
    # workers
    "ud01_worked": (jobs(lambda j: workers.worked(j.where("kind IN ('kind-1', 'kind-2')"), _registry()).select("job_id", "output", "error_message", "error_class", F.size("follow_ups").alias("children"))), J + f"""SELECT id AS job_id, CASE WHEN kind = 'kind-1' AND n % 7 <> 0 THEN CAST(2 * n AS VARCHAR) END AS output, CASE WHEN kind = 'kind-2' THEN 'unknown kind' WHEN n % 7 = 0 THEN 'bad ' || n END AS error_message,
  CASE WHEN kind = 'kind-2' THEN 'permanent' WHEN n % 7 = 0 THEN 'transient' END AS error_class, CAST(CASE WHEN kind = 'kind-1' AND n % 7 <> 0 THEN n % 3 ELSE 0 END AS INT) AS children FROM (SELECT id, kind, {_N} AS n FROM jobs WHERE kind IN ('kind-1', 'kind-2'))"""),
    "ud08_retry_delays": (jobs(lambda j: j.select("id", workers.retry_delay_s(F.when(F.col("job_key") % 3 == 0, F.lit(7).cast("bigint")), "attempt").alias("s"))), J + "SELECT id, CASE WHEN job_key % 3 = 0 THEN 7 ELSE least(60, 1::BIGINT << greatest(attempt - 1, 0)) END AS s FROM jobs"),
    "ud11_argument_problems": (_with(_texts("kind string, args string", ("python", '{"script":"a"}'), ("python", '{"script":"a","code":"b"}'), ("shell", "{}"), ("mage", "no"), ("other", "{}")), lambda d: d.select("kind", "args", workers.argument_problem("kind", "args").alias("problem"))), "SELECT * FROM (VALUES ('python', '{\"script\":\"a\"}', NULL), ('python', '{\"script\":\"a\",\"code\":\"b\"}', 'exactly one of script, module, code'), ('shell', '{}', 'exactly one of command, script'), ('mage', 'no', 'not JSON'), ('other', '{}', NULL)) v(kind, args, problem)"),
    # streams, over all that is there
    "sm02_leases": (sm02_leases, None),
    "sm05_first_ever": (lambda spark, sf: _done(spark, lifecycle.first_ever(_order_stream(spark, sf).where("unique_key IS NOT NULL").select("unique_key"))), J + "SELECT DISTINCT unique_key FROM jobs WHERE unique_key IS NOT NULL"),
    "sm06_first_while_active": (sm06_first_while_active, None),
    "sm07_first_in_bucket": (lambda spark, sf: _ntz(_done(spark, lifecycle.first_in_bucket(_stream(spark, sf).select("kind", "ts"), F.date_trunc("DAY", "ts"), "60 days").select("kind", "bucket")), "bucket"), L + "SELECT DISTINCT kind, date_trunc('day', ts)::TIMESTAMP AS bucket FROM lifecycle"),
    "sm10_windowed_counts": (lambda spark, sf: _ntz(_done(spark, lifecycle.windowed_counts(_stream(spark, sf)), ["began", "event", "kind"], "update"), "began"), L + "SELECT date_trunc('hour', ts)::TIMESTAMP AS began, event, kind, count(*) AS n, CAST(sum(duration_us) AS BIGINT) AS total_us FROM lifecycle GROUP BY ALL"),
    "sm10_windowed_buckets": (lambda spark, sf: _ntz(_done(spark, lifecycle.windowed_buckets(_stream(spark, sf), (1000, 50_000)), ["began", "kind"], "update"), "began"), L + "SELECT date_trunc('hour', ts)::TIMESTAMP AS began, kind, count(*) FILTER (duration_us <= 1000) AS le_1000, count(*) FILTER (duration_us <= 50000) AS le_50000, count(*) AS n FROM lifecycle WHERE event = 'finish' GROUP BY ALL"),
    "sm11_windowed_lag": (lambda spark, sf: _ntz(_done(spark, lifecycle.windowed_lag(_stream(spark, sf)), ["began", "queue"], "update"), "began"), L + "SELECT date_trunc('hour', ts)::TIMESTAMP AS began, queue, max(duration_us) AS most_us FROM lifecycle GROUP BY ALL"),
    "sm12_run_invariants": (lambda spark, sf: _done(spark, lifecycle.run_invariants(_stream(spark, sf).select(F.concat(F.lit("r"), (F.col("seq") % 300).cast("string")).alias("run_id"), "event")), ["run_id"], "update"), L + "SELECT 'r' || (seq % 300) AS run_id, count(*) FILTER (event = 'start') AS starts, count(*) FILTER (event = 'finish') AS ends, count(*) FILTER (event = 'start') = 1 AND count(*) FILTER (event = 'finish') <= 1 AND count(*) FILTER (event = 'retry') <= count(*) FILTER (event = 'finish') AS ok FROM lifecycle GROUP BY 1"),
    "sm17_denial_sessions": (lambda spark, sf: _ntz(_done(spark, lifecycle.sessions(_stream(spark, sf).where("event = 'retry'"), "6 hours"), ["queue", "began"], "complete").where("n > 0"), "began", "ended"), L + """, r AS (SELECT queue, ts, coalesce(ts - lag(ts) OVER (PARTITION BY queue ORDER BY ts) >= INTERVAL 6 HOUR, true) AS new FROM lifecycle WHERE event = 'retry'), g AS (SELECT *, sum(new::INT) OVER (PARTITION BY queue ORDER BY ts) AS k FROM r)
  SELECT queue, min(ts) AS began, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM g GROUP BY queue, k"""),
}
