"""Hand fixtures: the numbers that inspection, limits, schedules, workers and streams must give."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from tasklens.functions import scalars as fn
from tasklens.functions import workers
from tasklens.functions.schedule import Cron, cron_table
from tasklens.operators import audit, limiter, metrics, ordering, reads, transitions, workload
from tasklens.sources import store
from tasklens.streaming import lifecycle

NOW = dt.datetime(2026, 6, 22, 12)
JOB = "id string, job_key bigint, state string, kind string, queue string, scheduled_at timestamp_ntz, parent_job_id string, deleted_at timestamp_ntz"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def jobs(spark, *rows):
    """(id, state, minutes from now, parent, kind, deleted)"""
    made = [(i, k, s, kind, "q", NOW + dt.timedelta(minutes=m), parent, NOW if gone else None) for k, (i, s, m, parent, kind, gone) in enumerate(rows)]
    return spark.createDataFrame(made, JOB)


def trace(spark, parents):
    return spark.createDataFrame(list(enumerate(parents)), "seq bigint, parent_ordinal bigint")


def test_queue_health(spark):
    j = jobs(spark, ("a", "available", -10, None, "k", 0), ("b", "retryable", -1, None, "k", 0), ("c", "scheduled", 30, None, "k", 0), ("d", "running", -5, None, "k", 0), ("e", "succeeded", -60, None, "k", 0), ("f", "discarded", -60, None, "k", 0), ("g", "available", -120, None, "k", 1))
    got = reads.queue_health(j, now()).first()
    assert (got.ready, got.inflight, got.scheduled_ahead, got.oldest_ready_age_s) == (2, 1, 1, 600)
    assert got.counts == "available=1,discarded=1,retryable=1,running=1,scheduled=1,succeeded=1"
    none = reads.queue_health(j.limit(0), now()).first()
    assert (none.ready, none.inflight, none.oldest_ready_age_s, none.counts) == (0, 0, 0, "")


def test_progress(spark):
    kids = [("s%d" % k, "succeeded", -120, "P", "scrape", 0) for k in range(4)] + [("r", "running", -30, "P", "scrape", 0), ("a1", "available", -5, "P", "x", 0), ("a2", "available", -4, "P", "x", 0), ("d", "discarded", -200, "P", "x", 0)]
    j = jobs(spark, ("P", "running", -300, None, "c", 0), ("P2", "succeeded", -300, None, "c", 0), *kids, ("o1", "available", -1, "gone", "x", 0), ("o2", "succeeded", -1, "gone", "x", 0))
    got = reads.progress(j, "P", now()).first()
    assert (got.total, got.terminal, got.pending, got.oldest_pending_age_s, got.parent_state) == (8, 5, 3, 1800, "running")
    lost = reads.progress(j, "gone", now()).first()
    assert (lost.total, lost.pending, lost.parent_state) == (2, 1, "")
    wanted = spark.createDataFrame([("P",), ("P2",), ("P3",)], "parent_job_id string")
    many = {r.parent_job_id: (r.total, r.parent_state) for r in reads.progress_many(j, wanted).collect()}
    assert many == {"P": (8, "running"), "P2": (0, "succeeded"), "P3": (0, "")}
    kinds = {r.kind: (r.total, r.terminal, r.pending) for r in reads.progress_by_kind(j, spark.createDataFrame([("scrape",), ("absent",)], "kind string")).collect()}
    assert kinds == {"scrape": (5, 4, 1), "absent": (0, 0, 0)}


@pytest.mark.parametrize("parents, run, share", [([0] * 200 + [1] * 200, 200, 0), ([0, 1] * 200, 1, 0.5), ([0, 1] * 100 + [1] * 100, 101, None), ([], 0, 0), ([7], 1, 1.0)])
def test_fairness(spark, parents, run, share):
    t = trace(spark, parents) if parents else trace(spark, [0]).limit(0)
    assert audit.longest_run(t).first().longest == run
    got = audit.fairness(t).first().min_share
    assert got > 0 if share is None else abs(got - share) < 0.011


def test_fairness_of_a_million_claims(spark, monkeypatch):
    monkeypatch.setattr(audit, "BUCKET", 10_000)
    t = spark.range(0, 1_000_000, 1, 13).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("parent_ordinal"))
    for _ in range(3):
        assert [r.min_share for r in audit.parent_shares(t).collect()] == [0.5, 0.5]
    assert audit.longest_run(t).first().longest == 1


def test_ordering_over_buckets(spark):
    values = [None, None, 1, 1, 2, 2, 2, None, 3, 3]
    rows = spark.createDataFrame(list(enumerate(values)), "seq bigint, v int").repartition(3)
    for width in (1, 2, 3, 100):
        b = F.expr(f"seq div {width}")
        assert [r.pos for r in ordering.numbered(rows, b, "seq").orderBy("seq").collect()] == list(range(10))
        assert [r.previous for r in ordering.with_previous(rows, b, "seq", "v").orderBy("seq").collect()] == [None, *values[:-1]]
        assert [r.run for r in ordering.with_runs(rows, b, "seq", "v").orderBy("seq").collect()] == [1, 1, 2, 2, 3, 3, 3, 4, 5, 5]


def test_quantiles_stay_within_the_bound(spark):
    spans = spark.range(20_000).select(F.lit("k").alias("kind"), F.floor(F.pow(F.lit(2.0), 11 + F.rand(7) * 16.5)).cast("bigint").alias("ns"))
    values = sorted(r.ns for r in spans.collect())
    got = metrics.latency(spans).first()
    assert (got.n, got.min_ns, got.max_ns, got.mean_ns) == (20_000, values[0], values[-1], sum(values) // 20_000)
    for q, value in ((0.5, got.p50), (0.95, got.p95), (0.99, got.p99)):
        exact = values[math.ceil(q * 20_000) - 1]
        assert abs(value - exact) / exact <= 0.1552734375
    one = metrics.latency(spark.createDataFrame([("k", 1_234_000)], "kind string, ns bigint")).first()
    assert {one.min_ns, one.p50, one.p95, one.p99, one.max_ns, one.mean_ns} == {1_234_000}


def test_backoff(spark):
    d = spark.createDataFrame([(a,) for a in (-5, 0, 1, 2, 3, 7, 1_000_000)], "a int").select(fn.backoff_s("a", 1, 60).alias("s"))
    assert [r.s for r in d.collect()] == [1, 1, 1, 2, 4, 60, 60]


def test_truncation_keeps_whole_characters(spark):
    texts = ["", "a", "abc汉", "é" * 10, "😀😀😀", "x" * 20, "ab😀cd"]
    for most in (4, 5, 6, 7, 8):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(fn.truncated("t", most).alias("c")).collect()
        assert [r.c for r in got] == [t.encode()[:most].decode("utf-8", "ignore") for t in texts]


def test_splitmix_by_hand(spark):
    def fails(ordinal, seed, rate):
        mask = (1 << 64) - 1
        z = (seed + (ordinal + 1) * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        return ((z ^ (z >> 31)) >> 11) / 2.0**53 < rate

    got = [r.f for r in spark.range(300).select(fn.failing("id", 42, 0.25).alias("f")).collect()]
    assert got == [fails(k, 42, 0.25) for k in range(300)] and 40 < sum(got) < 110


def test_cron(spark):
    start = dt.datetime(2024, 2, 28, 23, 59, 30)
    assert Cron("0 0 29 2 *").after(start) == dt.datetime(2024, 2, 29) and Cron("0 0 30 2 *").after(start) is None
    assert Cron("*/15 9-17 * * 1-5").after(dt.datetime(2024, 3, 1, 17, 45)) == dt.datetime(2024, 3, 4, 9)
    assert Cron("0 0 13 * 5").after(dt.datetime(2024, 9, 6)) == dt.datetime(2024, 9, 13) and Cron("0 0 1 * 7").after(dt.datetime(2024, 9, 2)) == dt.datetime(2024, 9, 8)
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *", "5-1 * * * *", "a * * * *"):
        with pytest.raises(ValueError):
            Cron(bad)
    hour = dt.datetime(2024, 1, 1)
    due, following = Cron("0 * * * *").due(hour, hour + dt.timedelta(hours=30), 10)
    assert len(due) == 10 and due[-1] == hour + dt.timedelta(hours=30) and following == hour + dt.timedelta(hours=31)
    cron_table(spark, 3)
    rows = spark.sql("SELECT * FROM cron_buckets('s', '0 * * * *', TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-01 05:30:00')").collect()
    assert [r.bucket.hour for r in rows] == [3, 4, 5] and rows[0].next_run_at.hour == 6
    assert spark.sql("SELECT error FROM cron_buckets('s', 'x', TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-01 05:30:00')").first().error


def test_local_bucket():
    b = limiter.LocalBucket(limiter.Limits(rate=2, interval_s=1.0, burst=4, most_held=5))
    assert b.acquire(0.0, 3, "a") == (3, 0.0) and b.acquire(0.0, 2, "b") == (1, 0.5)
    assert b.acquire(1.0, 9, "c") == (1, 0.0) and b.tokens == 1.0  # two tokens came back, but only one more may be held
    assert b.release(9, "a") == 3 and b.release(1, "a") == 0 and b.held == 2
    assert b.acquire(1.0, 1, "d")[0] == 1 and b.acquire(0.5, 1, "e") == (0, 0.5)  # time that goes back refills nothing


def test_shared_bucket():
    b = limiter.SharedBucket(limiter.Limits(rate=3, interval_s=10.0, burst=3), ttl_s=5.0)
    assert b.acquire(0, 3, "a") == (3, 0.0) and b.acquire(2000, 1, "b") == (0, 1.333)
    assert b.acquire(4000, 2, "c")[0] == 1 and b.at == 3333 and b.held == 4
    assert b.acquire(5001, 0, "d")[0] == 0 and b.held == 1  # a's hold has run out
    assert b.acquire(60_000, 5, "e")[0] == 3
    assert limiter.SharedBucket(limiter.Limits(0, 1.0, 0), 1.0).acquire(0, 9, "x") == (9, 0.0)


def test_folds_match_plain_python(spark):
    rows = [(k, NOW + dt.timedelta(seconds=k), f"r{k % 3}", "release" if k % 5 == 4 else "acquire", 1 + k % 2, f"t{k if k % 5 != 4 else k - 3}") for k in range(300)]
    calls = spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, resource string, op string, n int, token string")
    limits = limiter.Limits(rate=1, interval_s=4.0, burst=3, most_held=6)
    got = {r.seq: (r.granted, r.held) for r in limiter.folded(calls, limits).collect()}
    buckets = {f"r{k}": limiter.LocalBucket(limits) for k in range(3)}
    for seq, ts, resource, op, n, token in rows:
        b = buckets[resource]
        granted = b.acquire(ts.replace(tzinfo=dt.timezone.utc).timestamp(), n, token)[0] if op == "acquire" else b.release(n, token)
        assert got[seq] == (granted, b.held)
    assert limiter.folded(calls.limit(0), limits).count() == 0


def test_replay_refuses_what_has_no_bound(spark):
    j = jobs(spark, ("a", "discarded", 0, None, "k", 0))
    for bad in (dict(scope=None), dict(scope=F.lit(True), states=("succeeded",)), dict(scope=F.lit(True), states=("running",))):
        with pytest.raises(ValueError):
            transitions.replay(j, now=now(), **bad)


def test_worker_errors_stay_with_their_job():
    class Work:
        kind = "k"

        def work(self, args, attempt):
            if args.get("bad"):
                raise TimeoutError("late")
            return workers.Result(output=args, snooze_s=args.get("s"))

        def next_retry_s(self, attempt, error):
            return 10 * attempt

    w = Work()
    assert workers.run_one(w, '{"s": 3}', 1)[:3] == ('{"s": 3}', 3, False)
    assert workers.run_one(w, '{"bad": 1}', 2)[3:6] == ("late", "timeout", 20)
    assert workers.run_one(w, "{", 1)[4] == "validation" and workers.run_one(None, "{}", 1)[3:5] == ("unknown kind", "permanent")
    r = workers.Registry()
    r.register(w)
    with pytest.raises(ValueError):
        r.register(w)


def test_settings_and_reports(spark):
    assert store.settings("{}").connector[0] == "sqlite" and store.settings('{"postgres": "postgres://h/d", "sqlite": "x"}').connector == ("postgres", "postgres://h/d")
    assert store.settings('{"batch": 5, "concurrency": 3, "queues": ["a"]}').claim_limit == 3
    for bad in ('{"nope": 1}', '{"batch": 0}', '{"queues": []}'):
        with pytest.raises(ValueError):
            store.settings(bad)
    r = store.Report("drain", "postgres://u:secret@h/d", 10, 1_500_000_000, {"claim_p50": 957_000, "never": 0})
    again = store.Report.from_json(r.to_json())
    assert "secret" not in r.to_json() and json.loads(r.to_json())["wall"] == "1500ms" and again.latencies_ns == {"claim_p50": 957_000}
    assert store.report_rows(spark, [r]).first().latencies["claim_p50"].ns == 957_000


def test_snapshots(spark, tmp_path):
    s = store.Snapshots(spark, f"file://{tmp_path}")
    with pytest.raises(FileNotFoundError):
        s.read("jobs")
    assert s.write("jobs", spark.range(3)) == 1 and s.write("runs", spark.range(9)) == 1 and s.write("jobs", spark.range(5)) == 2
    assert s.read("jobs").count() == 5 and s.read("runs").count() == 9


def test_workload_is_the_same_on_any_partitioning(spark):
    a = workload.planned(spark, "mixed-speed", 3000, 5, 1)
    assert workload.digest(a).first().digest == workload.digest(a.repartition(7)).first().digest != workload.digest(workload.planned(spark, "mixed-speed", 3000, 6, 1)).first().digest
    assert 200 < a.where("parent_ordinal IS NULL AND work_ms = 200").count() < 400


def test_leases_in_a_stream(spark, tmp_path):
    t = lambda s: NOW + dt.timedelta(seconds=s)
    first = [("a", t(0), "claim", "t1"), ("b", t(0), "claim", "u1"), ("c", t(0), "claim", "v1"), ("a", t(20), "heartbeat", "t1"), ("b", t(10), "finish", "u1"), ("a", t(25), "heartbeat", "old")]
    later = [("a", t(45), "finish", "t1"), ("c", t(50), "claim", "v2"), ("c", t(55), "finish", "v1"), ("c", t(60), "finish", "v2"), ("d", t(200), "claim", "w1")]
    for k, rows in enumerate((first, later)):
        spark.createDataFrame(rows, lifecycle.LEASES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lifecycle.files(spark, f"{tmp_path}/in", lifecycle.LEASES, 1)
    got = sorted((r.job_id, r.token, r.verdict) for r in lifecycle.finished(lifecycle.leases(stream, 30), f"{tmp_path}/out").collect())
    assert got == [("a", "t1", "accepted"), ("b", "u1", "accepted"), ("c", "v1", "reclaimed"), ("c", "v1", "superseded"), ("c", "v2", "accepted")]


def test_sinks(spark, caplog):
    seen = []
    batch = spark.createDataFrame([("supersede",), ("sweep",)], "event string")
    with caplog.at_level("INFO", logger="tasklens"):
        store.fan_out(lambda b, n: seen.append((1, b.count(), n)), lambda b, n: seen.append((2, b.count(), n)), store.log_sink)(batch, 4)
    assert seen == [(1, 2, 4), (2, 2, 4)] and {r.levelname for r in caplog.records} == {"WARNING", "INFO"}
