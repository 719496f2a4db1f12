"""Rate limits: sums over holds, and folds of one resource's calls in the order of their seq.

A resource's calls depend on each other, so each resource is one group; its calls stream through in Arrow batches
sorted by Spark, and what a fold keeps is its tokens and open holds alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRANTS = "seq bigint, resource string, granted int, tokens double, held int, retry_after_s double"


@dataclass(frozen=True)
class Limits:
    """rate tokens in each interval, at most burst of them; at most most_held at once; 0 switches a limit off."""

    rate: int
    interval_s: float
    burst: int
    most_held: int = 0


def live_holds(holds: DataFrame, now: Column) -> DataFrame:
    """resource, held: what is held and has not run out."""
    return holds.where((F.col("expires_at") >= now) & (F.col("n") > 0)).groupBy("resource").agg(F.sum("n").alias("held"))


def swept_holds(holds: DataFrame, now: Column) -> DataFrame:
    """Holds that a sweep removes: those run out, and those of nothing."""
    return holds.where((F.col("expires_at") < now) | (F.col("n") <= 0)).select("token", "resource")


class LocalBucket:
    """Tokens in floating point, full at first; a release gives back room to hold, never tokens."""

    def __init__(self, limits: Limits):
        self.limits, self.tokens, self.at, self.holds = limits, float(limits.burst), None, {}
        self.held = 0

    def _refill(self, now: float) -> None:
        if self.at is not None and now > self.at:
            self.tokens = min(float(self.limits.burst), self.tokens + self.limits.rate * (now - self.at) / self.limits.interval_s)
        if self.at is None or now > self.at:
            self.at = now

    def acquire(self, now: float, n: int, token: str) -> tuple[int, float]:
        """How much of n is granted, and the seconds to wait if that is less than n."""
        limits = self.limits
        if limits.rate > 0:
            self._refill(now)
        room = [n] + ([math.floor(self.tokens)] if limits.rate > 0 else []) + ([limits.most_held - self.held] if limits.most_held > 0 else [])
        granted = max(0, min(room))
        if limits.rate > 0:
            self.tokens -= granted
        self.holds[token] = self.holds.get(token, 0) + granted
        self.held += granted
        short = granted < n and limits.rate > 0 and self.tokens < 1
        return granted, (1 - self.tokens) * limits.interval_s / limits.rate if short else 0.0

    def release(self, n: int, token: str) -> int:
        back = min(n, self.holds.get(token, 0))
        self.held -= back
        if token in self.holds:
            self.holds[token] -= back
            if not self.holds[token]:
                del self.holds[token]
        return back


class SharedBucket:
    """Whole tokens with the time that made no whole token carried on; holds run out after ttl and are taken back first. Times are ms."""

    def __init__(self, limits: Limits, ttl_s: float):
        self.limits, self.tokens, self.at, self.ttl, self.holds = limits, limits.burst, None, int(ttl_s * 1000), {}

    def _refill(self, now: int) -> None:
        rate, interval, burst = self.limits.rate, int(self.limits.interval_s * 1000), self.limits.burst
        passed = 0 if self.at is None else max(0, now - self.at)
        if self.at is None or passed >= burst * interval // rate:
            self.tokens, self.at = (burst, now)
            return
        add = passed * rate // interval
        if add:
            self.tokens = min(burst, self.tokens + add)
            self.at = now if self.tokens == burst else self.at + add * interval // rate

    def acquire(self, now: int, n: int, token: str) -> tuple[int, float]:
        limits = self.limits
        if limits.rate <= 0 and limits.most_held <= 0:
            return n, 0.0
        self.holds = {t: (k, end) for t, (k, end) in self.holds.items() if end >= now}
        room = [n]
        if limits.rate > 0:
            self._refill(now)
            room.append(self.tokens)
        if limits.most_held > 0:
            room.append(limits.most_held - sum(k for k, _ in self.holds.values()))
        granted = max(0, min(room))
        if limits.rate > 0:
            self.tokens -= granted
        if granted:
            self.holds[token] = (self.holds.get(token, (0, 0))[0] + granted, now + self.ttl)
        short = granted < n and limits.rate > 0 and self.tokens < 1
        return granted, max(0.0, (self.at + int(limits.interval_s * 1000) // limits.rate - now) / 1000) if short else 0.0

    def release(self, n: int, token: str) -> int:
        k, end = self.holds.get(token, (0, 0))
        back = min(n, k)
        if token in self.holds:
            self.holds[token] = (k - back, end)
            if k == back:
                del self.holds[token]
        return back

    @property
    def held(self) -> int:
        return sum(k for k, _ in self.holds.values())


def folded(calls: DataFrame, limits: Limits, ttl_s: float | None = None) -> DataFrame:
    """What each call (seq, ts, resource, op, n, token) is granted or gives back; a ttl makes the buckets shared ones.

    Calls are dealt by resource and sorted by Spark, so a resource with very many of them streams through its task.
    """
    rows = calls.select("resource", "seq", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ms"), "op", "n", "token")
    dealt = rows.repartition("resource").sortWithinPartitions("resource", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = object(), None
        names = [f.split()[0] for f in GRANTS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.float64()]
        for batch in batches:
            out = []
            for resource, seq, ms, op, n, token in zip(*(c.to_pylist() for c in batch.columns)):
                if resource != now:
                    now, bucket = resource, LocalBucket(limits) if ttl_s is None else SharedBucket(limits, ttl_s)
                got, wait = bucket.acquire(ms / 1000 if ttl_s is None else ms, n, token) if op == "acquire" else (bucket.release(n, token), 0.0)
                out.append((seq, resource, got, float(bucket.tokens), bucket.held, float(wait)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    return dealt.mapInArrow(fold, GRANTS)
