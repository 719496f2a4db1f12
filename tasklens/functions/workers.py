"""Work on jobs in Python: a registry of kinds, isolated failures, results as columns, checks of arguments."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklens.functions.scalars import backoff_s, truncated

RESULT = "job_id string, attempt int, output string, snooze_s bigint, cancel boolean, error_message string, error_class string, delay_s bigint, follow_ups array<string>, cost_micros bigint"
#: Argument names of which exactly one must be there, by the kind of process: fixed values.
ONE_OF = {"python": ("script", "module", "code"), "shell": ("command", "script"), "mage": ("target", "default")}


@dataclass
class Result:
    """What a worker returns: an output, or a wish to wait or to cancel, children to enqueue, and a cost."""

    output: object = None
    snooze_s: int | None = None
    cancel: bool = False
    follow_ups: list = field(default_factory=list)
    cost_micros: int | None = None


class Worker(Protocol):
    """kind and work(args, attempt); timeout_ms, classify(error) and next_retry_s(attempt, error) if a worker has them."""

    kind: str

    def work(self, args: dict, attempt: int) -> Result: ...


class Limiter(Protocol):
    def acquire(self, now: float, n: int, token: str) -> tuple[int, float]: ...

    def release(self, n: int, token: str) -> int: ...


class Registry:
    def __init__(self):
        self.workers: dict[str, Worker] = {}

    def register(self, worker: Worker) -> None:
        if worker.kind in self.workers:
            raise ValueError(f"kind {worker.kind!r} is registered already")
        self.workers[worker.kind] = worker

    def timeouts(self) -> dict[str, int]:
        return {k: w.timeout_ms for k, w in self.workers.items() if getattr(w, "timeout_ms", 0) > 0}


class _Malformed(Exception):
    pass


def run_one(worker: Worker | None, args: str, attempt: int) -> tuple:
    """A row of RESULT without its job: whatever a worker raises becomes an error of its class, transient if it names none."""
    try:
        if worker is None:
            raise LookupError("unknown kind")
        try:
            given = json.loads(args or "{}")
        except ValueError as e:
            raise _Malformed(f"arguments: {e}") from e
        r = worker.work(given, attempt)
        return None if r.output is None else json.dumps(r.output, sort_keys=True), r.snooze_s, r.cancel, None, None, None, [json.dumps(f, sort_keys=True) for f in r.follow_ups], r.cost_micros
    except Exception as e:  # noqa: BLE001
        kind = "permanent" if isinstance(e, LookupError) and worker is None else "validation" if isinstance(e, _Malformed) else "timeout" if isinstance(e, TimeoutError) else None
        kind = kind or (worker.classify(e) if hasattr(worker, "classify") else None) or "transient"
        delay = worker.next_retry_s(attempt, e) if hasattr(worker, "next_retry_s") else None
        return None, None, False, str(e) or type(e).__name__, kind, delay, [], None


def worked(claimed: DataFrame, registry: Registry) -> DataFrame:
    """The results of claimed jobs (id, kind, args, attempt), in Arrow batches; one job's failure leaves the others alone."""
    workers = registry.workers
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, *run_one(workers.get(k), args, a)) for i, k, args, a in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    made = claimed.select("id", "kind", "args", F.col("attempt").cast("int")).mapInArrow(work, RESULT)
    return made.withColumn("error_message", truncated("error_message"))


def retry_delay_s(given: Column | str, attempt: Column | str, base: int = 1, most: int = 60) -> Column:
    """A worker's own delay, else the backoff of the attempt."""
    return F.coalesce(F.col(given) if isinstance(given, str) else given, backoff_s(attempt, base, most))


def argument_problem(kind: Column | str, args: Column | str) -> Column:
    """Why a process job's arguments (JSON) can't be run: not JSON, or not exactly one of its kind's names; null if they can."""
    kind, args = (F.col(x) if isinstance(x, str) else x for x in (kind, args))
    valid = F.try_parse_json(args).isNotNull() & args.isNotNull()
    out = F.when(~valid, "not JSON")
    for name, of in ONE_OF.items():
        there = sum((F.coalesce(F.get_json_object(args, f"$.{a}"), F.lit("")) != "").cast("int") for a in of)
        out = out.when((kind == name) & (there != 1), F.lit(f"exactly one of {', '.join(of)}"))
    return out
