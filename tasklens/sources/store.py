"""Snapshots, reports, settings and sinks."""

from __future__ import annotations

import json
import logging
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("tasklens")


def scratch(spark: SparkSession) -> str:
    """A folder for what passes: below spark.checkpoint.dir, or a temporary one where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tasklens-")
    return f"{root.rstrip('/')}/core-{uuid.uuid4().hex}"


class Snapshots:
    """Versions of relations below one folder: each is written whole, then a pointer row names it, so readers see all of it or none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_pointers")
        there = fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs)
        return self.spark.read.schema("name string, version bigint, path string").json(f"{self.root}/_pointers") if there else None

    def version(self, name: str) -> tuple[int, str | None]:
        found = self._pointers()
        row = None if found is None else found.where(F.col("name") == name).orderBy(F.desc("version")).first()
        return (row.version, row.path) if row else (0, None)

    def write(self, name: str, rows: DataFrame) -> int:
        version, path = self.version(name)[0] + 1, f"{self.root}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.spark.createDataFrame([(name, version, path)], "name string, version bigint, path string").write.mode("append").json(f"{self.root}/_pointers")
        return version

    def read(self, name: str) -> DataFrame:
        _, path = self.version(name)
        if path is None:
            raise FileNotFoundError(f"no snapshot of {name}")
        return self.spark.read.parquet(path)


# reports

_UNITS = (("h", 3600 * 10**9), ("m", 60 * 10**9), ("s", 10**9), ("ms", 10**6), ("us", 10**3), ("ns", 1))


def duration_text(ns: int) -> str:
    """The largest unit that a number of nanoseconds is a whole number of."""
    unit, size = next((u, s) for u, s in _UNITS if ns % s == 0 and (ns or s == 10**9))
    return f"{ns // size}{unit}"


@dataclass
class Report:
    """A run's figures; latencies that were never measured are left out, and a connection string loses its password."""

    scenario: str
    dsn: str = ""
    jobs: int = 0
    wall_ns: int = 0
    latencies_ns: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        out = asdict(self) | {"wall": duration_text(self.wall_ns), "dsn": re.sub(r"(://[^:@/]*):[^@]*@", r"\1:xxxxx@", self.dsn)}
        out["latencies"] = {k: {"text": duration_text(v), "ns": v} for k, v in sorted(out.pop("latencies_ns").items()) if v}
        return json.dumps(out, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Report:
        got = json.loads(text)
        return cls(got["scenario"], got["dsn"], got["jobs"], got["wall_ns"], {k: v["ns"] for k, v in got["latencies"].items()})


def report_rows(spark: SparkSession, reports: Iterable[Report]) -> DataFrame:
    """Reports as rows (scenario, jobs, wall_ns, latencies), through their JSON."""
    texts = spark.createDataFrame([(r.to_json(),) for r in reports], "text string")
    kind = "scenario string, dsn string, jobs bigint, wall string, wall_ns bigint, latencies map<string, struct<text: string, ns: bigint>>"
    return texts.select(F.from_json("text", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


# settings


@dataclass(frozen=True)
class Settings:
    """postgres names a database; without it a hardened SQLite file is used."""

    postgres: str = ""
    sqlite: str = "jobs.db"
    queues: tuple[str, ...] = ("default",)
    batch: int = 100
    concurrency: int = 8
    retention_s: int = 0

    @property
    def connector(self) -> tuple[str, str]:
        return ("postgres", self.postgres) if self.postgres else ("sqlite", f"{self.sqlite}?_journal_mode=WAL&_busy_timeout=5000&_foreign_keys=on")

    @property
    def claim_limit(self) -> int:
        return min(self.batch, self.concurrency)


def settings(text: str) -> Settings:
    """Settings of a JSON text, or of YAML where that library is there; unknown names and values out of range are errors."""
    try:
        got = json.loads(text or "{}")
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("settings must be JSON where no YAML library is installed") from e
        got = yaml.safe_load(text) or {}
    if unknown := set(got) - set(Settings.__dataclass_fields__):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    made = Settings(**{k: tuple(v) if k == "queues" else v for k, v in got.items()})
    if made.batch < 1 or made.concurrency < 1 or made.retention_s < 0 or not made.queues:
        raise ValueError("batch and concurrency must be 1 or more, retention_s 0 or more, queues not empty")
    return made


def jdbc(spark: SparkSession, made: Settings, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A relation of the database, read in parts by a numeric key; the driver's jar must be there."""
    dialect, where = made.connector
    if dialect != "postgres":
        raise ValueError("a SQLite file has one writer and no parallel readers: export it to Parquet")
    return spark.read.jdbc(where, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


# sinks

Sink = Callable[[DataFrame, int], None]


def fan_out(*sinks: Sink) -> Sink:
    """One sink that delivers a batch to each child, in order; the batch is kept meanwhile."""

    def deliver(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, number)
        finally:
            held.unpersist()

    return deliver


def log_sink(batch: DataFrame, number: int) -> None:
    """Numbers of events by kind in the log: supersedes as warnings, sweeps that found something as information."""
    for row in batch.groupBy("event").agg(F.count("*").alias("n")).collect():  # as many rows as there are kinds of events
        level = logging.WARNING if row.event == "supersede" else logging.INFO if row.event == "sweep" else logging.DEBUG
        log.log(level, "batch %d: %d %s", number, row.n, row.event)


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as a line of JSON, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
