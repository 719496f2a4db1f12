"""Shared plumbing: scratch tables in the shared folder, Arrow row mapping, the label split."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

OUT_ROWS, OUT_BYTES = 2000, 8 << 20
#: Rows of a record batch that a task hands to Python, where the session has Spark's own default: texts can be long.
BATCH_ROWS, SPARK_BATCH_ROWS = 1000, "10000"
#: Most rows of a few longs that are broadcast; beyond them the join is a shuffled one.
BROADCAST_ROWS = 1 << 20

_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share, spark.checkpoint.dir; it goes with the driver.

    Where that is unset, a local master (tests) gets a temporary folder, and any other an error: executors on other
    machines would not see the driver's folders.
    """
    app = spark.sparkContext.applicationId
    if app in _scratch:
        return _scratch[app]
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tasklens-")
        spark.sparkContext.setCheckpointDir(root)
    _scratch[app] = f"{root.rstrip('/')}/tasklens-{app}"
    atexit.register(_delete, spark, _scratch[app])
    return _scratch[app]


def _delete(spark: SparkSession, path: str) -> None:
    """Best effort: at exit the session may be gone already."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._tasklens_path = path
    return made


def dropped(made: DataFrame) -> None:
    """Deletes a table() that nothing reads any more; other DataFrames stay as they are."""
    if path := getattr(made, "_tasklens_path", None):
        _delete(made.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, name itself if it can be."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def sized(made: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most `most` rows, and for a shuffled join otherwise."""
    return F.broadcast(made) if made.limit(most + 1).count() <= most else made


_held: dict[str, object] = {}
_owner = ""


def kept(owner: str, name: str, make: Callable[[], object]):
    """make()'s object, one for each Python worker, kept from task to task for as long as the worker runs code of owner."""
    claim(owner)
    if name not in _held:
        _held[name] = make()
    return _held[name]


def claim(owner: str) -> None:
    """Frees what another operator's tasks have left in this Python worker, so that caches of several don't add up."""
    global _owner
    if owner != _owner:
        _owner = owner
        if _held:
            _held.clear()
            gc.collect()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)


def _cells(column: list | tuple, kind: pa.DataType) -> pa.Array:
    """A column of rows; lists of numbers may be numpy arrays, which become one flat buffer."""
    if pa.types.is_list(kind) and any(isinstance(x, np.ndarray) for x in column):
        sizes = np.fromiter((0 if x is None else len(x) for x in column), np.int64, len(column))
        flat = np.concatenate([x for x in column if x is not None and len(x)]) if sizes.any() else np.empty(0)
        missing = np.fromiter((x is None for x in column), bool, len(column))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(missing, False)), pa.array(flat, kind.value_type), type=kind)
    return pa.array(column, type=kind)


def _size(cell) -> int:
    return len(cell) if isinstance(cell, (str, bytes)) else 8 * len(cell) if isinstance(cell, (list, tuple, np.ndarray)) else 0


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in each record batch, where the session has Spark's default; a setting of the user's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, SPARK_BATCH_ROWS) == SPARK_BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_stream(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]]]) -> DataFrame:
    """mapInArrow for code that turns the record batches of a task into row tuples.

    make runs once in each task; rows leave in batches of OUT_ROWS rows or OUT_BYTES bytes (texts, bytes and lists
    counted), so memory stays bounded.
    """
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow, owner = to_arrow_schema(schema), make.__module__
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        held, size = [], 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_cells(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for row in make()(batches):
            held.append(row)
            size += sum(map(_size, row))
            if len(held) >= OUT_ROWS or size >= OUT_BYTES:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow for code that keeps the columns of df: rows go or cells change, one record batch at a time."""
    owner = make.__module__
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        change = make()
        for batch in batches:
            if batch.num_rows:
                yield change(batch)

    return df.mapInArrow(run, df.schema)


def map_rows(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterable[tuple]]]) -> DataFrame:
    """map_stream for code that takes one record batch at a time."""

    def stream():
        rows = make()
        return lambda batches: (row for batch in batches for row in rows(batch))

    stream.__module__ = make.__module__
    return map_stream(df, schema, stream)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled rows outside the held-out fifth, the first by a hash of doc_id.

    Of rows that repeat a doc_id, the one of the greatest text counts, and of repeated labels the greatest. The bound
    is a parameter of the models that call this; it limits fitting only, never scoring.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return joined.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("y").alias("y"))


def with_row_key(docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """docs with the column key, and whether that is the doc_id. If an id is null or repeated, each row has a number of its own."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count()
    if odd:
        return table(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), False
    return docs.withColumn(key, F.col("doc_id")), True
