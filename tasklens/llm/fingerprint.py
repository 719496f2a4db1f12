"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by normalised bit overlap.

Every window of WINDOW bytes is ranked by its collision entropy, from the number of equal pairs among its bytes: the
fewer, the rarer; ties go by the window's hash. A window that ranks first among its 2 * REACH neighbours is a feature. Features go
in order into Bloom filters of BITS bits, five bits each, and a new filter is chained when one holds MOST_FEATURES.
The likeness of two digests is the mean over the smaller one's filters of their best overlap with a filter of the other,
where an overlap of chance counts 0 and a whole one 1. Equal texts have equal digests and a likeness of 1; a text
without a feature (shorter than a window) has its bytes as its only feature, and an empty one likes only another.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import map_stream, shuffle_partitions, small_batches

WINDOW, REACH, BITS, PLACES, MOST_FEATURES, STEP = 16, 24, 2048, 5, 160, 1 << 18
_S = [np.uint64(x) for x in (29, 32, 11)]
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[0])) * _MUL
    return (x ^ (x >> _S[1])) * _MUL


def _ranked(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank key and hash of each window of b; a least key is the rarest window."""
    n = len(b) - WINDOW + 1
    pairs = np.zeros(n, np.int32)
    for d in range(1, WINDOW):
        same = np.zeros(len(b) - d + 1, np.int32)
        np.cumsum(b[d:] == b[:-d], out=same[1:])
        pairs += same[WINDOW - d : WINDOW - d + n] - same[:n]
    eight = np.zeros(len(b) - 7, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | b[k : len(b) - 7 + k]
    h = _mix(_mix(eight[:n]) + eight[8 : 8 + n])
    return (pairs.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8)), h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i that has so many, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1]) if have < width else out


def features(raw: bytes) -> np.ndarray:
    """Hashes of the features, in order; a long text goes in steps, and each step sees its neighbours' windows."""
    if not raw:
        return np.empty(0, np.uint64)
    if len(raw) < WINDOW:
        return np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64)
    b, found = np.frombuffer(raw, np.uint8), []
    n = len(b) - WINDOW + 1
    for at in range(0, n, STEP):
        low, high = max(0, at - REACH), min(n, at + STEP + REACH)
        key, h = _ranked(b[low : high + WINDOW - 1])
        padded = np.concatenate([np.full(REACH, np.iinfo(np.uint64).max, np.uint64), key, np.full(REACH, np.iinfo(np.uint64).max, np.uint64)])
        first = key == _least(padded, 2 * REACH + 1)
        first[: at - low] = False
        first[min(n, at + STEP) - low :] = False
        found.append(h[first])
    return np.concatenate(found)


def digest(text: str | None) -> np.ndarray:
    """Filters as rows of bits (bool)."""
    h = features((text or "").encode("utf-8", "surrogatepass"))
    out = np.zeros((-(-len(h) // MOST_FEATURES), BITS), bool)
    row = np.arange(len(h)) // MOST_FEATURES
    for k in range(PLACES):
        out[row, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.intp)] = True
    return out


def as_string(filters: np.ndarray) -> str:
    return f"{len(filters)}:{base64.b64encode(np.packbits(filters).tobytes()).decode()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = a.sum(1).astype(np.float64), b.sum(1).astype(np.float64)
    wide = b.astype(np.float32).T
    best = np.zeros(len(a))
    for i in range(0, len(a), 256):
        both = a[i : i + 256].astype(np.float32) @ wide
        chance = na[i : i + 256, None] * nb / BITS
        most = np.minimum(na[i : i + 256, None], nb)
        best[i : i + 256] = ((both - chance) / np.maximum(most - chance, 1e-9)).max(1)
    return float(np.clip(np.average(np.clip(best, 0, 1), weights=na), 0, 1))


def _buckets(docs: DataFrame, n: int) -> DataFrame:
    """docs (doc_id, text) with a bucket by range of doc_id, and the first rows of each bucket once more behind the one before it.

    Buckets ascend as doc_id descends; the first bucket's head is also behind the last one. Borders and the ids of the
    buckets' heads, n + 2 of each at most, reach the driver; a row finds its bucket by bisection.
    """
    found = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    borders = np.array(sorted({int(x) for x in found}), np.int64)
    last = len(borders) + 1  # of rows without an id

    def at(ids: pa.Array) -> pa.Array:
        place = len(borders) - np.searchsorted(borders, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), last, place).astype(np.int32))

    placed = docs.select("doc_id", "text").withColumn("bucket", F.arrow_udf(at, "int")(F.col("doc_id").cast("long")))
    heads = [(r.bucket, r.head) for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()]
    if not heads:
        return placed.withColumn("guest", F.lit(False))
    before = [(heads[k - 1][0], heads[k][0], heads[k][1]) for k in range(len(heads))]
    behind = docs.sparkSession.createDataFrame(before, "b int, own int, head long")
    guests = placed.join(F.broadcast(behind), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head")))
    guests = guests.select("doc_id", "text", F.col("b").alias("bucket"), F.lit(True).alias("guest"))
    return placed.withColumn("guest", F.lit(False)).unionByName(guests)


def fingerprints(docs: DataFrame, buckets_per_partition: int = 4) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The next document is that of the next lower doc_id, after the last the first; rows of one doc_id follow by text, and
    a null doc_id comes last. A null text counts as empty. One document is its own next; no rows give none.
    """
    n = shuffle_partitions(docs.sparkSession)
    small_batches(docs.sparkSession)
    dealt = _buckets(docs, n * buckets_per_partition).repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def make():
        def stream(batches: Iterator[pa.RecordBatch]):
            held = None
            for batch in batches:
                for doc_id, raw, bucket, guest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    if guest and (held is None or held[3] != bucket):
                        continue
                    text = raw.as_py() or ""
                    own = digest(text)
                    if held is not None:
                        last_id, last, last_own, _ = held
                        cut = len(last) // 3
                        edited = (last[: len(last) - cut] if cut else last) + text[:cut]
                        changed = digest(edited)
                        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                        yield last_id, len(last), sha, as_string(last_own), as_string(changed), likeness(last_own, changed), likeness(last_own, own)
                    held = None if guest else (doc_id, text, own, bucket)

        return stream

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_stream(dealt, schema, make)
