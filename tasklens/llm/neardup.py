"""Near-duplicate documents: MinHash samples, banded candidates, odd-sketch verification, exact confirmation.

A document is the set of its distinct 5-word shingles. 160 MinHash samples make 32 bands of 5 rows, which miss a pair
at a similarity of 0.85 once in 10^8, and are folded into an odd sketch (Mitzenmacher, Pagh, Pham, 2014): sample i
flips one of 256 parity bits, and the population count of two sketches' XOR estimates how many samples differ. Pairs
whose estimate lies beyond a wide margin are dropped; all others are confirmed on the full sets.

No step lists all pairs of a group. Equal sets are one class from the start. Each class is first linked to the best of
the least members of its buckets, and components are taken. Members of buckets that still lie in different components
then meet by the rare shingles of their prefixes, which loses no link of theirs; one inside a component cannot change
the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklens.llm.common import fresh, map_rows, sized, table, with_row_key
from tasklens.llm.graph import connected_components

WORDS, BANDS, ROWS = 5, 32, 5
SAMPLES, ODD_BITS = BANDS * ROWS, 256
#: Bits of two sketches that may differ: at a similarity of 0.85 about 38, with a deviation below 7.
MOST_DIFFERENT = 90

_rng = np.random.Generator(np.random.PCG64(20240601))
_MULTIPLY = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_ROW = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_FOLD = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_S29, _S32, _S56 = np.uint64(29), np.uint64(32), np.uint64(56)
STEP = 2048


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _PLACE[0]
    x = (x ^ (x >> _S29)) * _PLACE[1]
    return x ^ (x >> _S32)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; A-Z lower-cased, words parted by \\x20 and \\x09-\\x0D.

    With fewer words the whole sequence is one shingle; null, empty or blank text has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(w) < WORDS:
        h = np.array([len(w)], np.uint64)
        for k in range(len(w)):
            h = h * _PLACE[0] + w[k : k + 1] * _PLACE[k]
    else:
        n = len(w) - WORDS + 1
        h = w[:n] * _PLACE[0]
        for k in range(1, WORDS):
            h = (h ^ (h >> _S29)) * _PLACE[1] + w[k : n + k] * _PLACE[k]
    return np.unique(_mix(h))


def sketch(s: np.ndarray) -> tuple[list[int], list[int]]:
    """Band keys and the odd sketch (as 4 longs) of a set that isn't empty."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), STEP):
        np.minimum(low, (s[i : i + STEP, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    mixed = _mix(low ^ _ADD)
    keys = _mix((mixed.reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) + _BAND)
    places = (_mix(mixed * _FOLD) >> _S56).astype(np.intp)
    bits = (np.bincount(places, minlength=ODD_BITS) & 1).astype(np.uint8)
    return keys.view(np.int64).tolist(), np.packbits(bits).view("<i8").tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_hi, set_lo, keys, odd for each document; the last four are null for an empty set."""

    def make():
        def rows(batch: pa.RecordBatch):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(text.as_py())
                if len(s):
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    yield (i, len(s), int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), *sketch(s))
                else:
                    yield i, 0, None, None, None, None

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n long, set_hi long, set_lo long, keys array<long>, odd array<long>", make)


def _sets(docs: DataFrame) -> DataFrame:
    def make():
        def rows(batch: pa.RecordBatch):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield i, shingle_set(text.as_py()).view(np.int64)

        return rows

    return map_rows(docs.select("doc_id", "text"), "id long, set array<long>", make)


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, set for the documents named in ids (id); rows of one doc_id with several texts: the same one stands for it."""
    sets = table(_sets(docs.join(sized(table(ids.withColumnRenamed("id", "doc_id").distinct(), "ids")), "doc_id", "left_semi")), "sets")
    if sets.groupBy("id").count().where("count > 1").limit(1).count():
        sets = table(sets.groupBy("id").agg(F.max("set").alias("set")), "sets")
    return sets


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    )
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
    return shared.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def _different(x: str, y: str):
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(1, 4)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def _across(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different parts, for apart (id, part, odd) with the full sets: loses no link.

    Shingles stand in one order, rare ones first. The first shingle that two linked sets share stands so early in both
    that what follows it can still make up the overlap (prefix and positional filter; Bayardo et al., 2007, Xiao et al.,
    2008). Members of a large group that are linked to nothing differ from it by rare shingles, so few pairs meet. Of a
    shingle's parts the largest is never compared with itself. Shingles of one set only come first of all and can't be
    shared, so they are counted and not sorted; places come from a window over one document, which spills, and every
    join is one of two written tables, which Spark splits where a shingle is frequent.
    """
    rows = sets.select("id", F.size("set").cast("long").alias("n"), F.explode("set").alias("h"))
    often = table(rows.groupBy("h").agg(F.count("*").alias("f")).where("f > 1"), "often")
    own = Window.partitionBy("id")
    placed = rows.join(often, "h").withColumn("at", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "h")) - 1)
    early = placed.where(f"at <= n - (n * {percent} + 99) div 100").select("id", "n", "at", "h")
    early = table(early.join(sized(apart), "id"), "prefixes")
    spread = early.groupBy("h", "part").count().groupBy("h").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("parts"))
    early = table(early.join(sized(table(spread.where("parts > 1").select("h", "main"), "mains")), "h"), "mixed_prefixes")
    left, right = early.where("part <> main").toDF("h", "a", "na", "ia", "pa", "oa", "ma"), early.toDF("h", "b", "nb", "ib", "pb", "ob", "mb")
    met = left.join(right, (left.h == right.h) & F.expr(f"(pb = mb OR pa < pb) AND {100 + percent} * least(na - ia, nb - ib) >= {percent} * (na + nb)") & (_different("oa", "ob") <= MOST_DIFFERENT))
    return table(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "late")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are ignored).

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the least
    doc_id reachable by links, and kept says that it is the document's own. Empty sets link to nothing. Repeated rows
    of one doc_id share its component. A null doc_id has a null component and is kept. No rows give no rows.
    """
    every = table(sketches(docs), "sketches")
    full = every.where("n > 0 AND doc_id IS NOT NULL")
    classes = sized(table(full.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep")), "sets"))
    whole = full.join(classes.select(F.col("set_hi").alias("c_hi"), F.col("set_lo").alias("c_lo"), "rep"), F.expr("set_hi = c_hi AND set_lo = c_lo AND doc_id = rep"))
    whole = table(whole.select(F.col("rep").alias("id"), "n", "keys", "odd").dropDuplicates(["id"]), "classes")
    same = full.join(classes, ["set_hi", "set_lo"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    banded = whole.select("id", F.explode("keys").alias("key"))
    heads = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members")
    members = table(banded.join(sized(table(heads, "heads")), "key").select("key", "id", "hub"), "members")
    size_ok = lambda x, y: f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"
    traits = whole.select("id", "n", "odd")
    stars = (
        members.where("id > hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
        .join(traits.toDF("a", "na", "oa"), "a").join(traits.toDF("b", "nb", "ob"), "b")
        .withColumn("different", _different("oa", "ob")).where(size_ok("na", "nb")).where(F.col("different") <= MOST_DIFFERENT)
        .groupBy("a").agg(F.min(F.struct("different", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    )
    stars = table(stars, "stars")
    links = _confirmed(stars, _full_sets(docs, stars.select(F.explode(F.array("a", "b")).alias("id"))), percent)
    same = table(same.unionByName(links), "links")
    parts = table(connected_components(same, "a", "b"), "parts")

    # documents of a bucket whose members lie in several components as yet
    placed = members.select("key", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    apart = table(placed.join(sized(table(mixed, "mixed")), "key", "left_semi").select("id", "part").distinct().join(whole.select("id", "odd"), "id"), "apart")
    sets = _full_sets(docs, apart.select("id"))
    more = _confirmed(_across(apart, sets, percent), sets, percent)
    parts = table(connected_components(same.unionByName(more), "a", "b"), "parts")

    placed = every.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs with one row of each group of near duplicates, the one of the least doc_id; all columns stay as they are.

    Rows whose doc_id is null or repeated are compared like other rows, so of exact repeats one stays. A null doc_id
    stays only where its group has no other. Null, empty and blank texts are linked to nothing and stay. No rows give
    none; columns of any other name are carried along.
    """
    key = fresh(docs, "row_key")
    rows, own = with_row_key(docs, key)
    near = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), percent)
    if own:
        gone = near.where("NOT kept").select(F.col("doc_id").alias(key))
    else:
        near = table(near.select(F.col("doc_id").alias(key), "component_id"), "near")
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(key).alias("k"))
        groups = near.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(order)["k"].alias(key))
        gone = near.select(key).join(table(groups.select(key), "groups"), key, "left_anti")
    return rows.join(sized(table(gone.distinct(), "gone")), key, "left_anti").select(*docs.columns)
