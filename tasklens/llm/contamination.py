"""Benchmark decontamination: size-partitioned MinHash containment search, exact confirmation. DataFrame functions only.

A test item with n shingles lies inside a document if at least 80 % of them do. Such a document lacks at most
floor(n / 5) of them, so it holds one of the item's floor(n / 5) + 1 least hashes: its bottom-k MinHash sketch, whose
k grows with the partition of item sizes (sizes are parted by powers of two, each with the k of its largest size). All
shingle hashes of all documents are probed with these sketches, which loses nothing, and every candidate is confirmed
on shingle texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import fresh, sized, table, with_row_key
from tasklens.llm.urlrules import LOWER, UPPER

WORDS = 5


def _words(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def _shingles(words: str, k: int, hashed: bool) -> Column:
    def one(i: Column) -> Column:
        parts = [F.get(words, i + j) for j in range(k)]
        return F.xxhash64(*parts) if hashed else F.concat_ws(" ", *parts)

    made = F.transform(F.sequence(F.lit(0), F.size(words) - k), one)
    return F.array_distinct(F.when(F.size(words) >= k, made).otherwise(F.array().cast("array<bigint>" if hashed else "array<string>")))


def leaks(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, shared, n_item): items whose shingles lie in the document to at least percent %.

    Words are those of the near-duplicate operator; an item of fewer than five words is one shingle of its own length.
    Null or blank items and documents match nothing; rows of one doc_id count as one document; no rows give no rows.
    """
    made = items.where("item_id IS NOT NULL").select("item_id", _words(F.col("text")).alias("w")).withColumn("k", F.least(F.size("w"), F.lit(WORDS))).where("k > 0")
    shapes = [r.k for r in made.select("k").distinct().collect()]  # five numbers at most
    if not shapes:
        return docs.select("doc_id").limit(0).select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("n_item"))
    by_item = None
    for k in sorted(shapes):
        some = made.where(F.col("k") == k).select("item_id", "k", F.explode(_shingles("w", k, False)).alias("shingle"))
        some = some.withColumn("h", F.xxhash64(*[F.split("shingle", " ")[j] for j in range(k)]))
        by_item = some if by_item is None else by_item.unionByName(some)
    by_item = table(by_item.distinct(), "items")
    size_of = by_item.groupBy("item_id").agg(F.count("*").alias("n_item"))
    ordered = by_item.groupBy("item_id", "k").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    upper = F.pow(F.lit(2), F.floor(F.log2(F.size("hs"))) + 1) - 1  # the largest size of the item's partition
    depth = F.least(F.floor(upper * (100 - percent) / 100) + 1, F.size("hs")).cast("int")
    keys = table(ordered.select("k", "item_id", F.explode(F.slice("hs", F.lit(1), depth)).alias("h")), "sketches")
    probe = sized(table(keys.select("k", "h").distinct(), "probe"))

    worded = docs.where("doc_id IS NOT NULL").select("doc_id", _words(F.col("text")).alias("w"))
    hits = None
    for k in sorted(shapes):
        some = worded.select("doc_id", F.explode(_shingles("w", k, True)).alias("h")).join(probe.where(F.col("k") == k).select("h"), "h", "left_semi").withColumn("k", F.lit(k))
        hits = some if hits is None else hits.unionByName(some)
    hits = table(hits, "hits")
    pairs = table(hits.join(keys, ["k", "h"]).select("doc_id", "item_id").distinct(), "candidates")

    wanted = sized(table(pairs.select("doc_id").distinct(), "candidate_docs"))
    full = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").select("doc_id", _words(F.col("text")).alias("w"))
    every = None
    for k in sorted(shapes):
        some = full.select("doc_id", F.explode(_shingles("w", k, False)).alias("shingle")).withColumn("k", F.lit(k))
        every = some if every is None else every.unionByName(some)
    known = sized(table(by_item.select("k", "shingle", "item_id"), "shingles"))
    met = every.join(known, ["k", "shingle"]).select("doc_id", "item_id", "shingle").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    held = met.join(pairs, ["doc_id", "item_id"], "left_semi").join(size_of, "item_id")
    return held.where(100 * F.col("shared") >= percent * F.col("n_item")).select("doc_id", "item_id", "shared", "n_item")


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the rows that hold a test item, whether their doc_id is null, repeated or not; all columns stay.

    Null and blank texts hold nothing and stay. No items leave docs as they are; no rows give none.
    """
    key = fresh(docs, "row_key")
    rows, _ = with_row_key(docs, key)
    found = leaks(rows.select(F.col(key).alias("doc_id"), "text"), items, percent)
    gone = table(found.select(F.col("doc_id").alias(key)).distinct(), "leaking")
    return rows.join(sized(gone), key, "left_anti").select(*docs.columns)
