"""Connected components by alternating large-star and small-star (Kiveris et al., 2014), in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import dropped, sized, table


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # a written table, so that the join is of two plain exchanges, which Spark splits where a node has many edges
    least = sized(table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")), "least"))
    return both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sized(table(down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"), "least"))
    moved = down.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable, the node itself included.

    Edges are undirected. Repeated edges, loops and null ends are allowed: a loop makes a node, a null end drops the
    edge. No edges give no rows. Every round is cut by a table in the shared folder, and the one before it is deleted.
    Minima are summed before the shuffle, and the joins are plain ones, which Spark splits where one hub holds many
    edges.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    first = table(ends.distinct(), "edges")
    now = first.where("u <> v")
    last = None
    for _ in range(most_rounds):
        before, now = now, table(_small(table(_large(now), "large")), "stars")
        dropped(before)
        mark = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    loops = first.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    settled = members.union(roots)
    return settled.union(loops.join(settled.select("node"), "node", "left_anti"))
