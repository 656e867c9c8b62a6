"""Connected components of edge tables, by alternating stars with joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.plans.staging import Staging


#: Edges that a task writes, and the fewest tasks that write.
ROWS, LEAST_TASKS = 100_000, 8


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (a > b) is either a centre or tied to one centre alone, which then is the smallest of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("tied"), F.lit(1).alias("centre")))
    return ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre")).where("tied > 1 OR tied = 1 AND centre = 1").isEmpty()


def components(edges: DataFrame, staging: Staging, most_rounds: int = 60) -> DataFrame:
    """``a, b``: for every node of ``edges`` (a, b), except the smallest of each component, that smallest node.

    Large star, small star (Kiveris et al. 2014): a node's larger neighbours move
    to its smallest one, then its smaller neighbours do. Minima are aggregated
    before the shuffle and joined back to staged edges, so that no node's list
    of neighbours is ever gathered and a hot node's join can be split. Tables are
    written by a task for every ``ROWS`` edges, not by all tasks of the shuffle.
    """
    now = staging.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tasks = max(LEAST_TASKS, -(-now.count() // ROWS))
    put = lambda df, name: staging.table(df.coalesce(tasks), name)
    for _ in range(most_rounds):
        if _are_stars(now):
            return now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = put(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        # large star: of each pair (a < b) the larger end goes to a's minimum
        large = now.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = put(large, "large")
        least = put(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = put(small.select("e.*").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
