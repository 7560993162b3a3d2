"""Connected components by alternating large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import discard, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node of an edge the least node that it reaches.

    Each round hangs the neighbours of every node below the least of them.  The
    least neighbours are summed before the exchange and written, so that the join with
    them is one of two tables: small ones are broadcast by their size, and a node with
    very many edges is dealt to several tasks as a skewed key.  After it such a node is
    the lesser end of its edges, which the second step doesn't deal by.  The number of rounds
    follows the logarithm of the number of nodes; the tables of a round are deleted
    when the next one is there.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = written(edges.select(u, v).where("u <> v").distinct(), "edges")
    state = _state(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = written(small.where("u <> v").distinct(), "edges")
        found = _state(after)
        discard(least)
        if found == state:
            discard(after)
            break
        discard(now)
        now, state = after, found
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
