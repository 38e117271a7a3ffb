"""Connected components of a table of links, on the executors alone.

Large-star and small-star steps in turn: each round hangs a node's neighbours on its least neighbour, so paths halve.
Only minima are grouped (they combine before a shuffle), and what is joined back are plain equi-joins, which Spark
splits where one node has very many links. A round's table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.store import Scratch


def components(links: DataFrame, scratch: Scratch, label: str = "cc", rounds: int = 60) -> DataFrame:
    """From ``a``, ``b`` to ``node``, ``component`` (its least node) for every node that has a link."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.save(edges, f"{label}-0")
    seen = None
    for i in range(1, rounds + 1):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours above u hang on u's least neighbour. They are the edges (v, u) with v above.
        large = edges.select(F.col("u").alias("w"), F.col("v").alias("u")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its neighbours below hang on the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = scratch.save(small.where("u <> v").distinct(), f"{label}-{i}")
        scratch.drop(f"{label}-{i - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
