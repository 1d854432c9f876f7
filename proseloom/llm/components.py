"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.llm.store import drop_settled, settle


def _digest(edges: DataFrame) -> tuple:
    """Number and hash of distinct edges: equal where two tables have the same edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id of the edges (a, b) reaches.

    Alternating large-star and small-star steps: every node hangs its larger neighbours, then its smaller ones, under
    its smallest neighbour.  The edges become stars after a number of rounds that grows as the square of the logarithm
    at most; each round is two aggregations, and nothing but a count and two hashes of the edges reach the driver.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = settle(both, "edges")
    state = _digest(current)
    while True:
        ways = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("low"))
        # Large star: neighbours above a node hang under the least of its neighbourhood.
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v"))
        # Small star: a node and its neighbours below hang under the least of them; what stays is a forest of edges.
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        found = settle(small.select("e.*").where("u <> v").distinct(), "edges")
        drop_settled(current)
        current, before = found, state
        state = _digest(current)
        if state == before:
            return current.select(F.col("u").alias("id"), F.col("v").alias("root"))
