"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import durable


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, label) for every id in ``edges`` (a, b longs): the label is the smallest id of its component.

    Each round hooks every neighbour of a node onto the smallest id around it, first for the larger neighbours, then
    for the smaller ones, so stars grow and their number falls at least by a fixed share. A node with very many
    neighbours is no burden: minima are combined before the exchange, and the join that follows can be split.
    Rows with equal ends and null ends are passed over.
    """
    current = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = _trace(current)
    for _ in range(most_rounds):
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        grown = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        grown = grown.union(own).where("a <> b").distinct()
        floor = grown.groupBy("a").agg(F.min("b").alias("m"))
        hooked = grown.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b")))
        current = durable(hooked.where("a <> b").distinct())
        if (now := _trace(current)) == known:
            break
        known = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("id"), F.col("b").alias("label")).union(current.select("b", "b").distinct())


def _trace(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
