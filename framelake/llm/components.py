"""Connected components of an edge table, by random hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For each node of the edges (two columns of one type): node, component, the least node of its component.

    In each round a node hooks on to the neighbour of least hash (seeded by the round) if that is below its own, and is
    moved up its chain of hooks by four steps, which is to its root mostly, as chains of random hashes are short; edges
    move along, and those that join a node to itself are dropped. Any step up stays within the component, so what is
    connected stays so. The edges shrink by a constant factor a round, so the number of rounds grows with the logarithm of
    the input. Hot nodes are reduced by partial aggregation before each shuffle; nothing is collected but counts. Null
    ends are dropped; an empty table gives an empty table. The result is a table made by stored().
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    left = stored(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stored(left.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
    left, old = left.where("u <> v"), left
    number = 0
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        hooks = stored(left.groupBy("u").agg(F.min(rank("v")).alias("least")).select("u", F.least("least", rank("u"))["n"].alias("up")))
        once = hooks.select(F.col("u").alias("w"), F.col("up").alias("x"))
        twice = hooks.join(once, F.col("up") == F.col("w")).select("u", F.col("x").alias("up"))
        again = twice.select(F.col("u").alias("w"), F.col("up").alias("x"))
        ups = stored(twice.join(again, F.col("up") == F.col("w")).select("u", F.col("x").alias("up")))
        newer = stored(labels.join(ups, labels["root"] == ups["u"], "left").select("node", F.coalesce("up", "root").alias("root")))
        at = ups.select(F.col("u").alias("w"), F.col("up").alias("v_up"))
        shrunk = stored(left.join(ups, "u").select(F.col("up").alias("u"), "v").join(at, F.col("v") == F.col("w")).select("u", F.col("v_up").alias("v")).where("u <> v").distinct())
        dropped(labels, old, hooks, ups)
        labels, left, old = newer, shrunk, shrunk
        number += 1
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    out = stored(labels.join(least, "root").select("node", "component"))
    dropped(labels, old)
    return out
