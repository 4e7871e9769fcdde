"""Connected components of a large edge list, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node that has an edge.

    Each round every node joins its neighbour of the smallest hash, if that is below its own, and
    the edges are contracted; a fixed share of the nodes goes each time, so rounds grow with the
    logarithm of the size.  Rounds are written to the shared folder.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    left = Table(both.union(both.select("v", "u")).distinct(), "edges")
    owner = Table(left.df().select(F.col("u").alias("node"), F.col("u").alias("at")).distinct(), "owners")
    while left.df().limit(1).count():
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        least = left.df().groupBy("u").agg(F.min(order("v")).alias("near"))
        hooked = Table(least.select(F.col("u").alias("at"), F.least(order("u"), "near")["to"].alias("to")), "hooked")
        to = hooked.df()
        moved = owner.df().join(to, "at", "left").select("node", F.coalesce("to", "at").alias("at"))
        ends = left.df().join(to.select(F.col("at").alias("u"), F.col("to").alias("x")), "u").join(to.select(F.col("at").alias("v"), F.col("to").alias("y")), "v")
        owner, old = Table(moved, "owners"), (owner, left)
        left = Table(ends.filter("x != y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "edges")
        for x in (*old, hooked):
            x.drop()
    rows = owner.df()
    return rows.join(rows.groupBy("at").agg(F.min("node").alias("component")), "at").select("node", "component")
