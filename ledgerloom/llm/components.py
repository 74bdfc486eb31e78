"""Connected components of a graph given by its edges, by alternating star steps.

Large-star ties every larger neighbour of a node to the smallest, small-star every smaller
one; repeated, all that remains is one star per component around its smallest node.  Both
are a grouped minimum and a join back, so a node with a third of all edges is summed up
before the shuffle and its join partition can be split.  Each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.lookups import lookup
from ledgerloom.session import pin

MAX_ROUNDS = 100


def _smallest(pairs: DataFrame) -> DataFrame:
    """Add to ``u, v`` the smallest of u and all its v, as ``m``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_least"))
    return lookup(pairs, least, ["u"]).select("u", "v", F.least("u", "_least").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    small = _smallest(large)  # every v is below its u
    to_least = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return small.select(F.explode(to_least).alias("e")).select("e.*").where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node but the smallest of each component, its label.

    ``edges`` has two columns of whole numbers; loops and repeated edges are allowed, nulls are not edges.
    """
    a, b = edges.columns
    state = pin(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = digest(state)
    for _ in range(MAX_ROUNDS):
        state = pin(_round(state))
        now = digest(state)
        if now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now
    raise RuntimeError("components did not settle")
