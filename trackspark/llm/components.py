"""Connected components by star contraction: in turns, each node links its larger neighbours, then its smaller
ones, to the least node it knows. Nodes meet in aggregations and joins only; no component meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, materialise


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds m: the least v of each u. Edges combine before they are shuffled; a heavy node's edges are split where the join is skewed."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have an edge; component is the least node it reaches.

    edges: a, b, in any order; repeated edges and edges from a node to itself do no harm.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = materialise(e)
    mark = _mark(e)
    while True:
        both = _with_least(e.union(e.select("v", "u")))
        half = materialise(both.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        # A node's larger end goes to its least neighbour as well, once.
        ways = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        old, e = e, materialise(_with_least(half).select(F.explode(ways).alias("x")).select("x.*").filter("u <> v").distinct())
        discard(old, half)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
