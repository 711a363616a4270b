"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytemill.llm.shared import kept

#: Rounds after which the loop gives up; the steps converge in O(log n) rounds.
MOST = 60


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours get linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and the node itself get linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node that has a link to another; component is the least node reachable.

    edges: two columns a and b of comparable ids, in any direction, repeats and loops allowed; rows with a null are
    ignored. Each round is written to the shared folder, so a lost executor costs no more than one round. What a
    node gathers is bounded by partial aggregation: the least of its neighbours, never a list.
    """
    edges = kept(edges.select("a", "b").where("a <> b").distinct())  # it is read twice, and may be dear
    now = kept(_small(edges))
    seen = None
    for _ in range(MOST):
        said = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if said == seen:
            break
        seen = said
        now = kept(_small(_large(now)))
    else:
        raise RuntimeError(f"no fixed point after {MOST} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
