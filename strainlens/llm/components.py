"""Connected components of a link table, in a logarithmic number of rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlens import session


def _jump(parent: DataFrame) -> DataFrame:
    """Every pointer followed to its end; the number of steps halves the depth."""
    while True:
        q = parent.select(F.col("v").alias("q_v"), F.col("p").alias("q_p"))
        step = session.cut_lineage(parent.join(q, F.col("p") == F.col("q_v"), "left").select("v", F.coalesce("q_p", "p").alias("p"), F.col("q_p").isNotNull().alias("moved")), "jump")
        parent = step.select("v", "p")
        if step.where("moved").isEmpty():
            return parent


def components(links: DataFrame) -> DataFrame:
    """``v`` and ``root`` (smallest vertex of its component) for the ends of links ``a``, ``b``.

    Each round hooks every vertex to its smallest neighbour, follows the
    pointers and contracts the links.  Only local minima remain, at most half
    of the vertices, so the rounds are logarithmic in the number of vertices.
    """
    edges = session.cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        # of an edge only the larger end can hook to the other
        hook = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        parent = _jump(session.cut_lineage(hook, "hook"))
        rounds.append(parent)
        e = edges
        for end in ("a", "b"):
            q = parent.select(F.col("v").alias(f"v_{end}"), F.col("p").alias(f"p_{end}"))
            e = e.join(q, F.col(end) == F.col(f"v_{end}"), "left").withColumn(end, F.coalesce(f"p_{end}", end)).drop(f"v_{end}", f"p_{end}")
        edges = session.cut_lineage(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    if not rounds:
        return links.select(F.col("a").alias("v"), F.col("a").alias("root")).where("false")
    out = rounds[0]
    for later in rounds[1:]:
        q = later.select(F.col("v").alias("q_v"), F.col("p").alias("q_p"))
        moved = out.join(q, F.col("p") == F.col("q_v"), "left").select("v", F.coalesce("q_p", "p").alias("p"))
        out = moved.unionByName(later)
    # a root of an early round is its own entry only from the round in which it hooked
    out = session.cut_lineage(out.groupBy("v").agg(F.min("p").alias("root")), "roots")
    return out.unionByName(out.select(F.col("root").alias("v"), "root").distinct())
