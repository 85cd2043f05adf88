"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum and a join, so hubs are pre-aggregated and skewed joins
can be split; the edge table is written between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.base import stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").selectExpr("b as a", "m as b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.selectExpr("greatest(a, b) as a", "least(a, b) as b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").selectExpr("b as a", "m as b")
    return moved.unionByName(least.selectExpr("a", "m as b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (least id) of every id that has an edge. edges: a, b."""
    edges = stash(edges.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state or not now[0]:
            break
        state = now
        edges = stash(_small_star(_large_star(edges)), "edges")
    pairs = edges.selectExpr("a as id", "b as component")
    return pairs.unionByName(pairs.selectExpr("component as id", "component")).distinct()
