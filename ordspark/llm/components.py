"""Connected components of an edge table by alternating large-star and
small-star steps (Kiveris et al., 2014), as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for every node that has an edge, the smallest node it can
    reach.  Ids are longs; rows with a null end and self-loops are ignored.

    Each step writes the edges, so an executor loss costs one step.  A hub's
    edges are aggregated before they move; the joins are plain equi-joins whose
    large partitions Spark can split.
    """
    e = table(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(),
        "edges",
    )
    while not _is_star_forest(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = table(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u != v")
            .distinct()
        )
        e = table(small, "small")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _is_star_forest(e: DataFrame) -> bool:
    centres = e.select(F.col("v").alias("u")).distinct()
    return centres.join(e.select("u"), "u", "left_semi").isEmpty()
