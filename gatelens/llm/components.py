"""Connected components of large graphs by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star step on ``node, parent`` with parent < node."""
    around = edges.union(edges.select(F.col("parent"), F.col("node"))).toDF("x", "y")
    least = around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    larger = around.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    # every larger neighbour now hangs on the least node; smaller neighbours follow in the second step
    linked = larger.where("x > y").distinct()
    below = linked.groupBy("x").agg(F.min("y").alias("m"))
    moved = linked.join(below, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return (
        moved.where("x > y").union(below.select("x", F.col("m"))).distinct().toDF("node", "parent")
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges that is not the least of its component.

    Each round is a written table and needs a bounded share of the edges per task; nothing is
    collected but counts. The number of rounds grows with the logarithm of the graph.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent")).distinct(),
        "components",
    )
    mark = _mark(now)
    while mark[0]:
        now = written(_stars(now), "components")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select("node", F.col("parent").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("node", "parent").cast("decimal(38,0)"))
    ).first()
    return row[0], int(row[1] or 0)
