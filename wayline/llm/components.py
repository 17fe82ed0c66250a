"""Connected components by hooking and contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of the edges (a long, b long) the smallest node of its component.

    A round hooks each node to the smallest of its neighbours, follows the hooks, and keeps only the edges
    between different roots. Hooks go to smaller numbers, so they form trees; the number of edges that
    are left falls by a constant factor a round. Sums and minima are combined before any shuffle, so a node
    with very many edges costs no task more than others. An empty table gives no rows.
    """
    spark = edges.sparkSession
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    known = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        hooks = cut(hooks, "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top")).where("root <> top")
            jumped = cut(hooks.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        a = hooks.select(F.col("node").alias("a"), F.col("root").alias("x"))
        b = hooks.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = cut(edges.join(a, "a").join(b, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        if known is None:
            known = hooks
        else:
            higher = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            known = cut(known.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    return known if known is not None else spark.createDataFrame([], "node long, root long")
