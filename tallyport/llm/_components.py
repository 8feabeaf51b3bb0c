"""Connected components of a distributed edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyport.llm import _session

#: Tasks over which the edges of one node, and the nodes of one label, are dealt.
SALTS = 4


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges (a, b)``; the label is the smallest node of the component.

    Each round maps every node to the smallest node next to it (twice, so that chains shorten), replaces the edges by
    those between what is left, and ends when none is left.  A round shuffles the edges that still join different nodes;
    nothing is gathered, and the tables of a round are written before the next one.
    """
    edges = _session.materialize(edges.filter("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = _session.materialize(nodes.withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("from"), F.least("a", "m").alias("to"))
        near = _session.materialize(near, "near")
        step = near.alias("x").join(near.alias("y"), F.col("x.to") == F.col("y.from"), "left").select(F.col("x.from").alias("from"), F.coalesce("y.to", "x.to").alias("to"))
        step = _session.materialize(step, "step")
        moved = _session.salted_join(labels, step.withColumnRenamed("from", "label"), "label", "left", SALTS).select("node", F.coalesce("to", "label").alias("label"))
        moved = _session.materialize(moved, "labels")
        left = step.select(F.col("from").alias("a"), F.col("to").alias("new_a"))
        right = step.select(F.col("from").alias("b"), F.col("to").alias("new_b"))
        fewer = _session.salted_join(_session.salted_join(edges, left, "a", "inner", SALTS), right, "b", "inner", SALTS).select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        fewer = _session.materialize(fewer.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        _session.discard(edges, near, step, labels)
        edges, labels = fewer, moved
    _session.discard(edges)
    return labels
