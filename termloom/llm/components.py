"""Connected components of an edge table by repeated contraction, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import mark, release, written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``: comp is the smallest node reachable.

    Each round hangs every label below its smallest neighbour and relabels the edges; edges inside a label vanish.
    A hub is met by partial minima and by plain equi-joins that adaptive execution may split. Nulls and loops are ignored.
    """
    since = mark()
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select("b", "a"))
        parent = ends.groupBy("u").agg(F.least("u", F.min("v")).alias("p"))
        parent = written(parent, "parents")
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("comp"))
        else:
            labels = labels.join(parent, labels["comp"] == parent["u"], "left").select("node", F.coalesce("p", "comp").alias("comp"))
        labels = written(labels, "labels")
        for end in ("a", "b"):
            links = links.join(parent.select(F.col("u").alias(end), "p"), end).drop(end).withColumnRenamed("p", end)
        links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        release(since, labels, links)
    if labels is None:
        release(since)
        return edges.sparkSession.createDataFrame([], "node long, comp long")
    return labels
