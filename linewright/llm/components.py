"""Connected components by repeated contraction, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) -> one row per linked node: node, root.

    Every round sends each node to its smallest neighbour and contracts the
    links accordingly; linked nodes stay linked, and the links are gone after
    a few rounds. Minima combine before the shuffle, and joins on a hub are
    splittable, so a hub is no single task's work. No links give no rows.
    """
    edges = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        left = least.select("a", F.col("m").alias("ma"))
        right = least.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        edges = stored(
            edges.join(left, "a").join(right, "b").where("ma <> mb").select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct(), "links"
        )
        if labels is None:
            labels = least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        else:
            labels = stored(
                labels.join(least.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("m", "root").alias("root")), "labels"
            )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # A node may point to one that itself moved in the same round: follow until all rest.
    while True:
        step = labels.select(F.col("node").alias("root"), F.col("root").alias("further")).where("root <> further")
        moved = labels.join(step, "root").select("node", F.col("further").alias("root"))
        if moved.isEmpty():
            return labels
        labels = stored(labels.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "labels")
