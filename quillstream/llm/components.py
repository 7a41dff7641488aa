"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Smallest reachable id of every node: ``node, label``.

    ``links`` has non-null columns ``a, b``.  ``labels`` (``node, label``) are components found before, each node labelled with
    its component's smallest node; links then join those components.  Each round gives a component the smallest label
    beyond its links and follows labels of labels, so chains shorten by half or better; all is done by
    joins and sums of tables, and a node's links are combined before they are shuffled.
    """
    if labels is None:
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        labels = nodes.withColumn("label", F.col("node"))
    # links between components
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_"))
    pairs = links.join(of("a"), "a").join(of("b"), "b").where("a_ <> b_")
    pairs = pairs.select(F.least("a_", "b_").alias("low"), F.greatest("a_", "b_").alias("high")).distinct()
    pairs = written(pairs, "components-links")
    while not pairs.isEmpty():
        # every component points to its smallest smaller neighbour; pointers are then followed to their roots
        step = pairs.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root"))
        step = written(step, "components-step")
        while True:
            ahead = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            further = written(step.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "components-step")
            step = further.select("node", "root")
            if further.where("moved").isEmpty():
                break
        follow = step.select(F.col("node").alias("label"), "root")
        labels = written(labels.join(follow, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "components-labels")
        to = lambda c: step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        pairs = pairs.join(to("low"), "low", "left").join(to("high"), "high", "left").select(
            F.coalesce("low_root", "low").alias("x"), F.coalesce("high_root", "high").alias("y")
        ).where("x <> y")
        pairs = written(pairs.select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct(), "components-links")
    return labels
