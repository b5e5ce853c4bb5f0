"""Connected components of a link table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; the component is its smallest node.

    Each round a node takes the smallest label among its own and its neighbours', then the label
    of that label. Only minima are gathered, so a hub's links are combined before the exchange
    and its join side is split by adaptive execution. Every round is a stored table.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = C.store(both.filter("a <> b").distinct(), "links")
    labels = C.store(edges.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(
            F.min("component").alias("near"))
        step = C.store(labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")), "step")
        of = step.select(F.col("node").alias("label"), F.col("component").alias("further"))
        jumped = C.store(step.join(of, step["component"] == of["label"]).select("node", "old", F.col("further").alias("component")), "labels")
        C.discard(step, labels)
        labels = jumped
        if not labels.filter("old <> component").limit(1).count():
            return labels.select("node", "component")
