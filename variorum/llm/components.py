"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.session import stage


def components(links: DataFrame) -> DataFrame:
    """`node` and `component`, its smallest reachable node, for each node of `links` (a, b: long).

    Each round every node points at its smallest neighbour, pointers are followed twice, and links are
    rewritten between what they lead to, so their number falls by half or more a round; a star takes one.
    A round's result is written to the shared folder, so nothing is lost with an executor. Links are only
    counted, never collected.

    No links give no nodes.
    """
    edges = stage(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = stage(nodes.select("node", F.col("node").alias("component")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "points")
        next_of = points.select(F.col("a").alias("to"), F.col("to").alias("then"))
        jumped = stage(points.join(next_of, "to").select("a", F.col("then").alias("to")), "jumped")
        labels = stage(
            labels.join(jumped, labels["component"] == jumped["a"], "left").select(
                "node", F.coalesce("to", "component").alias("component")
            ),
            "labels",
        )
        from_a = jumped.select("a", F.col("to").alias("x"))
        from_b = jumped.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = stage(
            edges.join(from_a, "a")
            .join(from_b, "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "links",
        )
    return labels
