"""Connected components by joins: smallest label among neighbours, then the label's own label, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.tables import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); a component is named by its smallest node.

    Labels only fall, and each round also replaces a label by its label's label, so long chains halve. A hub's
    links are reduced before they meet; joins on a hub can be split. Nodes without a link have no row.
    """
    edges = durable(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "edges")
    labels = durable(edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        new = nearer.join(jump, "via", "left").select("node", "was", F.least("via", F.coalesce("beyond", "via")).alias("component"))
        new = durable(new, "labels")
        if new.filter(F.col("component") != F.col("was")).limit(1).count() == 0:
            return new.select("node", "component")
        labels = new.select("node", "component")
