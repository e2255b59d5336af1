"""Connected components of links between documents, by repeated joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import stored


def _followed(labels: DataFrame) -> DataFrame:
    """Labels replaced by their own labels, until they stay: paths halve each time."""
    while True:
        far = labels.select(F.col("node").alias("n2"), F.col("label").alias("far"))
        labels = stored(labels.join(far, labels["label"] == far["n2"]).select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")))
        if labels.filter("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node in edges (a, b), which have no direction. Edges with a null end, or
    both ends one node, link nothing and name no node; repeated edges count once; no edges give no rows.

    In each round every node takes its least neighbour, if less than itself, and so on to the end of the path; then nodes with one
    label become one node. At least half of the nodes with a link go in each round; rounds end when no link is left. Each round is
    written to the shared folder."""
    left = stored(edges.filter("a <> b").select("a", "b").distinct())
    rounds = []
    while not left.isEmpty():
        least = left.union(left.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        labels = _followed(stored(least.select("node", F.least("node", "near").alias("label"))))
        rounds.append(labels)
        of_a, of_b = labels.select(F.col("node").alias("na"), F.col("label").alias("la")), labels.select(F.col("node").alias("nb"), F.col("label").alias("lb"))
        left = left.join(of_a, left["a"] == of_a["na"]).join(of_b, left["b"] == of_b["nb"])
        left = stored(left.filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = rounds[0]
    for later in rounds[1:]:
        to = later.select(F.col("node").alias("n2"), F.col("label").alias("later"))
        out = out.join(to, out["label"] == to["n2"], "left").select("node", F.coalesce("later", "label").alias("label"))
    return out
