"""Connected components of an edge table, by rounds of joins on written tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """node, label for the nodes of edges (a long, b long): label is the least node of its component.

    Each round takes the least label among neighbours, then the label of that label, so that rounds grow
    with the logarithm of a component's width. The last round changes nothing. A node with many
    neighbours is pre-aggregated before the shuffle.
    """
    both = C.cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = C.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), "label")
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = C.cut(step.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
