"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links (a, b) -> node, component (the smallest node that can be reached), one row for each node that has a link.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so chains halve. Minima
    are taken before rows move; labels are written in the shared folder after every round. Null ends and loops are ignored.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node is not null and other is not null and node <> other")
    edges = materialize(pairs.union(pairs.select("other", "node")).distinct(), "cc-edges")
    before = labels = materialize(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "cc-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), F.col("component").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "theirs").alias("mid"))
        jump = step.join(labels.select(F.col("node").alias("mid"), F.col("component").alias("root")), "mid", "left")
        # the label's own label: a label is always a node
        out = materialize(jump.select("node", "was", F.least("mid", "root").alias("component")), "cc-labels")
        discard(before)
        before, labels = out, out.select("node", "component")
        if out.where("was <> component").limit(1).count() == 0:
            discard(edges)
            return labels
