"""Connected components of an edge table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.tables import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (src, dst); label is the smallest node reachable.

    Each round takes the smallest label among neighbours and then follows the
    label's own label, so paths shorten by doubling. Every round is written to
    the shared folder. Null ends, loops and repeated edges change nothing.
    """
    both = edges.where("src <> dst").select("src", "dst")
    both = materialize(both.union(both.select("dst", "src")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("label").alias("near"))
        best = labels.join(near, labels.node == near.src).select("node", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = best.join(jump, best.best == jump.via, "left").select("node", F.least("best", F.coalesce("far", "best")).alias("label"), F.expr("least(best, coalesce(far, best)) < label").alias("moved"))
        labels = discard(materialize(step, "labels"), labels)
        if not labels.where("moved").limit(1).count():
            out = discard(labels.drop("moved"), both)
            out._weekloom_path = labels._weekloom_path
            return out
