"""Connected components of edges between long ids, without any node's neighbours in memory.

Each round a node takes the least label around it, then labels jump to their own labels.
Aggregations combine before they shuffle, so a hub costs no more than its edges, and each
round is stored in the shared folder, so that plans stay short. Labels, one row a node, are
broadcast while they are small; beyond that both sides of a join are stored tables, whose hot
keys (a hub, or the label of a large component) adaptive execution parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import checked
from chronoweave.runtime import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of ``edges`` (u, v)."""
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        around = both.join(checked(labels.select(F.col("node").alias("v"), "label")), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = cut(near.join(checked(jump), "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels")
        discard(labels)
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            discard(both)
            return labels
