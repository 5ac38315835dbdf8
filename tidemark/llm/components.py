"""Connected components of a link table, by label hooking and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, component) per id that occurs in links; component is the smallest id it reaches.

    Links are undirected. Nulls and self links are ignored; repeated links count once; no links give no rows.
    Each round sends every node's label over its links (a minimum, combined before the shuffle), also to the node
    that the receiver's label names, then jumps to the label's label. The number of rounds grows with the logarithm of
    the longest path. Only the count of changed labels reaches the driver.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialize(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")), "labels")
    while True:
        sent = edges.join(labels.withColumnRenamed("node", "u"), "u").select("v", "label")
        heard = sent.groupBy(F.col("v").alias("node")).agg(F.min("label").alias("low"))
        met = labels.join(heard, "node")
        # the root that a node names hears what the node hears
        roots = met.where("low < label").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("root_low"))
        hooked = (
            met.join(roots, "node", "left")
            .select("node", F.col("label").alias("was"), F.least("label", "low", "root_low").alias("label"))
        )
        hooked = materialize(hooked, "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = hooked.join(up, "label", "left").select("node", "was", F.least("label", "up").alias("label"))
        jumped = materialize(jumped, "labels")
        changed = jumped.where("was <> label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
