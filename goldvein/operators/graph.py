"""Connected components by minimum labels with pointer jumping; rounds are cut by reliable checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that ``spark.checkpoint.dir`` names. Where it is unset, local sessions (tests)
    get one of our own; a cluster's machines share none, so there it must be set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is unset")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="goldvein-"))
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """(id, component): the smallest id reachable over (a, b) edges; nodes without edges are their own."""
    both = kept(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct())
    labels = kept(nodes.select(F.col(node).alias("id"), F.col(node).alias("component")).distinct())
    while True:
        near = both.join(labels, both.y == labels.id).groupBy(F.col("x").alias("id")).agg(F.min("component").alias("low"))
        stepped = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("low", "component")).alias("new"))
        far = stepped.select(F.col("id").alias("new"), F.col("new").alias("jump"))
        after = kept(stepped.join(far, "new", "left").select("id", "component", F.least("new", F.coalesce("jump", "new")).alias("new")))
        labels = after.select("id", F.col("new").alias("component"))
        if after.filter("new <> component").isEmpty():
            return labels
