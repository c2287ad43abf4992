"""Connected components over edge tables, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for the nodes of ``edges`` (a, b).

    Every round gives each node the least label of its neighbours and then
    that label's own label; labels settle within about the logarithm of the
    longest path.  Each round's labels are written to the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        closer = labels.join(near, "node").select("node", F.least("root", "seen").alias("root"), F.col("root").alias("was"))
        jump = closer.join(labels.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
        stepped = materialize(jump.select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "was"), "labels")
        labels = stepped.select("node", "root")
        if stepped.filter("root <> was").isEmpty():
            return labels
