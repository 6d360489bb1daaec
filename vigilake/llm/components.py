"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.session import cut


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, component): the smallest id that each linked id can reach.

    Labels move over edges and then jump to the label's own label, so a chain of
    n links needs about log n rounds; each round is written to the shared folder.
    Sums and minima are taken before rows are shuffled; a hub's edges meet its one
    label in a plain join of two shuffled sides, which Spark splits when skewed.
    """
    edges = edges.where("a <> b and a is not null and b is not null")
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:  # labels only fall, so this ends
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        least = F.least("new", F.coalesce("far", "new"))
        stepped = moved.join(jump, "new", "left").select("id", least.alias("label"), (least < F.col("label")).alias("changed"))
        stepped = cut(stepped, "labels")
        labels = stepped.select("id", "label")
        if stepped.where("changed").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
