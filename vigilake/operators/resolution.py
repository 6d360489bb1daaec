"""Entity resolution: components of observations that share an identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, shared) -> (node, component): nodes that share any value, directly or
    through others, get their smallest node (ER-01).

    Each shared value becomes a star around its smallest node, so a value of many
    nodes costs one row for each, not one for each pair. Labels move over these links
    and then jump to the label's own label: a chain of n nodes takes about log n
    rounds, and rounds go on until nothing moves. Minima are pre-aggregated; every
    round is written to the shared folder.
    """
    links = cut(links.where("node IS NOT NULL AND shared IS NOT NULL").select("node", "shared").distinct(), "links")
    hubs = links.groupBy("shared").agg(F.min("node").alias("hub"))
    star = links.join(hubs, "shared").where("node <> hub").select("node", "hub")
    both = cut(star.unionByName(star.select(F.col("hub").alias("node"), F.col("node").alias("hub"))).distinct(), "star")
    labels = cut(links.groupBy("node").agg(F.min("node").alias("label")), "labels")
    while True:  # labels only fall, so this ends
        seen = both.join(labels.withColumnRenamed("node", "hub"), "hub").groupBy("node").agg(F.min("label").alias("near"))
        moved = labels.join(seen, "node", "left").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        new = F.least("new", "far")
        stepped = cut(moved.join(jump, "new", "left").select("node", new.alias("label"), (new < F.col("label")).alias("moved")), "labels")
        labels = stepped.select("node", "label")
        if stepped.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def aggregates(observations: DataFrame, found: DataFrame) -> DataFrame:
    """One canonical record a component: primary identifier (the smallest CVE, else
    the smallest), first and last time, whether any source makes it active, and
    the evidence count (ER-03)."""
    cve = F.min(F.when(F.col("identifier").startswith("CVE-"), F.col("identifier")))
    return observations.join(found, "node").groupBy("component").agg(
        F.coalesce(cve, F.min("identifier")).alias("primary_identifier"), F.min("observed_at").alias("created_at"), F.max("observed_at").alias("updated_at"),
        F.bool_or("active").alias("active"), F.count_distinct("node").alias("n_evidence"),
    )


def owner_conflicts(found: DataFrame, owners: DataFrame) -> DataFrame:
    """Components that touch more than one stored record: never merged (ER-02)."""
    held = found.join(owners, "node").groupBy("component").agg(F.count_distinct("owner").alias("n_owners"))
    return held.where("n_owners > 1")
