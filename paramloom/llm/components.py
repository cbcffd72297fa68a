"""Connected components of links between numbered nodes, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramloom.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """``a long, b long`` to ``node, component``: the smallest node that each node reaches.

    Rounds of taking the neighbours' smallest label and then the label's own label; paths
    shorten by more than half in each, so that the rounds grow with the logarithm of a
    component's width. Labels of all rounds are tables in the shared folder. No links give
    no rows; null ends and loops are left out.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = written(links.union(links.select("b", "a")), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.node)
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        step = labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        step = written(step.join(target, "label", "left").select(
            "node", F.least("label", F.coalesce("further", "label")).alias("component"),
            (F.least("label", F.coalesce("further", "label")) != F.col("component")).alias("new")),
            "labels")
        labels = step.select("node", "component")
        if step.where("new").isEmpty():
            return labels


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links between nodes; nodes without a label are their own."""
    ends = links.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
    merged = components(ends.select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    old = labels.join(merged.toDF("component", "now"), "component", "left").select(
        "node", F.coalesce("now", "component").alias("component"))
    new = merged.join(labels, "node", "left_anti")
    return written(old.union(new), "labels")
