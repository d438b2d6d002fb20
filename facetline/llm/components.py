"""Connected components of an edge table, by smallest id, without a copy of the graph anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetline.llm.staging import materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in ``edges`` (a, b: long): label is the smallest id that it reaches.

    Labels take the least label among neighbours, then the label of their label, until none changes; stars take
    two or three rounds and a path of length n about log n. Each round is a table in the shared folder. Self-links
    and repeated links are harmless; no edges give no rows.
    """
    both = materialise(edges.select("a", "b").unionAll(edges.select("b", "a")).toDF("u", "v").distinct(), "links")
    labels = materialise(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("label")).select(F.col("u").alias("id"), "label"), "labels")
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    before = labels.agg(total).first()[0]
    while before is not None:
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("label").alias("seen"))
        lowered = labels.join(near, labels.id == near.u).select("id", F.least("label", "seen").alias("label"))
        parents = labels.select(F.col("id").alias("parent"), F.col("label").alias("above"))
        labels = materialise(lowered.join(parents, lowered.label == parents.parent).select("id", F.least("label", "above").alias("label")), "labels")
        after = labels.agg(total).first()[0]
        if after == before:
            break
        before = after
    return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, label) after further links (a, b): only the components that these touch are walked again, each as one node."""
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    ends = links.select("a", "b").join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    roots = components(ends.where("a <> b"))
    moved = labels.join(roots.toDF("label", "root"), "label", "left").select("id", F.coalesce("root", "label").alias("label"))
    return materialise(moved.unionAll(roots.join(labels.select("id"), "id", "left_anti").select("id", "label")), "labels")
