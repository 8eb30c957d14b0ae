"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import Scratch, copied, salted

#: Edges of a node that meet its label in one task; a node of more is a hub.
HUB = 100_000


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """``node`` and ``comp``, the smallest node it reaches, for every node of the edges (columns ``a`` and ``b``).

    Each round gives a node the smallest label among its neighbours and then follows labels of labels, so the number of
    rounds grows with the logarithm of a component's diameter. Minima are pre-aggregated, and each round is a written table.
    A hub's label is sent to as many tasks as share its edges.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = scratch.save(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), f"{label}-pairs")
    dealt, hubs = salted(both, "v", HUB, ["u"], scratch, f"{label}-hubs")
    both = scratch.save(dealt, f"{label}-edges")
    scratch.drop(f"{label}-pairs")
    labels = scratch.save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp")).withColumnRenamed("u", "node"), f"{label}-0")
    step = 0
    while True:
        near = (
            both.join(copied(labels.select(F.col("node").alias("v"), "comp"), "v", hubs), ["v", "__salt"])
            .select(F.col("u").alias("node"), "comp")
            .unionByName(labels)
            .groupBy("node")
            .agg(F.min("comp").alias("comp"))
        )
        near = scratch.save(near, f"{label}-near")
        up = near.select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
        dealt, large = salted(near, "comp", HUB, ["node"], scratch, f"{label}-large")  # a large component's nodes share a label
        jumped = dealt.join(copied(up, "comp", large), ["comp", "__salt"], "left").select("node", F.least("comp", F.coalesce("higher", "comp")).alias("comp"))
        new = scratch.save(jumped, f"{label}-{step + 1}")
        changed = new.join(labels.select("node", F.col("comp").alias("was")), "node").filter("comp <> was").isEmpty()
        scratch.drop(f"{label}-{step}", f"{label}-near", f"{label}-large")
        labels, step = new, step + 1
        if changed:
            scratch.drop(f"{label}-edges", f"{label}-hubs")
            return labels
