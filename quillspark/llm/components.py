"""Connected components by label propagation with pointer jumping, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a, b): rows (node, component).

    Nodes without an edge are left out. Null ends and loops are ignored; repeated edges count once. Rounds grow with
    the logarithm of a component's diameter. Both inputs of every join are plain scans of written tables, so that
    adaptive execution can split a hub's rows over tasks; aggregates are partial before they shuffle.
    """
    both = edges.where(F.col("a") != F.col("b")).select("a", "b")
    both = scratch.keep(both.union(both.select("b", "a")).distinct(), f"{name}-edges")
    label = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        told = both.join(label, both.b == label.node).select(both.a.alias("node"), "component")
        best = scratch.keep(told.union(label.select("node", "component")).groupBy("node").agg(F.min("component").alias("component")), f"{name}-best-{step}")
        up = best.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        new = scratch.keep(best.join(up, "component", "left").select("node", F.coalesce("higher", "component").alias("component")), f"{name}-{step}")
        moved = new.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        scratch.drop(f"{name}-best-{step}")
        if not moved:
            scratch.drop(f"{name}-edges")
            return new
        label = new
