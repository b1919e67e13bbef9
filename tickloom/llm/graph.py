"""Connected components of a link table, by min-label rounds with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) from links (a, b): label is the least node that links reach; nodes without links are absent.

    Every round each node takes the least of itself and its neighbours as its parent, chains of parents are shortened,
    and the links are drawn anew between the roots, where links inside a component vanish.  So the links shrink from
    round to round, and each round reads what is left of them twice.  All joins read written tables, so skewed nodes
    can be split.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-links")
    labels = None
    while True:
        ends = edges.select(F.col("b").alias("node"), F.col("a").alias("near")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("near")))
        roots = written = materialise(ends.groupBy("node").agg(F.min("near").alias("root")), f"{name}-roots")
        while True:
            up = roots.select(F.col("node").alias("up_node"), F.col("root").alias("up"))
            after = materialise(roots.join(up, roots["root"] == up["up_node"]).select("node", F.col("root").alias("old"), F.col("up").alias("root")), f"{name}-roots")
            done = after.filter("old <> root").isEmpty()
            discard(written)
            roots, written = after.select("node", "root"), after
            if done:
                break
        if labels is None:
            labels = materialise(roots.withColumnRenamed("root", "label"), name)
        else:
            to, old = roots.select(F.col("node").alias("to_node"), "root"), labels
            labels = materialise(labels.join(to, labels["label"] == to["to_node"], "left").select("node", F.coalesce("root", "label").alias("label")), name)
            discard(old)
        of = lambda k: roots.select(F.col("node").alias(f"{k}_node"), F.col("root").alias(f"{k}_root"))  # noqa: E731, B023
        met = edges.join(of("a"), F.col("a") == F.col("a_node")).filter("b <> a_root").join(of("b"), F.col("b") == F.col("b_node"))
        before, edges = edges, materialise(met.filter("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), f"{name}-links")
        discard(before, written)
        if edges.isEmpty():
            discard(edges)
            return labels
