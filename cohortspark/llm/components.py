"""Connected components of an edge table, by repeated hooking and pointer jumping on contracted graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """Columns (node, root): each node that occurs in `edges` (a, b: long) and the smallest node it is linked to.

    Every round hooks each node to its smallest neighbour, follows the hooks to their ends and contracts the graph to those ends,
    so the number of nodes at least halves and the rounds end. Hot nodes only meet in plain joins of written tables, which AQE splits, and in
    grouped minima, which Spark pre-aggregates. Edges with a null end or with equal ends are ignored.
    """
    some = F.count(F.lit(1))
    turned = edges.where("b < a").select(F.col("b").alias("a"), F.col("a").alias("b"))
    left, seen = stored(edges.where("a < b").select("a", "b").unionAll(turned).distinct(), n=some)
    steps = []
    while seen["n"]:
        ends = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = ends.groupBy("a").agg(F.min("b").alias("m"))
        hook, _ = stored(smallest.select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
        moved = 1
        while moved:
            up = hook.where("node <> root").select(F.col("node").alias("mid"), F.col("root").alias("top"))
            jumped = hook.join(up, hook["root"] == up["mid"], "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
            hook, seen = stored(jumped, moved=F.count_if(F.col("moved")))
            hook, moved = hook.select("node", "root"), seen["moved"]
        steps.append(hook)
        one = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        pairs = left.join(one, "a").join(two, "b").where("ra <> rb")
        left, seen = stored(pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), n=some)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for nxt in steps[1:]:
        nxt = nxt.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        out = out.join(nxt, out["root"] == nxt["mid"], "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(out)[0] if len(steps) > 1 else out


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Labels of n nodes of one task under the given links: each the smallest index it is linked to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            return label
        label = new
