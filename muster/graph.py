"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.runtime import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of one orderable type -> ``(node, component)`` with the least node as component.

    Large-star and small-star rounds (Kiveris et al., 2014): each keeps at most one edge per node and
    neighbour, so nothing grows; a round is two hash aggregates and two joins, and the number of rounds is
    logarithmic in practice. Every round is written to the shared folder. Self-loops and null ends are ignored; an empty
    table gives an empty result.
    """
    kind = edges.schema["a"].dataType.simpleString()
    now = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        after = materialize(_small_star(_large_star(now)).distinct(), "edges")
        release(now)
        now = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).select(
        F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component")
    )


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``n`` edges that connect the same of ``n`` nodes as the edges do."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            kept = np.nonzero(label != np.arange(n))[0]
            return kept, label[kept]
        label = new
