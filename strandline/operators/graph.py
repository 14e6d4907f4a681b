"""Connected components: few edges in one task, many as alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import checkpoint

#: Edges that one task may solve, some megabytes.
FEW = 250_000


def _neighbours(edges: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return edges.select(F.explode(both).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node points to the least of the node and its neighbours."""
    pairs = _neighbours(edges)
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lower neighbours point to the least of the lower neighbours."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges in, every node with the least node of its component out."""
    edges = [b for b in batches if len(b)]
    if not edges:
        return
    nodes, ends = np.unique(np.concatenate([b[c].to_numpy() for c in ("a", "b") for b in edges]), return_inverse=True)
    a, b = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # the hubs of both ends move too, so that components grow by more than a step
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    yield pd.DataFrame({"node": nodes, "component": nodes[label]})


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``, which are whole numbers; the component is its least node.

    Up to ``few`` distinct edges one task solves them.  Beyond, each round is a
    few grouped minima and joins whose rows never exceed a small multiple of the
    edges; its output is checkpointed, so lineage stays short.  Loops and repeated
    edges are allowed, null ends are ignored, and a node that occurs only in a
    loop is its own component.
    """
    edges = edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = checkpoint(edges.distinct())
    if edges.count() <= few:
        return edges.coalesce(1).mapInPandas(_solved, f"node {edges.dtypes[0][1]}, component {edges.dtypes[0][1]}")
    loops = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    current = edges.filter("a <> b")
    seen = None
    for _ in range(max_rounds):
        # a star forest repeats itself: as many edges, and the same sums
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        current = checkpoint(_small_star(_large_star(current)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    spokes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    hubs = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return spokes.unionByName(hubs).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
