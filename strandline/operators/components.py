"""Fittings: points near pipes, clustered by density, boxed, and set on their nearest pipe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import Components
from strandline.operators import kernels
from strandline.operators.spatial import near_segments, nearest_segment, thin
from strandline.session import checkpoint

#: Points that one group may cluster exactly; its time is quadratic and its memory linear.
MOST_POINTS = 20_000
#: Beyond that, points of one block of the plane, about, and blocks, until they hold ``MOST_POINTS`` each.
BLOCK, BLOCKS = 2_000, 1_024


class _Blocks:
    """A balanced tree of cuts of the plane, made from a sample, whose leaves are the blocks."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth, self.axis, self.cut = depth, np.zeros(2**depth - 1, int), np.zeros(2**depth - 1)
        own = {0: sample}
        for k in range(2**depth - 1):
            xy = own.pop(k)
            if len(xy):
                self.axis[k] = int(np.ptp(xy, axis=0).argmax())
                self.cut[k] = np.median(xy[:, self.axis[k]])
            over = xy[:, self.axis[k]] > self.cut[k]
            own[2 * k + 1], own[2 * k + 2] = xy[~over], xy[over]

    def of(self, xy: np.ndarray) -> np.ndarray:
        at = np.zeros(len(xy), int)
        for _ in range(self.depth):
            at = 2 * at + 1 + (xy[np.arange(len(xy)), self.axis[at]] > self.cut[at])
        return at - (2**self.depth - 1)


def _box_distances(xy: np.ndarray, boxes: np.ndarray, metric: str) -> np.ndarray:
    """(points, boxes); boxes are (x, y, x, y) of their least and greatest corners."""
    apart = [np.maximum(np.maximum(boxes[:, i] - xy[:, i, None], xy[:, i, None] - boxes[:, 2 + i]), 0) for i in (0, 1)]
    # a hair less, so that no rounding hides a pair
    return kernels.METRICS[metric](*apart) * (1 - 1e-9)


def _bottlenecks(at: np.ndarray, core: np.ndarray, inner: np.ndarray, metric: str) -> np.ndarray:
    """Between every two blocks, a length within which any of their points are linked: over the blocks' first points and the blocks' own trees."""
    m = len(at)
    step = kernels.METRICS[metric](at[:, None, 0] - at[:, 0], at[:, None, 1] - at[:, 1])
    for side in (np.maximum(core, inner), np.maximum(core, inner)[:, None]):
        step = np.maximum(step, side)
    reach = np.full((m, m), np.inf)
    np.fill_diagonal(reach, inner)
    nearest, source, seen = step[0].copy(), np.zeros(m, int), [0]
    for _ in range(m - 1):  # Prim; the way to a new block is that to its source and one step
        nearest[seen] = np.inf
        new = int(nearest.argmin())
        way = np.maximum(np.maximum(reach[source[new], seen], inner[seen]), nearest[new])
        reach[new, seen] = reach[seen, new] = way
        seen.append(new)
        closer = step[new] < nearest
        nearest[closer], source[closer] = step[new][closer], new
    return reach * (1 + 1e-9)


def _to_blocks(rows: DataFrame, boxes: np.ndarray, reach: np.ndarray | None, schema: str, metric: str) -> DataFrame:
    """Every row once for each block ``to`` within its ``reach``: its own ``core`` if None, else that from its own block to another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for low in range(0, len(whole), 1000):
                batch = whole.iloc[low : low + 1000]
                own = batch["block"].to_numpy()
                far = _box_distances(batch[["x", "y"]].to_numpy(), boxes, metric)
                near = far <= (batch["core"].to_numpy()[:, None] if reach is None else reach[own])
                if reach is not None:
                    near[np.arange(len(own)), own] = False
                i, to = np.nonzero(near)
                yield batch.iloc[i].assign(to=to)

    return rows.mapInPandas(run, schema)


def _joint_edges(rows: DataFrame, n: int, least: int, metric: str) -> DataFrame:
    """``(a, b, w)`` between the nodes of ``n`` rows ``(node, x, y)``: they hold a least spanning tree of the mutual reachability.

    The plane is cut into blocks.  Core distances are sought in the blocks that
    a first bound from the own block reaches.  Any edge lies in one block or
    between two, and those in the least trees of a block, or of two blocks
    together, link whatever edges up to the same length link.  Two blocks, or
    points of theirs, farther apart than a length within which other edges link
    them anyway add nothing and are not compared.
    """
    block = min(max(BLOCK, n // BLOCKS), max(BLOCK, MOST_POINTS))
    depth = max(0, int(np.ceil(np.log2(max(1, n / block)))))
    sample = rows.select("x", "y").sample(min(1.0, 64 * 2**depth / n), seed=42).toPandas().to_numpy()
    cuts, base = _Blocks(sample, depth), "node bigint, x double, y double, block int, core double"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(block=cuts.of(batch[["x", "y"]].to_numpy()))

    def bound(g: pd.DataFrame) -> pd.DataFrame:
        xy = g[["x", "y"]].to_numpy()
        return g.assign(core=kernels.nearest_distances(xy, xy, least, metric)[:, -1] if len(g) >= least else np.inf)

    blocks = checkpoint(rows.mapInPandas(cut, "node bigint, x double, y double, block int").groupBy("block").applyInPandas(bound, base))
    corners = [f(c) for f in (F.min, F.max) for c in ("x", "y")]
    # blocks without points are nowhere
    boxes = np.full((2**depth, 4), np.inf)
    for r in blocks.groupBy("block").agg(*corners).collect():
        boxes[r[0]] = r[1:]
    boxes[np.isinf(boxes[:, 0])] = [np.inf, np.inf, -np.inf, -np.inf]

    def nearest(asked: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        d = kernels.nearest_distances(asked[["x", "y"]].to_numpy(), g[["x", "y"]].to_numpy(), least, metric) if len(asked) and len(g) else np.zeros((0, 0))
        return pd.DataFrame({"node": asked["node"].iloc[: len(d)], "d": list(d)})

    asked = _to_blocks(blocks, boxes, None, f"{base}, to int", metric)
    found = asked.groupBy("to").cogroup(blocks.groupBy("block")).applyInPandas(nearest, "node bigint, d array<double>")
    core = found.groupBy("node").agg(F.sort_array(F.flatten(F.collect_list("d"))).alias("d")).select("node", F.element_at("d", least).alias("core"))
    blocks = checkpoint(blocks.drop("core").join(core, "node").select("node", "x", "y", "block", "core"))

    def tree(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node", ignore_index=True)
        a, b, w = kernels.spanning_tree(g[["x", "y"]].to_numpy(), g["core"].to_numpy(), metric)
        node, block = g["node"].to_numpy(), g["block"].to_numpy()
        return pd.DataFrame({"a": node[a], "b": node[b], "w": w, "block": block[a], "across": block[a] != block[b]})

    edges = "a bigint, b bigint, w double, block int, across boolean"
    inside = checkpoint(blocks.groupBy("block").applyInPandas(tree, edges))
    first = {r["block"]: r["p"] for r in blocks.groupBy("block").agg(F.min_by(F.struct("x", "y", "core"), "node").alias("p")).collect()}
    longest = {r["block"]: r["w"] for r in inside.groupBy("block").agg(F.max("w").alias("w")).collect()}
    full = sorted(first)
    reach = np.full((2**depth, 2**depth), -1.0)
    at = np.array([first[k][:2] for k in full])
    reach[np.ix_(full, full)] = _bottlenecks(at, np.array([first[k][2] for k in full]), np.array([longest.get(k, 0.0) for k in full]), metric)
    pairs = _to_blocks(blocks, boxes, reach, f"{base}, to int", metric)
    # least trees of the points of two blocks; what lies inside one is known
    across = pairs.groupBy(F.least("block", "to"), F.greatest("block", "to")).applyInPandas(lambda g: tree(g[["node", "x", "y", "block", "core"]]), edges).filter("across")
    return inside.unionByName(across).select("a", "b", "w")


def density_clusters(points: DataFrame, settings: Components = Components(), most: int = MOST_POINTS) -> DataFrame:
    """``(point_id, label)`` of the points in planar density clusters; noise is left out.

    There is one hierarchy of all points at any size.  Up to ``most`` points one
    task builds it; beyond, its edges are found block by block, and one task
    condenses the edges, a few for each point.  The driver holds a number for
    each pair of blocks, 8 MB up to 2 * 10**7 points and as the square of the
    points beyond; that, and the one task, end at some 10**8 points.  Labels are
    the least point_id of a cluster.
    """
    if settings.metric not in kernels.METRICS:
        raise ValueError(f"metric {settings.metric} is not one of {', '.join(kernels.METRICS)}")
    least, method, metric = settings.min_points, settings.cluster_selection_method, settings.metric
    rows = checkpoint(points.select(F.monotonically_increasing_id().alias("node"), "point_id", F.col("x").cast("double"), F.col("y").cast("double")))
    n = rows.count()
    if n <= most or n < max(least, 2):

        def run(g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"node": g["node"], "k": kernels.hdbscan(g[["x", "y"]].to_numpy(), least, method, metric)})

        found = rows.groupBy().applyInPandas(run, "node bigint, k bigint")
    else:

        def condense(g: pd.DataFrame) -> pd.DataFrame:
            nodes, ends = np.unique(np.concatenate([g["a"], g["b"]]), return_inverse=True)
            return pd.DataFrame({"node": nodes, "k": kernels.tree_labels(n, ends[: len(g)], ends[len(g) :], g["w"].to_numpy(), least, method)})

        found = _joint_edges(rows.select("node", "x", "y"), n, least, metric).groupBy().applyInPandas(condense, "node bigint, k bigint")
    named = checkpoint(rows.join(found.filter("k >= 0"), "node").select("point_id", "k"))
    return named.join(named.groupBy("k").agg(F.min("point_id").alias("label")), "k").select("point_id", "label")


def component_boxes(points: DataFrame, labels: DataFrame, pipes: DataFrame, threshold: float) -> DataFrame:
    """``COMPONENTS``: box and mean of each label's points, the mean's height taken from the nearest pipe; clusters farther than ``threshold`` from any pipe go."""
    rows = points.join(labels, "point_id")
    sides = [f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in ("x", "y", "z")]
    boxes = rows.groupBy(F.col("label").alias("comp_id")).agg(*sides, F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    near = nearest_segment(boxes, pipes, "comp_id", "cx", "cy", reach=threshold)
    boxes = boxes.join(near, "comp_id")
    return boxes.select("comp_id", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z", "cx", "cy", F.col("pipe_z").alias("cz"))


def component_points(points: DataFrame, pipes: DataFrame, settings: Components = Components(), thinning_radius: float | None = 0.02) -> DataFrame:
    """The points that may make components: thinned, and near pipes, as the settings ask; both are judged on all points, then combined."""
    kept = points.select("point_id", "x", "y", "z")
    chosen = kept
    if settings.apply_thinning and thinning_radius:
        chosen = chosen.join(thin(kept, thinning_radius), "point_id", "left_semi")
    if settings.filter_near_pipes:
        chosen = chosen.join(near_segments(kept, pipes, settings.pipe_distance_threshold).select("point_id"), "point_id", "left_semi")
    return chosen


def find_components(points: DataFrame, pipes: DataFrame, settings: Components = Components(), thinning_radius: float | None = 0.02) -> DataFrame:
    """``COMPONENTS`` of class-2 points; without pipes or points there are none."""
    chosen = checkpoint(component_points(points, pipes, settings, thinning_radius))
    return component_boxes(chosen, density_clusters(chosen, settings), pipes, settings.pipe_distance_threshold)
