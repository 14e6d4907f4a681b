"""Refining approximate segments against the points: samples, oriented boxes, top heights, chains and robust lines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import schema
from strandline.config import Snap
from strandline.functions import geometry as G
from strandline.operators.spatial import cell
from strandline.session import broadcast_if_small, checkpoint

TINY = 1e-6


def ghosts(segments: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """``(seg_id)`` of the segments that have no point within ``reach`` of either end, in the plane."""
    s = G.ends()
    tips = segments.select("seg_id", F.explode(F.array(F.struct(s.x0.alias("tx"), s.y0.alias("ty")), F.struct(s.x1.alias("tx"), s.y1.alias("ty")))).alias("e")).select("seg_id", "e.tx", "e.ty")
    # two places of a cell are within reach, whatever else there is
    size = reach * math.sqrt(0.5) * (1 - 1e-6)
    full = checkpoint(points.select(cell(F.col("x"), size).alias("_x"), cell(F.col("y"), size).alias("_y")).distinct())
    tips = tips.withColumns({"_x": cell(F.col("tx"), size), "_y": cell(F.col("ty"), size)})
    sure = tips.join(full, ["_x", "_y"], "left_semi").select(F.col("seg_id").alias("near_id")).distinct()
    sure = checkpoint(sure)
    # of the others, those beside full cells are tested point by point, and only by the points of those cells
    left = tips.join(sure, F.col("seg_id") == F.col("near_id"), "left_anti")
    steps = [F.struct((F.col("_x") + i).alias("_x"), (F.col("_y") + j).alias("_y")) for i in range(-2, 3) for j in range(-2, 3)]
    left = left.select("seg_id", "tx", "ty", F.explode(F.array(*steps)).alias("_c")).select("seg_id", "tx", "ty", "_c.*")
    left = checkpoint(left.join(full, ["_x", "_y"], "left_semi"))
    own = points.select("x", "y", cell(F.col("x"), size).alias("_x"), cell(F.col("y"), size).alias("_y"))
    own = own.join(broadcast_if_small(left.select("_x", "_y").distinct()), ["_x", "_y"], "left_semi").withColumnsRenamed({"_x": "px", "_y": "py"})
    d2 = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))
    found = left.hint("merge").join(own, (F.col("_x") == F.col("px")) & (F.col("_y") == F.col("py")) & (d2 <= F.lit(reach * reach)), "left_semi")
    near = sure.unionByName(found.select(F.col("seg_id").alias("near_id")).distinct())
    return segments.select("seg_id").join(near, F.col("seg_id") == F.col("near_id"), "left_anti")


def samples(segments: DataFrame, settings: Snap = Snap()) -> DataFrame:
    """``(seg_id, k, sx, sy, sz, tx, ty, nx, ny)``: evenly spaced places along each segment, ends included, with the planar tangent and normal."""
    s = G.ends()
    n = F.greatest(F.lit(settings.min_sample_points), F.ceil(G.length(s) * settings.samples_per_meter)).cast("int")
    tx, ty = G.unit_xy(s.x1 - s.x0, s.y1 - s.y0)
    rows = segments.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.when(F.col("_n") > 1, F.col("k") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return rows.select("seg_id", "k", (s.x0 + t * (s.x1 - s.x0)).alias("sx"), (s.y0 + t * (s.y1 - s.y0)).alias("sy"), (s.z0 + t * (s.z1 - s.z0)).alias("sz"), tx.alias("tx"), ty.alias("ty"), (-ty).alias("nx"), tx.alias("ny"))


def box_points(sample_rows: DataFrame, points: DataFrame, settings: Snap = Snap()) -> DataFrame:
    """Points in each sample's oriented box, of samples with enough points in the circle about the box and in the box itself.

    The circle holds the box, and both ask for the same number, so points are
    counted in the box only.  Cells are small, and those that a box meets are
    named, so that few points outside of it are tried; samples are counted in a
    first pass, and no pair is shuffled.
    """
    t, n = settings.tangential_length, settings.normal_length
    radius, size = math.sqrt(t**2 + n**2), max(min(t, n) * 2, max(t, n) / 4)
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    u, v = dx * F.col("tx") + dy * F.col("ty"), dx * F.col("nx") + dy * F.col("ny")
    inside = (dx * dx + dy * dy <= F.lit(radius * radius)) & (F.abs(u) <= t) & (F.abs(v) <= n)
    # places of the box at most half a cell apart, and the cells about them, as far as a box reaches
    marks = [max(1, math.ceil(2 * r / (size / 2))) for r in (t, n)]
    places = [(-t + 2 * t * i / marks[0], -n + 2 * n * j / marks[1]) for i in range(marks[0] + 1) for j in range(marks[1] + 1)]
    at = [(F.col("sx") + a * F.col("tx") + b * F.col("nx"), F.col("sy") + a * F.col("ty") + b * F.col("ny")) for a, b in places]
    quarter = size * (0.25 * math.sqrt(2) + 1e-6)  # a point of the box is no farther from the next of these places
    cells = F.array_distinct(F.array(*(F.xxhash64(cell(x + i * quarter, size), cell(y + j * quarter, size)) for x, y in at for i in (-1, 1) for j in (-1, 1))))
    # cells go as hashes: those of numbers are told apart by hashing, of structs by trying all pairs
    own = points.select("point_id", "x", "y", "z", F.xxhash64(cell(F.col("x"), size), cell(F.col("y"), size)).alias("_x"))

    def joined(rows: DataFrame) -> DataFrame:
        copies = rows.withColumn("_c", F.explode(cells)).select(*rows.columns, "_c")
        copies = F.broadcast(copies) if rows.count() <= 10_000 else copies.hint("merge")
        return own.join(copies, (F.col("_x") == F.col("_c")) & inside)

    sample_rows = checkpoint(sample_rows)
    enough = joined(sample_rows).groupBy("seg_id", "k").agg(F.count("*").alias("_m")).filter(F.col("_m") >= settings.min_points_for_centroid).drop("_m")
    found = joined(checkpoint(sample_rows.join(enough.hint("merge"), ["seg_id", "k"], "left_semi")))
    return found.withColumns({"u": u, "v": v}).drop("_x", "_c")


def _thinned(box: np.ndarray, order: np.ndarray, u: np.ndarray, v: np.ndarray, reach: float, radius: float) -> np.ndarray:
    """Places of the box points that stay: no two of a box closer than ``radius``, chosen greedily by ``order``, which is unique in a box.

    Boxes are cut across into strips no narrower than ``radius``.  The first
    point of a strip stays if it comes before all of the strips beside it; those
    too near to it go, and so on with what is left.
    """
    width = max(radius * (1 + 1e-6), reach / 256)
    strips = int(2 * reach / width) + 4  # with an empty one between boxes
    key = box * strips + 1 + np.floor((v + reach) / width).astype(np.int64)
    at = np.lexsort((order, key))
    key, order, u, v = key[at], order[at], u[at], v[at]
    size, kept = (int(box.max()) + 1) * strips if len(box) else 0, []
    while len(key):
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        best = np.full(size, np.iinfo(np.int64).max)
        best[key[first]] = order[first]
        own = best[key[first]]
        first = first[(own < best[key[first] - 1]) & (own < best[key[first] + 1])]
        kept.append(at[first])
        held = np.full((2, size), np.inf)
        held[:, key[first]] = u[first], v[first]
        left = np.ones(len(key), bool)
        left[first] = False
        for side in (-1, 0, 1):
            left &= (held[0, key + side] - u) ** 2 + (held[1, key + side] - v) ** 2 >= radius * radius
        at, key, order, u, v = at[left], key[left], order[left], u[left], v[left]
    return np.concatenate(kept) if kept else at


def _tops(box: np.ndarray, z: np.ndarray, precision: float) -> np.ndarray:
    """``top_heights`` of the boxes 0, 1, .. in their order; none is empty, and ``box`` is sorted."""
    start = np.flatnonzero(np.r_[True, box[1:] != box[:-1]])
    low, high = np.minimum.reduceat(z, start), np.maximum.reduceat(z, start)
    mean = np.add.reduceat(z, start) / np.diff(np.r_[start, len(z)])
    bins = np.maximum(1, np.ceil((high - low) / precision)).astype(np.int64)
    step = (high - low) / bins
    with np.errstate(invalid="ignore", divide="ignore"):
        place = np.where(bins[box] == 1, 0, np.minimum(np.floor((z - low[box]) / step[box]), bins[box] - 1)).astype(np.int64)
    at = np.lexsort((place, box))
    own, place = box[at], place[at]
    head = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (place[1:] != place[:-1])])
    own, place, n = own[head], place[head], np.diff(np.r_[head, len(at)])
    # empty bins come first in the order of counts
    counts = n[np.lexsort((n, own))]
    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    empty = bins - np.diff(np.r_[begin, len(own)])
    nth = lambda i: np.where(i < empty, 0, counts[np.minimum(begin + np.maximum(i - empty, 0), len(counts) - 1)])
    median = (nth((bins - 1) // 2) + nth(bins // 2)) / 2
    best = np.maximum.reduceat(np.where(n >= median[own] / 2, place, -1), begin)
    best = np.where(median == 0, bins - 1, best)
    return np.where(bins == 1, mean, low + (best + 0.5) * step)


#: Box points that are looked at together, and points of a tile beyond which tiles are halved.
BOX_POINTS, TILE_POINTS = 1_000_000, 500_000


def _box_rows(asked: pd.DataFrame, own: pd.DataFrame, settings: Snap, thinning: bool) -> pd.DataFrame:
    """``asked`` samples with the mean, top height and number of their boxes' points, of those with enough points among ``own``."""
    t, n, least = settings.tangential_length, settings.normal_length, settings.min_points_for_centroid
    none = asked.iloc[:0].assign(cx=0.0, cy=0.0, z=0.0, n_pts=0)
    if not len(asked) or not len(own):
        return none
    radius = math.sqrt(t**2 + n**2)
    x, y, z = (own[c].to_numpy(np.float64) for c in "xyz")
    ids = own["point_id"].to_numpy()
    order = np.empty(len(own), np.int64)
    order[np.lexsort((ids, (ids % 2147483647 * 48271 + 42) % 2147483647))] = np.arange(len(own))
    # rows of points, each from left to right, far enough apart for one search
    size = max(min(t, n) * 2, max(t, n) / 8)
    ox, oy = x.min() - radius, y.min() - radius
    span = 2 * (x.max() - ox + 4 * radius)
    row = np.floor((y - oy) / size).astype(np.int64)
    rows = int(row.max()) + 1
    place = row * span + (x - ox)
    at = np.argsort(place, kind="stable")
    x, y, z, order, place = x[at], y[at], z[at], order[at], place[at]

    sx, sy, tx, ty, nx, ny = (asked[c].to_numpy(np.float64) for c in ("sx", "sy", "tx", "ty", "nx", "ny"))
    flat = (tx == 0) & (ty == 0)  # an upright segment's box is the circle
    hx, hy = (np.where(flat, radius, np.minimum(t * np.abs(a) + n * np.abs(b), radius)) + 1e-9 for a, b in ((tx, nx), (ty, ny)))
    down, up = (np.clip(np.floor((sy + side * hy - oy) / size), -1, rows).astype(np.int64) for side in (-1, 1))
    i = np.repeat(np.arange(len(asked)), up - down + 1)
    r = down[i] + np.arange(len(i)) - np.repeat(np.cumsum(up - down + 1) - (up - down + 1), up - down + 1)
    bottom = np.maximum(oy + r * size - sy[i], -hy[i]) - 1e-9
    top = np.minimum(oy + (r + 1) * size - sy[i], hy[i]) + 1e-9
    left, right = -hx[i], hx[i].copy()
    for ax, ay, most in ((tx[i], ty[i], t), (nx[i], ny[i], n)):
        # |dx * ax + dy * ay| <= most for a dy of the row
        with np.errstate(divide="ignore", invalid="ignore"):
            a = (-most - np.maximum(bottom * ay, top * ay)) / ax
            b = (most - np.minimum(bottom * ay, top * ay)) / ax
        sure = np.abs(ax) > 1e-6
        left = np.where(sure, np.maximum(left, np.minimum(a, b) - 1e-9), left)
        right = np.where(sure, np.minimum(right, np.maximum(a, b) + 1e-9), right)
    from_ = np.searchsorted(place, r * span + np.clip(sx[i] + left - ox, 0, span / 2), "left")
    till = np.searchsorted(place, r * span + np.clip(sx[i] + right - ox, 0, span / 2), "right")
    some = (till > from_) & (r >= 0) & (r < rows)
    i, from_, till = i[some], from_[some], till[some]
    # candidates before each sample, so that samples go in blocks
    before = np.r_[0, np.cumsum(np.bincount(i, till - from_, len(asked)))].astype(np.int64)
    out, low = [], 0
    while low < len(asked):
        high = max(low + 1, int(np.searchsorted(before, before[low] + BOX_POINTS, "right")) - 1)
        a, b = np.searchsorted(i, [low, high])
        low, m = high, till[a:b] - from_[a:b]
        box = np.repeat(i[a:b], m)
        p = np.repeat(from_[a:b] - (np.cumsum(m) - m), m) + np.arange(len(box))
        dx, dy = x[p] - sx[box], y[p] - sy[box]
        u, v = dx * tx[box] + dy * ty[box], dx * nx[box] + dy * ny[box]
        inside = (dx * dx + dy * dy <= radius * radius) & (np.abs(u) <= t) & (np.abs(v) <= n)
        box, p, u, v = box[inside], p[inside], u[inside], v[inside]
        enough = np.bincount(box, minlength=1) >= least
        box, p, u, v = (e[enough[box]] for e in (box, p, u, v))
        if not len(box):
            continue
        names, box = np.unique(box, return_inverse=True)
        if thinning:
            stay = _thinned(box, order[p], u, v, n, settings.poisson_radius)
            few = np.bincount(box[stay], minlength=len(names)) < least
            chosen = few[box]
            chosen[stay] = True
            box, p = box[chosen], p[chosen]
        start = np.flatnonzero(np.r_[True, box[1:] != box[:-1]])
        count = np.diff(np.r_[start, len(box)])
        found = asked.iloc[names].copy()
        found["cx"], found["cy"] = np.add.reduceat(x[p], start) / count, np.add.reduceat(y[p], start) / count
        found["z"], found["n_pts"] = _tops(box, z[p], settings.quantization_precision), count
        out.append(found)
    return pd.concat(out) if out else none


def box_rows(sample_rows: DataFrame, points: DataFrame, settings: Snap = Snap(), thinning: bool = True) -> DataFrame:
    """``SAMPLES``: planar mean, top height and number of the points in each sample's oriented box, of boxes with enough points.

    If ``thinning``, box points no closer than ``poisson_radius`` to one another
    count, chosen greedily by priority; a box that would keep too few keeps all.
    Points go to the tiles in whose boxes they may be, and a task does all
    boxes of a tile in blocks, so that box points, of which there are many for
    each point, are never shuffled.  Tiles get smaller where points are crowded.
    """
    radius = math.sqrt(settings.tangential_length**2 + settings.normal_length**2) * (1 + 1e-6)
    side = 10 * radius
    points = points.select("point_id", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    points = points.filter(F.col("x").between(-1e300, 1e300) & F.col("y").between(-1e300, 1e300))
    for _ in range(2):
        if points.groupBy(cell(F.col("x"), side), cell(F.col("y"), side)).count().filter(F.col("count") > TILE_POINTS).isEmpty():
            break
        side /= 2
    tile = lambda x, y: F.struct(cell(x, side).alias("_x"), cell(y, side).alias("_y"))
    asked = sample_rows.select("seg_id", "k", "sx", "sy", "tx", "ty", "nx", "ny", tile(F.col("sx"), F.col("sy")).alias("_t")).select("*", "_t.*").drop("_t")
    asked = checkpoint(asked)
    corners = F.array_distinct(F.array(*(tile(F.col("x") + i * radius, F.col("y") + j * radius) for i in (-1, 1) for j in (-1, 1))))
    near = points.select("*", F.explode(corners).alias("_t")).select("point_id", "x", "y", "z", "_t.*")
    near = near.join(broadcast_if_small(asked.select("_x", "_y").distinct()), ["_x", "_y"], "left_semi")
    names = [c.split()[0] for c in schema.SAMPLES.split(", ")]

    def run(samples: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return _box_rows(samples, own, settings, thinning)[names]

    return asked.groupBy("_x", "_y").cogroup(near.groupBy("_x", "_y")).applyInPandas(run, schema.SAMPLES)


def top_heights(rows: DataFrame, keys: list[str], z: str, precision: float) -> DataFrame:
    """``(keys, top_z)``: middle of the highest bin that holds at least half of the bins' median count, empty bins included.

    Bins of equal width cover each group's range, the last one closed; a range
    of one bin gives the mean.
    """
    width = Window.partitionBy(*keys)
    rows = rows.select(*keys, F.col(z).alias("z")).withColumns({"low": F.min("z").over(width), "high": F.max("z").over(width)})
    rows = rows.withColumn("bins", F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / precision)).cast("int"))
    place = F.least(F.floor((F.col("z") - F.col("low")) / ((F.col("high") - F.col("low")) / F.col("bins"))), F.col("bins") - 1).cast("int")
    rows = rows.withColumn("bin", F.when(F.col("bins") == 1, 0).otherwise(place))
    filled = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum("z").alias("total"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("bins").alias("bins"))
    per = filled.groupBy(*keys).agg(F.collect_list(F.struct("bin", "n")).alias("held"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("bins").alias("bins"), (F.sum("total") / F.sum("n")).alias("mean"))
    # empty bins come first in the order of counts, so the median needs only their number
    counts = F.array_sort(F.transform("held", lambda h: h["n"]))
    empty = F.col("bins") - F.size("held")
    nth = lambda i: F.when(i < empty, F.lit(0)).otherwise(F.get(counts, i - empty))
    low, high = F.floor((F.col("bins") - 1) / 2).cast("int"), F.floor(F.col("bins") / 2).cast("int")
    median = (nth(low) + nth(high)) / 2
    best = F.when(median == 0, F.col("bins") - 1).otherwise(F.array_max(F.transform(F.filter("held", lambda h: h["n"] >= median / 2), lambda h: h["bin"])))
    step = (F.col("high") - F.col("low")) / F.col("bins")
    return per.withColumn("best", best).select(*keys, F.when(F.col("bins") == 1, F.col("mean")).otherwise(F.col("low") + (F.col("best") + 0.5) * step).alias("top_z"))


def box_centroids(boxes: DataFrame, precision: float) -> DataFrame:
    """``(seg_id, k, cx, cy, z, n_pts)``: planar mean, top height and number of each box's points."""
    means = boxes.groupBy("seg_id", "k").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n_pts"))
    return means.join(top_heights(boxes, ["seg_id", "k"], "z", precision).withColumnRenamed("top_z", "z"), ["seg_id", "k"])


_STATE = "struct<before: double, n: int, total: double, bucket: int, out: array<struct<bucket: int, i: int>>>"


def height_buckets(chains: DataFrame, settings: Snap = Snap()) -> DataFrame:
    """``(chain_id, bucket, pos, seq, x, y, z)``: chain points cut where the fall of height leaves the running mean of its bucket.

    Neighbouring buckets share the point at the cut, which so occurs twice;
    buckets of a single point do not arise.  A chain of one point gives none.
    """
    limit = math.tan(math.radians(settings.max_angle_change_deg)) / settings.samples_per_meter
    whole = chains.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("p"))
    start = F.struct(F.lit(None).cast("double").alias("before"), F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit(0).alias("bucket"), F.expr("cast(array() as array<struct<bucket: int, i: int>>)").alias("out"))

    def step(s: Column, e: Column) -> Column:
        dz = s["before"] - e["z"]
        cut = (s["n"] > 0) & (F.abs(dz - s["total"] / F.greatest(s["n"], F.lit(1))) > limit)
        bucket = F.when(cut, s["bucket"] + 1).otherwise(s["bucket"])
        again = F.when(cut, F.array(F.struct(bucket.alias("bucket"), (e["i"] - 1).alias("i")))).otherwise(F.expr("cast(array() as array<struct<bucket: int, i: int>>)"))
        first = s["before"].isNull()
        return F.struct(
            e["z"].alias("before"),
            F.when(first, 0).when(cut, 1).otherwise(s["n"] + 1).alias("n"),
            F.when(first, F.lit(0.0)).when(cut, dz).otherwise(s["total"] + dz).alias("total"),
            bucket.alias("bucket"),
            F.concat(s["out"], again, F.array(F.struct(bucket.alias("bucket"), e["i"].alias("i")))).alias("out"),
        )

    indexed = F.transform("p", lambda e, i: F.struct(e["z"].alias("z"), i.alias("i")))
    cut = F.aggregate(indexed, start, step, lambda s: s["out"])
    rows = whole.filter(F.size("p") > 1).select("chain_id", "p", F.explode(cut).alias("c"))
    rows = rows.select("chain_id", "c.bucket", F.col("c.i").alias("pos"), F.col("p")[F.col("c.i")].alias("e"))
    return rows.select("chain_id", "bucket", "pos", "e.seq", "e.x", "e.y", "e.z")


def bucket_angles(buckets: DataFrame, settings: Snap = Snap()) -> DataFrame:
    """``(chain_id, bucket, n, first_seq, last_seq, mean_angle)``; the angle takes neighbours to be one sample step apart."""
    turn = Window.partitionBy("chain_id", "bucket").orderBy("pos")
    angle = F.degrees(F.abs(F.atan((F.col("z") - F.lag("z").over(turn)) * settings.samples_per_meter)))
    return buckets.withColumn("angle", angle).groupBy("chain_id", "bucket").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.avg("angle").alias("mean_angle"))


def level_buckets(buckets: DataFrame, settings: Snap = Snap()) -> DataFrame:
    """Points of the buckets that have enough points and a mean angle under the limit."""
    good = bucket_angles(buckets, settings).filter((F.col("n") >= settings.min_points_per_bucket) & (F.col("mean_angle") < settings.mean_angle_limit_deg)).select("chain_id", "bucket")
    return buckets.join(good, ["chain_id", "bucket"], "left_semi")


_NO_IDS = "cast(array() as array<struct<bucket: int, part: int>>)"


def joined_buckets(buckets: DataFrame, settings: Snap = Snap()) -> DataFrame:
    """``buckets`` with ``part``: consecutive buckets of a chain are one part while the gap between them and the difference of their mean heights are small.

    The mean height of a part counts all of its points, shared ones twice.
    """
    point = F.struct("pos", "x", "y", "z")
    each = buckets.groupBy("chain_id", "bucket").agg(F.min(point).alias("a"), F.max(point).alias("b"), F.sum("z").alias("total"), F.count("*").alias("n"))
    chains = each.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "a", "b", "total", "n"))).alias("g"))
    start = F.struct(F.lit(None).cast("struct<pos: int, x: double, y: double, z: double>").alias("end"), F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("part"), F.expr(_NO_IDS).alias("out"))

    def step(s: Column, e: Column) -> Column:
        gap = G.norm(s["end"]["x"] - e["a"]["x"], s["end"]["y"] - e["a"]["y"], s["end"]["z"] - e["a"]["z"])
        flat = F.abs(s["total"] / F.greatest(s["n"], F.lit(1)) - e["total"] / e["n"]) < settings.merge_height_limit
        same = F.coalesce((gap < settings.merge_jump_threshold) & flat, F.lit(False))
        part = F.when(same, s["part"]).otherwise(s["part"] + 1)
        return F.struct(
            F.struct(e["b"]["pos"].alias("pos"), e["b"]["x"].alias("x"), e["b"]["y"].alias("y"), e["b"]["z"].alias("z")).alias("end"),
            F.when(same, s["total"] + e["total"]).otherwise(e["total"]).alias("total"),
            F.when(same, s["n"] + e["n"]).otherwise(e["n"]).alias("n"),
            part.alias("part"),
            F.concat(s["out"], F.array(F.struct(e["bucket"].alias("bucket"), part.alias("part")))).alias("out"),
        )

    named = chains.select("chain_id", F.explode(F.aggregate("g", start, step, lambda s: s["out"])).alias("m")).select("chain_id", "m.bucket", "m.part")
    return buckets.join(named, ["chain_id", "bucket"])


#: Distances of points to lines that are worked out at once.
AT_ONCE = 4_000_000


def _robust_line(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[int, int, int, float, float, float, float, float] | None:
    """The best line through two of the points: their places, inliers, residual, mean and direction of the inliers; None if all points are one."""
    m, best = len(x), None
    rows = max(1, AT_ONCE // max(1, m * m))
    for low in range(0, m - 1, rows):
        first = np.arange(low, min(low + rows, m - 1))
        i = np.repeat(first, m - 1 - first)
        j = i + 1 + np.arange(len(i)) - np.searchsorted(i, i)
        for at in range(0, len(i), max(1, AT_ONCE // m)):
            p, q = i[at : at + max(1, AT_ONCE // m)], j[at : at + max(1, AT_ONCE // m)]
            dx, dy = x[q] - x[p], y[q] - y[p]
            size = np.sqrt(dx * dx + dy * dy)
            p, q, dx, dy, size = p[size > 0], q[size > 0], dx[size > 0], dy[size > 0], size[size > 0]
            if not len(p):
                continue
            d = np.abs(dx[:, None] * (y[None, :] - y[p][:, None]) - dy[:, None] * (x[None, :] - x[p][:, None])) / size[:, None]
            hit = d < threshold
            count = hit.sum(1)
            top = np.flatnonzero(count == count.max())
            if best and count[top[0]] < best[0]:
                continue
            residual = np.round((d[top] ** 2 * hit[top]).sum(1), 9)
            k = int(np.lexsort((q[top], p[top], residual))[0])
            found = (int(count[top[k]]), -float(residual[k]), -int(p[top[k]]), -int(q[top[k]]), hit[top[k]])
            if best is None or found[:4] > best[:4]:
                best = found
    if best is None:
        return None
    count, residual, i, j, hit = best
    x, y = x[hit], y[hit]
    ox, oy = float(x.mean()), float(y.mean())
    turn = np.arctan2(2 * ((x - ox) * (y - oy)).mean(), ((x - ox) ** 2).mean() - ((y - oy) ** 2).mean()) * 0.5
    return -i, -j, count, -residual, ox, oy, float(np.cos(turn)), float(np.sin(turn))


def robust_lines(parts: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """``(keys, i, j, inliers, residual, ox, oy, dx, dy)``: of all lines through two points of a group, the one with the most points closer than ``threshold``.

    Ties go to the least squared residual, then to the first pair; the line is
    refitted to its inliers by least squared distance.  ``parts`` has (keys,
    idx, x, y) with idx unique in a group.  A group is one pipe's samples; its
    pairs are tried in blocks of bounded size, in a time that grows with the cube
    of the samples: 2,000 of them, a kilometre of pipe, take about half a minute.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        found = _robust_line(g["x"].to_numpy(np.float64), g["y"].to_numpy(np.float64), threshold)
        out = g.iloc[:0] if found is None else g.iloc[:1]
        out = out[keys].copy()
        for k, name in enumerate(["i", "j", "inliers", "residual", "ox", "oy", "dx", "dy"]):
            out[name] = None if found is None else g["idx"].iloc[found[k]] if k < 2 else found[k]
        return out

    kinds = dict(parts.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"i {kinds['idx']}", f"j {kinds['idx']}", "inliers bigint", *(f"{c} double" for c in ("residual", "ox", "oy", "dx", "dy"))])
    return parts.select(*keys, "idx", F.col("x").cast("double"), F.col("y").cast("double")).groupBy(*keys).applyInPandas(run, schema)


def chain_segments(chains: DataFrame, settings: Snap = Snap()) -> DataFrame:
    """``(chain_id, part, x0 .. z1)``: the level parts of each chain as segments, their first and last points put on the robust line; heights stay."""
    parts = joined_buckets(level_buckets(height_buckets(chains, settings), settings), settings)
    turn = Window.partitionBy("chain_id", "part").orderBy("bucket", "pos")
    parts = checkpoint(parts.withColumn("idx", F.row_number().over(turn)))
    lines = robust_lines(parts, ["chain_id", "part"], settings.ransac_residual_threshold)
    point = F.struct("idx", "x", "y", "z")
    tips = parts.groupBy("chain_id", "part").agg(F.min(point).alias("a"), F.max(point).alias("b"))
    rows = tips.join(lines, ["chain_id", "part"])
    foot = lambda e: G.project_on_line(F.col(f"{e}.x"), F.col(f"{e}.y"), F.col("ox"), F.col("oy"), F.col("dx"), F.col("dy"))
    (x0, y0), (x1, y1) = foot("a"), foot("b")
    return rows.select("chain_id", "part", x0.alias("x0"), y0.alias("y0"), F.col("a.z").alias("z0"), x1.alias("x1"), y1.alias("y1"), F.col("b.z").alias("z1"))


def snap(segments: DataFrame, points: DataFrame, settings: Snap = Snap(), thinning: bool = True) -> tuple[DataFrame, DataFrame]:
    """Final pipes ``(seg_id, part, x0 .. z1)`` and their sample rows ``SAMPLES``.

    Ghosts go; tiny segments and those with fewer than two usable samples stay
    as they are; a segment all of whose parts are discarded gives none.
    """
    s = G.ends()
    real = segments.join(ghosts(segments, points, settings.normal_length).withColumnRenamed("seg_id", "ghost"), F.col("seg_id") == F.col("ghost"), "left_anti")
    tiny = G.length(s) < TINY
    grid = samples(real.filter(~tiny), settings)
    found = checkpoint(box_rows(grid, points, settings, thinning))
    chains = found.select(F.col("seg_id").alias("chain_id"), F.col("k").alias("seq"), F.col("cx").alias("x"), F.col("cy").alias("y"), "z")
    usable = found.groupBy("seg_id").agg(F.count("*").alias("m")).filter("m >= 2").select(F.col("seg_id").alias("usable"))
    kept = real.join(usable, F.col("seg_id") == F.col("usable"), "left_anti").select("seg_id", F.lit(0).alias("part"), *s)
    snapped = chain_segments(chains.join(usable, F.col("chain_id") == F.col("usable"), "left_semi"), settings)
    return kept.unionByName(snapped.withColumnRenamed("chain_id", "seg_id")), found


def chain_points(segments: DataFrame, sample_rows: DataFrame) -> DataFrame:
    """``(chain_id, points array)`` of every segment, by sample; a segment without samples has an empty chain."""
    p = sample_rows.groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("k", "cx", "cy", "z"))).alias("p"))
    rows = segments.select("seg_id").join(p, "seg_id", "left")
    points = F.transform(F.coalesce("p", F.expr("cast(array() as array<struct<k: int, cx: double, cy: double, z: double>>)")), lambda e: F.struct(e["cx"].alias("x"), e["cy"].alias("y"), e["z"].alias("z")))
    return rows.select(F.col("seg_id").alias("chain_id"), points.alias("points"))
