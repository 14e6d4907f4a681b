"""Neighbourhood joins on a grid, nearest segments, and thinning to a least distance.

Every join here is an equi-join on grid cells with an exact test after it, so it
shuffles once and never compares all pairs; dense cells are split by AQE.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.session import broadcast_if_small, checkpoint


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def _around(columns: list[Column], size: float) -> Column:
    """Array of the cells of a place and of those beside it, in any number of dimensions."""
    cells = [cell(c, size) for c in columns]
    return F.array(*(F.struct(*((c + d).alias(f"c{i}") for i, (c, d) in enumerate(zip(cells, shift, strict=True)))) for shift in product((-1, 0, 1), repeat=len(cells))))


def radius_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], radius: float, by: tuple[str, str] | None = None, strict: bool = False, few: bool = False) -> DataFrame:
    """Pairs of rows at most ``radius`` apart (less, if ``strict``), with the squared distance ``d2``.

    ``left_on`` and ``right_on`` name the coordinates, in two or three
    dimensions; ``by`` names a column of either side that must be equal.  The
    right side is the one that is copied to its neighbour cells, so give the
    smaller one there; if it is ``few`` against the left one its size is checked
    and, where it fits, broadcast, so that the left side is not shuffled.  The
    two sides must not share column names.
    """
    near = right.withColumn("_c", F.explode(_around([F.col(c) for c in right_on], radius)))
    near = broadcast_if_small(near) if few else near
    own = left.select("*", *(cell(F.col(c), radius).alias(f"_l{i}") for i, c in enumerate(left_on)))
    on = reduce(lambda a, b: a & b, (F.col(f"_l{i}") == F.col(f"_c.c{i}") for i in range(len(left_on))))
    if by:
        on = on & (F.col(by[0]) == F.col(by[1]))
    d2 = reduce(lambda a, b: a + b, ((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(left_on, right_on, strict=True)))
    limit = F.lit(radius * radius)
    return own.join(near, on & ((d2 < limit) if strict else (d2 <= limit))).withColumn("d2", d2).drop("_c", *(f"_l{i}" for i in range(len(left_on))))


def segment_cells(s: G.Ends, size: float, around: bool) -> Column:
    """Distinct cells of places half a cell apart along a segment, and those beside them if ``around``."""
    steps = F.greatest(F.ceil(G.length_xy(s) / (size / 2)), F.lit(1)).cast("int")
    shifts = list(product((-1, 0, 1), repeat=2)) if around else [(0, 0)]

    def at(k: Column) -> Column:
        t = k / steps
        cx, cy = cell(s.x0 + t * (s.x1 - s.x0), size), cell(s.y0 + t * (s.y1 - s.y0), size)
        return F.array(*(F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i, j in shifts))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), steps), at)))


def cells_beside(rows: DataFrame, s: G.Ends, length: Column, size: float, reach: float) -> DataFrame:
    """``rows``, finite segments of a planar ``length`` above 0, once for each cell ``_cx, _cy`` that may hold a place within ``reach``.

    Row of cells by row of cells, the strip about the segment's line is cut by
    the box about the segment.  Sequences stay inside generated code.
    """
    u, v = s.x1 - s.x0, s.y1 - s.y0
    rows = rows.withColumn("_cy", F.explode(F.sequence(cell(F.least(s.y0, s.y1) - reach, size), cell(F.greatest(s.y0, s.y1) + reach, size))))
    # where the segment's line crosses the row's lower and upper bound
    lower, upper = ((F.col("_cy") + k) * F.lit(size) - s.y0 for k in (0, 1))
    side = F.abs(length / v) * reach
    one, two = s.x0 + lower * u / v, s.x0 + upper * u / v
    low, high = F.least(s.x0, s.x1) - reach, F.greatest(s.x0, s.x1) + reach
    steep = F.abs(v) > 1e-9 * length  # else the box is the strip
    rows = rows.withColumns(
        {
            "_low": cell(F.when(steep, F.greatest(low, F.least(one, two) - side)).otherwise(low), size),
            "_high": cell(F.when(steep, F.least(high, F.greatest(one, two) + side)).otherwise(high), size),
        }
    )
    return rows.withColumn("_cx", F.explode(F.when(F.col("_low") <= F.col("_high"), F.sequence("_low", "_high")))).drop("_low", "_high")


def near_segments(points: DataFrame, pipes: DataFrame, threshold: float, planar: bool = True) -> DataFrame:
    """Points closer than ``threshold`` to any segment of ``pipes(x0 .. z1)``; all columns of ``points(x, y, z, ..)`` stay.

    While the pipes' cells fit a broadcast the points are not shuffled.
    """
    size = max(4 * threshold, 1e-9)
    p = pipes.select(*(F.col(c).alias(f"p{c}") for c in G.Ends._fields))
    p = broadcast_if_small(p.withColumn("_c", F.explode(segment_cells(G.ends("p"), size, True))))
    own = points.withColumns({"_cx": cell(F.col("x"), size), "_cy": cell(F.col("y"), size)})
    s = G.ends("p")
    d = G.distance_xy(F.col("x"), F.col("y"), s) if planar else G.distance(F.col("x"), F.col("y"), F.col("z"), s)
    return own.join(p, (F.col("_cx") == F.col("_c.cx")) & (F.col("_cy") == F.col("_c.cy")) & (d < threshold), "left_semi").drop("_cx", "_cy")


#: Pairs of places and segments that are tried outright, and segments that are broadcast for it.
MOST_PAIRS, MOST_SEGMENTS = 20_000_000, 20_000


def _least(places: DataFrame, pipes: DataFrame, key: str, x: Column, y: Column, measure: Column, most: int) -> DataFrame:
    """``(key, b)``: the least ``measure``, a struct that begins with a distance no smaller than the planar one, of each place over all segments (prefixed p).

    Few pairs are tried outright.  Otherwise cells grow: a place whose best
    segment within a reach is no farther than it needs no wider search, so each
    round joins on cells and goes on with the places that are left.  Places
    without coordinates have no row.
    """
    s = G.ends("p")
    places, pipes = checkpoint(places.filter(x.isNotNull() & y.isNotNull())), checkpoint(pipes)
    n, count = pipes.count(), places.count()
    if n * count == 0 or (n <= MOST_SEGMENTS and n * count <= most):
        return places.crossJoin(F.broadcast(pipes)).groupBy(key).agg(F.min(measure).alias("b"))
    ends = lambda c, d: [f(v) for f in (F.min, F.max) for v in (F.least(c, d), F.greatest(c, d))]
    sides = [v for frame, pairs in ((places, ((x, x), (y, y))), (pipes, ((s.x0, s.x1), (s.y0, s.y1)))) for v in frame.agg(*(e for pair in pairs for e in ends(*pair))).first()]
    xs, ys = [sides[k] for k in (0, 1, 2, 3, 8, 9, 10, 11)], [sides[k] for k in (4, 5, 6, 7, 12, 13, 14, 15)]
    whole = math.hypot(max(xs) - min(xs), max(ys) - min(ys)) + 1e-9
    reach, left, out = whole / math.sqrt(n) / 4, places, None
    while True:
        size = 4 * reach
        cells = broadcast_if_small(pipes.withColumn("_c", F.explode(segment_cells(s, size, True))), 100_000)
        pairs = left.join(cells, (cell(x, size) == F.col("_c.cx")) & (cell(y, size) == F.col("_c.cy")) & (G.distance_xy(x, y, s) <= reach))
        found = pairs.groupBy(key).agg(F.min(measure).alias("b"))
        if reach >= whole:  # every segment was within it
            return found if out is None else out.unionByName(found)
        found = checkpoint(found.filter(F.col("b.distance") <= reach))
        out = found if out is None else out.unionByName(found)
        left = checkpoint(left.join(found.select(key), key, "left_anti"))
        if left.isEmpty():
            return out
        reach *= 4


def segment_distances(points: DataFrame, pipes: DataFrame, planar: bool = True, most: int = MOST_PAIRS) -> DataFrame:
    """``(point_id, distance)``: least distance of every point to any segment; beyond ``most`` pairs by cells of growing size."""
    s = G.ends("p")
    p = pipes.select(*(F.col(c).alias(f"p{c}") for c in G.Ends._fields))
    x, y = F.col("x"), F.col("y")
    d = G.distance_xy(x, y, s) if planar else G.distance(x, y, F.col("z"), s)
    columns = ["point_id", "x", "y"] if planar else ["point_id", "x", "y", "z"]
    return _least(points.select(*columns), p, "point_id", x, y, F.struct(d.alias("distance")), most).select("point_id", "b.distance")


def nearest_segment(places: DataFrame, pipes: DataFrame, key: str, x: str, y: str, reach: float | None = None, most: int = MOST_PAIRS) -> DataFrame:
    """``(key, pipe_id, distance, pipe_z)``: the planar nearest segment of each place, the smaller pipe_id among equals, and its height there.

    With a ``reach`` only segments within it count and the join is on grid cells;
    without one, beyond ``most`` pairs, on cells of growing size.
    """
    s = G.ends("p")
    p = pipes.select("pipe_id", *(F.col(c).alias(f"p{c}") for c in G.Ends._fields))
    px, py = F.col(x), F.col(y)
    t = G.clamp(G.along_xy(px, py, s, 1e-30), 0.0, 1.0)
    near = F.struct(G.distance_xy(px, py, s).alias("distance"), "pipe_id", (s.z0 + t * (s.z1 - s.z0)).alias("pipe_z"))
    if reach is None:
        best = _least(places.select(key, x, y), p, key, px, py, near, most)
    else:
        size = max(4 * reach, 1e-9)
        p = p.withColumn("_c", F.explode(segment_cells(s, size, True)))
        pairs = places.select(key, x, y).join(p, (cell(px, size) == F.col("_c.cx")) & (cell(py, size) == F.col("_c.cy")) & (G.distance_xy(px, py, s) <= reach))
        best = pairs.groupBy(key).agg(F.min(near).alias("b"))
    return best.select(key, "b.pipe_id", "b.distance", "b.pipe_z")


def priority(id_col: Column, seed: int = 42) -> Column:
    """A pseudo-random order of ids; ties are broken by the id."""
    m = 2147483647
    return F.pmod(F.pmod(id_col, F.lit(m)) * 48271 + seed, F.lit(m))


#: Sides of the cells in which close pairs in space are sought, in radii.
WIDE = 8


def _close_pairs(points: DataFrame, radius: float, planar: bool, seed: int) -> DataFrame:
    """(worse, better): each pair closer than ``radius``, by priority.

    In space a cell is ``WIDE`` radii wide, so that a point is copied to about
    two cells and not to 27, and a cell goes as one hash.
    """
    axes = ["x", "y"] if planar else ["x", "y", "z"]
    a = points.select("point_id", *axes)
    b = a.select(F.col("point_id").alias("q_id"), *(F.col(c).alias(f"q{c}") for c in axes))
    if planar:
        pairs = radius_join(a, b, axes, [f"q{c}" for c in axes], radius, strict=True)
    else:
        size, hair = WIDE * radius, radius * (1 + 1e-6)
        corners = [F.xxhash64(*(cell(F.col(f"q{c}") + s, size) for c, s in zip(axes, side, strict=True))) for side in product((-hair, hair), repeat=3)]
        near = b.withColumn("_q", F.explode(F.array_distinct(F.array(*corners))))
        own = a.withColumn("_p", F.xxhash64(*(cell(F.col(c), size) for c in axes)))
        d2 = reduce(lambda p, q: p + q, ((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in axes))
        pairs = own.join(near.hint("merge"), (F.col("_p") == F.col("_q")) & (d2 < F.lit(radius * radius)))
    rank, q_rank = priority(F.col("point_id"), seed), priority(F.col("q_id"), seed)
    first = (q_rank < rank) | ((q_rank == rank) & (F.col("q_id") < F.col("point_id")))
    return pairs.filter(first & (F.col("q_id") != F.col("point_id"))).select(F.col("point_id").alias("worse"), F.col("q_id").alias("better"))


def thin_first_round(points: DataFrame, radius: float, planar: bool = True, seed: int = 42) -> DataFrame:
    """``(point_id)`` of the points that come before all their neighbours."""
    return points.select("point_id").join(_close_pairs(points, radius, planar, seed), F.col("point_id") == F.col("worse"), "left_anti")


def thin(points: DataFrame, radius: float, planar: bool = True, seed: int = 42, max_rounds: int = 100) -> DataFrame:
    """``(point_id)`` of a largest set of points no two of which are closer than ``radius``: the greedy choice by priority.

    Each round accepts the points that come before all their undecided
    neighbours and rejects the neighbours of those.  Rounds are checkpointed and
    few: their number grows with the logarithm of the neighbourhoods.
    """
    pairs = checkpoint(_close_pairs(points, radius, planar, seed))
    kept = points.select("point_id").join(pairs, F.col("point_id") == F.col("worse"), "left_anti")
    left = pairs
    taken = checkpoint(kept)
    out = taken
    for _ in range(max_rounds):
        gone = left.join(taken, F.col("better") == F.col("point_id"), "left_semi").select(F.col("worse").alias("gone")).distinct()
        left = left.join(gone, F.col("worse") == F.col("gone"), "left_anti")
        undecided = left.select(F.col("worse").alias("point_id")).distinct()
        gone_better = gone.withColumnRenamed("gone", "gone_b")
        left = checkpoint(left.join(gone_better, F.col("better") == F.col("gone_b"), "left_anti"))
        # points whose better neighbours are all gone
        taken = checkpoint(undecided.join(left, F.col("point_id") == F.col("worse"), "left_anti"))
        if taken.isEmpty():
            return out
        out = out.unionByName(taken)
    raise RuntimeError(f"thinning did not settle in {max_rounds} rounds")
