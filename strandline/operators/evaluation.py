"""Detected pipes and fittings against ground truth: matches, labels, coverage, distances and reports."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.operators.spatial import cell, cells_beside, radius_join, segment_cells
from strandline.session import checkpoint

TOLERANCE = 0.5


def _sides(gt: DataFrame, det: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = gt.select(F.col("id").alias("gt_id"), *(F.col(c).alias(f"g{c}") for c in G.Ends._fields))
    d = det.select(F.col("id").alias("det_id"), *(F.col(c).alias(f"d{c}") for c in G.Ends._fields))
    return g, d


def _in_box(s: G.Ends, edges, margin: float) -> tuple[Column, Column]:
    """Between which places, in lengths of the segment, its line runs inside the box (x, x, y, y) widened by the margin."""
    low, high = [], []
    for a, b, e in ((s.x0, s.x1, edges[:2]), (s.y0, s.y1, edges[2:])):
        one, two = (F.lit(float(e[0]) - margin) - a) / (b - a), (F.lit(float(e[1]) + margin) - a) / (b - a)
        inside = a.between(float(e[0]) - margin, float(e[1]) + margin)
        far = F.lit(float("inf"))
        low.append(F.when(a != b, F.least(one, two)).otherwise(F.when(inside, -far).otherwise(far)))
        high.append(F.when(a != b, F.greatest(one, two)).otherwise(F.when(inside, far).otherwise(-far)))
    return F.greatest(*low), F.least(*high)


def _flat(rows: DataFrame, s: str) -> DataFrame:
    """Segments of finite planar coordinates with a length, which is added as ``{s}l``; the rest matches nothing.

    Columns that are never null need no tests for it, which would make the joins'
    code too long to be compiled.
    """
    planar = [f"{s}{c}" for c in ("x0", "y0", "x1", "y1")]
    finite = reduce(lambda a, b: a & b, (F.abs(c) < float("inf") for c in planar))
    rows = rows.filter(finite).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in planar})
    return rows.withColumn(f"{s}l", G.length_xy(G.ends(s))).filter(F.col(f"{s}l") > 0)


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows over all cores: a table of one small file is one task, and its cells are many."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 50_000)), rows.columns[0])


def _matching(base: str, other: str, tolerance: float, level: bool) -> Column:
    """``G.within_tolerance`` of flat segments prefixed g and d, of which ``base`` is the shorter; the cheapest tests go first.

    With ``level`` only for lines that meet at up to 60 degrees.
    """
    along = lambda e: (F.col(f"{e}x1") - F.col(f"{e}x0"), F.col(f"{e}y1") - F.col(f"{e}y0"))
    (u, v), (p, q), long = along("d"), along(base), F.col("dl")
    off = lambda i: F.abs(u * (F.col(f"gy{i}") - F.col("dy0")) - v * (F.col(f"gx{i}") - F.col("dx0"))) / long <= tolerance
    at = lambda i: ((F.col(f"{other}x{i}") - F.col(f"{base}x0")) * p + (F.col(f"{other}y{i}") - F.col(f"{base}y0")) * q) / (p * p + q * q)
    low, high = F.greatest(F.lit(0.0), F.least(at(0), at(1))), F.least(F.lit(1.0), F.greatest(at(0), at(1)))
    size = F.col(f"{base}l")
    shared = F.greatest(F.lit(0.0), high - low) * size / size >= 0.5
    if not level:
        return off(0) & off(1) & shared
    a, b = along("g")
    # cosine of the angle between them, with a hair for rounding
    return (F.abs(a * u + b * v) >= (0.5 - 1e-6) * F.col("gl") * long) & off(0) & off(1) & shared


def match_pipes(gt: DataFrame, det: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """A row for each matching pair, with the pair's measures.

    Matching is planar, coverage and height distances are spatial.  As half of
    the shorter one overlaps, its middle lies beside the longer one; where the
    lines meet at up to 60 degrees it is within two tolerances of it.  So middles
    are looked up in the cells about longer segments, and a pair is found once.
    Steeper lines can only match ground truth shorter than 2 tolerances / sin 60,
    whose middle lies within a tolerance of the detection's line: it meets the
    cells of that line, as far as the box about such ground truth goes.
    """
    g, d = _sides(gt, det)
    columns = [*g.columns, *d.columns]
    g, d = _flat(g, "g"), _flat(d, "d")
    gs, ds = G.ends("g"), G.ends("d")
    size = max(4 * tolerance, 8.0)
    short = F.col("gl") <= 2 * tolerance / math.sin(math.pi / 3) + 1e-9
    mx, my = (gs.x0 + gs.x1) / 2, (gs.y0 + gs.y1) / 2
    n, *edges = g.agg(F.count("*"), *(f(F.when(short, c)) for c in (mx, my) for f in (F.min, F.max))).first()
    g, d = _dealt(g, n), _dealt(d, d.count())
    # a hair more for rounding
    step, reach, long = max(2 * tolerance, 0.25), 2 * tolerance + 1e-6, g.filter(~short)
    dx, dy = (ds.x0 + ds.x1) / 2, (ds.y0 + ds.y1) / 2

    def beside(middles: DataFrame, x: Column, y: Column, others: DataFrame, s: G.Ends, kind: Column, base: str, other: str) -> DataFrame:
        around = cells_beside(others, s, F.col(f"{other}l"), step, reach)
        own = middles.withColumns({"_x": cell(x, step), "_y": cell(y, step)})
        on = (F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy"))
        return own.hint("merge").join(around, on & kind & _matching(base, other, tolerance, True)).select(*columns)

    shorter = F.col("dl") <= F.col("gl")
    far = beside(d, dx, dy, long, gs, shorter, "d", "g").unionByName(beside(long, mx, my, d, ds, ~shorter, "g", "d"))
    pairs = far
    if edges[0] is not None:
        low, high = _in_box(ds, edges, 2 * tolerance)
        line = G.Ends(*(a + t * (b - a) for t in (low, high) for a, b in ((ds.x0, ds.x1), (ds.y0, ds.y1), (ds.z0, ds.z1))))
        along = d.filter(low <= high).withColumn("_d", F.explode(segment_cells(line, size, True)))
        own = g.filter(short).withColumns({"_x": cell(mx, size), "_y": cell(my, size)})
        on = (F.col("_x") == F.col("_d.cx")) & (F.col("_y") == F.col("_d.cy"))
        match = (shorter & _matching("d", "g", tolerance, False)) | (~shorter & _matching("g", "d", tolerance, False))
        near = along.join(own, on & match).select(*columns)
        pairs = far.unionByName(near)
    t0, t1 = G.place_on_segment(ds.x0, ds.y0, ds.z0, gs), G.place_on_segment(ds.x1, ds.y1, ds.z1, gs)
    return pairs.withColumns(
        {
            "correct": G.best_pairing_xy(gs, ds) <= tolerance,
            "t_start": F.least(t0, t1),
            "t_end": F.greatest(t0, t1),
            "xy0": G.line_distance_xy(ds.x0, ds.y0, gs),
            "xy1": G.line_distance_xy(ds.x1, ds.y1, gs),
            "rise0": G.line_distance_z(ds.x0, ds.y0, ds.z0, gs),
            "rise1": G.line_distance_z(ds.x1, ds.y1, ds.z1, gs),
        }
    )


def pipe_labels(gt: DataFrame, matches: DataFrame) -> DataFrame:
    """``(id, label)``: correct if a match pairs the ends, partial if there is a match, else missed."""
    rank = matches.groupBy("gt_id").agg(F.max(F.when(F.col("correct"), 2).otherwise(1)).alias("rank"))
    rows = gt.select("id").join(rank, F.col("id") == F.col("gt_id"), "left")
    return rows.select("id", F.when(F.col("rank") == 2, "correct").when(F.col("rank") == 1, "partial").otherwise("missed").alias("label"))


def distance_samples(matches: DataFrame) -> DataFrame:
    """``(gt_id, det_id, tip, xy, z)``: two samples of each match."""
    tips = F.array(*(F.struct(F.lit(i).alias("tip"), F.col(f"xy{i}").alias("xy"), F.col(f"rise{i}").alias("z")) for i in (0, 1)))
    return matches.select("gt_id", "det_id", F.explode(tips).alias("s")).select("gt_id", "det_id", "s.tip", "s.xy", "s.z")


def coverage(gt: DataFrame, matches: DataFrame) -> DataFrame:
    """``(key, covered, length)`` of each distinct ground-truth segment: the union of its matches' intervals; equal segments are one."""
    s = G.ends()
    key = lambda e: F.struct(*(c.alias(n) for c, n in zip(e, G.Ends._fields, strict=True)))
    turn = Window.partitionBy("key").orderBy("t_start", "t_end")
    rows = matches.select(key(G.ends("g")).alias("key"), "t_start", "t_end")
    rows = rows.withColumn("reach", F.max("t_end").over(turn.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("opens", (F.col("reach").isNull() | (F.col("t_start") > F.col("reach"))).cast("int"))
    rows = rows.withColumn("island", F.sum("opens").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy("key", "island").agg((F.max("t_end") - F.min("t_start")).alias("t"))
    share = spans.groupBy("key").agg(F.sum("t").alias("share")).withColumnRenamed("key", "match_key")
    whole = gt.select(key(s).alias("key"), G.length(s).alias("length")).dropDuplicates(["key"])
    return whole.join(share, F.col("key") == F.col("match_key"), "left").select("key", (F.coalesce("share", F.lit(0.0)) * F.col("length")).alias("covered"), "length")


def false_positives(det: DataFrame, matches: DataFrame) -> DataFrame:
    """Detections equal to no matched detection, by their coordinates, with their ``length``."""
    hit = matches.select(*(F.col(f"d{c}").alias(f"h{c}") for c in G.Ends._fields)).distinct()
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"h{c}")) for c in G.Ends._fields))
    return det.join(hit, same, "left_anti").withColumn("length", G.length(G.ends()))


def missed(gt: DataFrame, matches: DataFrame) -> DataFrame:
    """Ground truth without a match."""
    return gt.join(matches.select(F.col("gt_id").alias("hit")).distinct(), F.col("id") == F.col("hit"), "left_anti")


def _summary(samples: DataFrame, columns: list[str]) -> DataFrame:
    out = []
    for c in columns:
        out += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_avg"), F.median(c).alias(f"{c}_median")]
    return samples.agg(*out)


def pipe_counts(gt: DataFrame, det: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: ground truth, detections, correct, partial, missed, false positives.

    Detections that equal one another count one by one, but as one match.
    """
    labels = pipe_labels(gt, matches).agg(F.count("*").alias("n_gt"), *(F.count(F.when(F.col("label") == k, 1)).alias(k) for k in ("correct", "partial", "missed")))
    hits = matches.agg(F.count_distinct(G.segment_key(G.ends("d"))).alias("hits"))
    return labels.crossJoin(det.agg(F.count("*").alias("n_det"))).crossJoin(hits).select("n_gt", "n_det", "correct", "partial", "missed", (F.col("n_det") - F.col("hits")).alias("false_positives"))


def pipe_report(gt: DataFrame, det: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row of counts, coverage, false-positive length and distance statistics; shares of nothing are null.

    The one-row parts are joined without a key.
    """
    matches = checkpoint(match_pipes(gt, det, tolerance))
    cover = coverage(gt, matches).agg(F.coalesce(F.sum("covered"), F.lit(0.0)).alias("coverage"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("total_length"))
    false = false_positives(det, matches).agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("false_positive_length"))
    lost = missed(gt, matches).agg(F.coalesce(F.sum(G.length(G.ends())), F.lit(0.0)).alias("missed_length"))
    rows = pipe_counts(gt, det, matches).crossJoin(cover).crossJoin(false).crossJoin(lost).crossJoin(_summary(distance_samples(matches), ["xy", "z"]))
    share = lambda part, whole: F.when(whole > 0, part / whole * 100)
    both = F.col("total_length") + F.col("false_positive_length")
    return rows.withColumns({"coverage_pct": share(F.col("coverage"), F.col("total_length")), "coverage_iou_pct": share(F.col("coverage"), both)})


def match_components(gt: DataFrame, det: DataFrame, tolerance: float = TOLERANCE, compat: bool = False) -> DataFrame:
    """``(gt_id, det_id, xy, z)`` of the fittings within the planar tolerance; with ``compat`` a distance of exactly 0 reads -1."""
    g = gt.select(F.col("id").alias("gt_id"), F.col("cx").alias("gx"), F.col("cy").alias("gy"), F.col("cz").alias("gz"))
    d = det.select(F.col("id").alias("det_id"), F.col("cx").alias("dx"), F.col("cy").alias("dy"), F.col("cz").alias("dz"))
    pairs = radius_join(g, d, ["gx", "gy"], ["dx", "dy"], tolerance * (1 + 1e-12))
    xy, z = F.sqrt("d2"), F.abs(F.col("dz") - F.col("gz"))
    shown = (lambda v: F.when(v == 0, F.lit(-1.0)).otherwise(v)) if compat else (lambda v: v)
    return pairs.filter(xy <= tolerance).select("gt_id", "det_id", shown(xy).alias("xy"), shown(z).alias("z"))


def component_report(gt: DataFrame, det: DataFrame, tolerance: float = TOLERANCE, compat: bool = False) -> DataFrame:
    """One row: ground truth, detections, found, missed, false positives, shares and distance statistics."""
    m = checkpoint(match_components(gt, det, tolerance, compat))
    hits = m.agg(F.count_distinct("gt_id").alias("found"), F.count_distinct("det_id").alias("hits"))
    rows = gt.agg(F.count("*").alias("n_gt")).crossJoin(det.agg(F.count("*").alias("n_det"))).crossJoin(hits).crossJoin(_summary(m, ["xy", "z"]))
    rows = rows.withColumns({"missed": F.col("n_gt") - F.col("found"), "false_positives": F.col("n_det") - F.col("hits")})
    share = lambda whole: F.when(whole > 0, F.col("found") / whole * 100)
    return rows.withColumns({"coverage_pct": share(F.col("n_gt")), "coverage_iou_pct": share(F.col("n_gt") + F.col("false_positives"))}).drop("hits")


def box_statistics(samples: DataFrame, value: str) -> DataFrame:
    """One row for a box plot of the finite values: n, mean, quartiles, and whiskers at the farthest values within 1.5 times the quartile range."""
    v = F.col("v")
    rows = samples.select(F.col(value).alias("v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = rows.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), *(F.percentile("v", F.lit(p)).alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    tips = rows.crossJoin(F.broadcast(q)).agg(F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"), F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"))
    return q.crossJoin(tips)


def shares(values: list[tuple[str, Column]], row: DataFrame, scale: str) -> DataFrame:
    """``(scale, label, value, pct)`` of a one-row frame's values; a total of 0 is an error, as there is nothing to show."""
    total = sum((v for _, v in values[1:]), values[0][1])
    checked = F.when(total > 0, total).otherwise(F.raise_error(F.lit(f"no {scale} to share")).cast("double"))
    parts = F.array(*(F.struct(F.lit(name).alias("label"), v.cast("double").alias("value"), (v / checked * 100).alias("pct")) for name, v in values))
    return row.select(F.lit(scale).alias("scale"), F.explode(parts).alias("p")).select("scale", "p.label", "p.value", "p.pct")


def pipe_shares(report: DataFrame) -> DataFrame:
    """Shares of the pipes' classes by number and by length."""
    c = F.col
    return shares([(k, c(k)) for k in ("correct", "partial", "missed", "false_positives")], report, "count").unionByName(
        shares([(k, c(k)) for k in ("coverage", "missed_length", "false_positive_length")], report, "length")
    )


def component_shares(report: DataFrame) -> DataFrame:
    return shares([(k, F.col(k)) for k in ("found", "missed", "false_positives")], report, "count")
