"""Lines in height bands: rasters cut into tiles, edges and segments found per tile, results in the world."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import ClusterMerge, Hough
from strandline.operators import kernels
from strandline.operators.lines import cluster_lines, merge_clusters
from strandline.operators.slicing import pixel_to_world, raster_counts, slice_extents, slice_members
from strandline.session import broadcast_if_small, checkpoint


def _halo(settings: Hough) -> int:
    return int(4 * settings.canny_sigma + 0.5) + 2


def tiled_cells(cells: DataFrame, settings: Hough = Hough()) -> DataFrame:
    """Cells ``(slice_id, tile_row, tile_col, row, col, n, peak)``, those near a tile's border in the neighbour tiles too.

    ``peak`` is the band's largest count.  A tile has a bounded number of cells,
    so one dense band does not land in one task.
    """
    size, halo = settings.tile_cells, _halo(settings)
    peak = cells.groupBy("slice_id").agg(F.max("n").alias("peak"))
    tiles = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + d) / size).cast("int") for d in (-halo, 0, halo))))
    rows = cells.join(broadcast_if_small(peak, 100_000), "slice_id").withColumn("tile_row", F.explode(tiles("row"))).withColumn("tile_col", F.explode(tiles("col")))
    return rows.filter("tile_row >= 0 and tile_col >= 0")


def _dense(group: pd.DataFrame, settings: Hough) -> tuple[np.ndarray, int, int]:
    """Raster of a tile's bounding box with its halo, and the place of its first cell."""
    halo = _halo(settings)
    low_r, low_c = int(group["row"].min()) - halo, int(group["col"].min()) - halo
    image = np.zeros((int(group["row"].max()) - low_r + halo + 1, int(group["col"].max()) - low_c + halo + 1), dtype=np.float32)
    image[group["row"].to_numpy() - low_r, group["col"].to_numpy() - low_c] = group["n"].to_numpy()
    return image, low_r, low_c


def _tile_edges(group: pd.DataFrame, settings: Hough) -> pd.DataFrame:
    image, low_r, low_c = _dense(group, settings)
    r, c = np.nonzero(kernels.canny(image, settings.canny_sigma, settings.canny_low, settings.canny_high, float(group["peak"].iloc[0])))
    r, c, size = r + low_r, c + low_c, settings.tile_cells
    tr, tc = int(group["tile_row"].iloc[0]), int(group["tile_col"].iloc[0])
    own = (r // size == tr) & (c // size == tc) & (r >= 0) & (c >= 0)
    return pd.DataFrame({"slice_id": group["slice_id"].iloc[0], "tile_row": tr, "tile_col": tc, "row": r[own], "col": c[own]})


def canny_cells(cells: DataFrame, settings: Hough = Hough()) -> DataFrame:
    """``(slice_id, tile_row, tile_col, row, col)`` of the edge cells."""
    schema = "slice_id int, tile_row int, tile_col int, row int, col int"
    return tiled_cells(cells, settings).groupBy("slice_id", "tile_row", "tile_col").applyInPandas(lambda g: _tile_edges(g, settings), schema)


def _inside(line: tuple[int, int, int, int], low: tuple[float, float], size: int) -> tuple[float, ...] | None:
    """The part of a line in a square, or None."""
    start, end, ways = 0.0, 1.0, (line[2] - line[0], line[3] - line[1])
    for at, way, first in zip(line[:2], ways, low, strict=True):
        if way:
            one, two = sorted(((first - at) / way, (first + size - at) / way))
            start, end = max(start, one), min(end, two)
        elif not first <= at < first + size:
            return None
    if start >= end:
        return None
    # whole lines keep their exact ends
    return tuple(float(line[i]) if t == i // 2 else line[i % 2] + t * ways[i % 2] for i, t in zip(range(4), (start, start, end, end), strict=True))


def hough_segments(edges: DataFrame, settings: Hough = Hough()) -> DataFrame:
    """``(slice_id, seg_no, px0, py0, px1, py1)`` in pixels of the band's raster.

    A tile sees the edges around it as far as a line's least length and a gap,
    so that a line over its border counts by its whole length.  It returns the
    part of a line inside itself, however short; merging joins the parts again.
    The random order depends on the seed, the band and the tile only.
    """
    length, gap = max(1, round(settings.min_line_length / settings.cell_size)), max(0, round(settings.max_line_gap / settings.cell_size))
    size, halo = settings.tile_cells, length + gap + 1
    tiles = lambda c: F.sequence(*(F.floor((F.col(c) + d) / size).cast("int") for d in (-halo, halo)))
    seen = edges.select("slice_id", "row", "col", F.explode(tiles("row")).alias("tile_row")).withColumn("tile_col", F.explode(tiles("col"))).filter("tile_row >= 0 and tile_col >= 0")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["row", "col"])
        low_r, low_c = int(g["row"].min()), int(g["col"].min())
        image = np.zeros((int(g["row"].max()) - low_r + 1, int(g["col"].max()) - low_c + 1), dtype=bool)
        image[g["row"] - low_r, g["col"] - low_c] = True
        tile = [int(g[c].iloc[0]) for c in ("slice_id", "tile_row", "tile_col")]
        found = kernels.hough_lines(image, settings.threshold, length, gap, seed=[settings.seed, *(t + 1 for t in tile)])
        low = (tile[2] * size - 0.5, tile[1] * size - 0.5)
        parts = (_inside((x0 + low_c, y0 + low_r, x1 + low_c, y1 + low_r), low, size) for x0, y0, x1, y1 in found)
        out = pd.DataFrame([p for p in parts if p], columns=["px0", "py0", "px1", "py1"], dtype="float64")
        return out.assign(slice_id=tile[0], tile_row=tile[1], tile_col=tile[2], seg_no=range(len(out)))

    schema = "slice_id int, tile_row int, tile_col int, seg_no int, px0 double, py0 double, px1 double, py1 double"
    return seen.groupBy("slice_id", "tile_row", "tile_col").applyInPandas(run, schema)


def hough_space(edges: DataFrame, angles: int = 180) -> DataFrame:
    """``(slice_id, angle, rho, votes)``: how many edge cells lie on each line, angles in steps of pi / ``angles``, rho in cells; votes are summed before they are shuffled."""
    rows = edges.withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))))
    theta = F.col("angle") * (np.pi / angles) - np.pi / 2
    rho = F.rint(F.col("col") * F.cos(theta) + F.col("row") * F.sin(theta)).cast("int")
    return rows.groupBy("slice_id", "angle", rho.alias("rho")).agg(F.count("*").alias("votes"))


def hough_peaks(votes: DataFrame, distance: int = 20, turn: int = 10, share: float = 0.3, angles: int = 180) -> DataFrame:
    """``(slice_id, angle, rho, votes, place)``: the strongest lines of each band's votes, one by one.

    A line counts with more than ``share`` of the band's most votes, and unless a
    stronger one lies within ``distance`` cells and ``turn`` angles, where the last
    angle is beside the first with rho turned about; ties go to the smaller angle
    and rho.
    """
    top = votes.groupBy("slice_id").agg(F.max("votes").alias("most"))
    strong = votes.join(broadcast_if_small(top, 100_000), "slice_id").filter(F.col("votes") > share * F.col("most")).drop("most")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["votes", "angle", "rho"], ascending=[False, True, True])
        angle, rho = g["angle"].to_numpy(np.int64), g["rho"].to_numpy(np.int64)
        free, kept = np.ones(len(g), dtype=bool), []
        while free.any():
            k = int(free.argmax())
            kept.append(k)
            for shift, sign in ((0, 1), (angles, -1), (-angles, -1)):
                free &= (np.abs(angle + shift - angle[k]) > turn) | (np.abs(sign * rho - rho[k]) > distance)
        return g.iloc[kept].assign(place=range(1, len(kept) + 1))[["slice_id", "angle", "rho", "votes", "place"]]

    return strong.groupBy("slice_id").applyInPandas(run, "slice_id int, angle int, rho int, votes bigint, place int")


def slice_lines(points: DataFrame, thickness: float, settings: Hough = Hough()) -> DataFrame:
    """``SEGMENTS`` found in the height bands of the points, each at its band's middle height; no points, no lines."""
    members = slice_members(points, thickness)
    extents = checkpoint(slice_extents(members, settings.cell_size))
    pixels = hough_segments(canny_cells(checkpoint(raster_counts(members, extents)), settings), settings)
    rows = pixels.join(extents, "slice_id")
    world = {}
    for i in (0, 1):
        world[f"x{i}"] = pixel_to_world(F.col(f"px{i}"), F.col("x_min"), F.col("x_max"), F.col("nx"))
        world[f"y{i}"] = pixel_to_world(F.col(f"py{i}"), F.col("y_min"), F.col("y_max"), F.col("ny"))
        world[f"z{i}"] = F.col("z_center")
    # the band, tile and number of a segment in one id
    seg = ((F.col("slice_id").cast("bigint") * 4096 + F.col("tile_row")) * 4096 + F.col("tile_col")) * 1048576 + F.col("seg_no")
    return rows.select(seg.alias("seg_id"), "slice_id", *(world[c].alias(c) for c in ("x0", "y0", "z0", "x1", "y1", "z1")))


def merged_lines(segments: DataFrame, settings: ClusterMerge, by: str | None = None) -> DataFrame:
    """Segments clustered and merged along their axes, numbered anew by the cluster and its island."""
    named = cluster_lines(segments, settings.epsilon, settings.min_samples, settings.rho_scale, settings.preserve_noise, by, settings.fix_axial_seam)
    merged = merge_clusters(named, settings.max_line_gap, settings.min_line_length, by)
    keys = [F.col(by)] if by else [F.lit(None).cast("int").alias("slice_id")]
    return merged.select(F.xxhash64("cluster_id", "island").alias("seg_id"), *keys, "x0", "y0", "z0", "x1", "y1", "z1")
