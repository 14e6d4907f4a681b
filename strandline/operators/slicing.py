"""Height bands, count rasters, and pixels back to the world."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import broadcast_if_small


def by_class(points: DataFrame, code: int, planar: bool = False) -> DataFrame:
    """Points of one class (1 pipes, 2 fittings), without heights if ``planar``."""
    found = points.filter(F.col("class") == code)
    return found.drop("z") if planar else found


def _extent(points: DataFrame, thickness: float) -> DataFrame:
    """One row: (z_min, z_max, n)."""
    e = points.agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    return e.withColumn("n", F.greatest(F.lit(1), F.ceil((F.col("z_max") - F.col("z_min")) / thickness)).cast("int"))


def _bounds(i: Column, thickness: float) -> tuple[Column, Column, Column]:
    """Centre, lower and upper bound of band ``i``; the first starts at the least height, the last ends at the greatest and has its centre between."""
    centre = F.col("z_min") + (i + 0.5) * thickness
    low = F.when(i == 0, F.col("z_min")).otherwise(centre - 0.5 * thickness)
    last = i == F.col("n") - 1
    high = F.when(last, F.col("z_max")).otherwise(centre + 0.5 * thickness)
    return F.when(last, (low + high) * 0.5).otherwise(centre), low, high


def z_slices(points: DataFrame, thickness: float) -> DataFrame:
    """``(slice_id, z_center, zmin, zmax)``; no points, no bands."""
    ids = _extent(points, thickness).filter("z_min is not null").withColumn("slice_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    centre, low, high = _bounds(F.col("slice_id"), thickness)
    return ids.select("slice_id", centre.alias("z_center"), low.alias("zmin"), high.alias("zmax"))


def slice_members(points: DataFrame, thickness: float) -> DataFrame:
    """Points with ``slice_id`` and ``z_center``, once for each band that holds them; bounds are closed, so a point on an inner bound is in two.

    One pass: the band of a height and its two neighbours are tested by their
    exact bounds, rather than every band against every point.
    """
    extent = F.broadcast(_extent(points, thickness))  # one row
    guess = F.floor((F.col("z") - F.col("z_min")) / thickness).cast("int")
    rows = points.crossJoin(extent).withColumn("slice_id", F.explode(F.array(guess - 1, guess, guess + 1)))
    centre, low, high = _bounds(F.col("slice_id"), thickness)
    inside = (F.col("slice_id") >= 0) & (F.col("slice_id") < F.col("n")) & F.col("z").between(low, high)
    return rows.filter(inside).withColumn("z_center", centre).drop("z_min", "z_max", "n")


def slice_extents(members: DataFrame, cell_size: float) -> DataFrame:
    """``(slice_id, z_center, x_min, x_max, y_min, y_max, nx, ny)``: planar extent and grid of each band; an extent without width is padded by a cell."""
    e = members.groupBy("slice_id").agg(F.first("z_center").alias("z_center"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    for a in "xy":
        low, high = F.col(f"{a}_min"), F.col(f"{a}_max")
        e = e.withColumn(f"{a}_max", F.when(high <= low, low + cell_size).otherwise(high))
    for a in "xy":
        e = e.withColumn(f"n{a}", F.greatest(F.lit(1), F.ceil((F.col(f"{a}_max") - F.col(f"{a}_min")) / cell_size)).cast("int"))
    return e


def raster_counts(members: DataFrame, extents: DataFrame) -> DataFrame:
    """``(slice_id, row, col, n)`` of the cells that hold points: equal parts of the extent, the last one closed.

    Extents are a row a band and broadcast after a check, so only the partial
    counts of cells are shuffled, never the points.
    """

    def place(a: str) -> Column:
        width = (F.col(f"{a}_max") - F.col(f"{a}_min")) / F.col(f"n{a}")
        return F.least(F.floor((F.col(a) - F.col(f"{a}_min")) / width), F.col(f"n{a}") - 1).cast("int")

    rows = members.select("slice_id", "x", "y").join(broadcast_if_small(extents, 100_000), "slice_id")
    return rows.groupBy("slice_id", place("y").alias("row"), place("x").alias("col")).agg(F.count("*").alias("n"))


def pixel_to_world(pixel: Column, low: Column, high: Column, n: Column) -> Column:
    """Middle of a pixel's cell: rounded half to even, kept within the grid."""
    k = F.greatest(F.lit(0), F.least(F.rint(pixel), n - 1))
    width = (high - low) / n
    return low + k * width + 0.5 * width


def raster_bytes(extents: DataFrame) -> DataFrame:
    """``(slice_id, cells, bytes)``: what a dense grid of each band would take, at 25 bytes a cell."""
    cells = F.col("nx").cast("bigint") * F.col("ny")
    return extents.select("slice_id", cells.alias("cells"), (cells * 25).alias("bytes"))
