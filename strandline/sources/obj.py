"""Wavefront OBJ and JSON texts: each function returns ordered text lines, and ``write_lines`` writes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import geometry as G
from strandline.session import numbered


def _vertex(pattern: str, x: Column, y: Column, z: Column) -> Column:
    return F.format_string(f"v {pattern} {pattern} {pattern}", x, y, z)


def _exploded(rows: DataFrame, texts: list[Column], part: int = 1) -> DataFrame:
    return rows.select(F.lit(part).alias("part"), F.col("n"), F.posexplode(F.array(*texts)).alias("k", "line"))


def _header(df: DataFrame, *texts: str) -> DataFrame:
    """Lines before the rows; ``{count}`` stands for the number of rows."""
    total = df.agg(F.count("*").cast("string").alias("t"))
    made = [F.concat(*(x for i, piece in enumerate(t.split("{count}")) for x in ([F.col("t")] if i else []) + [F.lit(piece)])) for t in texts]
    return total.select(F.lit(0).alias("part"), F.lit(0).alias("n"), F.posexplode(F.array(*made)).alias("k", "line"))


def segment_lines(segments: DataFrame, by: str, header: tuple[str, ...] = ("# lines: {count}",), pattern: str = "%.6f") -> DataFrame:
    """``(part, n, k, line)``: two vertices and a line for each segment (x0 .. z1), in order of ``by``."""
    s, n = G.ends(), F.col("n")
    rows = numbered(segments, by)
    link = F.format_string("l %d %d", n * 2 + 1, n * 2 + 2)
    return _header(segments, *header).unionByName(_exploded(rows, [_vertex(pattern, s.x0, s.y0, s.z0), _vertex(pattern, s.x1, s.y1, s.z1), link]))


def slice_segment_lines(segments: DataFrame, slice_id: int, z_center: float) -> DataFrame:
    """The lines of one height band."""
    return segment_lines(segments.filter(F.col("slice_id") == slice_id), "seg_id", (f"# slice {slice_id}", f"# height: {z_center:.6f}", "# lines: {count}"))


def point_lines(points: DataFrame, by: str) -> DataFrame:
    """A vertex for each point."""
    return _header(points, "# points: {count}").unionByName(_exploded(numbered(points, by), [_vertex("%.6f", F.col("x"), F.col("y"), F.col("z"))]))


def cluster_lines_obj(segments: DataFrame) -> DataFrame:
    """Segments with ``cluster_id``, an object and group for each cluster; nine decimals.  Clusters are numbered in order of their names."""
    s, n = G.ends(), F.col("n")
    rows = segments.filter(F.col("cluster_id").isNotNull())
    names = numbered(rows.select("cluster_id").distinct(), "cluster_id", into="cid")
    rows = numbered(rows, "cluster_id", "seg_id").join(names, "cluster_id")
    first = F.row_number().over(Window.partitionBy("cluster_id").orderBy("seg_id")) == 1
    rows = rows.withColumn("first", first).withColumn("size", F.count("*").over(Window.partitionBy("cluster_id")))
    name = F.lpad(F.col("cid").cast("string"), 3, "0")
    # numbers of more than three digits keep them all
    name = F.when(F.col("cid") > 999, F.col("cid").cast("string")).otherwise(name)
    head = F.when(F.col("first"), F.array(F.concat(F.lit("# cluster "), F.col("cid").cast("string"), F.lit(", segments: "), F.col("size").cast("string")), F.concat(F.lit("o cluster_"), name), F.concat(F.lit("g cluster_"), name, F.lit("_lines")))).otherwise(F.expr("cast(array() as array<string>)"))
    body = F.array(_vertex("%.9f", s.x0, s.y0, s.z0), _vertex("%.9f", s.x1, s.y1, s.z1), F.format_string("l %d %d", n * 2 + 1, n * 2 + 2))
    lines = rows.select(F.lit(1).alias("part"), "n", F.posexplode(F.concat(head, body)).alias("k", "line"))
    return _header(rows.select("cluster_id").distinct(), "# clusters: {count}").unionByName(lines)


def sample_vector_lines(samples: DataFrame, tangential: float, normal: float) -> DataFrame:
    """Six vertices and five lines for each sample: its place, the ends of tangent and normal both ways, and the centroid it was moved to."""
    n, z = F.col("n"), F.col("z")
    sx, sy = F.col("sx"), F.col("sy")
    at = lambda x, y: _vertex("%.6f", x, y, z)
    ends = [at(sx + sign * F.col(f"{v}x") * size, sy + sign * F.col(f"{v}y") * size) for v, size in (("t", tangential), ("n", normal)) for sign in (1, -1)]
    links = [F.format_string("l %d %d", n * 6 + 1, n * 6 + 2 + i) for i in range(5)]
    rows = numbered(samples, "seg_id", "k")
    head = F.concat(F.lit("# sample "), n.cast("string"))
    return _header(samples, f"# tangent: {tangential}", f"# normal: {normal}", "# samples: {count}").unionByName(_exploded(rows, [head, at(sx, sy), *ends, at(F.col("cx"), F.col("cy")), *links]))


# fixed values: the corners of a box in the order of the format, its edges, and the cross at its centre
_CORNERS = [("min", "min", "min"), ("max", "min", "min"), ("max", "max", "min"), ("min", "max", "min"), ("min", "min", "max"), ("max", "min", "max"), ("max", "max", "max"), ("min", "max", "max")]
_EDGES = [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)]
_CROSS = 0.01


def component_lines(components: DataFrame) -> DataFrame:
    """Box, centre point and a small cross for each component: 15 vertices, a point, 3 + 12 lines."""
    n = F.col("n")
    v = lambda x, y, z: _vertex("%.6f", x, y, z)
    corners = [v(*(F.col(f"{m}_{a}") for m, a in zip(c, "xyz", strict=True))) for c in _CORNERS]
    c = [F.col("cx"), F.col("cy"), F.col("cz")]
    cross = [v(*(x + sign * _CROSS if i == axis else x for i, x in enumerate(c))) for axis in range(3) for sign in (-1, 1)]
    link = lambda a, b: F.format_string("l %d %d", n * 15 + a + 1, n * 15 + b + 1)
    point = F.format_string("p %d", n * 15 + 9)
    rows = numbered(components, "comp_id")
    return _exploded(rows, [*corners, v(*c), point, *cross, *(link(9 + 2 * i, 10 + 2 * i) for i in range(3)), *(link(a, b) for a, b in _EDGES)])


def cluster_json(segments: DataFrame, slice_id: int, z_value: float = 0.0) -> DataFrame:
    """One row ``(value)``: the clusters of a band's segments as nested JSON, in order of their names."""
    rows = segments.filter(F.col("slice_id") == slice_id)
    tip = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), F.coalesce(f"z{i}", F.lit(z_value)).alias("z"))
    own = F.struct(F.col("seg_id").alias("segment_index"), tip(0).alias("start_point"), tip(1).alias("end_point"))
    per = rows.filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("segment_count"), F.array_sort(F.collect_list(own)).alias("segments"))
    whole = per.agg(F.count("*").alias("total_clusters"), F.array_sort(F.collect_list(F.struct("cluster_id", "segment_count", "segments"))).alias("clusters"))
    total = rows.agg(F.count("*").alias("total_segments"))
    return whole.crossJoin(total).select(F.to_json(F.struct(F.lit(slice_id).alias("slice_id"), "total_segments", "total_clusters", F.lit(z_value).alias("z_value"), "clusters")).alias("value"))


def cluster_json_bands(segments: DataFrame, z_value: float = 0.0) -> DataFrame:
    """``(slice_id, value)``: what ``cluster_json`` gives, for every band of the segments."""
    tip = lambda i: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), F.coalesce(f"z{i}", F.lit(z_value)).alias("z"))
    own = F.struct(F.col("seg_id").alias("segment_index"), tip(0).alias("start_point"), tip(1).alias("end_point"))
    per = segments.groupBy("slice_id", "cluster_id").agg(F.count("*").alias("segment_count"), F.array_sort(F.collect_list(own)).alias("segments"))
    named = F.when(F.col("cluster_id").isNotNull(), F.struct("cluster_id", "segment_count", "segments"))
    whole = per.groupBy("slice_id").agg(F.sum("segment_count").alias("total_segments"), F.count("cluster_id").alias("total_clusters"), F.array_sort(F.collect_list(named)).alias("clusters"))
    return whole.select("slice_id", F.to_json(F.struct("slice_id", "total_segments", "total_clusters", F.lit(z_value).alias("z_value"), "clusters")).alias("value"))


def metrics_json(report: DataFrame, samples: DataFrame) -> DataFrame:
    """One row ``(value)``: a report's columns and the raw samples as JSON; nulls are left out."""
    raw = samples.agg(F.array_sort(F.collect_list("xy")).alias("xy_samples"), F.array_sort(F.collect_list("z")).alias("z_samples"))
    return report.crossJoin(raw).select(F.to_json(F.struct("*")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ordered text lines as one file."""
    order = [c for c in ("part", "n", "k") if c in lines.columns]
    lines.coalesce(1).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def union_lines(*parts: DataFrame) -> DataFrame:
    """Several texts one after another."""
    moved = [p.withColumn("part", F.col("part") + 10 * i) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, moved)
