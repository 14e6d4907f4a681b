"""The registered queries of the line-extraction and evaluation operators, over planted geometry.

Doubles are rounded to six decimals, so that engines compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import ClusterMerge, Components, Config, Hough, Snap
from strandline.functions import geometry as G
from strandline.functions import records
from strandline.operators import components, detection, evaluation, lines, slicing, snapping, spatial
from strandline.plans import extraction, oracle
from strandline.plans.fixtures import planted
from strandline.session import checkpoint, read_table
from strandline.sources import geojson, las, obj

THICKNESS, CELL, EPS = 0.2, 0.5, 0.45
#: The planted clouds are sparse, so their rasters are coarser than the default.
COARSE = Hough(cell_size=0.1, canny_sigma=0.8, threshold=10, min_line_length=1.5, max_line_gap=1.0)
SPARSE = Config(
    point_sample_radius=None,
    hough=COARSE,
    slice_cluster_and_merge=ClusterMerge(min_samples=1),
    snap_to_pipe=Snap(tangential_length=0.2),
    pipeComponent_clustering=Components(min_points=5, apply_thinning=False),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL = oracle.SQL


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    """Rounded as DuckDB does it: Spark's own rounding takes the digits that are printed, which near a half may go the other way."""
    return F.round((F.col(c) if isinstance(c, str) else c) * F.lit(1e6)) / F.lit(1e6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """``df`` with its doubles rounded."""
    return df.select(*(r6(df[n]).alias(n) if kind == "double" else df[n] for n, kind in df.dtypes))


def _points(spark: SparkSession, sf_dir: str, code: int) -> DataFrame:
    return slicing.by_class(planted(spark, sf_dir, "POINTS"), code).drop("supplier")


def _gt(spark: SparkSession, sf_dir: str, key: str = "id") -> DataFrame:
    return planted(spark, sf_dir, "GT").withColumnRenamed("id", key)


def _det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir, "DET")


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir, "FEW_FRAGMENTS")


# sources, bands, rasters


@query
def las_class_split(spark, sf_dir):
    sides = [r6(f(c)).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))]
    return planted(spark, sf_dir, "POINTS").groupBy("class").agg(F.count("*").alias("n"), *sides)


@query
def las_roundtrip(spark, sf_dir):
    """All points written as LAS files and read again: numbers and sums in units of a file's steps."""
    points = planted(spark, sf_dir, "POINTS").select(F.lit(0).cast("bigint").alias("point_id"), "x", "y", "z", F.col("class").cast("int").alias("class"))
    step = lambda c: F.sum(F.round(F.col(c) * 10000).cast("bigint")).alias(f"sum_{c}")
    return las.written_and_read(points).groupBy("class").agg(F.count("*").alias("n"), *map(step, "xyz"))


@query
def z_slices(spark, sf_dir):
    return rounded(slicing.z_slices(_points(spark, sf_dir, 1), THICKNESS))


@query
def slice_membership(spark, sf_dir):
    return slicing.slice_members(_points(spark, sf_dir, 1), THICKNESS).groupBy("slice_id").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("avg_x"))


@query
def slice_raster_counts(spark, sf_dir):
    members = slicing.slice_members(_points(spark, sf_dir, 1), THICKNESS)
    return slicing.raster_counts(members, slicing.slice_extents(members, CELL))


@query
def raster_memory(spark, sf_dir):
    return slicing.raster_bytes(slicing.slice_extents(slicing.slice_members(_points(spark, sf_dir, 1), THICKNESS), CELL))


@query
def pixel_to_world(spark, sf_dir):
    pixel = ((F.col("p_partkey") * 7919) % 2003) / 8.0 - 5.0
    return read_table(spark, sf_dir, "part").select("p_partkey", r6(slicing.pixel_to_world(pixel, F.lit(-3.25), F.lit(96.75), F.lit(200))).alias("x"))


# line fragments


@query
def line_axial_features(spark, sf_dir):
    return rounded(lines.axial_features(planted(spark, sf_dir, "FRAGMENTS")).select("seg_id", "theta", "rho", "c2", "s2"))


@query
def axial_mean_direction(spark, sf_dir):
    return rounded(lines.axial_means(planted(spark, sf_dir, "FRAGMENTS"), ["slice_id"]))


@query
def eps_neighbour_pairs(spark, sf_dir):
    return lines.eps_pairs(lines.axial_features(_few(spark, sf_dir)), EPS)


@query
def eps_core_points(spark, sf_dir):
    return lines.core_points(lines.eps_pairs(lines.axial_features(_few(spark, sf_dir)), EPS), 3)


@query
def line_clusters_connected(spark, sf_dir):
    return lines.cluster_lines(_few(spark, sf_dir), EPS, 1).select("seg_id", "cluster_id")


@query
def line_clusters_dbscan(spark, sf_dir):
    return lines.cluster_lines(_few(spark, sf_dir), EPS, 3).select("seg_id", "cluster_id")


@query
def line_clusters_noise_kept(spark, sf_dir):
    return lines.cluster_lines(_few(spark, sf_dir), EPS, 3, preserve_noise=True).select("seg_id", "cluster_id")


@query
def strict_metric_pairs(spark, sf_dir):
    return lines.strict_pairs(lines.axial_features(_few(spark, sf_dir)), 0.3, 10.0)


@query
def strict_metric_clusters(spark, sf_dir):
    return lines.strict_clusters(_few(spark, sf_dir), 0.3, 10.0, 2).select("seg_id", "cluster_id")


@query
def z_gap_subclusters(spark, sf_dir):
    rows = planted(spark, sf_dir, "FRAGMENTS").withColumn("cluster_id", F.col("seg_id") % 3000)
    return lines.split_by_height(rows, 0.15).select("seg_id", "cluster_id", "block")


@query
def merge_islands(spark, sf_dir):
    rows = planted(spark, sf_dir, "INTERVALS").withColumn("sub", F.col("row_id") % 20)
    return rounded(lines.islands(rows, ["grp", "sub"], 2.0, "row_id"))


@query
def merge_islands_z(spark, sf_dir):
    named = planted(spark, sf_dir, "FRAGMENTS").withColumn("cluster_id", F.col("seg_id") % 500)
    return rounded(lines.merge_clusters(named, 2.0, 1.5).select("cluster_id", "island", "x0", "y0", "z0", "x1", "y1", "z1"))


@query
def eps_neighbour_pairs_all(spark, sf_dir):
    return lines.eps_pairs(lines.axial_features(planted(spark, sf_dir, "FRAGMENTS")), EPS)


@query
def line_clusters_dbscan_all(spark, sf_dir):
    return lines.cluster_lines(planted(spark, sf_dir, "FRAGMENTS"), EPS, 3).select("seg_id", "cluster_id")


# snapping


@query
def snap_samples(spark, sf_dir):
    return rounded(snapping.samples(_gt(spark, sf_dir, "seg_id")))


@query
def ghost_segments(spark, sf_dir):
    return snapping.ghosts(_few(spark, sf_dir), _points(spark, sf_dir, 1), 0.8)


@query
def ghost_segments_all(spark, sf_dir):
    return snapping.ghosts(planted(spark, sf_dir, "FRAGMENTS"), _points(spark, sf_dir, 1), 0.8)


@query
def snap_tiny(spark, sf_dir):
    """Segments without length stay as they are, unless no point is near."""
    tips = _gt(spark, sf_dir, "seg_id").withColumns({"x1": F.col("x0"), "y1": F.col("y0"), "z1": F.col("z0")})
    return rounded(snapping.snap(tips, _points(spark, sf_dir, 1))[0])


def _boxes(spark, sf_dir):
    return snapping.box_points(snapping.samples(_gt(spark, sf_dir, "seg_id")), _points(spark, sf_dir, 1))


@query
def sample_box_points(spark, sf_dir):
    return rounded(_boxes(spark, sf_dir).select("seg_id", "k", "point_id", "u", "v"))


@query
def sample_box_centroid(spark, sf_dir):
    return rounded(snapping.box_centroids(_boxes(spark, sf_dir), Snap().quantization_precision))


@query
def quantised_top_z(spark, sf_dir):
    return rounded(snapping.top_heights(planted(spark, sf_dir, "POINTS"), ["supplier"], "z", 0.01))


@query
def delta_z_buckets(spark, sf_dir):
    return rounded(snapping.bucket_angles(snapping.height_buckets(planted(spark, sf_dir, "CHAIN"))))


@query
def bucket_angle_filter(spark, sf_dir):
    return snapping.level_buckets(snapping.height_buckets(planted(spark, sf_dir, "CHAIN"))).select("chain_id", "bucket", "seq")


@query
def ransac_exhaustive_inliers(spark, sf_dir):
    parts = planted(spark, sf_dir, "CHAIN").withColumn("part", F.floor(F.col("seq") / 8)).withColumnRenamed("seq", "idx")
    return rounded(snapping.robust_lines(parts, ["chain_id", "part"], Snap().ransac_residual_threshold).select("chain_id", "part", "i", "j", "inliers", "residual", "ox", "oy"))


@query
def chain_lines(spark, sf_dir):
    return rounded(snapping.chain_segments(planted(spark, sf_dir, "CHAIN")))


@query
def project_endpoints_on_line(spark, sf_dir):
    rows = _few(spark, sf_dir)
    px, py = G.project_on_line(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), (F.col("seg_id") % 3).cast("double"), (F.col("seg_id") % 5).cast("double"))
    return rows.select("seg_id", r6(px).alias("px"), r6(py).alias("py"))


# points, pipes, fittings


@query
def point_segment_min_distance(spark, sf_dir):
    return rounded(spatial.segment_distances(_points(spark, sf_dir, 2), _gt(spark, sf_dir), planar=False))


def _places(spark, sf_dir):
    return planted(spark, sf_dir, "FRAGMENTS").select(F.col("seg_id").alias("point_id"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z"))


@query
def near_pipe_points(spark, sf_dir):
    return spatial.near_segments(_places(spark, sf_dir), _gt(spark, sf_dir), 0.5).select("point_id")


@query
def nearest_pipe(spark, sf_dir):
    places = _few(spark, sf_dir).select("seg_id", "x0", "y0")
    return rounded(spatial.nearest_segment(places, _gt(spark, sf_dir, "pipe_id"), "seg_id", "x0", "y0"))


@query
def nearest_pipe_all(spark, sf_dir):
    places = planted(spark, sf_dir, "FRAGMENTS").select("seg_id", "x0", "y0")
    return rounded(spatial.nearest_segment(places, _gt(spark, sf_dir, "pipe_id"), "seg_id", "x0", "y0"))


@query
def component_boxes(spark, sf_dir):
    rows = planted(spark, sf_dir, "POINTS").filter("class = 2")
    return rounded(components.component_boxes(rows.select("point_id", "x", "y", "z"), rows.select("point_id", F.col("supplier").alias("label")), _gt(spark, sf_dir, "pipe_id"), 0.5))


@query
def component_mask(spark, sf_dir):
    return components.component_points(_points(spark, sf_dir, 2), _gt(spark, sf_dir)).select("point_id")


@query
def thin_first_round(spark, sf_dir):
    return spatial.thin_first_round(_points(spark, sf_dir, 2), 0.02)


@query
def thin_points(spark, sf_dir):
    return spatial.thin(_points(spark, sf_dir, 2), 0.02)


@query
def source_thinning(spark, sf_dir):
    return spatial.thin(_points(spark, sf_dir, 1), 0.02, planar=False)


@query
def hdbscan_components(spark, sf_dir):
    return components.density_clusters(_points(spark, sf_dir, 2), Components(min_points=5))


# detection and the whole plan


def _cells(spark, sf_dir):
    members = slicing.slice_members(_points(spark, sf_dir, 1), THICKNESS)
    return slicing.raster_counts(members, slicing.slice_extents(members, COARSE.cell_size))


@query
def canny_cells(spark, sf_dir):
    return detection.canny_cells(_cells(spark, sf_dir), COARSE)


@query
def hough_segments(spark, sf_dir):
    return detection.hough_segments(detection.canny_cells(_cells(spark, sf_dir), COARSE), COARSE)


@query
def hough_space(spark, sf_dir):
    return detection.hough_space(detection.canny_cells(_cells(spark, sf_dir), COARSE))


@query
def hough_votes(spark, sf_dir):
    """Votes of all occupied cells of a coarse raster, by the quarter of a right angle."""
    members = slicing.slice_members(_points(spark, sf_dir, 1), THICKNESS)
    return detection.hough_space(slicing.raster_counts(members, slicing.slice_extents(members, CELL)), 4)


@query
def hough_peaks(spark, sf_dir):
    return detection.hough_peaks(hough_space(spark, sf_dir))


@query
def slice_lines(spark, sf_dir):
    return detection.slice_lines(_points(spark, sf_dir, 1), THICKNESS, COARSE)


@query
def pipe_extraction(spark, sf_dir):
    return extraction.approximate_pipes(checkpoint(_points(spark, sf_dir, 1)), SPARSE)


@query
def pipe_snapping(spark, sf_dir):
    return snapping.snap(_gt(spark, sf_dir, "seg_id"), _points(spark, sf_dir, 1))[0]


@query
def pipe_snapping_whole(spark, sf_dir):
    """Snapping of the pipes to all points of their boxes."""
    return rounded(snapping.snap(_gt(spark, sf_dir, "seg_id"), _points(spark, sf_dir, 1), thinning=False)[0])


@query
def pipeline_features(spark, sf_dir):
    points = checkpoint(planted(spark, sf_dir, "POINTS").drop("supplier"))
    found = extraction.extract_pipes(slicing.by_class(points, 1), SPARSE)
    fittings = extraction.extract_components(slicing.by_class(points, 2), found.pipes, SPARSE)
    return geojson.feature_rows(found.pipes, found.chains, fittings)


# evaluation


def _matches(spark, sf_dir):
    return evaluation.match_pipes(_gt(spark, sf_dir), _det(spark, sf_dir))


@query
def eval_pipe_labels(spark, sf_dir):
    return evaluation.pipe_labels(_gt(spark, sf_dir), _matches(spark, sf_dir))


@query
def eval_pipe_counts(spark, sf_dir):
    return evaluation.pipe_counts(_gt(spark, sf_dir), _det(spark, sf_dir), checkpoint(_matches(spark, sf_dir)))


@query
def eval_pipe_samples(spark, sf_dir):
    return rounded(evaluation.distance_samples(_matches(spark, sf_dir)))


@query
def eval_pipe_coverage(spark, sf_dir):
    found = evaluation.coverage(_gt(spark, sf_dir), _matches(spark, sf_dir))
    return rounded(found.select("key.*", "covered", "length"))


@query
def eval_false_positives(spark, sf_dir):
    return rounded(evaluation.false_positives(_det(spark, sf_dir), _matches(spark, sf_dir)).select("id", "length"))


@query
def eval_missed(spark, sf_dir):
    return evaluation.missed(_gt(spark, sf_dir), _matches(spark, sf_dir)).select("id")


def _report(spark, sf_dir):
    return evaluation.pipe_report(_gt(spark, sf_dir), _det(spark, sf_dir))


@query
def eval_pipe_report(spark, sf_dir):
    return rounded(_report(spark, sf_dir))


@query
def eval_component_matches(spark, sf_dir):
    return rounded(evaluation.match_components(planted(spark, sf_dir, "GT_COMP"), planted(spark, sf_dir, "DET_COMP")))


@query
def eval_component_report(spark, sf_dir):
    return rounded(evaluation.component_report(planted(spark, sf_dir, "GT_COMP"), planted(spark, sf_dir, "DET_COMP")))


@query
def distance_boxplot_stats(spark, sf_dir):
    samples = checkpoint(evaluation.distance_samples(_matches(spark, sf_dir)))
    parts = [rounded(evaluation.box_statistics(samples, c)).withColumn("part", F.lit(c)) for c in ("xy", "z")]
    return parts[0].unionByName(parts[1])


@query
def class_share_table(spark, sf_dir):
    report = checkpoint(_report(spark, sf_dir))
    fittings = evaluation.component_report(planted(spark, sf_dir, "GT_COMP"), planted(spark, sf_dir, "DET_COMP"))
    both = evaluation.pipe_shares(report).withColumn("of", F.lit("pipes")).unionByName(evaluation.component_shares(fittings).withColumn("of", F.lit("components")))
    return rounded(both)


# sinks


def _fittings(spark, sf_dir):
    near = lambda c, d: (F.col(f"c{c}") + d)
    c = planted(spark, sf_dir, "GT_COMP")
    sides = [near(a, d).alias(f"{name}_{a}") for name, d in (("min", -0.25), ("max", 0.25)) for a in "xyz"]
    return c.select(F.col("id").alias("comp_id"), *sides, "cx", "cy", "cz")


def _collection(spark, sf_dir):
    pipes = _gt(spark, sf_dir, "pipe_id")
    chains = pipes.select(F.col("pipe_id").alias("chain_id"), F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("z1").alias("z"))).alias("points"))
    return geojson.feature_rows(pipes, chains, _fittings(spark, sf_dir), 25832)


@query
def geojson_features(spark, sf_dir):
    rows = _collection(spark, sf_dir)
    get = lambda path: F.get_json_object("json", path)
    bbox = F.coalesce(F.size(F.from_json(get("$.bbox"), "array<double>")), F.lit(0))
    return rows.select(get("$.id").alias("id"), get("$.geometry.type").alias("kind"), get("$.properties.feature_type").alias("feature_type"), bbox.alias("n_bbox"), get("$.properties.proj:epsg").cast("int").alias("epsg"))


@query
def geojson_roundtrip(spark, sf_dir):
    features = geojson.parse_collections(geojson.collection(_collection(spark, sf_dir), 'a "cloud"'))
    return rounded(geojson.pipes_of(features).select(F.col("pos").cast("int").alias("pos"), "x0", "y0", "z0", "x1", "y1", "z1"))


@query
def geojson_edges(spark, sf_dir):
    features = geojson.parse_collections(geojson.collection(_collection(spark, sf_dir), "cloud"))
    return rounded(geojson.edges_of(features).drop("pos"))


@query
def geojson_components(spark, sf_dir):
    features = geojson.parse_collections(geojson.collection(_collection(spark, sf_dir), "cloud"))
    return rounded(geojson.components_of(features).drop("pos"))


@query
def obj_lines(spark, sf_dir):
    return obj.segment_lines(_gt(spark, sf_dir), "id").select("part", "n", "k", "line")


@query
def obj_slice(spark, sf_dir):
    return obj.slice_segment_lines(_few(spark, sf_dir), 5, 1.25).select("part", "n", "k", "line")


@query
def obj_missed(spark, sf_dir):
    return obj.segment_lines(evaluation.missed(_gt(spark, sf_dir), _matches(spark, sf_dir)), "id").select("part", "n", "k", "line")


@query
def obj_points(spark, sf_dir):
    return obj.point_lines(planted(spark, sf_dir, "CHAIN").withColumn("at", F.col("chain_id") * 100 + F.col("seq")), "at").select("part", "n", "k", "line")


@query
def obj_clusters(spark, sf_dir):
    return obj.cluster_lines_obj(_few(spark, sf_dir).withColumn("cluster_id", F.when(F.col("seg_id") % 7 != 0, F.col("seg_id") % 60))).select("part", "n", "k", "line")


@query
def obj_sample_vectors(spark, sf_dir):
    rows = snapping.samples(_gt(spark, sf_dir, "seg_id")).withColumns({"cx": F.col("sx") + 0.25, "cy": F.col("sy") - 0.25, "z": F.col("sz")})
    return obj.sample_vector_lines(rows, 0.05, 0.8).select("part", "n", "k", "line")


@query
def obj_component_boxes(spark, sf_dir):
    return obj.component_lines(_fittings(spark, sf_dir)).select("part", "n", "k", "line")


@query
def cluster_json(spark, sf_dir):
    return obj.cluster_json(_few(spark, sf_dir).withColumn("cluster_id", F.col("seg_id") % 9), 5)


@query
def cluster_json_bands(spark, sf_dir):
    return obj.cluster_json_bands(_few(spark, sf_dir).withColumn("cluster_id", F.col("seg_id") % 9))


@query
def cluster_json_contents(spark, sf_dir):
    """What the JSON of all bands says when read back."""
    point = "struct<x: double, y: double, z: double>"
    schema = f"total_segments bigint, total_clusters bigint, clusters array<struct<cluster_id: bigint, segment_count: bigint, segments: array<struct<segment_index: bigint, start_point: {point}, end_point: {point}>>>>"
    rows = cluster_json_bands(spark, sf_dir).select("slice_id", F.from_json("value", schema).alias("v"))
    rows = rows.select("slice_id", "v.total_segments", "v.total_clusters", F.explode("v.clusters").alias("c"))
    rows = rows.select("slice_id", "total_segments", "total_clusters", "c.cluster_id", "c.segment_count", F.explode("c.segments").alias("s"))
    ends = [F.col(f"s.{e}_point.{a}").alias(f"{a}{i}") for i, e in enumerate(("start", "end")) for a in "xyz"]
    return rounded(rows.select("slice_id", "total_segments", "total_clusters", "cluster_id", "segment_count", "s.segment_index", *ends))


@query
def metrics_json(spark, sf_dir):
    samples = checkpoint(evaluation.distance_samples(_matches(spark, sf_dir)))
    return obj.metrics_json(_report(spark, sf_dir), samples)


@query
def metrics_json_contents(spark, sf_dir):
    """What the JSON says when read back: the report, and the number and sum of the samples."""
    report = _report(spark, sf_dir)
    schema = ", ".join(f"{n} {kind}" for n, kind in report.dtypes) + ", xy_samples array<double>, z_samples array<double>"
    rows = metrics_json(spark, sf_dir).select(F.from_json("value", schema).alias("v"))
    total = lambda c: F.aggregate(f"v.{c}_samples", F.lit(0.0), lambda s, x: s + x).alias(f"sum_{c}")
    counts = [v for c in ("xy", "z") for v in (F.size(f"v.{c}_samples").cast("bigint").alias(f"n_{c}"), total(c))]
    return rounded(rows.select(*(f"v.{n}" for n in report.columns), *counts))


@query
def label_mapping(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", records.mapped_label(F.col("c_nationkey"), [(k * 7) % 5 for k in range(25)]).alias("label"))


@query
def segment_records(spark, sf_dir):
    return rounded(records.segments_to_records(_gt(spark, sf_dir), "id"))


@query
def segments_from_records(spark, sf_dir):
    return rounded(records.records_to_segments(records.segments_to_records(_gt(spark, sf_dir), "id")))
