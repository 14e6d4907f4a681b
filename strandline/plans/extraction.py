"""The whole extraction: points to pipes, chains and fittings, their export, and their evaluation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schema
from strandline.config import Config, load_config
from strandline.operators import components, detection, evaluation, snapping
from strandline.operators.slicing import by_class
from strandline.operators.spatial import thin
from strandline.session import checkpoint, ship
from strandline.sources import geojson, las, obj


class Pipes(NamedTuple):
    """Pipes ``PIPES``, chains ``(chain_id, points)``, the approximate segments and the samples they come from."""

    pipes: DataFrame
    chains: DataFrame
    approximate: DataFrame
    samples: DataFrame


def approximate_pipes(points: DataFrame, config: Config = Config()) -> DataFrame:
    """``SEGMENTS`` over all height bands: lines per band, merged within the band, then across bands."""
    lines = checkpoint(detection.slice_lines(points, config.slice_thickness, config.hough))
    merged = checkpoint(detection.merged_lines(lines, config.slice_cluster_and_merge, "slice_id"))
    return checkpoint(detection.merged_lines(merged, config.global_cluster_and_merge))


def extract_pipes(points: DataFrame, config: Config = Config()) -> Pipes:
    """Pipes of class-1 points ``(point_id, x, y, z)``; no points or no lines give empty frames."""
    approximate = approximate_pipes(points, config)
    snapped, samples = snapping.snap(approximate, points, config.snap_to_pipe)
    samples = checkpoint(samples)
    pipes = checkpoint(snapped.select(F.xxhash64("seg_id", "part").alias("pipe_id"), "x0", "y0", "z0", "x1", "y1", "z1"))
    return Pipes(pipes, snapping.chain_points(approximate, samples), approximate, samples)


def extract_components(points: DataFrame, pipes: DataFrame, config: Config = Config()) -> DataFrame:
    """``COMPONENTS`` of class-2 points."""
    return checkpoint(components.find_components(points, pipes, config.pipeComponent_clustering, config.point_sample_radius))


#: Folders of an output.
FOLDERS = ("obj", "geojson", "metrics")


def clear_output(spark: SparkSession, output: str) -> None:
    """Remove the folders that runs write under ``output``, wherever Spark writes; what else lies there stays."""
    for name in FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{output}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def extract_features(spark: SparkSession, cloud: str, output: str, config_path: str | None = None, truth: str | None = None, evaluate: bool = False, name: str = "cloud", clean: bool = False) -> dict[str, DataFrame]:
    """Read a classified cloud, write its features under ``output`` and return them; with a truth file, reports too.

    Only this run's own files under ``output`` are replaced, unless it is to be
    ``clean``: then what earlier runs left in its folders goes first.
    """
    ship(spark)
    if clean:
        clear_output(spark, output)
    config = load_config(spark, config_path)
    cloud_points = checkpoint(schema.require(las.load_points(spark, cloud), schema.POINTS, "points"))
    if config.point_sample_radius:
        kept = thin(cloud_points, config.point_sample_radius, planar=False)
        cloud_points = checkpoint(cloud_points.join(kept, "point_id", "left_semi"))
    found = extract_pipes(by_class(cloud_points, 1), config)
    fittings = extract_components(by_class(cloud_points, 2), found.pipes, config)
    snap = config.snap_to_pipe
    geojson.write_geojson(found.pipes, found.chains, fittings, name, f"{output}/geojson/{name}")
    obj.write_lines(obj.segment_lines(found.approximate, "seg_id"), f"{output}/obj/{name}_approximate")
    obj.write_lines(obj.segment_lines(found.pipes, "pipe_id"), f"{output}/obj/{name}_pipes")
    obj.write_lines(obj.sample_vector_lines(found.samples, snap.tangential_length, snap.normal_length), f"{output}/obj/{name}_snap_vectors")
    obj.write_lines(obj.component_lines(fittings), f"{output}/obj/{name}_components")
    out = {"pipes": found.pipes, "chains": found.chains, "components": fittings}
    if evaluate and truth:
        features = checkpoint(geojson.read_geojson(spark, truth))
        out |= evaluate_features(features, found.pipes, fittings, output, name)
    return out


def evaluate_features(truth: DataFrame, pipes: DataFrame, fittings: DataFrame, output: str | None = None, name: str = "cloud") -> dict[str, DataFrame]:
    """Reports of pipes and fittings against the features of a truth file, written under ``output`` if given."""
    gt = geojson.pipes_of(truth).withColumnRenamed("pos", "id")
    det = pipes.withColumnRenamed("pipe_id", "id")
    matches = checkpoint(evaluation.match_pipes(gt, det))
    report = evaluation.pipe_report(gt, det)
    gt_fit = geojson.components_of(truth).withColumnRenamed("pos", "id")
    det_fit = fittings.withColumnRenamed("comp_id", "id")
    fit_report = evaluation.component_report(gt_fit, det_fit)
    if output:
        obj.metrics_json(report, evaluation.distance_samples(matches)).coalesce(1).write.mode("overwrite").text(f"{output}/metrics/{name}_pipes")
        obj.metrics_json(fit_report, evaluation.match_components(gt_fit, det_fit)).coalesce(1).write.mode("overwrite").text(f"{output}/metrics/{name}_components")
        lost, false = evaluation.missed(gt, matches), evaluation.false_positives(det, matches)
        for rows, kind in ((lost, "missed"), (false, "false_positives")):
            if not rows.isEmpty():
                obj.write_lines(obj.segment_lines(rows, "id"), f"{output}/obj/{name}_{kind}")
    return {"pipe_report": report, "component_report": fit_report}
