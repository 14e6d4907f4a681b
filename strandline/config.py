"""Settings of the extraction, with their defaults and a JSON reader."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import SparkSession


# fixed values: the defaults of the published settings file
@dataclass(frozen=True)
class Hough:
    cell_size: float = 0.01
    canny_sigma: float = 1.2
    threshold: int = 15
    min_line_length: float = 1.5
    max_line_gap: float = 0.5
    canny_low: float = 0.1
    canny_high: float = 0.2
    tile_cells: int = 1024
    seed: int = 42


@dataclass(frozen=True)
class ClusterMerge:
    epsilon: float = 0.45
    min_samples: int = 3
    rho_scale: float = 1.0
    preserve_noise: bool = False
    min_line_length: float = 1.5
    max_line_gap: float = 2.0
    fix_axial_seam: bool = False


@dataclass(frozen=True)
class Snap:
    normal_length: float = 0.8
    tangential_length: float = 0.05
    min_points_for_centroid: int = 4
    samples_per_meter: float = 2.0
    min_sample_points: int = 3
    poisson_radius: float = 0.02
    quantization_precision: float = 0.01
    max_angle_change_deg: float = 15.0
    ransac_residual_threshold: float = 0.05
    min_points_per_bucket: int = 3
    merge_jump_threshold: float = 3.0
    mean_angle_limit_deg: float = 15.0
    merge_height_limit: float = 0.1


@dataclass(frozen=True)
class Components:
    min_points: int = 20
    metric: str = "euclidean"
    cluster_selection_method: str = "eom"
    pipe_distance_threshold: float = 0.5
    filter_near_pipes: bool = True
    apply_thinning: bool = True


@dataclass(frozen=True)
class Config:
    point_sample_radius: float | None = 0.02
    slice_thickness: float = 0.2
    hough: Hough = field(default_factory=Hough)
    slice_cluster_and_merge: ClusterMerge = field(default_factory=ClusterMerge)
    global_cluster_and_merge: ClusterMerge = field(default_factory=lambda: ClusterMerge(epsilon=0.7, min_samples=1, preserve_noise=True, min_line_length=1.0))
    snap_to_pipe: Snap = field(default_factory=Snap)
    pipeComponent_clustering: Components = field(default_factory=Components)


#: Keys that are accepted and have no effect.
UNUSED = {"parallel_worker", "leaf_size"}


def _merged(default, values: dict, path: str):
    known = {f.name for f in fields(default)}
    for key in set(values) - known - UNUSED:
        warnings.warn(f"unknown setting {path}{key}", stacklevel=3)
    own = {k: _merged(getattr(default, k), v, f"{path}{k}.") if is_dataclass(getattr(default, k)) else v for k, v in values.items() if k in known}
    return type(default)(**{f.name: own.get(f.name, getattr(default, f.name)) for f in fields(default)})


def load_config(spark: SparkSession, path: str | None = None) -> Config:
    """Defaults, overridden by a JSON file that Spark can read; any failure is a RuntimeError."""
    if path is None:
        return Config()
    try:
        text = spark.read.text(path, wholetext=True).first()[0]
        return _merged(Config(), json.loads(text), "")
    except Exception as e:
        raise RuntimeError(f"cannot read settings from {path}: {e}") from e
