"""Command line: ``python -m strandline.cli --input CLOUD [--output_dir DIR] [--config_path JSON] [--gt_path GEOJSON] [--eval] [--clean]``."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from strandline.plans.extraction import extract_features


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description="Pipes and fittings of a classified point cloud.")
    p.add_argument("--input", required=True, help="LAS file or folder, or Parquet with point_id, x, y, z, class")
    p.add_argument("--config_path", help="JSON settings; defaults otherwise")
    p.add_argument("--gt_path", help="GeoJSON ground truth")
    p.add_argument("--output_dir", default="./output")
    p.add_argument("--eval", action="store_true", help="report against the ground truth")
    p.add_argument("--clean", action="store_true", help="remove what earlier runs left in the output's folders first")
    return p


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("strandline").getOrCreate()
    name = os.path.splitext(os.path.basename(given.input.rstrip("/")))[0]
    found = extract_features(spark, given.input, given.output_dir, given.config_path, given.gt_path, given.eval and given.gt_path is not None, name, given.clean)
    for key in ("pipe_report", "component_report"):
        if key in found:
            found[key].show(truncate=False, vertical=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
