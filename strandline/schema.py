"""Row types that the operators exchange, and a check of a frame against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ENDS = "x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"

POINTS = "point_id bigint, x double, y double, z double, class int"
SLICES = "slice_id int, z_center double, zmin double, zmax double"
CELLS = "slice_id int, row int, col int, n bigint"
SEGMENTS = f"seg_id bigint, slice_id int, {_ENDS}"
PIPES = f"pipe_id bigint, {_ENDS}"
SAMPLES = "seg_id bigint, k int, sx double, sy double, tx double, ty double, nx double, ny double, cx double, cy double, z double, n_pts bigint"
CHAINS = "chain_id bigint, seq int, x double, y double, z double"
COMPONENTS = "comp_id bigint, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, cx double, cy double, cz double"
FEATURES = "type string, id string, bbox array<double>, geometry struct<type: string, coordinates: string>, properties map<string, string>"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A frame without rows."""
    return spark.createDataFrame([], schema)


def require(df: DataFrame, schema: str, what: str) -> DataFrame:
    """``df`` with the schema's columns, cast; a missing column is a ValueError."""
    wanted = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    lost = [f.name for f in wanted if f.name not in df.columns]
    if lost:
        raise ValueError(f"{what} need columns {lost}; got {df.columns}")
    return df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in wanted))
