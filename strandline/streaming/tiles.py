"""Point tiles that arrive over time: running raster counts, and extraction per arriving batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.schema import POINTS


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet tiles that appear in a folder."""
    return spark.readStream.schema(POINTS).parquet(folder)


def running_cells(points: DataFrame, thickness: float, cell_size: float) -> DataFrame:
    """``(band, row, col, n)`` on a fixed grid from the origin, which needs no extent and so can be counted as points come."""
    place = lambda c, size: F.floor(F.col(c) / size).cast("bigint")
    return points.groupBy(place("z", thickness).alias("band"), place("y", cell_size).alias("row"), place("x", cell_size).alias("col")).agg(F.count("*").alias("n"))


def each_tile(points: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch plan on every micro-batch and append what it returns; a batch that is repeated after a failure replaces its own folder."""

    def run(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
