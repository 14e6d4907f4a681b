"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's source to the workers, once a context, so that they need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_strandline_shipped", False):
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline_source.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    context.addPyFile(str(path))
    context._strandline_shipped = True


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the reread rows.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local master
    without that setting gets a temporary folder; a cluster must name one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="strandline-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *by: str, into: str = "n", few: int = 200_000) -> DataFrame:
    """``df`` with each row's place, from 0, in order of ``by``.

    Up to ``few`` rows are sorted in one task.  More are sorted by ranges, and
    each range's places follow those of the ranges before it.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    if df.count() <= few:
        return df.withColumn(into, (F.row_number().over(Window.orderBy(*by)) - 1).cast("bigint"))
    rows = checkpoint(df.repartitionByRange(*by).sortWithinPartitions(*by))
    # the number of a checkpoint's partition and the row's place in it
    rows = rows.withColumn(into, F.monotonically_increasing_id())
    part = F.shiftright(F.col(into), 33)
    counts = sorted((r["p"], r["m"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("m")).collect())
    before, starts = 0, []
    for p, m in counts:
        starts.append((p, before))
        before += m
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint"))
    return rows.withColumn("_part", part).join(table, "_part").withColumn(into, F.col("_start") + F.col(into).bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start")


def broadcast_if_small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` checkpointed, and marked for broadcast if it has at most ``most`` (narrow) rows; beyond, joins shuffle.

    Spark's own estimate of a checkpoint is that of its plan, in which rows that
    were exploded count once: without the hint it may broadcast any number.
    """
    from pyspark.sql import functions as F

    kept = checkpoint(df)
    return F.broadcast(kept) if kept.count() <= most else kept.hint("merge")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
