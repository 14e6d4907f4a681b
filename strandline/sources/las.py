"""LAS point files as a Spark data source, read by ranges of records and written a file per partition.

Only uncompressed files are read; a compressed one is an error that says so.
Plain paths, which all executors see, are read by ranges; addresses of a store
(``scheme://``) go through Spark's own readers, a file of up to 2 GB at a time.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strandline.session import checkpoint

SCHEMA = "point_id bigint, x double, y double, z double, class int"
#: Records of a partition.
CHUNK = 1_000_000
# fixed values: the byte of a record that holds its class, by point format
_CLASS_BYTE = {**dict.fromkeys(range(6), 15), **dict.fromkeys(range(6, 11), 16)}


@dataclass(frozen=True)
class Header:
    offset: int
    fmt: int
    size: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]


def read_header(raw: bytes) -> Header:
    """From the first 375 bytes of a file."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = raw[25]
    offset, fmt, size, count = struct.unpack_from("<I", raw, 96)[0], raw[104], struct.unpack_from("<H", raw, 105)[0], struct.unpack_from("<I", raw, 107)[0]
    if fmt & 0xC0:
        raise ValueError("compressed point records (LAZ) are not supported: write the cloud as LAS")
    if minor >= 4 and len(raw) >= 255:
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    return Header(offset, fmt, size, count, struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155))


def decode_records(raw: bytes, h: Header) -> dict[str, np.ndarray]:
    """x, y, z and class of whole records; the other dimensions are not decoded."""
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(-1, h.size)
    xyz = rows[:, :12].copy().view("<i4").astype(np.float64)
    code = rows[:, _CLASS_BYTE[h.fmt]]
    return {a: xyz[:, i] * h.scale[i] + h.shift[i] for i, a in enumerate("xyz")} | {"class": (code & 31 if h.fmt < 6 else code).astype(np.int32)}


def encode(x: np.ndarray, y: np.ndarray, z: np.ndarray, code: np.ndarray, scale: float = 0.0001) -> bytes:
    """A version 1.2 file of point format 0."""
    n = len(x)
    axes = [np.asarray(a, dtype=np.float64) for a in (x, y, z)]
    shift = [float(np.floor(a.min())) if n else 0.0 for a in axes]
    rows = np.zeros((n, 20), dtype=np.uint8)
    rows[:, :12] = np.stack([np.rint((a - s) / scale) for a, s in zip(axes, shift, strict=True)], axis=1).astype("<i4").view(np.uint8).reshape(n, 12)
    rows[:, 15] = np.asarray(code) & 31
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    struct.pack_into("<HIIBHI", head, 94, 227, 227, 0, 0, 20, n)
    struct.pack_into("<6d", head, 131, scale, scale, scale, *shift)
    struct.pack_into("<6d", head, 179, *(v for a in axes for v in ((a.max(), a.min()) if n else (0.0, 0.0))))
    return bytes(head) + rows.tobytes()


@dataclass
class _Range(InputPartition):
    path: str
    file: int
    start: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.files = las_files(path)

    def partitions(self) -> list[_Range]:
        out = []
        for k, path in enumerate(self.files):
            with open(path, "rb") as f:
                h = read_header(f.read(375))
            out += [_Range(path, k, s, min(CHUNK, h.count - s)) for s in range(0, h.count, CHUNK)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        with open(part.path, "rb") as f:
            h = read_header(f.read(375))
            f.seek(h.offset + part.start * h.size)
            found = decode_records(f.read(part.count * h.size), h)
        ids = (np.int64(part.file) << 40) + part.start + np.arange(part.count)
        yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(found[c]) for c in ("x", "y", "z", "class"))], names=["point_id", "x", "y", "z", "class"])


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceArrowWriter):
    """New files appear beside old ones; the old ones go when all of the new ones are there."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:12]
        os.makedirs(path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        table = [b for b in batches if b.num_rows]
        columns = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in table]) if table else np.zeros(0) for c in ("x", "y", "z", "class")]
        path = os.path.join(self.path, f"part-{self.job}-{task.partitionId():05d}.las")
        if len(columns[0]):
            with open(f"{path}.{task.attemptNumber()}", "wb") as f:
                f.write(encode(*columns[:3], columns[3].astype(np.uint8)))
            os.replace(f"{path}.{task.attemptNumber()}", path)
        return _Written(path)

    def _remove(self, own: bool) -> None:
        for name in os.listdir(self.path):
            if name.startswith("part-") and ".las" in name and name.startswith(f"part-{self.job}-") == own:
                os.remove(os.path.join(self.path, name))

    def commit(self, messages: list[_Written | None]) -> None:
        if self.overwrite:
            self._remove(own=False)

    def abort(self, messages: list[_Written | None]) -> None:
        self._remove(own=True)


class LasSource(DataSource):
    """``spark.read.format("las").load(path)``: a file, or the files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def las_files(path: str) -> list[str]:
    """The file itself, or the folder's .las and .laz files, in any case, not its subfolders'."""
    own = lambda p: p.lower().endswith((".las", ".laz"))
    if os.path.isfile(path):
        return [path] if own(path) else []
    return sorted(os.path.join(path, f) for f in os.listdir(path) if own(f)) if os.path.isdir(path) else []


def class_column(df: DataFrame) -> Column:
    """The column that holds the class, whatever its usual name."""
    for name in ("class", "classification", "Classification", "raw_classification"):
        if name in df.columns:
            return df[name].cast("int").alias("class")
    raise ValueError(f"no class among the columns {df.columns}")


def _stored_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[lL][aA][sSzZ]").load(path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """Points of the LAS files at an address that Spark can read; ids number the files in order of their names."""
    files = _stored_files(spark, path)
    numbers = {r["path"]: k for k, r in enumerate(files.select("path").orderBy("path").collect())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = memoryview(raw.as_buffer())
                h = read_header(bytes(raw[:375]))
                for start in range(0, h.count, CHUNK):
                    n = min(CHUNK, h.count - start)
                    found = decode_records(raw[h.offset + start * h.size : h.offset + (start + n) * h.size], h)
                    ids = (np.int64(numbers[name]) << 40) + start + np.arange(n)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(found[c]) for c in ("x", "y", "z", "class"))], names=["point_id", "x", "y", "z", "class"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def load_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a LAS file or folder, or of Parquet with (point_id, x, y, z, class)."""
    if "://" in path and not _stored_files(spark, path).select("path").isEmpty():
        return read_stored(spark, path)
    if las_files(path):
        spark.dataSource.register(LasSource)
        return spark.read.format("las").load(path)
    df = spark.read.parquet(path)
    return df.select("point_id", *(F.col(c).cast("double").alias(c) for c in "xyz"), class_column(df))


def written_and_read(points: DataFrame) -> DataFrame:
    """The points as they come back from LAS files, which go to a folder of their own beside the session's checkpoints."""
    spark = points.sparkSession
    spark.dataSource.register(LasSource)
    checkpoint(spark.range(0))  # names the folder
    folder = urlsplit(spark.sparkContext.getCheckpointDir()).path + f"/las-{uuid.uuid4().hex[:12]}"
    points.write.format("las").mode("overwrite").save(folder)
    return load_points(spark, folder)
