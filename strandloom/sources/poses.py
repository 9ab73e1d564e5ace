"""Binary pose files in any store, as a data source with ranges of files and a commit.

Layout (little endian): mark, bucket size u16, bucket i16 x3, offset count u16 (0 means
65,536), pose count u32, offsets i16 x3, poses per offset u32, and per pose conformer,
rotamer and offset number u16.  The mark is given by the caller.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from strandloom.constants import BUCKET, BUCKET_SIZE, POSE
from strandloom.operators.pool import bucket_starts
from strandloom.sources import store
from strandloom.sources.staged import StagedWriter

CHUNK = 500_000  # poses held at a time
TASK_BYTES = 24 << 20  # of a file, for one task: four million poses
ROWS_PER_FILE = 4_000_000
ENDINGS = (".bin", ".bin.zst")
OFFSETS = ["ox", "oy", "oz"]
_FIXED = struct.Struct("<HhhhHI")
SCHEMA = "file string, row bigint, conformer int, rotamer int, gx int, gy int, gz int"
_ARROW = pa.schema([("file", pa.string()), ("row", pa.int64()), *[(c, pa.int32()) for c in POSE]])


def _exactly(handle, size: int, uri: str) -> bytes:
    data = bytearray()
    while len(data) < size:
        got = handle.read(size - len(data))
        if not got:
            raise ValueError(f"{uri}: file is too short")
        data += got
    return bytes(data)


def _head(handle, mark: bytes, uri: str) -> tuple[int, tuple[int, int, int], int, int]:
    if _exactly(handle, len(mark), uri) != mark:
        raise ValueError(f"{uri}: wrong file mark")
    size, mx, my, mz, offsets, poses = _FIXED.unpack(_exactly(handle, _FIXED.size, uri))
    if size < 1:
        raise ValueError(f"{uri}: bucket size must be positive")
    return size, (mx, my, mz), offsets or 65_536, poses


def _poses(uri: str, mark: bytes, size: int, share: int, shares: int) -> Iterator[pa.RecordBatch]:
    """One of ``shares`` equal ranges of the poses of a file, in bounded chunks."""
    packed = uri.endswith(store.ZSTD)
    with store.stream(uri) as handle:
        bucket_size, bucket, n_offsets, n_poses = _head(handle, mark, uri)
        offsets = np.frombuffer(_exactly(handle, 6 * n_offsets, uri), "<i2").reshape(-1, 3)
        counts = np.frombuffer(_exactly(handle, 4 * n_offsets, uri), "<u4").astype(np.int64)
        if counts.sum() != n_poses:
            raise ValueError(f"{uri}: offset counts do not add up to {n_poses}")
        begin = len(mark) + _FIXED.size + 10 * n_offsets
        if not packed and size != begin + 6 * n_poses:
            raise ValueError(f"{uri}: " + ("file is too short" if size < begin + 6 * n_poses else "data after the last pose"))
        first, last = n_poses * share // shares, n_poses * (share + 1) // shares
        if first:
            handle.seek(begin + 6 * first)
        grids = (offsets.astype(np.int64) + np.array(bucket) * bucket_size).astype(np.int32)
        for at in range(first, last, CHUNK):
            stop = min(last, at + CHUNK)
            fields = np.frombuffer(_exactly(handle, 6 * (stop - at), uri), "<u2").reshape(-1, 3)
            if fields[:, 2].max(initial=0) >= n_offsets:
                raise ValueError(f"{uri}: pose refers to a missing offset")
            grid = grids[fields[:, 2]]
            columns = [*fields[:, :2].astype(np.int32).T, *grid.T]
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri] * (stop - at)), pa.array(np.arange(at, stop)), *[pa.array(np.ascontiguousarray(c)) for c in columns]],
                schema=_ARROW,
            )
        if packed and handle.read(1):
            raise ValueError(f"{uri}: data after the last pose")


@dataclass
class Share(InputPartition):
    uri: str
    size: int
    share: int
    shares: int


class PoseReader(DataSourceReader):
    """Files in name order; a large plain file is read by several tasks."""

    def __init__(self, options: dict):
        self.folder, self.mark = options["folder"], bytes.fromhex(options["mark"])
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))

    def partitions(self) -> list[Share]:
        out = []
        for file in store.files(self.folder, ENDINGS):
            # A compressed file is one stream.
            shares = 1 if file.uri.endswith(store.ZSTD) else max(1, -(-file.size // self.task_bytes))
            out += [Share(file.uri, file.size, k, shares) for k in range(shares)]
        return out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        yield from _poses(partition.uri, self.mark, partition.size, partition.share, partition.shares)


class PoseWriter(StagedWriter, DataSourceArrowWriter):
    """Poses in order of bucket, part and id; one file for each bucket and part."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.mark, self.bucket_size = bytes.fromhex(options["mark"]), int(options["bucket_size"])

    def _save(self, key: tuple, tables: list[np.ndarray]) -> tuple:
        rows = np.concatenate(tables)
        offsets = rows[:, 2:]
        firsts = np.append(0, np.flatnonzero((offsets[1:] != offsets[:-1]).any(1)) + 1)
        if len(firsts) > 65_536:
            raise ValueError("too many offsets in one file")
        counts = np.diff(np.append(firsts, len(rows)))
        which = np.repeat(np.arange(len(firsts)), counts)
        *bucket, part = key
        head = self.mark + _FIXED.pack(self.bucket_size, *bucket, len(firsts) % 65_536, len(rows))
        body = np.column_stack([rows[:, :2], which])
        if body.min(initial=0) < 0 or body.max(initial=0) > 65_535:
            raise ValueError("conformer or rotamer does not fit 16 bits")
        parts = [head, offsets[firsts].astype("<i2").tobytes(), counts.astype("<u4").tobytes(), body.astype("<u2").tobytes()]
        name = "_".join(f"{b:+06d}" for b in bucket)
        return (*self.put(f"poses_{name}_{part:06d}.bin", parts), len(rows))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done, held, key = [], [], None
        for batch in iterator:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in (*BUCKET, "part")], 1).astype(np.int64)
            rows = np.stack([batch[c].to_numpy() for c in ("conformer", "rotamer", *OFFSETS)], 1).astype(np.int64)
            cut = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)
            for low, high in zip(cut, np.append(cut[1:], len(rows))):
                found = tuple(keys[low].tolist())
                if found != key:
                    if held:
                        done.append(self._save(key, held))
                    key, held = found, []
                held.append(rows[low:high])
        if held:
            done.append(self._save(key, held))
        return self.message(done)


class PoseFiles(DataSource):
    """``spark.read.format("pose_files")`` with ``folder`` (a URI), ``mark`` (hex) and ``task_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "pose_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PoseReader:
        return PoseReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> PoseWriter:
        return PoseWriter(dict(self.options))


def read_poses(spark: SparkSession, path: str, mark: bytes, *, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Poses of one file or of a folder, with ``file`` and the place in it (``row``)."""
    spark.dataSource.register(PoseFiles)
    options = {"folder": store.qualified(spark, path), "mark": mark.hex(), "task_bytes": str(task_bytes)}
    return spark.read.format("pose_files").options(**options).load()


def count_poses(spark: SparkSession, path: str, mark: bytes) -> DataFrame:
    """``(file, poses)`` from the first bytes of every file."""
    uris = [f.uri for f in store.files(store.qualified(spark, path), ENDINGS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["file"].to_pylist()
            poses = []
            for uri in names:
                with store.stream(uri) as handle:
                    poses.append(_head(handle, mark, uri)[3])
            yield pa.RecordBatch.from_pydict({"file": names, "poses": pa.array(poses, pa.int64())})

    listed = spark.createDataFrame([(u,) for u in uris], "file string")
    return listed.repartition(max(1, len(uris)), "file").mapInArrow(count, "file string, poses bigint")


def write_poses(
    pool: DataFrame, path: str, mark: bytes, *, rows_per_file: int = ROWS_PER_FILE, bucket_size: int = BUCKET_SIZE
) -> DataFrame:
    """Write an organized pool as pose files; returns their ``(file, poses)``.

    A bucket with many poses is cut into files of ``rows_per_file`` by pose id, which
    bounds what a task holds.  Files appear only when all of them are written.
    """
    spark = pool.sparkSession
    spark.dataSource.register(PoseFiles)
    starts = bucket_starts(pool).select(*BUCKET, "first_id")
    parts = pool.join(starts, BUCKET).withColumn("part", F.floor((F.col("pose_id") - F.col("first_id")) / rows_per_file))
    ordered = (
        parts.select(*BUCKET, "part", "pose_id", "conformer", "rotamer", *OFFSETS)
        .repartition(*BUCKET, "part")
        .sortWithinPartitions(*BUCKET, "part", "pose_id")
    )
    options = {"folder": store.qualified(spark, path), "mark": mark.hex(), "bucket_size": str(bucket_size)}
    ordered.write.format("pose_files").mode("append").options(**options).save()
    return count_poses(spark, path, mark)
