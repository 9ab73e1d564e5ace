"""Array files in any store: ``.npy`` columns and arrays of any shape, plain or zstd.

Headers and frame bounds are read by tasks, one per file; then plain files are read in row
ranges and compressed ones in runs of frames, each by a task of its own in bounded chunks.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql import functions as F

from strandloom.sources import store
from strandloom.sources.staged import StagedWriter
from strandloom.staging import task_count

TASK_BYTES = 64 << 20  # of content, for one task
CHUNK_BYTES = 8 << 20  # of content, held at a time
ROWS_PER_FILE = 4_000_000
SHORT_TASKS = 8  # times the task slots: no more tasks than this for files or runs that are short
ENDINGS = (".npy", ".npy.zst")


def _header(handle) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(handle)
    reader = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = reader(handle)
    if fortran and len(shape) > 1:
        raise ValueError("column-major arrays are not supported")
    return shape, dtype


def _sql_type(dtype: np.dtype) -> str:
    if dtype.kind == "f":
        return "float" if dtype.itemsize <= 4 else "double"
    if dtype.kind == "b":
        return "boolean"
    if dtype.kind in "iu" and not (dtype.kind == "u" and dtype.itemsize == 8):
        return "int" if dtype.itemsize < 4 or dtype == np.int32 else "bigint"
    if dtype.kind == "u":
        return "bigint"  # ids above 2^63 are refused while reading
    raise ValueError(f"unsupported array type {dtype}")


_ARROW = {"float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64()}


def _describe(uri: str, size: int, task_bytes: int) -> dict:
    """Shape and type of an array file, and the runs that tasks read it in.

    A run is a place in the file and the range of content bytes found from there.
    """
    with store.stream(uri) as handle:
        shape, dtype = _header(handle)
        begin = handle.tell()
    if not shape:
        raise ValueError(f"{uri}: a single value is no array")
    row = dtype.itemsize * math.prod(shape[1:])
    total = begin + row * shape[0]
    if not uri.endswith(store.ZSTD):
        if size != total:
            raise ValueError(f"{uri}: the data do not fit shape {shape}")
        step = max(1, task_bytes // max(row, 1)) * row
        runs = [(at, at, min(at + step, total)) for at in range(begin, total, max(step, 1))]
    else:
        runs, at, known = [], 0, True
        for start, _, content in store.frames(uri, size):
            known = known and content >= 0
            if runs and (not known or at + max(content, 0) - runs[-1][1] <= task_bytes):
                runs[-1] = (*runs[-1][:2], at + content)
            else:
                runs.append((start, at, at + content))
            at += content
        if not known:  # frames of unknown length: one stream
            runs = [(0, 0, total)]
        elif at != total:
            raise ValueError(f"{uri}: the data do not fit shape {shape}")
    return {
        "uri": uri,
        "rows": shape[0],
        "kind": f"{dtype.str} {' '.join(map(str, shape[1:]))}".strip(),
        "begin": begin,
        "runs": [dict(zip(("place", "low", "high"), r)) for r in runs],
    }


_FACTS = "uri string, rows bigint, kind string, begin bigint, runs array<struct<place: bigint, low: bigint, high: bigint>>"


def describe(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per array file of ``path``: rows, type, and what tasks read."""
    found = store.files(store.qualified(spark, path), ENDINGS)
    if not found:
        raise FileNotFoundError(path)

    run = pa.struct([(c, pa.int64()) for c in ("place", "low", "high")])
    schema = pa.schema(
        [("uri", pa.string()), ("rows", pa.int64()), ("kind", pa.string()), ("begin", pa.int64()), ("runs", pa.list_(run))]
    )

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_describe(u, s, task_bytes) for u, s in zip(batch["uri"].to_pylist(), batch["size"].to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    listed = spark.createDataFrame([(f.uri, f.size) for f in found], "uri string, size bigint")
    return listed.repartition(min(len(found), SHORT_TASKS * task_count(spark))).mapInArrow(facts, _FACTS)


def _rows(uri: str, run: tuple[int, int, int], begin: int, row: int, rows: int, chunk: int) -> Iterator[tuple[int, bytes]]:
    """``(first row, data)`` of the rows that begin in a run of content bytes.

    A row that goes on in the next frame is read to its end.
    """
    place, low, high = run
    first = max(0, -(-(low - begin) // row)) if row else 0
    last = min(rows, max(0, -(-(high - begin) // row))) if row else rows
    if first >= last:
        return
    packed = uri.endswith(store.ZSTD)
    with store.unpacked(uri, place) if packed else store.opened(uri) as handle:
        skip = begin + first * row - low
        if packed:
            while skip:
                got = len(handle.read(min(skip, chunk)))
                if not got:
                    raise ValueError(f"{uri}: file is too short")
                skip -= got
        else:
            handle.seek(place + skip)
        step = max(1, chunk // max(row, 1))
        for at in range(first, last, step):
            want = (min(step, last - at)) * row
            data = bytearray()
            while len(data) < want:
                got = handle.read(want - len(data))
                if not got:
                    raise ValueError(f"{uri}: file is too short")
                data += got
            yield at, bytes(data)
        if packed and last == rows and handle.read(1):
            raise ValueError(f"{uri}: data after the last row")


def read_arrays(
    spark: SparkSession, path: str, name: str = "value", *, task_bytes: int = TASK_BYTES, chunk: int = CHUNK_BYTES
) -> DataFrame:
    """``(row, name)`` of an array kept as one file or as a folder of parts in name order.

    Parts may be compressed (``.npy.zst``).  Rows of arrays of more dimensions are flat
    arrays.  All parts need one type and one row shape.  No task holds more than some rows
    of one file.
    """
    # One row per file, with the runs of its frames.
    parts = describe(spark, path, task_bytes).orderBy("uri").collect()
    kinds = {p.kind for p in parts}
    if len(kinds) != 1:
        raise ValueError(f"{path}: parts differ: {sorted(kinds)}")
    code, *inner = kinds.pop().split(" ")
    dtype, width = np.dtype(code), math.prod(map(int, inner))
    sql = _sql_type(dtype)
    item = _ARROW[sql]
    starts = np.cumsum([0, *[p.rows for p in parts]]).tolist()
    tasks = [
        (p.uri, start, r.place, r.low, r.high, p.begin, p.rows) for p, start in zip(parts, starts) for r in p.runs
    ]
    schema = pa.schema([("row", pa.int64()), (name, pa.list_(item) if inner else item)])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, place, low, high, begin, rows in zip(*[c.to_pylist() for c in batch.columns]):
                for at, data in _rows(uri, (place, low, high), begin, dtype.itemsize * width, rows, chunk):
                    flat = np.frombuffer(data, dtype)
                    if dtype.kind == "u" and dtype.itemsize == 8 and len(flat) and flat.max() >> 63:
                        raise ValueError(f"{uri}: value exceeds 63 bits")
                    count = len(flat) // max(width, 1) if width else rows
                    column = pa.array(flat.astype(item.to_pandas_dtype()))
                    if inner:
                        column = pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32) * width, column)
                    yield pa.RecordBatch.from_arrays([pa.array(start + at + np.arange(count)), column], schema=schema)

    sql = sql if not inner else f"array<{sql}>"
    fields = "uri string, start bigint, place bigint, low bigint, high bigint, begin bigint, rows bigint"
    if not tasks:
        return spark.createDataFrame([], f"row bigint, {name} {sql}")
    # One task a run, however small its description; but very many short runs share tasks.
    content = sum(r.high - r.low for p in parts for r in p.runs)
    most = max(SHORT_TASKS * task_count(spark), -(-content // TASK_BYTES))
    spread = spark.sparkContext.parallelize(tasks, min(len(tasks), most))
    return spark.createDataFrame(spread, fields).mapInArrow(load, f"row bigint, {name} {sql}")


def read_npy(spark: SparkSession, path: str, name: str = "value", **limits) -> DataFrame:
    """``(pose_id, name)`` of a one-dimensional array."""
    found = read_arrays(spark, path, name, **limits)
    if found.schema[name].dataType.typeName() == "array":
        raise ValueError(f"{path}: expected one dimension")
    return found.withColumnRenamed("row", "pose_id")


# ---------------------------------------------------------------- writing


class ArrayWriter(StagedWriter, DataSourceArrowWriter):
    """Parts of an array: rows of one part follow each other in a task."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.dtype, self.width = np.dtype(options["dtype"]), int(options["width"])
        self.rows = int(options["rows"])

    def _save(self, part: int, first: int, values: list[np.ndarray]) -> tuple:
        flat = np.concatenate(values).astype(self.dtype)
        shape = (len(flat) // max(self.width, 1), self.width) if self.width else (len(flat),)
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(
            head, {"descr": np.lib.format.dtype_to_descr(self.dtype), "fortran_order": False, "shape": shape}
        )
        name = f"part-{first:015d}.npy"
        return (*self.put(name, [head.getvalue(), flat.tobytes()]), first, shape[0])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done, held, part, first, following = [], [], None, 0, 0
        for batch in iterator:
            rows = batch["row"].to_numpy()
            column = batch["value"]
            if column.null_count:
                raise ValueError("an array has no nulls")
            flat = column.flatten() if self.width else column
            if self.width and (column.value_lengths().to_numpy() != self.width).any():
                raise ValueError(f"rows differ in length; {self.width} is expected")
            flat = flat.to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            parts = rows // self.rows
            for cut in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(parts)) + 1):
                if not len(cut):
                    continue
                if parts[cut[0]] != part:
                    if held:
                        done.append(self._save(part, first, held))
                    held, part, first, following = [], parts[cut[0]], int(rows[cut[0]]), int(rows[cut[0]])
                if (rows[cut] != following + np.arange(len(cut))).any():
                    raise ValueError("rows of an array must be dense and without repeats")
                following += len(cut)
                held.append(flat[cut].ravel())
        if held:
            done.append(self._save(part, first, held))
        return self.message(done)

    def complete(self, files: list[tuple]) -> None:
        following = 0
        for *_, first, count in sorted(files, key=lambda f: f[2]):
            if first != following:
                raise ValueError(f"row {following} is missing or repeated")
            following += count


class ArrayFiles(DataSource):
    """Writes dense rows as ``.npy`` parts, see ``write_arrays``."""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return "row bigint, value double"

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options))


def write_arrays(
    df: DataFrame, path: str, value: str, *, row: str = "pose_id", dtype: str | None = None, width: int = 0,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Write the column ``value`` as ``.npy`` parts ``part-<first row>.npy`` in a folder.

    ``row`` has the dense ids 0..n-1, which give every part its place: a part holds the rows
    of one multiple of ``rows_per_file`` and is written by one task, which sees no more than
    that.  Rows are numbers, or arrays of ``width`` numbers.  Parts appear only when all are
    there and follow each other; a failed job leaves nothing.
    """
    spark = df.sparkSession
    spark.dataSource.register(ArrayFiles)
    found = df.select(F.col(row).cast("bigint").alias("row"), F.col(value).alias("value"))
    if dtype is None:
        kind = found.schema["value"].dataType
        dtype = {"float": "<f4", "double": "<f8", "int": "<i4", "bigint": "<i8", "boolean": "|b1"}[
            getattr(kind, "elementType", kind).simpleString()
        ]
    part = F.floor(F.col("row") / rows_per_file)
    ordered = found.repartition(part).sortWithinPartitions("row")
    options = {"folder": store.qualified(spark, path), "dtype": dtype, "width": str(width), "rows": str(rows_per_file)}
    ordered.write.format("array_files").mode("append").options(**options).save()
