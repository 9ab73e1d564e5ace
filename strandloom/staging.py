"""Shared-folder staging, dense ids and joins that survive hot keys.

Intermediate tables are written to the shared folder that the cluster names in
``spark.checkpoint.dir``.  A written table cuts lineage, survives the loss of
executors and has exact row counts in its footers.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# A key with fewer rows than this is handled by one task without trouble.
HOT_ROWS = 2_000_000
# No more keys than this are ever treated as hot, so their table can be broadcast.
MAX_HOT_KEYS = 20_000
# Fewer input rows per task than this may all land in one task.
SPREAD_ROWS = 500_000
# Rows are counted by this many hashes of their key before any key is counted.
KEY_HASHES = 1 << 16

_ROW_BITS = 33  # low bits of monotonically_increasing_id hold the row in its partition


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; only a local session may lack one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="strandloom-"))
    return context.getCheckpointDir()


_run: ContextVar[str | None] = ContextVar("run", default=None)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Keep the tables written inside in one folder, and remove it at the end.

    Results that read those tables have to be written or collected before that.
    """
    path = f"{shared_dir(spark)}/strandloom/run-{uuid.uuid4().hex}"
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        remove(spark, path)


def folder(spark: SparkSession, label: str) -> str:
    """Path of a new folder in the shared one, or in the workspace that is open."""
    return f"{_run.get() or f'{shared_dir(spark)}/strandloom'}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    The rows are counted while they are written; see ``row_bound``.  Outside a
    ``workspace`` the table stays until the shared folder is cleaned.
    """
    spark = df.sparkSession
    path = folder(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return with_bound(spark.read.schema(df.schema).parquet(path), seen.get["rows"])


def with_bound(df: DataFrame, rows: int | None) -> DataFrame:
    """Note that ``df`` has at most ``rows`` rows."""
    if rows is not None:
        df._row_bound = rows
    return df


def row_bound(df: DataFrame) -> int:
    """Known upper bound on the rows of ``df``; counts them if none was noted."""
    known = getattr(df, "_row_bound", None)
    return df.count() if known is None else known


def dense_ids(
    df: DataFrame, order: list[str], id_col: str, label: str, columns: list[str] | None = None
) -> DataFrame:
    """Number rows 0..n-1 in the total order ``order``.

    Rows are range-partitioned and sorted once, and written with their partition
    and their place in it.  Partition starts are a running sum over one row per
    partition, so no task ever sees more than its own range.  Only ``columns`` are
    written, if given.
    """
    ranged = (
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn(
            "_row",
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        )
    )
    if columns is not None:
        ranged = ranged.select(*columns, "_part", "_row")
    staged = stage(ranged, label)
    # One row per partition: the unpartitioned window is bounded by their number.
    starts = (
        staged.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_n").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_start"),
        )
    )
    numbered = (
        staged.join(F.broadcast(starts), "_part")
        .withColumn(id_col, F.col("_start") + F.col("_row"))
        .drop("_part", "_row", "_start")
    )
    return with_bound(numbered, row_bound(staged))


def _changed(batch: pa.RecordBatch, names: list[str], last: dict) -> np.ndarray:
    """Rows that differ from the row before in one of the whole-number columns ``names``."""
    out = np.zeros(batch.num_rows, bool)
    for name in names:
        column = batch.column(name)
        empty = column.is_null().to_numpy(zero_copy_only=False)
        value = column.fill_null(0).to_numpy(zero_copy_only=False)
        out[1:] |= (value[1:] != value[:-1]) | (empty[1:] != empty[:-1])
        out[0] |= last.get(name) != (value[0], empty[0])
        last[name] = value[-1], empty[-1]
    return out


def _mark_groups(keys: list[str], within: list[str]) -> Callable:
    """Adds the number of each sorted row's group in its partition, and where groups begin."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, groups, held = {}, 0, None

        def made(batch, new, row, ends):
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(row), pa.array(new), pa.array(ends)],
                names=[*batch.schema.names, "_row", "_new", "_end"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.zeros(batch.num_rows, np.int8)
            ends[0] = 1 if held is None else 0
            group = _changed(batch, keys, last)
            new = np.where(group, 2, _changed(batch, within, last)).astype(np.int8)
            row = np.cumsum(group, dtype=np.int64) + (groups - 1)
            groups = int(row[-1]) + 1
            if held is not None:
                yield made(*held)
            held = batch, new, row, ends
        if held is not None:
            held[3][-1] |= 2
            yield made(*held)

    return mark


def dense_groups(
    df: DataFrame, keys: list[str], within: list[str], tie: list[str], id_col: str, label: str
) -> tuple[DataFrame, int]:
    """Number the distinct ``keys`` 0..n-1 in order, and give every row its number; also n.

    ``_new`` is 2 on the first row of a group, 1 on the first row of other ``within`` values
    of a group, and 0 on the rest; rows of a group go by ``within``, then by ``tie``.  All of
    these are whole numbers.  Rows are range-partitioned and sorted once, so a group that
    fills a large share of the rows is spread over tasks; the last row of a partition and
    the first one of the next tell where groups go on.
    """
    order = keys + within + tie
    marked = (
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .mapInArrow(
            _mark_groups(keys, within),
            ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
            + ", _row long, _new byte, _end byte",
        )
        .withColumn("_part", F.spark_partition_id())
    )
    staged = stage(marked, label)
    starts, total, before = [], 0, None
    # Two rows per partition at most.
    edges = staged.where("_end > 0").select("_part", "_row", "_end", *keys, *within)
    for r in sorted(edges.collect(), key=lambda r: (r["_part"], r["_end"] & 1 == 0)):
        key, value = tuple(r[c] for c in keys), tuple(r[c] for c in keys + within)
        if r["_end"] & 1:
            goes_on = before is not None and key == before[: len(keys)]
            start = total - goes_on
            starts.append((r["_part"], start, (0 if value == before else 1) if goes_on else 2))
        if r["_end"] & 2:
            total, before = start + r["_row"] + 1, value
    kinds = pa.schema([("_part", pa.int32()), ("_start", pa.int64()), ("_first", pa.int32())])
    columns = [pa.array([x[k] for x in starts], f.type) for k, f in enumerate(kinds)]
    starts = df.sparkSession.createDataFrame(pa.Table.from_arrays(columns, schema=kinds))
    first_row = F.col("_end").bitwiseAND(F.lit(1).cast("byte")) > 0
    numbered = (
        staged.join(F.broadcast(starts), "_part")
        .withColumn(id_col, F.col("_start") + F.col("_row"))
        .withColumn("_new", F.when(first_row, F.col("_first")).otherwise(F.col("_new").cast("int")))
        .select(*df.columns, id_col, "_new")
    )
    return with_bound(numbered, row_bound(staged)), total


def task_count(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Give a small input that is about to be multiplied to every task slot.

    Adaptive execution sizes tasks by their input, so a small input would stay in one
    task however much comes out of it.  Large inputs already have enough partitions.
    """
    tasks = task_count(df.sparkSession)
    return df.repartition(tasks, *keys) if rows < tasks * SPREAD_ROWS else df


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if it has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _hot_keys(df: DataFrame, on: list[str], rows: int, hot_rows: int, name: str) -> DataFrame | None:
    """Keys with very many rows and the blocks they are cut into; None if there are none.

    All rows of a key have one hash, so only keys of a hash with enough rows are counted.
    """
    cutoff = max(hot_rows, rows // MAX_HOT_KEYS)
    hashed = df.select(*on).withColumn("_h", F.pmod(F.xxhash64(*on), F.lit(KEY_HASHES)))
    # At most MAX_HOT_KEYS hashes by construction of the cutoff.
    full = hashed.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") >= cutoff).select("_h").collect()
    if not full:
        return None
    full = df.sparkSession.createDataFrame(full, "_h bigint")
    return (
        hashed.join(F.broadcast(full), "_h", "left_semi")
        .groupBy(*on)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= cutoff)
        .select(*on, F.ceil(F.col("_n") / F.lit(cutoff)).cast("int").alias(name))
    )


def has_hot_keys(df: DataFrame, on: list[str], rows: int, hot_rows: int | None = None) -> bool:
    """Whether a key may have too many rows for one task; ``rows`` is their bound."""
    return _hot_keys(df, on, rows, HOT_ROWS if hot_rows is None else hot_rows, "_n") is not None


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    left_rows: int | None = None,
    right_rows: int | None = None,
    hot_rows: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join whose hot keys are split over a grid of salts on both sides.

    ``left_rows`` and ``right_rows`` are upper bounds.  A side below ``hot_rows``
    cannot hold a hot key; when neither can, the join is left to the optimizer, and so
    it is when a count by key hash finds none.  Otherwise a key with ``a`` blocks on the
    left and ``b`` on the right becomes ``a*b`` groups, each left row meeting each
    right row in exactly one of them.  ``counted`` has the keys of the left rows, for a
    ``left`` that it would cost much to run for the count.
    """
    if how not in ("inner", "left_semi", "left_outer"):
        raise ValueError(f"skew_join supports inner, left_semi and left_outer, not {how}")
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    left_rows = row_bound(left) if left_rows is None else left_rows
    if how == "left_semi":
        right = right.select(*on).distinct()
        right_rows = 0  # distinct keys: never hot
    elif right_rows is None:
        right_rows = row_bound(right)
    if how == "left_outer" and right_rows >= hot_rows:
        # A block of a split right key may hold no partner of a left row.
        raise ValueError("left_outer needs a right side without hot keys; pass right_rows=0 for unique keys")
    if max(left_rows, right_rows) < hot_rows:
        joined = left.join(right, on, how)
        return with_bound(joined, left_rows) if how == "left_semi" else joined

    fans = None
    counted = left if counted is None else counted
    for df, rows, name in ((counted, left_rows, "_fl"), (right, right_rows, "_fr")):
        hot = _hot_keys(df, on, rows, hot_rows, name) if rows >= hot_rows else None
        if hot is not None:
            fans = hot if fans is None else fans.join(hot, on, "full_outer")
    if fans is None:
        joined = left.join(right, on, how)
        return with_bound(joined, left_rows) if how == "left_semi" else joined
    for name in ("_fl", "_fr"):
        if name not in fans.columns:
            fans = fans.withColumn(name, F.lit(1))
    # At most 2 * MAX_HOT_KEYS rows by construction of the cutoff.
    fans = F.broadcast(stage(fans.select(*on, "_fl", "_fr"), "hot-keys"))

    def salted(df, own, other, own_salt, other_salt):
        columns = list(df.columns)
        return (
            df.join(fans, on, "left_outer")
            .withColumn(
                own_salt,
                F.pmod(F.xxhash64(*columns), F.coalesce(F.col(own), F.lit(1))).cast("int"),
            )
            .withColumn(
                other_salt,
                F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)),
            )
            .drop("_fl", "_fr")
        )

    salted_left = salted(left, "_fl", "_fr", "_sl", "_sr")
    salted_right = salted(right, "_fr", "_fl", "_sr", "_sl")
    joined = salted_left.join(salted_right, on + ["_sl", "_sr"], how).drop("_sl", "_sr")
    return with_bound(joined, left_rows) if how == "left_semi" else joined


def present(column: Column, message: str) -> Column:
    """The column, or an error where a join found no partner."""
    return F.when(column.isNull(), F.raise_error(F.lit(message))).otherwise(column)


def together(*steps: Callable) -> list:
    """Results of independent steps, whose jobs share the cluster instead of waiting in line."""
    with ThreadPoolExecutor(max(1, len(steps))) as threads:
        running = [threads.submit(copy_context().run, step) for step in steps]
        return [r.result() for r in running]


def require_empty(df: DataFrame, message: str) -> None:
    """Raise with a sample row if ``df`` has any row."""
    bad = df.limit(1).collect()
    if bad:
        raise ValueError(f"{message}: {bad[0].asDict()}")
