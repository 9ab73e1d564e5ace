"""Helpers shared by the text operators: Arrow passes over rows and fixed text rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandloom.staging import row_bound, skew_join, task_count

WORDS = rb"[^\x20\x09-\x0D]+"  # what bytes.split() yields
ROWS = 1000
HOT = 100_000  # rows of a key below which a join leaves it to one task
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z only


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_kept: dict = {}
_touched: set = set()


def kept(key: tuple, build: Callable):
    """What ``build`` makes, kept in the Python worker for its next tasks.

    A worker keeps one thing at a time, and none once it runs tasks that do not ask for it.
    """
    _touched.add(key)
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def map_batches(
    df: DataFrame,
    schema: StructType | str,
    start: Callable[[], Callable[[pa.RecordBatch], dict | None]],
    finish: bool = False,
) -> DataFrame:
    """Run a function over the Arrow batches of every partition.

    ``start`` runs once per task and returns the function from a batch to a dict of
    column values (``None``: no rows); it gets at most ``ROWS`` rows at a time, which
    bounds the Python objects alive.  With ``finish`` it is called once more with
    ``None`` after the last batch.
    """
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _touched.clear()
        step = start()
        for key in _kept.keys() - _touched:
            del _kept[key]

        def made(columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                    for f in arrow
                    for c in (columns[f.name],)
                ],
                schema=arrow,
            )

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                if (columns := step(batch.slice(k, ROWS))) is not None:
                    yield made(columns)
        if finish and (columns := step(None)) is not None:
            yield made(columns)

    return df.mapInArrow(run, target)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores where the caller's columns have them already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def to_unique(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a side of unique keys; keys that many rows of the other side share are spread."""
    rows = row_bound(left)
    hot = max(HOT, rows // task_count(left.sparkSession))
    return skew_join(left, right, on, how, left_rows=rows, right_rows=0, hot_rows=hot)


def bounded(df: DataFrame, rows: int, key: str) -> DataFrame:
    """At most ``rows`` rows of ``df``, the same ones every time, spread over ``key``."""
    total = df.count()
    if total <= rows:
        return df
    scale = 1 << 30
    part = df.where(F.pmod(F.xxhash64(key), F.lit(scale)) < int(scale * rows / total))
    return part.orderBy(F.xxhash64(key), key).limit(rows)
