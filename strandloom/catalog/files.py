"""Queries through files: pools and arrays written in their binary forms and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.catalog import tables as t
from strandloom.catalog.geometry import DOCK, dock_pool
from strandloom.catalog.relational import POSES
from strandloom.constants import BUCKET, POSE
from strandloom.operators.digest import ordered_digest
from strandloom.sources import arrays, poses
from strandloom.staging import folder

QUERIES, SQL = {}, {}
MARK = b"strand01"
POSES_PER_FILE, ROWS_PER_FILE = 2_000, 4_000


def query(name, sql):
    def register(function):
        QUERIES[name], SQL[name] = function, sql
        return function

    return register


def _written_poses(spark, sf_dir):
    path = folder(spark, "pose-files")
    return path, poses.write_poses(dock_pool(spark, sf_dir), path, MARK, rows_per_file=POSES_PER_FILE)


def _bucket(file):
    """Bucket and part that a file name states."""
    name = F.regexp_extract_all(F.regexp_extract(file, "[^/]*$", 0), F.lit("[+-]?[0-9]+"), F.lit(0))
    return [F.get(name, F.lit(k)).cast("int").alias(c) for k, c in enumerate((*BUCKET, "part"))]


_PLACED = (
    f"WITH {DOCK}, placed AS (SELECT *, pose_id - min(pose_id) OVER (PARTITION BY mx, my, mz) AS place FROM dock)"
)


@query(
    "pose_files_read_back",
    f"{_PLACED} SELECT mx, my, mz, CAST(place // {POSES_PER_FILE} AS INTEGER) AS part, "
    f"CAST(place % {POSES_PER_FILE} AS BIGINT) AS row, {POSES} FROM placed",
)
def pose_files_read_back(spark, sf_dir):
    path, _ = _written_poses(spark, sf_dir)
    # Small shares, so that files are read by several tasks.
    back = poses.read_poses(spark, path, MARK, task_bytes=8_000)
    return back.select(*_bucket(F.col("file")), "row", *POSE)


@query(
    "pose_file_counts",
    f"{_PLACED} SELECT mx, my, mz, CAST(place // {POSES_PER_FILE} AS INTEGER) AS part, count(*) AS poses FROM placed GROUP BY ALL",
)
def pose_file_counts(spark, sf_dir):
    return _written_poses(spark, sf_dir)[1].select(*_bucket(F.col("file")), "poses")


@query("score_arrays_read_back", f"WITH {t.ORDERS} SELECT pose_id, score FROM order_pool")
def score_arrays_read_back(spark, sf_dir):
    path = folder(spark, "scores")
    arrays.write_arrays(t.orders(spark, sf_dir), path, "score", rows_per_file=ROWS_PER_FILE)
    return arrays.read_npy(spark, path, "score", task_bytes=10_000)


@query(
    "coordinate_arrays_read_back",
    "SELECT vec_id AS row, embedding AS xyz FROM embeddings",
)
def coordinate_arrays_read_back(spark, sf_dir):
    path = folder(spark, "coordinates")
    vectors = t.read(spark, sf_dir, "embeddings")
    arrays.write_arrays(vectors, path, "embedding", row="vec_id", width=64, rows_per_file=500)
    return arrays.read_arrays(spark, path, "xyz", task_bytes=50_000)


# Two levels of the tree, as there are more than 1,024 orders and less than its square.
_ROW_HASH = "sha256(" + " || ".join(
    f"length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR" for c in ("pose_id", *POSE)
) + ")"


@query(
    "pool_digest",
    f"WITH {t.ORDERS}, level0 AS (SELECT pose_id AS id, {_ROW_HASH} AS h FROM order_pool), "
    "level1 AS (SELECT id // 1024 AS id, sha256(string_agg(h, '' ORDER BY id)) AS h FROM level0 GROUP BY id // 1024) "
    "SELECT (SELECT count(*) FROM orders) AS rows, sha256(string_agg(h, '' ORDER BY id)) AS digest FROM level1",
)
def pool_digest(spark, sf_dir):
    return ordered_digest(t.orders(spark, sf_dir), POSE)
