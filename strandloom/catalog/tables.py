"""Pools, lineage and scores derived from the given tables.

Three fragments are linked by the tables' own keys: customers (fragment 1) are the
parents of orders (fragment 2), which are the parents of lineitems (fragment 3).
``frame`` is the fragment whose coordinate frame a pool is placed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.pool import organize, pose_columns

LINE_TIE = ["source_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def place(conformer, rotamer, key, frame: int):
    """Pose columns of a key: two 30,000-wide grid axes and the frame number."""
    return pose_columns(
        F.expr(conformer),
        F.expr(rotamer),
        F.expr(f"{key} % 30000 - 700"),
        F.expr(f"({key} div 30000) % 30000 - 700"),
        F.lit(frame),
    )


def customer_poses(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(
        *place("c_nationkey", "c_nationkey % 3", "c_custkey div 2", 1),
        F.col("c_custkey").alias("source_id"),
    )


def order_poses(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        *place("o_orderkey % 4", "o_orderkey % 3", "o_custkey", 2),
        F.col("o_orderkey").alias("source_id"),
        F.col("o_custkey").alias("parent_key"),
        F.expr("(o_totalprice - 250000.0D) / 1000.0D").alias("score"),
    )


def line_poses(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        *place("l_suppkey % 4", "l_partkey % 2", "l_orderkey", 3),
        F.col("l_orderkey").alias("source_id"),
        *LINE_TIE[1:],
    )


def order_poses_in_line_frame(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        *place("o_custkey % 4", "o_orderkey % 2", "o_orderkey", 3),
        F.col("o_orderkey").alias("source_id"),
    )


def _organized(poses, tie, label, columns):
    """The pool, or only ``columns`` of it in the same order.

    Two tie columns are enough then: rows alike in them and in ``columns`` cannot be told apart.
    """
    if columns is not None:
        tie = tie[:2]
        poses = poses.select(*dict.fromkeys([*columns, *tie]))
    return organize(poses, tie, label=label, columns=columns)


def customers(spark, sf_dir, columns=None):
    return _organized(customer_poses(spark, sf_dir), ["source_id"], "customers", columns)


def orders(spark, sf_dir, columns=None):
    return _organized(order_poses(spark, sf_dir), ["source_id"], "orders", columns)


def lines(spark, sf_dir, columns=None):
    return _organized(line_poses(spark, sf_dir), LINE_TIE, "lines", columns)


def orders_in_line_frame(spark, sf_dir):
    return organize(order_poses_in_line_frame(spark, sf_dir), ["source_id"], label="order-lines")


# The same pools in SQL, written from the definition of the canonical order.

def _pose_sql(conformer, rotamer, key, frame, extra, table):
    return (
        f"SELECT CAST({conformer} AS INTEGER) AS conformer, CAST({rotamer} AS INTEGER) AS rotamer, "
        f"CAST({key} % 30000 - 700 AS INTEGER) AS gx, "
        f"CAST(({key} // 30000) % 30000 - 700 AS INTEGER) AS gy, {frame} AS gz, {extra} FROM {table}"
    )


def pool_sql(name: str, poses: str, tie: str) -> str:
    axes = ", ".join(
        f"CAST(floor((g{a} + 8) / 16.0) AS INTEGER) AS m{a}, "
        f"CAST(g{a} - 16 * floor((g{a} + 8) / 16.0) AS INTEGER) AS o{a}"
        for a in "xyz"
    )
    return (
        f"{name} AS (SELECT CAST(row_number() OVER (ORDER BY mx, my, mz, ox, oy, oz, conformer, "
        f"rotamer, {tie}) - 1 AS BIGINT) AS pose_id, * FROM (SELECT *, {axes} FROM ({poses})))"
    )


CUSTOMERS = pool_sql(
    "customers",
    _pose_sql("c_nationkey", "c_nationkey % 3", "(c_custkey // 2)", 1, "c_custkey AS source_id", "customer"),
    "source_id",
)
ORDERS = pool_sql(
    "order_pool",
    _pose_sql(
        "o_orderkey % 4", "o_orderkey % 3", "o_custkey", 2,
        "o_orderkey AS source_id, o_custkey AS parent_key, "
        "(o_totalprice - 250000.0::DOUBLE) / 1000.0::DOUBLE AS score",
        "orders",
    ),
    "source_id",
)
LINES = pool_sql(
    "lines",
    _pose_sql(
        "l_suppkey % 4", "l_partkey % 2", "l_orderkey", 3,
        "l_orderkey AS source_id, " + ", ".join(LINE_TIE[1:]), "lineitem",
    ),
    ", ".join(LINE_TIE),
)
ORDER_LINES = pool_sql(
    "order_lines",
    _pose_sql("o_custkey % 4", "o_orderkey % 2", "o_orderkey", 3, "o_orderkey AS source_id", "orders"),
    "source_id",
)
