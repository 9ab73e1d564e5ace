"""Digest of a table in the order of its dense ids, as a tree of hashes.

Rows are hashed, then runs of ``FAN`` neighbouring hashes, and so on to one.  Groups are
bounded, partitions do not matter, and a row that changes or moves changes the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.staging import row_bound

FAN = 1024


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of the values as text, each with its length; null differs from empty."""
    parts = []
    for name in columns:
        text = F.col(name).cast("string")
        parts += [F.coalesce(F.length(text).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def ordered_digest(table: DataFrame, columns: list[str], id_col: str = "pose_id") -> DataFrame:
    """One row: number of ``rows`` and the ``digest`` of all of them in order of ``id_col``.

    Ids should be dense from 0, so that groups hold at most ``FAN`` rows; ids that
    repeat are taken in the order of their hashes.  An empty table has the digest of nothing.
    """
    rows = max(row_bound(table), 1)
    level = table.select(F.col(id_col).alias("id"), row_digest([id_col, *columns]).alias("hash"), F.lit(1).cast("long").alias("n"))
    while True:
        inside = F.transform(F.sort_array(F.collect_list(F.struct("id", "hash"))), lambda x: x.hash)
        level = level.groupBy(F.floor(F.col("id") / FAN).alias("id")).agg(
            F.sha2(F.concat_ws("", inside), 256).alias("hash"), F.sum("n").alias("n")
        )
        if rows <= FAN:
            break
        rows = -(-rows // FAN)
    # One row is left; ids beyond the number of rows may leave a few more, which are joined alike.
    tops = F.transform(F.sort_array(F.collect_list(F.struct("id", "hash"))), lambda x: x.hash)
    one = F.when(F.size(tops) == 1, F.get(tops, F.lit(0))).otherwise(F.sha2(F.concat_ws("", tops), 256))
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), one.alias("digest"))
