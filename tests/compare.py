"""Run catalog queries and their SQL side by side: python tests/compare.py DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def database(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def difference(df, con, sql):
    """Empty string when both sides have the same columns and the same bag of rows."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    theirs = Counter(
        tuple(plain(row[names.index(c)]) for c in order) for row in cursor.fetchall()
    )
    ours = Counter(tuple(plain(row[c]) for c in order) for row in df.collect())
    if ours == theirs:
        return ""
    only, missing = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"rows {sum(ours.values())} vs {sum(theirs.values())}; only ours {only}; only SQL {missing}"


def types(df, con, sql):
    """Column types of both sides, where they differ."""
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT",
             "array<double>": "DOUBLE[]", "array<float>": "FLOAT[]", "array<bigint>": "BIGINT[]", "array<int>": "INTEGER[]"}
    theirs = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {
        f.name: (f.dataType.simpleString(), theirs.get(f.name))
        for f in df.schema
        if names.get(f.dataType.simpleString()) != theirs.get(f.name)
    }


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    from strandloom.catalog import all_queries, all_sql

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(argv[0])
    sql = all_sql()
    failed = 0
    for name, function in all_queries().items():
        if argv[1:] and not any(a in name for a in argv[1:]):
            continue
        start = time.time()
        try:
            df = function(spark, argv[0])
            if name in sql:
                problem = difference(df, con, sql[name])
                odd = types(df, con, sql[name])
                if odd:
                    problem += f" types {odd}"
                label = f"MISMATCH {problem}" if problem else "ok"
                failed += bool(problem)
            else:
                label = f"rows {df.count()} (no SQL)"
        except Exception as error:  # noqa: BLE001
            label, failed = f"ERROR {str(error)[:600]}", failed + 1
        print(f"{name:40s} {time.time() - start:6.2f}s {label}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
