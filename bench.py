"""Time the headline queries: BENCH_SF_DIR, BENCH_CPUS; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

HEADLINE = [
    "pool_canonical_order_with_copies",
    "score_filter_with_provenance",
    "identity_map_one",
    "deduplicate_map",
    "lineage_lines_to_customers",
    "chain_counts",
    "chain_table",
    "energy_filter",
    "grow",
    "grow_restricted_to_pool",
    "anchor",
    "pose_rmsd_full_and_per_nucleotide",
    "structure_pairs_below_rmsd",
    "best_pose_per_fragment",
    "stacking_filter_check",
    "pair_energy_with_receptor",
    "best_conformer_per_fragment",
    "chain_rmsd",
    "chain_coordinates",
    "index_filter_keeps_copies",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from strandloom.catalog import all_queries
    from strandloom.staging import workspace

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the engine
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        with workspace(spark):
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
