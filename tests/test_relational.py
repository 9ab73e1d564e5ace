"""Brute force for pools, filters, identity, lineage and chains."""

import math
import random
from collections import Counter
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.constants import POSE
from strandloom.operators import cascade, chains, identity, lineage, pool, select
from strandloom.staging import dense_groups, dense_ids, skew_join, stage, workspace

POSES = "conformer int, rotamer int, gx int, gy int, gz int"


def make_pool(spark, rows):
    """Organized pool of (conformer, rotamer, (x, y, z)) rows, ties in given order."""
    data = [(n, c, r, *xyz) for n, (c, r, xyz) in enumerate(rows)]
    df = spark.createDataFrame(data, f"source_id int, {POSES}")
    return pool.organize(df, ["source_id"])


def poses(df):
    return [tuple(r) for r in df.orderBy("pose_id").select(*POSE).collect()]


def pairs(df, a, b):
    return sorted((r[a], r[b]) for r in df.collect())


def test_workspace_removes_what_was_staged(spark):
    with workspace(spark) as path:
        inside = stage(spark.range(5), "w")
        assert inside.count() == 5 and all(f"{path}/w-" in name for name in inside.inputFiles())
        folder = Path(inside.inputFiles()[0].removeprefix("file://")).parents[1]
        assert folder.exists()
    assert not folder.exists()
    assert stage(spark.range(3), "w").count() == 3


def test_bucket_split_floors_negative_coordinates(spark):
    df = spark.createDataFrame([(g,) for g in range(-40, 41)], "g int")
    bucket, offset = pool.split_grid(F.col("g"))
    rows = df.select("g", bucket.alias("b"), offset.alias("o"), pool.join_grid(bucket, offset).alias("back")).collect()
    for r in rows:
        assert r.b == math.floor((r.g + 8) / 16) and r.back == r.g and -8 <= r.o <= 7


def test_dense_ids_follow_the_order_with_many_copies(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1, 2, 9]), n) for n in range(500)]
    df = spark.createDataFrame(rows, "k int, n int").repartition(7)
    got = dense_ids(df, ["k", "n"], "id", "t").orderBy("id").collect()
    assert [r.id for r in got] == list(range(500))
    assert [(r.k, r.n) for r in got] == sorted(rows)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_outer"])
def test_skew_join_splits_hot_keys_without_losing_rows(spark, how):
    rng = random.Random(3)
    left = [(0 if rng.random() < 0.5 else rng.randrange(20), n) for n in range(300)]
    right = [(0 if rng.random() < 0.4 else rng.randrange(25), n) for n in range(120)]
    a = spark.createDataFrame(left, "k int, l int")
    if how == "left_outer":  # its right side has unique keys
        right = [(k, 10 * k) for k in range(15)]
    b = spark.createDataFrame(right, "k int, r int")
    known = {"right_rows": 0} if how == "left_outer" else {}
    joined = skew_join(a, b, ["k"], how, hot_rows=20, **known)
    if how == "left_outer":
        got = Counter((r.k, r.l, r.r) for r in joined.collect())
        assert got == Counter((k, l, dict(right).get(k)) for k, l in left)
        with pytest.raises(ValueError, match="hot keys"):
            skew_join(a, b, ["k"], how, hot_rows=5)
        return
    if how == "inner":
        want = Counter((k, l, r) for (k, l), (q, r) in product(left, right) if k == q)
        got = Counter((r.k, r.l, r.r) for r in joined.collect())
    else:
        keys = {k for k, _ in right}
        want = Counter((k, l) for k, l in left if k in keys)
        got = Counter((r.k, r.l) for r in joined.collect())
    assert got == want


def some_rows(seed, n, conformers=6):
    """Poses with copies, from a small range on both sides of a bucket edge."""
    rng = random.Random(seed)
    return [(rng.randrange(conformers), rng.randrange(2), (rng.randrange(6, 10), -rng.randrange(7, 10), 0)) for _ in range(n)]


def test_common_conformer_masks(spark):
    one, two = make_pool(spark, some_rows(1, 20, 9)), make_pool(spark, some_rows(2, 15, 7))
    shared = {p[0] for p in poses(one)} & {p[0] for p in poses(two)}
    for source, selector in zip((one, two), select.common_conformer_masks(one, two)):
        assert ids(selector) == [n for n, p in enumerate(poses(source)) if p[0] in shared]
        kept = select.apply_mask(source, selector, pool.fingerprint(source))
        assert poses(kept) == [p for p in poses(source) if p[0] in shared]
    with pytest.raises(ValueError, match="another pool"):
        select.apply_mask(one, selector, pool.fingerprint(two))


def test_identity_of_two_pools(spark):
    one, two = make_pool(spark, some_rows(3, 40)), make_pool(spark, some_rows(4, 30))
    given = poses(one), poses(two)
    both = set(given[0]) & set(given[1])
    out, *maps = identity.intersect_pools(one, two)
    kept = poses(out)
    assert set(kept) == both and len(kept) == len(both) > 3
    for source, mapping in zip(given, maps):
        want = sorted((n, kept.index(p)) for n, p in enumerate(source) if p in both)
        assert pairs(mapping, "parent_id", "pose_id") == want
    totals = {r.measure: r.poses for r in identity.manifest(one, two, out).collect()}
    assert (totals["identity_poses"], totals["input_poses_one"], totals["input_poses_two"]) == (len(both), 40, 30)


def test_deduplicate_maps_every_input_row(spark):
    source = make_pool(spark, some_rows(5, 60, 3))
    out, mapping = identity.deduplicate(source)
    given, kept = poses(source), poses(out)
    assert sorted(set(given)) == sorted(kept) and len(kept) < 60
    assert pairs(mapping, "parent_id", "pose_id") == [(n, kept.index(p)) for n, p in enumerate(given)]


def test_filters_are_strict_and_keep_lineage(spark):
    source = make_pool(spark, [(0, 0, (n, 0, 0)) for n in range(5)])
    scores = spark.createDataFrame(
        list(enumerate([-1.01, -1.0, -0.99, float("nan"), -7.0])), "pose_id bigint, score double"
    )
    kept = select.filter_by_score(source, scores, -1.0)
    assert pairs(kept, "pose_id", "parent_id") == [(0, 0), (1, 4)]
    with pytest.raises(ValueError, match="values for"):
        select.filter_by_score(source, scores.where("pose_id < 3"), -1.0)
    index = spark.createDataFrame([(3,), (1,), (3,)], "pose_id bigint")
    assert pairs(select.filter_by_index(source, index), "pose_id", "parent_id") == [(0, 1), (1, 3), (2, 3)]
    assert pairs(select.filter_by_mask(source, index), "pose_id", "parent_id") == [(0, 1), (1, 3)]
    other = scores.withColumn("pose_id", F.col("pose_id") + 1)
    with pytest.raises(Exception, match="no score"):
        select.filter_by_score(source, other, -1.0).collect()
    with pytest.raises(Exception, match="not in the pool"):
        select.filter_by_index(source, other.select("pose_id")).collect()


def test_copies_of_a_hot_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(select, "COPY_BLOCK", 10)
    source = make_pool(spark, [(0, 0, (n, 0, 0)) for n in range(5)])
    listed = [3] * 400 + [0, 4, 4]
    index = spark.createDataFrame([(n,) for n in listed], "pose_id bigint")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = select.filter_by_index(source, index)
        assert sorted(r.parent_id for r in got.collect()) == sorted(listed)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_select_by_rmsd_is_stable(spark):
    rmsds = spark.createDataFrame(list(enumerate([0.5, 0.2, 0.5, 0.9, 0.2])), "pose_id bigint, rmsd double")
    assert pairs(select.select_by_rmsd(rmsds, 0.9), "request_pos", "pose_id") == [(0, 1), (1, 4), (2, 0), (3, 2)]
    kept = select.select_by_rmsd(rmsds, 0.9, preserve_order=True)
    assert pairs(kept, "request_pos", "pose_id") == [(0, 0), (1, 1), (2, 2), (3, 4)]


def test_selection_errors_and_base(spark):
    source = make_pool(spark, [(0, 0, (n, 0, 0)) for n in range(4)])
    asked = spark.createDataFrame([(0, 4), (1, 1), (2, 4)], "request_pos int, pose_id bigint")
    got = pool.select_poses(source, asked, base=1)
    assert pairs(got, "request_pos", "gx") == [(0, 3), (1, 0), (2, 3)]
    with pytest.raises(Exception, match="out of range"):
        pool.select_poses(source, asked).collect()
    with pytest.raises(Exception, match="out of range"):
        df = spark.createDataFrame([(0, 70000, 0, 0, 0)], POSES)
        df.select(*pool.pose_columns(*[F.col(c) for c in POSE])).collect()


def test_fingerprint_and_score_chunks(spark):
    a = make_pool(spark, [(0, 0, (n, 0, 0)) for n in range(6)])
    b = make_pool(spark, [(0, 0, (n, 0, 0)) for n in range(1, 7)])
    assert pool.same_pool(a, a.repartition(3)) and not pool.same_pool(a, b)
    scores = a.select("pose_id", F.col("gx").cast("double").alias("score"))
    halves = [scores.where("pose_id < 3"), scores.where("pose_id >= 3")]
    assert pool.score_concat(halves, 6).count() == 6
    with pytest.raises(ValueError, match="cover"):
        pool.score_concat([halves[0], halves[0]], 6)
    assert [pool.chunk_range(10, p, 3) for p in (1, 2, 3)] == [(1, 3), (4, 6), (7, 10)]
    with pytest.raises(Exception, match="differ in length"):
        pool.score_add(scores, halves[0]).collect()


def test_library_ranges(spark):
    conformers = spark.createDataFrame([(0,), (1,), (3,)], "conformer int")
    chosen = select.conformer_range(conformers, first_last=(2, 4), size=4)
    assert {r.conformer for r in chosen.collect()} == {1, 3}
    with pytest.raises(ValueError, match="not in"):
        select.conformer_range(conformers, conformer=5, size=4)
    with pytest.raises(ValueError, match="no conformer"):
        select.conformer_range(conformers, conformer=3, size=4)
    rotamers = spark.createDataFrame([(0, r) for r in range(4)] + [(1, r) for r in range(3)], "conformer int, rotamer int")
    assert select.rotamer_range(rotamers, 2, 3).count() == 4
    with pytest.raises(ValueError, match="shortest"):
        select.rotamer_range(rotamers, 1, 4)
    drawn = [r.conformer for r in select.sample_library(conformers, "conformer", 2, 7).collect()]
    assert len(drawn) == 2 and set(drawn) <= {0, 1, 3}
    assert select.mask_encoding(1000, 3) == "index" and select.mask_encoding(1000, 900) == "boolean"


# ---------------------------------------------------------------- cascade


def energies(spark, exact, *grids):
    rows = list(zip(range(len(exact)), exact, *grids))
    names = ", ".join(f"g{n} double" for n in range(len(grids)))
    return spark.createDataFrame(rows, "pose_id bigint, energy double" + (", " + names if grids else ""))


def ids(df):
    return sorted(r.pose_id for r in df.collect())


def test_cascade_against_brute_force(spark):
    rng = random.Random(9)
    exact = [rng.uniform(-3, 3) for _ in range(200)] + [-0.5]
    coarse = [e + rng.uniform(-0.9, 0.9) for e in exact]
    fine = [e + rng.uniform(-0.2, 0.2) for e in exact]
    coarse[7] = coarse[8] = 2.0**55  # too coarse for the error bound, whatever the side
    df = energies(spark, exact, coarse, fine)
    for least in (0, 60, 500):
        seen = []

        def grid(name):
            def add(rows):
                seen.append(rows.count())
                return rows.withColumn("_grid", F.col(name))
            return add

        steps = [cascade.Step(grid("g0"), 1.0), cascade.Step(grid("g1"), 0.25)]
        kept, table = cascade.cascade_filter(df, -0.5, steps, least, grid("energy"))
        assert ids(kept) == [n for n, e in enumerate(exact) if e < -0.5]
        open_ = set(range(201))
        want, unsafe = [], set()
        for number, (values, error) in enumerate(((coarse, 1.0), (fine, 0.25))):
            if len(open_) < max(least, 1):
                break
            odd = {n for n in open_ if np.spacing(abs(values[n])) >= error / 2}
            stay = {n for n in open_ - odd if -0.5 - error <= values[n] < -0.5 + error}
            want.append((number, len(open_), len(odd), len(open_) - len(odd) - len(stay)))
            unsafe |= odd
            open_ = stay
        want.append((None, len(open_ | unsafe), 0, len(open_ | unsafe)))
        assert [tuple(r) for r in table.collect()] == want
        assert seen == [r[1] for r in want]


def test_spacing_matches_numpy(spark):
    rng = np.random.default_rng(0)
    values = [0.0, 1.0, -1.0, 2.0**53, 5e-324, 1e-310, *(rng.normal(size=50) * 10.0 ** rng.integers(-20, 20, 50)).tolist()]
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    for r in df.select("x", cascade.spacing(F.col("x")).alias("s")).collect():
        assert r.s == np.spacing(abs(r.x))


def test_ranges_are_combined_with_and(spark):
    a = spark.createDataFrame([(0, -100.0), (1, -2.0), (2, -3.0)], "pose_id bigint, score double")
    b = spark.createDataFrame([(0, 2.0), (1, -2.0), (2, 0.0)], "pose_id bigint, score double")
    assert ids(select.all_ranges_below([a, b], 0.0)) == [1]


# ---------------------------------------------------------------- chains


def rel(spark, rows):
    return spark.createDataFrame(rows, "pose_id bigint, parent_id bigint")


def test_chains_against_brute_force(spark):
    rng = random.Random(11)
    sizes = [12, 15, 14, 10]
    given, pools = [], []
    for size in sizes:
        rows = [(rng.randrange(3), 0, (rng.randrange(3), 0, 0)) for _ in range(size)]
        pools.append(make_pool(spark, rows))
        given.append(poses(pools[-1]))
    edge_lists = [
        [(rng.randrange(sizes[j] - 3), rng.randrange(sizes[j + 1])) for _ in range(16)] for j in range(3)
    ]
    edges = [spark.createDataFrame(e, "low bigint, high bigint") for e in edge_lists]
    layers = chains.connect(list("wxyz"), pools, edges)

    alive = [set(range(s)) for s in sizes]
    for j, e in enumerate(edge_lists):
        alive[j + 1] &= {h for low, h in e if low in alive[j]}
    for j in (2, 1, 0):
        alive[j] &= {low for low, h in edge_lists[j] if h in alive[j + 1]}
    nodes = [{i: given[j][i] for i in alive[j]} for j in range(4)]
    links = [
        {(nodes[j][a], nodes[j + 1][b]) for a, b in e if a in nodes[j] and b in nodes[j + 1]}
        for j, e in enumerate(edge_lists)
    ]
    paths = [(a, b) for a, b in links[0]]
    for step in links[1:]:
        paths = [(*p, b) for p in paths for a, b in step if a == p[-1]]
    assert chains.count_paths(layers) == len(paths)
    assert chains.count_paths(layers, 2) == min(len(paths), 3)
    with pytest.raises(chains.TooManyChains):
        chains.enumerate_chains(layers, 2)
    assert {int(r.chains) for r in chains.chain_counts(layers).collect()} == {len(paths)}
    rank = [{p: n + 1 for n, p in enumerate(sorted(set(layer.values())))} for layer in nodes]
    want = sorted(tuple(rank[j][p] for j, p in enumerate(path)) for path in paths)
    table = chains.number_chains(chains.enumerate_chains(layers), layers.names).orderBy("chain").collect()
    assert [(r.w, r.x, r.y, r.z) for r in table] == want
    focused, provenance = chains.focus(
        chains.number_chains(chains.enumerate_chains(layers), layers.names), ["y", "w"]
    )
    first_seen = list(dict.fromkeys((w, y) for w, _, y, _ in want))
    assert [(r.w, r.y) for r in focused.orderBy("focused").collect()] == first_seen
    assert [r.focused for r in provenance.orderBy("chain").collect()] == [
        first_seen.index((w, y)) + 1 for w, _, y, _ in want
    ]


def test_lineage_requires_parents(spark):
    child, parent = rel(spark, [(0, 5), (1, 6)]), rel(spark, [(5, 50)])
    assert pairs(lineage.compose(child, parent), "pose_id", "parent_id") == [(0, 50)]
    for strict in (lineage.compose_route([child, parent], strict=True), lineage.link_edges([child, parent], [parent])):
        with pytest.raises(Exception, match="missing parent"):
            strict.collect()
    kept = lineage.prune(child, spark.createDataFrame([(6,)], "pose_id bigint"))
    assert pairs(kept, "pose_id", "parent_id") == [(1, 6)]


def test_pools_with_fewer_columns_keep_their_order(spark):
    rng = random.Random(3)
    grid = [pool.MIN_GRID, -9, -8, -1, 0, 7, 8, 500, pool.MAX_GRID]
    rows = [(rng.randrange(3), rng.randrange(2), *[rng.choice(grid) for _ in range(3)], n) for n in range(600)]
    poses = spark.createDataFrame(rows, "conformer int, rotamer int, gx int, gy int, gz int, source_id bigint")
    whole = {(r.pose_id, r.source_id) for r in pool.organize(poses, ["source_id"]).collect()}
    few = pool.organize(poses, ["source_id"], columns=["gx", "source_id"])
    assert few.columns == ["gx", "source_id", "pose_id"]
    assert {(r.pose_id, r.source_id) for r in few.collect()} == whole


def test_groups_are_numbered_across_partitions_with_nulls_and_copies(spark):
    rng = random.Random(4)
    keys = [(rng.choice([None, 0, 1, 2, 2, 2, 2, 5]), rng.choice([None, 0, 7])) for _ in range(3000)]
    rows = [(a, b, rng.randrange(3), n) for n, (a, b) in enumerate(keys)]
    df = spark.createDataFrame(rows, "a int, b bigint, o int, n bigint").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got, count = dense_groups(df, ["a", "b"], ["o"], ["n"], "g", "groups")
        got = got.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    order = lambda x: tuple((v is not None, v or 0) for v in x)
    rank = {k: g for g, k in enumerate(sorted(set(keys), key=order))}
    assert count == len(rank) and {(r.a, r.b, r.o, r.n, r.g) for r in got} == {(*r, rank[r[:2]]) for r in rows}
    least = {}
    for a, b, o, n in rows:
        least.setdefault((a, b, o), n)
    firsts = {k[:2]: min(x for x in least if x[:2] == k[:2]) for k in least}
    for r in got:
        begins = least[r.a, r.b, r.o] == r.n
        assert r._new == (0 if not begins else 2 if firsts[r.a, r.b] == (r.a, r.b, r.o) else 1)
    empty, count = dense_groups(df.limit(0), ["a", "b"], ["o"], ["n"], "g", "groups")
    assert count == 0 and empty.count() == 0


def test_a_layer_of_copies_is_numbered_without_looking_up_each_row(spark, monkeypatch):
    """Rows of a layer meet their node in the sort that numbers it, not in a later join."""
    run = []
    whole = chains.stage
    monkeypatch.setattr(chains, "stage", lambda df, label: run.append(label) or whole(df, label))
    poses = spark.createDataFrame(
        [(n, n % 3, 0, 0, 0, 0) for n in range(30)], "pose_id bigint, conformer int, rotamer int, gx int, gy int, gz int"
    )
    edges = [spark.createDataFrame([(n, (n * s) % 30) for n in range(30)], "low bigint, high bigint") for s in (1, 7)]
    layers = chains.connect(["a", "b", "c"], [poses] * 3, edges)
    assert not [label for label in run if label.startswith(("members", "links", "edges-"))]
    assert layers.counts == [3, 3, 3]
    for nodes in layers.nodes:
        assert sorted((r.node, r.first, r.conformer) for r in nodes.collect()) == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]
    want = [{(n % 3, n * s % 30 % 3) for n in range(30)} for s in (1, 7)]
    assert [sorted(map(tuple, e.collect())) for e in layers.edges] == [sorted(w) for w in want]
    one = chains.connect(["a", "b"], [poses] * 2, edges[1:])
    assert one.counts == [3, 3] and sorted(map(tuple, one.edges[0].collect())) == sorted(want[1])
