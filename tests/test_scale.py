"""Steps that must not cost more where tables are large but have no hot keys."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from strandloom import staging
from strandloom.operators import chains, energy, grow, library, lineage, rmsd
from strandloom.sources import arrays


def plan(df):
    return df._jdf.queryExecution().toString()


def test_pair_energies_are_summed_without_sorting(spark):
    rng = np.random.default_rng(40)
    poses = [(n % 5, rng.normal(size=(3, 3)).tolist(), [0, 1, 0]) for n in range(10)] + [(2, None, None), (None, [[0.0] * 3], [1])]
    df = spark.createDataFrame(poses, "pose_id bigint, xyz array<array<double>>, types array<int>")
    rec = spark.createDataFrame([(*map(float, x), 0) for x in rng.normal(size=(20, 3))], "x double, y double, z double, type int")
    kernel = lambda square, a, b: (a + b + 1) / (square + 1.0)
    scored = energy.score_each(df, rec, kernel, 2.0)
    text = plan(scored)
    assert "HashAggregate(keys=[pose_id" in text and "partial_sum(CASE" in text.split("HashAggregate(keys=[pose_id", 1)[1]
    split = energy.score_each(df, rec, kernel, 2.0, max_cells=0).collect()
    rows = {r.pose_id: r for r in scored.collect()}
    assert len(rows) == 6 and rows[2].score is None and rows[2].error == "no atoms" and rows[None].score > 0
    for r in split:
        assert r.error == rows[r.pose_id].error
        assert r.score is None or math.isclose(r.score, rows[r.pose_id].score, rel_tol=1e-9)


@pytest.mark.parametrize("few", [500_000, 0])
def test_grid_steps_are_worked_out_once_a_rotation_pair(spark, monkeypatch, few):
    monkeypatch.setattr(grow, "FEW_POSES", few)
    rng = np.random.default_rng(41)
    conf = spark.createDataFrame([(n, rng.normal(size=(4, 3)).tolist()) for n in range(2)], "conformer int, coords array<array<double>>")
    vecs = [(c, r, *map(float, rng.normal(size=3) * 0.05)) for c in range(2) for r in range(4)]
    rot = library.rotamers_from_rotvec(spark.createDataFrame(vecs, "conformer int, rotamer int, rx double, ry double, rz double"))
    grid = lambda: [int(x) for x in rng.integers(-6, 7, 3)]
    poses = [(n, n % 2, n % 4, *grid()) for n in range(40)]
    pool = spark.createDataFrame(poses + poses[:3], "pose_id bigint, conformer int, rotamer int, gx int, gy int, gz int")
    pairs = spark.createDataFrame([(a, b, 0.0) for a in range(2) for b in range(2)], "source int, target int, crmsd double")
    args = (pool, conf, rot, conf, rot, pairs)
    grown = grow.grow(*args, crmsd=0.2, ovrmsd=0.8)
    assert "Generate explode" not in plan(grown)
    rows = [tuple(r) for r in grown.select(*grow.POSE, "parent_id").collect()]
    assert len(rows) > 500
    kept = {r[:5] for r in rows[::3]} | {(0, 0, 99, 0, 0)}
    wanted = spark.createDataFrame([*kept, *kept], "conformer int, rotamer int, gx int, gy int, gz int")
    only = grow.grow(*args, crmsd=0.2, ovrmsd=0.8, restrict=wanted).select(*grow.POSE, "parent_id").collect()
    assert Counter(tuple(r) for r in only) == Counter(r for r in rows if r[:5] in kept)


def test_large_join_without_hot_keys_is_a_plain_join(spark):
    a = spark.createDataFrame([(n % 40, n) for n in range(200)] + [(None, -1)] * 3, "k int, l int")
    b = spark.createDataFrame([(k, -k) for k in range(30)], "k int, r int")
    joined = staging.skew_join(a, b, ["k"], hot_rows=10)
    assert "_sl" not in plan(joined)
    assert Counter(tuple(r) for r in joined.collect()) == Counter((n % 40, n, -(n % 40)) for n in range(200) if n % 40 < 30)
    hot = staging.skew_join(a, b, ["k"], hot_rows=4)
    assert "_sl" in plan(hot) and hot.count() == joined.count()
    # The keys may be counted on another table than the one that is joined.
    nothing = a.withColumn("l", staging.F.raise_error(staging.F.lit("must not run")).cast("int"))
    assert "_sl" not in plan(staging.skew_join(nothing, b, ["k"], left_rows=203, right_rows=0, hot_rows=10, counted=a))


def test_large_parent_without_hot_keys_is_checked_by_the_join(spark, monkeypatch):
    monkeypatch.setattr(lineage, "HOT_ROWS", 5)
    monkeypatch.setattr(lineage, "require_parents", lambda *_: pytest.fail("a second pass"))
    child = spark.createDataFrame([(n, n % 10) for n in range(30)], "pose_id bigint, parent_id bigint")
    parent = spark.createDataFrame([(n, n // 2) for n in range(10)], "pose_id bigint, parent_id bigint")
    got = {tuple(r) for r in lineage.compose(child, parent, strict=True).collect()}
    assert got == {(n, n % 10 // 2) for n in range(30)}
    with pytest.raises(Exception, match="missing parent"):
        lineage.compose(child, parent.where("pose_id < 9"), strict=True).collect()


def test_nodes_of_poses_are_looked_up_once_a_layer(spark, monkeypatch):
    asked = []
    whole = chains.skew_join
    monkeypatch.setattr(chains, "skew_join", lambda *a, **k: asked.append(a[2]) or whole(*a, **k))
    pool = lambda copies: spark.createDataFrame(
        [(n, n // copies % 5, 0, n // copies, 0, 0) for n in range(20)],
        "pose_id bigint, conformer int, rotamer int, gx int, gy int, gz int",
    )
    edges = [spark.createDataFrame([(n, (n * s) % 20) for n in range(20)], "low bigint, high bigint") for s in (3, 7)]
    layers = chains.connect(["a", "b", "c"], [pool(1), pool(2), pool(4)], edges)
    assert sum(on == chains.POSE for on in asked) == 3
    links = {(n // 1, n * 3 % 20 // 2) for n in range(20)}
    nodes = [{r.gx: r.node for r in x.collect()} for x in layers.nodes]
    assert {tuple(r) for r in layers.edges[0].collect()} == {(nodes[0][a], nodes[1][b]) for a, b in links}


def test_sparse_structures_take_wide_cells_and_ids_may_repeat(spark):
    rng = np.random.default_rng(42)
    data = rng.normal(size=(300, 12)) * 40
    data = np.concatenate([data, data[:20] + rng.normal(size=(20, 12)) * 0.05])
    rows = [(n % 310, x.tolist()) for n, x in enumerate(data)]
    df = spark.createDataFrame(rows, "id bigint, coords array<double>")
    want = Counter(
        (min(a, b), max(a, b))
        for (a, x), (b, y) in itertools.combinations([(i, np.array(c)) for i, c in rows], 2)
        if a != b and math.sqrt(((x - y) ** 2).sum() / 4) < 0.5
    )
    assert Counter((r.i, r.j) for r in rmsd.pairs_below(df, 0.5).collect()) == want and sum(want.values()) >= 20
    close = spark.createDataFrame([(n, n, float(n % 3)) for n in range(200)], "_row bigint, id bigint, c0 double")
    far = close.withColumn("c0", staging.F.col("id") * 100.0)
    assert rmsd._widening(close, 1.0, 200) == 1 and rmsd._widening(far, 1.0, 200) == rmsd.WIDER[0]


def test_very_many_short_runs_share_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "SHORT_TASKS", 1)
    df = spark.range(2_000).selectExpr("id AS pose_id", "id / 7.0D AS score")
    arrays.write_arrays(df, str(tmp_path / "scores"), "score", rows_per_file=50)
    back = arrays.read_npy(spark, str(tmp_path / "scores"), "score", task_bytes=100)
    assert back.rdd.getNumPartitions() == staging.task_count(spark)
    assert {r.pose_id: r.score for r in back.collect()} == {n: n / 7.0 for n in range(2_000)}


@pytest.mark.parametrize("few", [500_000, 0])
def test_restricted_growing_looks_blocks_up_by_one_number(spark, monkeypatch, few):
    """One hash a grown pose finds its block, whatever else has that hash; poses out of the grid stay an error."""
    monkeypatch.setattr(grow, "FEW_POSES", few)
    fields = {"t_conf": 1, "t_rot": 2, "tgx": -5, "tgy": 9, "tgz": 0}
    rows = [{**fields, **change, "parent_id": n} for n, change in enumerate(
        [{}, {}, {"t_conf": 2}, {"t_rot": 3}, {"tgx": -6}, {"tgy": 8}, {"tgz": 64}, {"tgx": 40, "tgy": -40}]
    )]
    schema = "t_conf int, t_rot int, tgx bigint, tgy bigint, tgz bigint, parent_id int"
    grown = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    poses = [(1, 2, -5, 9, 0), (1, 2, 40, -40, 0), (2, 2, -5, 9, 1), (3, 2, -5, 9, 0)]
    blocks = staging.stage(grow._blocks(spark.createDataFrame(poses, "conformer int, rotamer int, gx int, gy int, gz int")), "blocks")
    pose = [staging.F.col(c) for c in fields]
    look = lambda df: grow._looked_up(df, pose, blocks)
    assert sorted(r.parent_id for r in look(grown).collect()) == [0, 1, 7]
    if few:
        text = plan(look(grown)).split("== Physical Plan ==")[1]
        assert "BroadcastHashJoin [_key" in text and "isnotnull(CASE" not in text
    with pytest.raises(Exception, match="gy out of range: 32768"):
        look(grown.withColumn("tgy", staging.F.lit(32768).cast("bigint"))).collect()
    # Blocks that share a hash are told apart.
    monkeypatch.setattr(grow.F, "xxhash64", lambda *_: grow.F.lit(7).cast("bigint"))
    assert sorted(r.parent_id for r in look(grown).collect()) == [0, 1, 7]
