"""Chains that carry their poses: numbers, coordinates and near pairs as from nodes, and little that is moved."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.constants import GRID_SPACING, MAX_GRID, MAX_INDEX, MIN_GRID, POSE
from strandloom.operators import chains, rmsd
from strandloom.staging import stage

POOL = "pose_id bigint, conformer int, rotamer int, gx int, gy int, gz int"


def make_layers(spark, rng, sizes, grid, conformers=3):
    pools = [[(n, rng.choice([0, 1, conformers - 1]), rng.randrange(2), *[rng.choice(grid) for _ in range(3)]) for n in range(s)] for s in sizes]
    edges = [[(rng.randrange(a), rng.randrange(b)) for _ in range(2 * max(a, b))] for a, b in itertools.pairwise(sizes)]
    pools = [spark.createDataFrame(p, POOL) for p in pools]
    edges = [spark.createDataFrame(e, "low bigint, high bigint") for e in edges]
    return chains.connect(list("wxyz")[: len(sizes)], pools, edges)


def posed(layers):
    return chains.number_posed_chains(chains.posed_path_table(layers), len(layers.names))


def make_turned(spark, count, conformers, copies=1):
    """Two atoms a half; further copies of a rotation are turned otherwise."""
    gen, rows = np.random.default_rng(3), []
    for layer, c, r, _ in itertools.product(range(count), conformers, range(2), range(copies)):
        rows.append((layer, c, r, gen.normal(size=6).tolist(), gen.normal(size=6).tolist()))
    df = spark.createDataFrame(rows, "layer int, conformer int, rotamer int, first array<double>, second array<double>")
    return stage(df, "turned"), rows


def structures(numbered, rows, count):
    """Every chain's flat coordinates by nucleotide, for each choice of turned halves."""
    out = []
    for n in numbered:
        found = []
        for j in range(count):
            c, r, *grid = n[f"p{j}"]
            at = np.array([g * GRID_SPACING for g in grid] * 2)
            found.append([(np.array(a) + at, np.array(b) + at) for layer, x, y, a, b in rows if (layer, x, y) == (j, c, r)])
        for halves in itertools.product(*found):
            parts = [halves[0][0], *[(p[1] + q[0]) / 2 for p, q in itertools.pairwise(halves)], halves[-1][1]]
            out.append((n.chain, parts))
    return out


def unpacked(numbered, count):
    fields = [F.array(*chains.unpacked_pose(j).values()).alias(f"p{j}") for j in range(count)]
    return numbered.select("chain", *fields).collect()


@pytest.mark.parametrize("sizes", [[25], [25, 30], [20, 30, 25], [12, 20, 25, 14]])
def test_posed_chains_have_the_numbers_and_poses_of_node_chains(spark, sizes):
    grid = [MIN_GRID, -1, 0, 1, MAX_GRID]
    layers = make_layers(spark, random.Random(5), sizes, grid, MAX_INDEX + 1)
    by_node = [{r.node + 1: tuple(r[c] for c in POSE) for r in nodes.collect()} for nodes in layers.nodes]
    table = chains.number_chains(chains.path_table(layers), layers.names).collect()
    want = {(r.chain, *[by_node[j][r[name]] for j, name in enumerate(layers.names)]) for r in table}
    got = {(r.chain, *[tuple(r[f"p{j}"]) for j in range(len(sizes))]) for r in unpacked(posed(layers), len(sizes))}
    assert got == want and len(table) >= len(sizes) * 10


def test_outer_layers_bring_their_poses_and_coordinates_meet_no_nodes(spark, monkeypatch):
    layers = make_layers(spark, random.Random(6), [20, 30, 25], range(-3, 4))
    numbered, (turned, rows) = posed(layers), make_turned(spark, 3, range(3))
    asked = []
    for module in (chains, rmsd):
        monkeypatch.setattr(module, "skew_join", lambda *a, f=module.skew_join, **k: asked.append(a[2]) or f(*a, **k))
    chains.posed_path_table(layers)
    assert asked == [["x"], ["x"]]  # the poses of the inner layer by the key of the paths
    coords = rmsd.chain_coordinates(numbered, turned, 3)
    assert len(asked) == 2 and "SortMergeJoin" not in coords._jdf.queryExecution().executedPlan().toString()
    want = {(c, n): part for c, parts in structures(unpacked(numbered, 3), rows, 3) for n, part in enumerate(parts)}
    got = {(r.chain, r.nucleotide): r.xyz for r in coords.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    monkeypatch.setattr(rmsd, "SENT_ROTATIONS", 0)
    assert {(r.chain, r.nucleotide): r.xyz for r in rmsd.chain_coordinates(numbered, turned, 3).collect()} == got


@pytest.mark.parametrize(("copies", "hot_rows", "sent", "bits"), [(1, None, 100_000, 63), (2, 3, 0, 63), (1, 3, 100_000, 2)])
def test_near_chains_meet_by_their_poses_alone(spark, monkeypatch, copies, hot_rows, sent, bits):
    monkeypatch.setattr(rmsd, "SENT_ROTATIONS", sent)
    monkeypatch.setattr(rmsd, "CELL_BITS", bits)
    layers = make_layers(spark, random.Random(7), [12, 16, 12], [-40, 0, 0, 1, 1])
    numbered, (turned, rows) = posed(layers), make_turned(spark, 3, range(3), copies)
    met = structures(unpacked(numbered, 3), rows, 3)
    want = Counter()
    for (i, a), (j, b) in itertools.combinations([(c, np.concatenate(parts)) for c, parts in met], 2):
        d = math.sqrt(((a - b) ** 2).sum() / 8)
        if i != j and d < 2.0:
            want[min(i, j), max(i, j), round(d, 6)] += 1
    written, whole = [], rmsd.stage
    monkeypatch.setattr(rmsd, "stage", lambda df, label: written.append((label, df.columns)) or whole(df, label))
    got = rmsd.chain_pairs_below(numbered, turned, 3, 2.0, hot_rows=hot_rows)
    assert Counter((r.i, r.j, round(r.rmsd, 6)) for r in got.collect()) == want and sum(want.values()) > 20
    # Coordinates of a sample of chains are written, of all chains never.
    assert {label for label, _ in written} <= {"pivots", "projected"}
    with pytest.raises(ValueError, match="positive"):
        rmsd.chain_pairs_below(numbered, turned, 3, 0.0)
    assert rmsd.chain_pairs_below(stage(numbered.limit(0), "none"), turned, 3, 1.1).collect() == []


def test_copies_in_cells_are_dealt_out_once(spark):
    layers = make_layers(spark, random.Random(8), [20, 30, 25], range(-3, 4))
    pairs = rmsd.chain_pairs_below(posed(layers), make_turned(spark, 3, range(3))[0], 3, 1.1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = pairs.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in text.splitlines() if "Exchange hashpartitioning(_cell" in line]
    assert len(dealt) == 2 and sum("ReusedExchange" in line for line in dealt) == 1, text
