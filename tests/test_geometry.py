"""Geometry operators against plain numpy on small random inputs."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.constants import GRID_SPACING, POSE
from strandloom.functions import decimals, gaussian, nucleotides, stacking, superpose
from strandloom.functions import vectors as v
from strandloom.operators import anchor, energy, filter_cache, fit, grow, library, rebuild, rmsd, structure

CONF = "conformer int, coords array<array<double>>"


def matrix(rotvec):
    angle = np.linalg.norm(rotvec)
    if angle == 0:
        return np.eye(3)
    x, y, z = rotvec / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * (k @ k)


def make_library(spark, rng, conformers, atoms, rotamers, spread=0.6):
    coords = rng.normal(size=(conformers, atoms, 3)) * 1.5
    vecs = rng.normal(size=(conformers, rotamers, 3)) * spread
    c = spark.createDataFrame([(n, coords[n].tolist()) for n in range(conformers)], CONF)
    r = spark.createDataFrame(
        [(n, k, *map(float, vecs[n, k])) for n in range(conformers) for k in range(rotamers)],
        "conformer int, rotamer int, rx double, ry double, rz double",
    )
    mats = np.array([[matrix(x) for x in row] for row in vecs])
    return coords, mats, c, library.rotamers_from_rotvec(r), r


def test_rotation_vectors(spark):
    rng = np.random.default_rng(1)
    vecs = np.vstack([np.zeros(3), rng.normal(size=(20, 3)), [[math.pi, 0, 0]]])
    df = spark.createDataFrame([tuple(map(float, x)) for x in vecs], "rx double, ry double, rz double")
    got = [r.m for r in df.select(v.rotvec_matrix("rx", "ry", "rz").alias("m")).collect()]
    assert np.allclose(got, [matrix(x).ravel() for x in vecs], atol=1e-12)


@pytest.mark.parametrize("restricted", [False, True])
def test_grow_equals_brute_force(spark, restricted):
    rng = np.random.default_rng(2)
    sc, sr, sconf, srot, _ = make_library(spark, rng, 3, 7, 5, 0.25)
    tc, tr, tconf, trot, _ = make_library(spark, rng, 3, 7, 6, 0.25)
    tc = sc + rng.normal(size=sc.shape) * 0.2
    tconf = spark.createDataFrame([(n, tc[n].tolist()) for n in range(3)], CONF)
    source = [(n, int(rng.integers(3)), int(rng.integers(5)), *map(int, rng.integers(-6, 7, 3))) for n in range(25)]
    pool_df = spark.createDataFrame(source, "pose_id bigint, conformer int, rotamer int, gx int, gy int, gz int")
    crmsd = rng.random((3, 3))
    pairs = spark.createDataFrame(
        [(a, b, float(crmsd[a, b])) for a in range(3) for b in range(3)], "source int, target int, crmsd double"
    )
    limit, reach = 1.1, 4
    want = set()
    for n, c, r, *grid in source:
        placed = sc[c] @ sr[c, r] + np.array(grid) * GRID_SPACING
        for ct, rt in itertools.product(range(3), range(6)):
            if not crmsd[c, ct] < 0.6:
                continue
            turned = tc[ct] @ tr[ct, rt]
            at = np.rint((placed.mean(0) - turned.mean(0)) / GRID_SPACING).astype(int)
            for d in itertools.product(range(-reach, reach + 1), repeat=3):
                g = at + d
                if math.sqrt(((turned + g * GRID_SPACING - placed) ** 2).sum() / 7) < limit:
                    want.add((n, ct, rt, *map(int, g)))
    restrict = None
    if restricted:
        chosen = sorted({w[1:] for w in want})[::3]
        restrict = spark.createDataFrame(chosen, "conformer int, rotamer int, gx int, gy int, gz int")
        want = {w for w in want if w[1:] in set(chosen)}
    got = grow.grow(
        pool_df, sconf, srot, tconf, trot, pairs, crmsd=0.6, ovrmsd=limit, restrict=restrict
    ).collect()
    assert len(want) > 20
    assert len(got) == len(want) and {(r.parent_id, *(r[c] for c in POSE)) for r in got} == want
    for bad in (0.0, 1.8, float("nan")):
        with pytest.raises(ValueError):
            grow.valid_ovrmsd(bad)


def test_pose_rmsd_and_coordinates(spark):
    rng = np.random.default_rng(4)
    coords, mats, conf, rot, rotvecs = make_library(spark, rng, 2, 9, 4)
    reference = rng.normal(size=(9, 3)) * 2
    rows = [(n, int(rng.integers(2)), int(rng.integers(4)), *map(int, rng.integers(-5, 6, 3))) for n in range(40)]
    df = spark.createDataFrame(rows, "pose_id bigint, conformer int, rotamer int, gx int, gy int, gz int")
    placed = {n: coords[c] @ mats[c, r] + np.array(g) * GRID_SPACING for n, c, r, *g in rows}
    got = {r.pose_id: r for r in rmsd.ensemble_rmsd(df, conf, rot, reference.tolist(), 4).collect()}
    for n, xyz in placed.items():
        gap = ((xyz - reference) ** 2).sum(1)
        for name, part in (("rmsd", gap), ("first", gap[:4]), ("second", gap[4:])):
            assert abs(got[n][name] - math.sqrt(part.mean())) <= 0.00051
    for r in library.pose_coordinates(df, conf, rot).collect():
        assert np.allclose(r.xyz, placed[r.pose_id])
    for r in library.converted_poses(df, rotvecs).collect():
        back = coords[r.conformer] @ matrix(-np.array([r.rx, r.ry, r.rz])) + [r.x, r.y, r.z]
        assert np.allclose(back, placed[r.pose_id])


@pytest.mark.parametrize("hot_rows", [None, 4])
def test_pairs_below_and_full_matrix(spark, hot_rows):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(15, 12))
    data = np.vstack([base, base + rng.normal(size=base.shape) * 0.05, base[0] + rng.normal(size=(12, 12)) * 0.02])
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(data)], "id bigint, coords array<double>")
    full = {
        (i, j): math.sqrt(((data[i] - data[j]) ** 2).sum() / 4)
        for i, j in itertools.combinations(range(len(data)), 2)
    }
    got = {(r.i, r.j): r.rmsd for r in rmsd.pairs_below(df, 0.4, hot_rows=hot_rows).collect()}
    want = {k: x for k, x in full.items() if x < 0.4}
    assert got.keys() == want.keys() and len(want) > 50
    assert [rmsd.triangle_pair(n, len(data)) for n in range(len(full))] == sorted(full)


def test_superposition(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(6, 8, 3))
    turned = np.array([x @ matrix(rng.normal(size=3)) + 3 for x in a])
    df = spark.createDataFrame(
        [(x.tolist(), y.tolist(), (x * [1, 1, -1]).tolist()) for x, y in zip(a, turned)],
        "a array<array<double>>, b array<array<double>>, mirrored array<array<double>>",
    )
    scored = superpose.with_superposed_rmsd(superpose.with_superposed_rmsd(df, "a", "b", "d"), "a", "mirrored", "far")
    turn = superpose.superposing_rotation(F.flatten("a"), F.flatten("b"))
    rows = scored.select("d", "far", turn.alias("m")).collect()
    want = superpose.fit(a, a * [1, 1, -1])[1]
    assert np.allclose([r.far for r in rows], want)
    odd = df.select("a", F.slice("b", 1, 7).alias("b"))
    with pytest.raises(Exception, match="atom counts"):
        superpose.with_superposed_rmsd(odd, "a", "b", "d").collect()
    for r, x, y in zip(rows, a, turned):
        m = np.reshape(r.m, (3, 3))
        assert r.d < 1e-6 and r.far > 0.1 and abs(np.linalg.det(m) - 1) < 1e-9
        assert np.allclose((x - x.mean(0)) @ m, y - y.mean(0))
    with pytest.raises(ValueError, match="degenerate"):
        superpose.ring_rotation(np.arange(12.0).reshape(4, 3), a[0, :4])


def test_best_fit(spark):
    rng = np.random.default_rng(8)
    coords, mats, conf, rot, _ = make_library(spark, rng, 4, 8, 6)
    fragments, truth = [], {}
    for n in range(5):
        c, r, g = int(rng.integers(4)), int(rng.integers(6)), rng.integers(-4, 5, 3)
        fragments.append((n, "AC", (coords[c] @ mats[c, r] + g * GRID_SPACING).tolist()))
        truth[n] = (c, r, *map(int, g))
    refs = spark.createDataFrame(fragments, "fragment int, sequence string, coords array<array<double>>")
    chosen = fit.best_conformers(refs, conf.withColumn("sequence", F.lit("AC")))
    assert {r.fragment: r.conformer for r in chosen.collect()} == {n: x[0] for n, x in truth.items()}
    best = fit.best_poses(refs.join(chosen.select("fragment", "conformer"), "fragment"), conf, rot).collect()
    assert {r.fragment: (r.conformer, r.rotamer, r.gx, r.gy, r.gz) for r in best} == truth
    assert all(r.rmsd < 1e-6 for r in best)


def test_library_exclusion_updates_crmsds(spark):
    rng = np.random.default_rng(9)
    lo, hi, new = rng.normal(size=(3, 5, 3)), rng.normal(size=(2, 5, 3)), rng.normal(size=(5, 3))
    rows = [(0, lo[0].tolist(), "1abc", new.tolist(), False), (1, lo[1].tolist(), "2xyz", None, False),
            (2, lo[2].tolist(), "1ABC", None, True)]
    given = spark.createDataFrame(
        rows, f"{CONF}, origin string, replacement array<array<double>>, extension boolean"
    )
    lower = library.exclude_origins(given, ["1abc"])
    assert {r.conformer: r.replaced for r in lower.collect()} == {0: True, 1: False}
    upper = spark.createDataFrame([(n, hi[n].tolist(), False) for n in range(2)], CONF + ", replaced boolean")
    table = spark.createDataFrame([(a, b, 9.0) for a in range(3) for b in range(2)], "lower int, upper int, crmsd double")
    got = {(r.lower, r.upper): r.crmsd for r in library.update_crmsds(table, lower, upper).collect()}
    fresh = superpose.fit(np.stack([new, new]), hi)[1]
    assert set(got) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert got[1, 0] == got[1, 1] == 9.0 and np.allclose([got[0, 0], got[0, 1]], fresh)
    assert [r.position for r in library.conformer_mapping(lower).orderBy("conformer").collect()] == [0, 1]
    kept = library.atom_subset(upper, [("P", 0), ("C1", 0), ("N", 1), ("C2", 1), ("C10", 1)],
                               nucleotides=[False, True], only_base=True).first()
    assert np.allclose(kept.coords, hi[kept.conformer][[3]])


def test_gaussian_names_and_containment(spark):
    names = gaussian.filter_names()
    assert len(names) == 12 and gaussian.cutoff("rrm70-tilt30".split("-")[0]) == 2.04198
    for bad in ("rrm55", "rrm50-tilt30", "rrm90-disp45-tilt30", "rrm90 "):
        with pytest.raises(ValueError):
            gaussian.parse_name(bad)
    got = {tuple(r) for r in gaussian.containment_pairs(gaussian.filter_table(spark)).collect()}
    assert got == {(n, w) for n in names for w in names if gaussian.contains(w, n)}


def test_hopf_cells_are_their_own_centres(spark):
    from strandloom.staging import stage

    cells = stage(gaussian.hopf_cells(spark), "cells")
    assert cells.where(gaussian.hopf_cell(F.col("rotation")) != F.col("cell")).count() == 0
    tilt = cells.join(gaussian.cell_tilts(spark), "cell")
    assert tilt.where(F.abs(F.get("rotation", F.lit(8)) - F.col("r33")) > 1e-12).count() == 0


def test_smallest_filter_has_its_published_size(spark):
    assert gaussian.filter_pairs(spark, "rrm50").count() == 4_111_232


def test_anchor_equals_brute_force(spark):
    rng = np.random.default_rng(10)
    ring = np.array([[math.cos(a), math.sin(a), 0.0] for a in np.arange(6) * math.pi / 3]) * 1.4
    protein = ring @ matrix(np.array([0.3, -0.2, 0.5])) + [2.0, 1.0, -1.0]
    frame, centre = anchor.protein_frame(protein.tolist(), ring.tolist())
    w, centre = np.reshape(frame, (3, 3)), np.array(centre)
    coords = np.vstack([rng.normal(size=(2, 3)), ring @ matrix(np.array([0.1, 0.4, -0.3])) + 0.7])
    vecs = rng.normal(size=(12, 3)) * 0.5
    conf = spark.createDataFrame([(0, coords.tolist())], CONF)
    rot = library.rotamers_from_rotvec(
        spark.createDataFrame([(0, n, *map(float, x)) for n, x in enumerate(vecs)],
                              "conformer int, rotamer int, rx double, ry double, rz double")
    )
    shapes = anchor.ring_shapes(conf, list(range(2, 8)), ring.tolist())
    got = {
        (r.rotamer, r.gx, r.gy, r.gz): (r["count"], r.capacity)
        for r in anchor.candidate_cells(rot, shapes, "rrm80", frame, centre.tolist()).collect()
    }
    tilt = {r.cell: r.r33 for r in gaussian.cell_tilts(spark).collect()}
    to_ref = superpose.ring_rotation(coords[2:], ring)
    axis = np.arange(-20, 21)
    ijk = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), -1).reshape(-1, 3)
    ijk = ijk[(ijk**2).sum(1) > 0]
    d = np.sqrt((ijk**2).sum(1)) * 0.25
    phi = np.arccos(np.abs(ijk[:, 2]) * 0.25 / d)
    side = ijk[:, 0] ** 2 + ijk[:, 1] ** 2
    masked = ((ijk**2).sum(1) < 400) & (3 * ijk[:, 2] ** 2 > side)
    cells = spark.createDataFrame(
        [(n, (to_ref.T @ matrix(x) @ w.T).ravel().tolist()) for n, x in enumerate(vecs)], "n int, m array<double>"
    ).select("n", gaussian.hopf_cell(F.col("m")).alias("cell")).collect()
    p, want = np.array(gaussian.PRECISION), {}
    for n, cell in cells:
        dev = np.stack([d, phi, np.full_like(d, math.acos(min(1, abs(tilt[cell]))))], 1) - gaussian.MEAN
        score = np.exp(-0.5 * np.einsum("ni,ij,nj->n", dev, p, dev)) / gaussian.NORMALIZER
        hits = ijk[masked & (score >= gaussian.cutoff("rrm80"))] * 0.25
        offset = centre - coords[2:].mean(0) @ matrix(vecs[n])
        grid, counts = np.unique(np.rint((offset + hits @ w) / GRID_SPACING).astype(int), axis=0, return_counts=True)
        near = np.stack(np.meshgrid(*[np.arange(-4, 5)] * 3, indexing="ij"), -1).reshape(-1, 3)
        for g, count in zip(grid, counts):
            phase = np.mod((g * GRID_SPACING - offset) @ w.T / 0.25, 1.0)
            binned = (np.minimum((phase * 64).astype(int), 63) + 0.5) / 64
            inside = (np.abs((near - binned) @ w) <= GRID_SPACING * 2).all(1).sum()
            want[(n, *map(int, g))] = (int(count), int(inside))
    assert len(want) > 10 and got == want
    kept = anchor.anchor(rot, shapes, "rrm80", frame, centre.tolist()).collect()
    assert {(r.rotamer, r.gx, r.gy, r.gz) for r in kept} == {k for k, (c, cap) in want.items() if c >= cap / 3}


def plane_normal(ring):
    """Direction of least spread, on the side the first three atoms go round."""
    normal = np.linalg.svd(ring - ring.mean(0))[2][2]
    return normal * np.sign(normal @ np.cross(ring[1] - ring[0], ring[2] - ring[1]))


def test_stacking_angle_and_dihedral(spark):
    rng = np.random.default_rng(12)
    rows = [(rng.normal(size=(6, 3)), rng.normal(size=(9, 3))) for _ in range(6)]
    df = spark.createDataFrame(
        [(a.ravel().tolist(), b.ravel().tolist()) for a, b in rows], "p array<double>, n array<double>"
    )
    got = stacking.stacking_angle_dihedral(df, "p", "n").collect()
    for r, (a, b) in zip(got, rows):
        n, m = plane_normal(a), plane_normal(b)
        assert abs(r.angle - math.asin(min(1, np.linalg.norm(np.cross(n, m))))) < 1e-7
        x = (a[0] - a.mean(0)) / np.linalg.norm(a[0] - a.mean(0))
        y = np.cross(n, x) / np.linalg.norm(np.cross(n, x))
        f = b[0] - b.mean(0)
        f = f - (f @ n) * n
        assert abs(r.dihedral - math.atan2(f @ y, f @ x)) < 1e-7
    line = spark.createDataFrame([([float(k) for n in range(4) for k in (n, 2 * n, -n)],)], "p array<double>")
    with pytest.raises(Exception, match="degenerate"):
        superpose.with_plane_normal(line, "p", "n").collect()


def test_rings_by_residue(spark):
    atoms = [("PHE", n, k, float(k), 0.0, 1.0) for k, n in enumerate(["CZ", "CG", "CA", "CD1", "CD2", "CE1", "CE2"])]
    df = spark.createDataFrame([(7, *a) for a in atoms], "resid int, resname string, name string, index int, x double, y double, z double")
    ring = stacking.rings(df, ["resid"]).first()
    assert ring.ring[::3] == [0.0, 1.0, 3.0, 4.0, 5.0, 6.0]
    with pytest.raises(Exception, match="too few"):
        stacking.rings(df.where("index < 3"), ["resid"]).collect()


def test_mutation_round_trip(spark):
    rng = np.random.default_rng(13)
    coords = rng.normal(size=(42, 3))
    df = spark.createDataFrame([(coords.tolist(),)], "c array<array<double>>")
    out = df.select(nucleotides.mutate(F.col("c"), "AC", "GU", centre=False).alias("g")).select(
        "g", nucleotides.mutate(F.col("g"), "GU", "AC", centre=False).alias("back")
    ).first()
    assert len(out.g) == 43 and np.allclose(out.back, coords)
    normal = np.cross(coords[11] - coords[8], coords[13] - coords[8])
    assert abs((np.array(out.g[12]) - coords[8]) @ normal) < 1e-9
    assert abs(np.linalg.norm(np.array(out.g[12]) - coords[8]) - math.hypot(4.66517696, 0.69231318)) < 1e-9
    with pytest.raises(ValueError, match="cannot mutate"):
        nucleotides.mutate(F.col("c"), "AC", "CC")


def test_thresholds_just_below_a_cent(spark):
    values = [0.009999999999, 1.2299999999, 0.01, 1.23, -1.23, -0.004, 12.999999999999, 1e-9, 0.0]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for r in df.select("x", decimals.above_cent_column(F.col("x")).alias("y")).collect():
        assert str(r.y) == decimals.above_cent(r.x)


def test_poses_of_an_unknown_library_entry_are_refused(spark):
    rng = np.random.default_rng(20)
    _, _, conf, rot, rotvecs = make_library(spark, rng, 2, 4, 3)
    pool_schema = "pose_id bigint, conformer int, rotamer int, gx int, gy int, gz int"
    for pose, words in (((0, 5, 0, 0, 0, 0), "missing conformer"), ((0, 1, 9, 0, 0, 0), "missing rotamer")):
        df = spark.createDataFrame([pose], pool_schema)
        with pytest.raises(Exception, match=words):
            library.pose_coordinates(df, conf, rot).collect()
        with pytest.raises(Exception, match="missing rotamer"):
            library.converted_poses(df, rotvecs).collect()


def test_decimal_thresholds():
    cases = {"0": "0.01", "1.23": "1.24", "1.239": "1.24", "-1.23": "-1.22", "-1.239": "-1.23", "-0.004": "0.00",
             "1e-9": "0.01", "-1e-9": "0.00", "0.01": "0.02", "12.999999999999999999999999999999": "13.00"}
    for raw, want in cases.items():
        assert decimals.above_cent_text(raw) == want
    assert decimals.above_cent(0.29) == "0.30" and decimals.floor_decimal(3.3038440180955031) == "3.30384"
    for bad in ("", "x", "NaN", "Infinity"):
        with pytest.raises(ValueError):
            decimals.above_cent_text(bad)


def test_structure_fragments(spark):
    atoms = []
    for resid, (base, gap) in enumerate([("RA", 0), ("G", 0), ("U", 5), ("C", 5)], start=1):
        atoms += [(1, "B", resid, base, " P", 2 * resid, resid * 3.0 + gap, 0.0, 0.0),
                  (1, "B", resid, base, " O3*", 2 * resid + 1, resid * 3.0 + gap + 1.0, 0.0, 0.0)]
    schema = "structure int, chain string, resid int, resname string, name string, index int, x double, y double, z double"
    df = spark.createDataFrame(atoms, schema)
    template = spark.createDataFrame(
        [(b, n, k) for b in "ACGU" for k, n in enumerate(["P", "O3'"])], "base string, name string, place int"
    )
    nucs = structure.nucleotides(df, template)
    assert structure.sequences(nucs).first().sequence == "AGUC"
    got = {r.fragment: r.sequence for r in structure.dinucleotides(nucs).collect()}
    assert got == {1: "AG", 3: "UC"}  # the backbone breaks between G and U
    structure.require_single_chain(df)
    for bad, words in (
        (df.where("index <> 5"), "lacks atoms"),
        (df.unionByName(df.where("index = 5")), "duplicate atom"),
        (df.withColumn("resname", F.lit("XX")), "unknown base"),
    ):
        with pytest.raises(Exception, match=words):
            structure.nucleotides(bad, template).collect()
    kept = structure.nucleotides(df.where("index <> 5"), template, ignore_missing=True)
    assert [r.resid for r in kept.orderBy("position").collect()] == [1, 3, 4]


def test_pair_energy(spark):
    rng = np.random.default_rng(14)
    poses = [(n, rng.uniform(-8, 8, (3, 3)).tolist(), [0, 1, 0]) for n in range(12)]
    atoms = [(*map(float, rng.uniform(-8, 8, 3)), int(rng.integers(2))) for _ in range(40)]
    p = spark.createDataFrame(poses, "pose_id bigint, xyz array<array<double>>, types array<int>")
    r = spark.createDataFrame(atoms, "x double, y double, z double, type int")

    def kernel(square, a, b):
        return energy.lennard_jones_8_6(square, (a + b + 1).cast("double"), F.lit(3.0))

    got = {x.pose_id: x.score for x in energy.score_poses(p, r, kernel, 5.0).collect()}
    for n, xyz, types in poses:
        total = 0.0
        for atom, kind in zip(xyz, types):
            for *q, other in atoms:
                square = sum((s - t) ** 2 for s, t in zip(atom, q))
                if square < 25:
                    s2 = 9 / square
                    total += (kind + other + 1) * (s2**4 - s2**3)
        assert math.isclose(got[n], total, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("turns", [60, 120])
def test_second_axis_leaves_few_rotation_candidates(spark, monkeypatch, turns):
    """A long thin shape turned about its own axis: one axis lets all of these turns meet."""
    rng = np.random.default_rng(20)
    rod = rng.normal(size=(9, 3)) * [6.0, 1.5, 1.0]
    u, s, _ = np.linalg.svd(rod - rod.mean(0), full_matrices=False)
    rod = u * s  # its long axis is the first
    conf = spark.createDataFrame([(0, rod.tolist())], CONF)
    angles = rng.uniform(-math.pi, math.pi, turns)
    vecs = [(0, n, float(a), *map(float, rng.normal(size=2) * 0.003)) for n, a in enumerate(angles)]
    rot = library.rotamers_from_rotvec(
        spark.createDataFrame(vecs, "conformer int, rotamer int, rx double, ry double, rz double")
    )
    pairs = spark.createDataFrame([(0, 0)], "source int, target int")
    args = (rot, conf, conf, rot, pairs, 0.25)
    found = {(r.rotamer, r.t_rot) for r in grow.rotation_pairs(*args).collect()}
    both = grow.rotation_candidates(*args).select("rotamer", "t_rot").collect()
    assert len(both) == len(set(both)) and found <= {tuple(r) for r in both}
    axes = grow._axes
    monkeypatch.setattr(grow, "_axes", lambda c: axes(c)[:1])
    one = grow.rotation_candidates(*args).count()
    assert {(r.rotamer, r.t_rot) for r in grow.rotation_pairs(*args).collect()} == found
    assert len(both) <= 6 * len(found) and 5 * len(both) < one


def test_hot_rotation_cells_are_split(spark, monkeypatch):
    """The same pairs when every cell counts as hot."""
    from strandloom import staging

    rng = np.random.default_rng(21)
    coords, _, conf, rot, _ = make_library(spark, rng, 2, 6, 30, 0.1)
    pairs = spark.createDataFrame([(a, b) for a in range(2) for b in range(2)], "source int, target int")
    want = sorted((r.conformer, r.rotamer, r.t_conf, r.t_rot) for r in grow.rotation_pairs(rot, conf, conf, rot, pairs, 0.9).collect())
    monkeypatch.setattr(staging, "HOT_ROWS", 5)
    got = sorted((r.conformer, r.rotamer, r.t_conf, r.t_rot) for r in grow.rotation_pairs(rot, conf, conf, rot, pairs, 0.9).collect())
    assert got == want and len(want) > 100


def test_structures_with_one_centroid_meet_by_pivots(spark):
    rng = np.random.default_rng(22)
    groups = rng.normal(size=(60, 8, 3)) * 3
    data = np.concatenate([g + rng.normal(size=(5, 8, 3)) * 0.03 for g in groups])
    data -= data.mean(axis=1, keepdims=True)
    df = spark.createDataFrame([(n, x.ravel().tolist()) for n, x in enumerate(data)], "id bigint, coords array<double>")
    near = rmsd.near_candidates(df, 0.3, rmsd.pivot_directions(df)).count()
    got = {(r.i, r.j) for r in rmsd.pairs_below(df, 0.3).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(300), 2) if i // 5 == j // 5}
    assert near <= 2 * len(got)  # of 44,850 pairs, all of which share their centroid's cell
    assert rmsd.pairs_below(df.limit(0), 0.3).collect() == []


def test_accept_rows_and_stored_filter(spark, tmp_path):
    cells = spark.createDataFrame([(n,) for n in range(0, gaussian.HOPF_CELLS, 97)], "cell int")
    cells = cells.select("cell", gaussian.hopf_r33(F.col("cell")).alias("r33"))
    scored = gaussian.scored_keys(cells, "rrm70")
    keys = gaussian.lattice_keys(spark, False).count()
    assert scored.count() <= cells.count() * keys and keys < 1500
    tilt = {r.cell: r.r33 for r in cells.collect()}
    axis = np.arange(-20, 21)
    ijk = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), -1).reshape(-1, 3)
    side = ijk[:, 0] ** 2 + ijk[:, 1] ** 2
    ijk = ijk[((ijk**2).sum(1) < 400) & (3 * ijk[:, 2] ** 2 > side)]
    d = np.sqrt((ijk**2).sum(1)) * 0.25
    phi = np.arccos(np.abs(ijk[:, 2]) * 0.25 / d)
    p, want = np.array(gaussian.PRECISION), {}
    for cell, r33 in tilt.items():
        dev = np.stack([d, phi, np.full_like(d, math.acos(min(1, abs(r33))))], 1) - gaussian.MEAN
        score = np.exp(-0.5 * np.einsum("ni,ij,nj->n", dev, p, dev)) / gaussian.NORMALIZER
        if hits := set(map(tuple, ijk[score >= gaussian.cutoff("rrm70")].tolist())):
            want[cell] = hits
    rows = gaussian.accept_rows(cells, "rrm70")
    assert {r.cell: r["size"] for r in rows.collect()} == {c: len(h) for c, h in want.items()} and len(want) > 20
    points = gaussian.accepted_points(rows.select("cell", "accepted")).collect()
    assert len(points) == sum(map(len, want.values()))
    assert all((r.i, r.j, r.k) in want[r.cell] for r in points)


def test_stored_filter_is_checked(spark, tmp_path):
    path = str(tmp_path / "rrm50")
    said = filter_cache.write(spark, "rrm50", path)
    assert said["pairs"] == 4_111_232 and said["min_rel_margin"] > gaussian.AUDIT_MARGIN
    cells = filter_cache.read(spark, "rrm50", path)
    assert cells.agg(F.sum("size")).first()[0] == 4_111_232
    with pytest.raises(filter_cache.FilterCacheError, match="name"):
        filter_cache.read(spark, "rrm60", path)
    with pytest.raises(filter_cache.FilterCacheError, match="rounding"):
        filter_cache.write(spark, "rrm50", str(tmp_path / "other"), least=1.0)
    changed = tmp_path / "changed"
    first = cells.orderBy("cell").first().cell
    flipped = F.transform("accepted", lambda a: F.struct(a.side.alias("side"), a.bits.bitwiseXOR(F.lit(6)).alias("bits")))
    cells.withColumn("accepted", F.when(F.col("cell") == first, flipped).otherwise(F.col("accepted"))).write.parquet(f"{changed}/cells")
    spark.read.json(f"{path}/manifest").write.json(f"{changed}/manifest")
    with pytest.raises(filter_cache.FilterCacheError, match="digest"):
        filter_cache.read(spark, "rrm50", str(changed))


def test_anchor_from_a_stored_filter(spark, monkeypatch):
    """Rows of a stored filter, and shuffled accept rows, give the same cells."""
    rng = np.random.default_rng(23)
    rot = library.rotamers_from_rotvec(
        spark.createDataFrame([(0, n, *map(float, rng.normal(size=3) * 0.4)) for n in range(6)],
                              "conformer int, rotamer int, rx double, ry double, rz double")
    )
    identity = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    shapes = spark.createDataFrame([(0, identity, [0.1, 0.2, 0.3])], "conformer int, to_reference array<double>, ring_centre array<double>")
    args = (rot, shapes, "rrm80", identity, [0.0, 0.5, 1.0])
    want = sorted(map(tuple, anchor.candidate_cells(*args).collect()))
    stored = gaussian.accept_rows(gaussian.cell_tilts(spark), "rrm80")
    assert sorted(map(tuple, anchor.candidate_cells(*args, accepted=stored).collect())) == want and len(want) > 10
    monkeypatch.setattr(anchor, "FEW_CELLS", 0)
    assert sorted(map(tuple, anchor.candidate_cells(*args).collect())) == want


def test_digest_follows_order_and_not_partitions(spark, monkeypatch):
    from strandloom.operators import digest

    monkeypatch.setattr(digest, "FAN", 8)
    rows = [(n, f"v{n % 7}" if n % 5 else None) for n in range(700)]

    def of(rows, parts=3):
        df = spark.createDataFrame(rows, "pose_id bigint, v string").repartition(parts)
        return tuple(digest.ordered_digest(df, ["v"]).first())

    base = of(rows)
    assert base == of(rows, 7) and base[0] == 700
    swapped = list(rows)
    swapped[3], swapped[4] = (3, rows[4][1]), (4, rows[3][1])
    assert of(swapped) != base and of(rows[:-1]) != base
    assert of([(0, "")]) != of([(0, None)]) and of([])[0] == 0


def rebuilt_case(spark):
    rng = np.random.default_rng(30)
    ring = np.array([[math.cos(a), math.sin(a), 0.0] for a in np.arange(6) * math.pi / 3]) * 1.4
    shapes = [np.vstack([ring @ matrix(rng.normal(size=3)) + rng.normal(size=3), rng.normal(size=(2, 3))]) for _ in range(2)]
    flat = shapes[1].copy()
    flat[:6] = np.arange(6)[:, None] * [0.5, 0.2, 0.1]
    shapes.append(flat)
    conf = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(shapes)], CONF)
    vecs = rng.normal(size=(3, 2, 3)) * 0.4
    rot = library.rotamers_from_rotvec(
        spark.createDataFrame([(c, r, *map(float, vecs[c, r])) for c in range(3) for r in range(2)],
                              "conformer int, rotamer int, rx double, ry double, rz double")
    )
    return ring, shapes, vecs, conf, rot


def test_rebuilt_jobs_and_their_errors(spark):
    ring, shapes, vecs, conf, rot = rebuilt_case(spark)
    frame = matrix(np.array([0.2, -0.1, 0.3]))
    centre = np.array([0.5, 1.0, -3.0])
    jobs = [(n, n % 2, n // 2 % 2, n % 3 - 1, 0, 1 - n % 2, 0) for n in range(8)]
    jobs += [(8, 9, 0, 0, 0, 0, 0), (9, 0, 9, 0, 0, 0, 0), (10, 0, 0, 0, 0, 0, 0), (11, 0, 0, 0, 0, 0, 0), (12, 0, 0, 0, 0, 0, 0),
             (13, 2, 0, 0, 0, 0, 0), (14, 0, 0, 0, 0, 0, 2), (15, 0, 0, 0, 0, 0, 0)]
    published = {}
    for n, c, r, *grid, _ in jobs:
        if c < 9 and r < 9 and n != 10:
            published[n] = shapes[c] @ matrix(vecs[c, r]) + np.array(grid) * GRID_SPACING
    published[11] = published[11] + 0.003
    published[12] = published[12][:-1]
    published[15] = published[15].copy()
    published[15][0, 0] = np.nan
    jobs_df = spark.createDataFrame(jobs, "job int, conformer int, rotamer int, gx int, gy int, gz int, nucleotide int")
    published_df = spark.createDataFrame([(n, x.tolist()) for n, x in published.items()], "job int, xyz array<array<double>>")
    args = (jobs_df, published_df, conf, rot, [list(range(6))] * 2, [ring.tolist()] * 2, frame.ravel().tolist(), centre.tolist())
    got = {r.job: r for r in rebuild.prepared(*args).collect()}
    for n in range(8):
        turned = superpose.ring_rotation(published[n][:6], ring)
        relative = turned.T @ frame.T
        at = (published[n][:6].mean(0) - centre) @ frame.T
        d = np.linalg.norm(at)
        assert got[n].error is None and abs(got[n].d - d) < 1e-9
        assert abs(got[n].phi - math.acos(abs(at[2]) / d)) < 1e-9 and abs(got[n].theta - math.acos(abs(relative[2, 2]))) < 1e-7
    assert [got[n].error for n in range(8, 16)] == [
        "conformer 9 is not in the library", "rotamer 9 of conformer 0 is not in the library", "no published coordinates",
        "reconstructed pose RMSD 0.005196 exceeds 0.002", "7 published atoms for a pose of 8", "ring has no plane",
        "nucleotide is neither first nor second", "coordinates are not numbers",
    ]
    assert all(got[n].d is None for n in range(8, 16))
    rows = rebuild.check_rebuilt(*args).collect()
    assert len(rows) == 8 * 12 + 8
    assert {(r.job, r.state) for r in rows if r.error} == {(n, "error") for n in range(8, 16)}


@pytest.mark.parametrize("max_cells", [10**6, 0])
def test_energy_errors_stay_with_their_pose(spark, monkeypatch, max_cells):
    from strandloom import staging

    monkeypatch.setattr(staging, "HOT_ROWS", 5)
    rng = np.random.default_rng(31)
    receptor = [(*map(float, x), n % 2) for n, x in enumerate(rng.normal(size=(40, 3)) * 2)]
    poses = {n: (rng.normal(size=(4, 3)) * 2).tolist() for n in range(12)}
    types = {n: [0, 1, 0, 1] for n in poses}
    poses[3] = [[100.0, 0.0, 0.0]] * 4
    types[4] = [0, 1]
    poses[5][2] = [0.0, float("inf"), 0.0]
    types[6] = [0, 5, 0, 1]
    poses[7] = None
    types[8] = [0, None, 1, 1]
    poses[9], types[9] = [], []
    df = spark.createDataFrame([(n, poses[n], types[n]) for n in poses], "pose_id bigint, xyz array<array<double>>, types array<int>")
    rec = spark.createDataFrame(receptor, "x double, y double, z double, type int")
    kernel = lambda square, a, b: (a + b + 1) / (square + 1.0)
    got = {r.pose_id: r for r in energy.score_each(df, rec, kernel, 2.5, types=[0, 1], max_cells=max_cells).collect()}
    assert {n: got[n].error for n in (4, 5, 6, 7, 8)} == {
        4: "4 coordinates but 2 types", 5: "coordinates are not numbers", 6: "unknown atom type 5", 7: "no atoms", 8: "unknown atom type null",
    }
    assert got[3].score == 0.0 and got[9].score == 0.0 and len(got) == 12
    for n in (0, 1, 2, 10, 11):
        want = 0.0
        for atom, a in zip(poses[n], types[n]):
            for x, y, z, b in receptor:
                square = sum((p - q) ** 2 for p, q in zip(atom, (x, y, z)))
                want += (a + b + 1) / (square + 1.0) if square < 6.25 else 0.0
        assert got[n].error is None and abs(got[n].score - want) < 1e-9
    with pytest.raises(Exception, match="pose [45678]: "):
        energy.score_poses(df.where("pose_id in (4, 5)"), rec, kernel, 2.5).collect()


def test_fragments_of_structures_need_one_exchange(spark):
    atoms = [
        (s, resid, "ACGU"[(resid + (s or 0)) % 4], name, float(resid), gap * (resid == 4), 0.0)
        for s, last in ((1, 6), (2, 3), (None, 4)) for resid in range(1, last) for name, gap in (("P", 9.0), ("O3'", 0.0))
        if (s, resid) != (2, 2)
    ]
    df = spark.createDataFrame(atoms, "structure int, resid int, resname string, name string, x double, y double, z double")
    template = spark.createDataFrame([(b, n, k) for b in "ACGU" for k, n in enumerate(["P", "O3'"])], "base string, name string, place int")
    found = structure.dinucleotides(structure.nucleotides(df, template))
    texts = found.groupBy("structure", "fragment", "sequence").agg(F.max(F.size("coords")).alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = texts._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(structure") == 1 and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    got = sorted((r.structure, r.fragment, r.sequence, r.n) for r in texts.collect())
    assert got == [(1, 1, "GU", 4), (1, 2, "UA", 4), (1, 4, "CG", 4)]  # no neighbours, a break, and no structure


def test_a_shared_reference_ring_is_looked_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    rings = [*rng.normal(size=(50, 18)), np.arange(18.0), rng.normal(size=15), None]
    reference = rng.normal(size=18)
    targets = [reference] * len(rings)
    seen, whole = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda x, *a, **k: seen.append((len(x), k)) or whole(x, *a, **k))
    got = superpose.plane_rotation.func(pd.Series(rings, dtype=object), pd.Series(targets))
    assert sum(n for n, k in seen if k) == 51 + 1
    assert [x is None for x in got] == [False] * 50 + [True] * 3
    for ring, turn in zip(rings[:50], got):
        want = superpose.ring_rotation(ring.reshape(6, 3), reference.reshape(6, 3))
        np.testing.assert_allclose(np.array(turn).reshape(3, 3), want, atol=1e-12)
