"""Text and array sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.constants import POSE
from strandloom.operators import pool
from strandloom.sources import arrays, pdb, poses, tables


def atoms_frame(spark, models=2):
    rows = []
    for model in range(1, models + 1):
        for n, (name, resname, chain, resid) in enumerate(
            [("P", "RG", "B", 1), ("N1", "RG", "B", 1), ("O3'", "RU", "B", 2), ("HO5'", "RU", "B", 4)], start=1
        ):
            rows.append((model, "", name, " ", resname, chain, n, " ", resid, n * 1.5, -n / 8, 2.0, 1.0, 0.0, "", "C"))
    return spark.createDataFrame(
        rows,
        "model int, hetero string, name string, altloc string, resname string, chain string, index int, icode string, "
        "resid int, x double, y double, z double, occupancy double, bfactor double, segid string, element string",
    )


def test_pdb_round_trip(spark, tmp_path):
    given = atoms_frame(spark, 3)
    pdb.write_models(given, str(tmp_path / "out"))
    text = "\n".join(
        p.read_text() for p in sorted((tmp_path / "out").glob("part-*.txt"))
    ).replace("\n\n", "\n")
    assert text.count("MODEL ") == 3 and text.count("ENDMDL") == 3
    assert text.count("TER") == 3  # residue 2 to 4 jumps
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "all.pdb").write_text(text)
    keys = ["model", "index", "name", "resname", "chain", "resid", "x", "y", "z", "occupancy", "bfactor"]
    back = pdb.read_pdb(spark, str(tmp_path / "in"))
    assert sorted(map(tuple, back.select(*keys).collect())) == sorted(map(tuple, given.select(*keys).collect()))


def test_pdb_without_models(spark, tmp_path):
    line = "HETATM   12  O   HOH A 101       1.000   2.000  -3.500 -1.00 20.00           O  "
    (tmp_path / "a.pdb").write_text(f"TITLE     A MODEL OF WATER\n{line}\nEND\n")
    row = pdb.read_pdb(spark, str(tmp_path)).first()
    assert (row.model, row.hetero, row["index"], row.resid, row.z) == (1, "H", 12, 101, -3.5)
    assert row.occupancy == 0.0 and row.bfactor == 0.0


def test_complex_models(spark):
    rna = atoms_frame(spark, 2)
    protein = atoms_frame(spark, 1).withColumn("resname", F.lit("ALA"))
    both = pdb.complex_models(protein, rna).orderBy("model", "index").collect()
    assert len(both) == 2 * (4 + 3)  # the first phosphate is gone
    assert [r.chain for r in both[:7]] == ["A"] * 4 + ["B"] * 3
    assert [r["index"] for r in both[:7]] == list(range(1, 8)) and both[4].resname == "G"


def packed(path, frames, sizes=True):
    """Replace a file by a zstd file of so many frames."""
    import zstandard

    raw = path.read_bytes()
    cut = np.linspace(0, len(raw), frames + 1).astype(int)
    pack = zstandard.ZstdCompressor(write_content_size=sizes, write_checksum=True)
    path.unlink()
    target = path.with_name(path.name + ".zst")
    target.write_bytes(b"".join(pack.compress(raw[x:y]) for x, y in zip(cut, cut[1:])))
    return target


@pytest.mark.parametrize("frames,sizes", [(0, True), (1, True), (40, True), (40, False)])
def test_npy_columns_in_ranges(spark, tmp_path, frames, sizes):
    """Plain files by row ranges, compressed ones by frames; rows may cross frames."""
    values = np.random.default_rng(1).normal(size=5000)
    path = tmp_path / "score.npy"
    np.save(path, values)
    if frames:
        packed(path, frames, sizes)
    df = arrays.read_npy(spark, str(path), "score", task_bytes=4000, chunk=1000)
    got = df.orderBy("pose_id").collect()
    assert [r.pose_id for r in got] == list(range(5000)) and np.array_equal([r.score for r in got], values)
    assert df.rdd.getNumPartitions() == {(0, True): 10, (1, True): 1, (40, True): 14, (40, False): 1}[frames, sizes]


def test_array_faults(spark, tmp_path):
    path = tmp_path / "a.npy"
    np.save(path, np.arange(10))
    whole = path.read_bytes()
    for raw in (whole[:-3], whole + b"x"):
        path.write_bytes(raw)
        with pytest.raises(Exception, match="do not fit"):
            arrays.read_npy(spark, str(path)).collect()
    path.write_bytes(whole + b"x")
    packed(path, 2)
    with pytest.raises(Exception, match="do not fit"):
        arrays.read_npy(spark, str(path)).collect()
    with pytest.raises(FileNotFoundError):
        arrays.read_npy(spark, str(tmp_path / "none.npy"))
    np.save(path, np.zeros((2, 2)))
    with pytest.raises(ValueError, match="one dimension"):
        arrays.read_npy(spark, str(path))


@pytest.mark.parametrize("width", [0, 3])
def test_array_writer_round_trip(spark, tmp_path, width):
    values = np.random.default_rng(3).normal(size=(1000, width) if width else 1000)
    rows = [(n, v.tolist()) for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"pose_id bigint, v {'array<double>' if width else 'double'}").repartition(7)
    folder = tmp_path / "out"
    arrays.write_arrays(df, str(folder), "v", width=width, rows_per_file=300)
    parts = sorted(folder.iterdir())
    assert [p.name for p in parts] == [f"part-{n:015d}.npy" for n in (0, 300, 600, 900)]
    assert np.array_equal(np.concatenate([np.load(p) for p in parts]), values)
    back = arrays.read_arrays(spark, str(folder), "v").orderBy("row").collect()
    assert np.array_equal([r.v for r in back], values)


def test_failed_writes_leave_nothing(spark, tmp_path):
    gap = spark.createDataFrame([(n, 1.0) for n in range(50) if n != 20], "pose_id bigint, v double")
    apart = spark.createDataFrame([(n, 1.0) for n in range(50) if not 20 <= n < 30], "pose_id bigint, v double")
    twice = spark.createDataFrame([(n // 2, 1.0) for n in range(50)], "pose_id bigint, v double")
    for name, df in (("gap", gap), ("apart", apart), ("twice", twice)):
        with pytest.raises(Exception, match="dense|missing or repeated"):
            arrays.write_arrays(df, str(tmp_path / name), "v", rows_per_file=10)
        assert not (tmp_path / name).exists() or list((tmp_path / name).iterdir()) == []
    bad = spark.createDataFrame([(0, 70_000, 1, 0, 0, 0)], "source_id int, conformer int, rotamer int, gx int, gy int, gz int")
    with pytest.raises(Exception):
        poses.write_poses(pool.organize(bad, ["source_id"]), str(tmp_path / "bad"), b"m")
    assert not (tmp_path / "bad").exists() or list((tmp_path / "bad").iterdir()) == []


def test_pose_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(n, int(rng.integers(3)), int(rng.integers(4)), *map(int, rng.integers(-30, 30, 3))) for n in range(200)]
    rows += [(200 + n, 1, 1, 5, 5, 5) for n in range(50)]
    df = spark.createDataFrame(rows, "source_id int, conformer int, rotamer int, gx int, gy int, gz int")
    organized = pool.organize(df, ["source_id"])
    folder = tmp_path / "poses"
    written = poses.write_poses(organized, str(folder), b"marker1", rows_per_file=20).collect()
    assert sum(r.poses for r in written) == 250 and max(r.poses for r in written) == 20
    assert all(p.name.startswith("poses_") for p in folder.iterdir())
    # Several tasks a file, and files compressed here and there.
    for path in sorted(folder.iterdir())[::3]:
        packed(path, 2)
    back = poses.read_poses(spark, str(folder), b"marker1", task_bytes=60)
    assert sorted(map(tuple, back.select(*POSE).collect())) == sorted(r[1:] for r in rows)
    assert back.rdd.getNumPartitions() > len(written)
    assert poses.count_poses(spark, str(folder), b"marker1").agg(F.sum("poses")).first()[0] == 250
    # Places in the file are those of the pool.
    most = max(written, key=lambda r: r.poses).file
    places = sorted(r.row for r in back.where(F.col("file").startswith(most)).collect())
    assert places == list(range(20))
    with pytest.raises(Exception, match="wrong file mark"):
        poses.read_poses(spark, str(folder), b"another").collect()
    plain = next(p for p in sorted(folder.iterdir()) if p.suffix == ".bin")
    whole = plain.read_bytes()
    for raw, message in ((whole[:-1], "too short"), (whole + b"x", "data after")):
        plain.write_bytes(raw)
        with pytest.raises(Exception, match=message):
            poses.read_poses(spark, str(folder), b"marker1").collect()


def test_chain_table_round_trip(spark, tmp_path):
    table = spark.createDataFrame([(n, n % 3 + 1, n + 1) for n in range(1, 9)], "chain bigint, a bigint, b bigint")
    columns = [{"pool": "a", "fragment": 2, "sequence": "AC"}, {"pool": "b", "fragment": 3, "sequence": "CG"}]
    tables.write_chains(table, ["a", "b"], str(tmp_path / "c"), columns)
    back, described = tables.read_chains(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == sorted((r.a, r.b) for r in table.collect())
    assert tables.chain_sequences(described) == ["AC", "CG"]
    assert tables.chain_sequences(described, "guu") == ["GU", "UU"]
    with pytest.raises(ValueError):
        tables.chain_sequences(described, "gu")


def test_best_fit_table_and_bead_map(spark, tmp_path):
    path = tmp_path / "fit.tsv"
    path.write_text("fragment\tsequence\tconformer\trotamer\tgrid_x\tgrid_y\tgrid_z\trmsd\n3\tGU\t5\t7\t-1\t2\t3\t0.5\n")
    row = tables.read_best_fits(spark, str(path)).first()
    assert (row.conformer, row.rotamer, row.gx, row.rmsd) == (4, 6, -1, 0.5)
    path.write_text("fragment\tx\n")
    with pytest.raises(ValueError, match="expected columns"):
        tables.read_best_fits(spark, str(path))
    beads = tmp_path / "beads.dat"
    beads.write_text("# comment\nRES\n30 N N\n6 SIDE CA CB CG -1.0\n")
    got = sorted(map(tuple, tables.read_bead_map(spark, str(beads)).collect()))
    assert got == [("RES", 0, 30, "N", 1), ("RES", 1, 6, "CA", 3), ("RES", 1, 6, "CB", 3), ("RES", 1, 6, "CG", 3)]


def test_parameter_files():
    text = json.dumps({"schema": 1, "pairs": [{"down": 1, "up": 2, "crmsd": 0.25, "ovrmsd": "1.30"}]})
    assert tables.parse_constraints(text) == {(1, 2): {"crmsd": 0.25, "ovrmsd": 1.3}}
    with pytest.raises(ValueError, match="two decimals"):
        tables.parse_constraints(text.replace("0.25", "0.255"))
    with pytest.raises(ValueError, match="adjacent"):
        tables.parse_constraints(text.replace('"up": 2', '"up": 3'))
    good = json.dumps({"schema": 1, "frag-1-AC": {"range-2": "-7.25"}})
    assert tables.parse_energy_thresholds(good) == {"frag-1-AC": {"range-2": -7.25}}
    with pytest.raises(ValueError):
        tables.parse_energy_thresholds(good.replace("-7.25", "-7.2"))
    assert tables.substitute({"root": "/d", "lib": "$root/l", "x": "$lib/x"})["x"] == "/d/l/x"
    with pytest.raises(ValueError, match="circle"):
        tables.substitute({"a": "$b/", "b": "$a/"})


def test_arrays_of_any_shape_and_library_files(spark, tmp_path):
    import zstandard

    from strandloom.sources import library

    rng = np.random.default_rng(3)
    whole = rng.normal(size=(7, 4, 3)).astype("<f4")
    folder = tmp_path / "conformers"
    folder.mkdir()
    np.save(folder / "a.npy", whole[:3])
    np.save(tmp_path / "b.npy", whole[3:])
    raw = (tmp_path / "b.npy").read_bytes()
    frames = [zstandard.compress(raw[:50]), zstandard.compress(raw[50:])]
    (folder / "b.npy.zst").write_bytes(b"".join(frames))
    got = {r.conformer: r.coords for r in library.read_conformers(spark, str(folder)).collect()}
    assert sorted(got) == list(range(7)) and all(np.allclose(got[n], whole[n]) for n in got)
    np.save(tmp_path / "v.npy", rng.normal(size=(6, 3)))
    np.save(tmp_path / "ends.npy", np.array([2, 2, 6], np.uint32))
    rotamers = library.read_rotamers(spark, str(tmp_path / "v.npy"), str(tmp_path / "ends.npy"))
    rows = sorted((r.conformer, r.rotamer, round(r.rx, 9)) for r in rotamers.collect())
    first = np.load(tmp_path / "v.npy")[:, 0].round(9).tolist()
    assert rows == [(c, r, x) for (c, r), x in zip([(0, 0), (0, 1), (2, 0), (2, 1), (2, 2), (2, 3)], first)]
    np.save(tmp_path / "ends.npy", np.array([2, 5], np.uint32))
    with pytest.raises(Exception, match="end indices differ"):
        library.read_rotamers(spark, str(tmp_path / "v.npy"), str(tmp_path / "ends.npy")).collect()
    matrix = rng.random((2, 3))
    np.save(tmp_path / "m.npy", matrix)
    pairs = {(r.lower, r.upper): r.crmsd for r in library.read_crmsds(spark, str(tmp_path / "m.npy")).collect()}
    assert pairs == {(i, j): matrix[i, j] for i in range(2) for j in range(3)}
    np.save(folder / "c.npy", np.zeros((2, 5)))
    with pytest.raises(ValueError, match="parts differ"):
        arrays.read_arrays(spark, str(folder))
    (tmp_path / "short.npy").write_bytes(raw[:-4])
    with pytest.raises(Exception, match="do not fit"):
        arrays.read_arrays(spark, str(tmp_path / "short.npy"))


def test_rmsd_output_formats(spark, tmp_path):
    rmsds = spark.createDataFrame([(2, 0.5), (0, 1.25), (1, 2.0)], "pose_id bigint, rmsd double")
    tables.write_rmsds(rmsds, str(tmp_path / "t"), format="text")
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["1.250", "2.000", "0.500"]
    tables.write_rmsds(rmsds, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    with pytest.raises(ValueError, match="format"):
        tables.write_rmsds(rmsds, str(tmp_path / "x"), format="tsv")


def test_library_of_a_sequence_from_files(spark, tmp_path):
    from strandloom.functions.nucleotides import ATOMS
    from strandloom.sources import library

    rng = np.random.default_rng(5)
    atoms = ATOMS["A"] + ATOMS["C"]
    shapes = {name: rng.normal(size=(n, atoms, 3)) * 3 for name, n in (("main", 4), ("other", 4), ("more", 2))}
    for name, coords in shapes.items():
        np.save(tmp_path / f"{name}-AC.npy", coords)
    for name, counts in (("main", [2, 1, 3, 1]), ("more", [1, 2])):
        np.save(tmp_path / f"{name}-turns-AC.npy", rng.normal(size=(sum(counts), 3)))
        np.save(tmp_path / f"{name}-ends-AC.npy", np.cumsum(counts))
    origins = spark.createDataFrame([(n, c) for n, c in enumerate(["1abc", "2xyz", "1abc", "3def", "2XYZ", "4ghi"])], "conformer int, origin string")
    at = lambda name: str(tmp_path / f"{name}-{{}}.npy")
    conf, rot = library.load_library(
        spark, "GU", at("main"), (at("main-turns"), at("main-ends")), replacements=at("other"), extensions=at("more"),
        extension_rotamers=(at("more-turns"), at("more-ends")), origins=origins, exclude=["2xyz"],
    )
    rows = {r.conformer: r for r in conf.collect()}
    assert sorted(rows) == [0, 1, 2, 3, 5] and [n for n in rows if rows[n].replaced] == [1]
    assert all(len(r.coords) == ATOMS["G"] + ATOMS["U"] for r in rows.values())
    used = {0: shapes["main"][0], 1: shapes["other"][1], 5: shapes["more"][1]}
    for n, coords in used.items():
        got = np.array(rows[n].coords)
        assert np.allclose(got.mean(0), 0, atol=1e-9)
        # The last base keeps its shape: C and U differ by names alone.
        assert np.allclose(got[ATOMS["G"]:] - got[-1], coords[ATOMS["A"]:] - coords[-1])
    counts = {r.conformer: r["count"] for r in rot.groupBy("conformer").count().collect()}
    assert counts == {0: 2, 1: 1, 2: 3, 3: 1, 5: 2}
    with pytest.raises(ValueError, match="origins"):
        library.load_library(spark, "GU", at("main"), (at("main-turns"), at("main-ends")), exclude=["2xyz"])


def test_fragment_files_and_atom_types(spark, tmp_path):
    from strandloom.operators import library
    from strandloom.sources import texts

    kept = "hetero string, name string, altloc string, resname string, chain string, index int, icode string, resid int, " \
        "occupancy double, bfactor double, segid string, element string"
    template = spark.createDataFrame(
        [("GU", 0, "", "P", " ", "G", "A", 1, " ", 1, 1.0, 0.0, "A", "P"), ("GU", 1, "", "O3'", " ", "U", "A", 2, " ", 2, 1.0, 0.0, "A", "O")],
        f"sequence string, place int, {kept}",
    )
    fragments = spark.createDataFrame(
        [(1, 3, "GU", [[1.0, 2.0, 3.0], [-4.5, 0.25, 100.125]]), (1, 4, "GU", [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]])],
        "structure int, fragment int, sequence string, coords array<array<double>>",
    )
    made = pdb.fragment_texts(fragments, template)
    texts.write_texts(made, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["frag-3-GU-refe.pdb", "frag-4-GU-refe.pdb"]
    back = pdb.read_pdb(spark, str(tmp_path / "out" / "frag-3-GU-refe.pdb")).orderBy("index").collect()
    assert [(r.name, r.resname, r.resid, r.x, r.y, r.z) for r in back] == [("P", "G", 1, 1.0, 2.0, 3.0), ("O3'", "U", 2, -4.5, 0.25, 100.125)]
    with pytest.raises(Exception, match="two files"):
        texts.write_texts(made.select(F.lit("same").alias("name"), "text"), str(tmp_path / "twice"))
    assert list((tmp_path / "twice").iterdir()) == []
    with pytest.raises(Exception, match="differ in atoms"):
        pdb.fragment_texts(fragments.withColumn("coords", F.slice("coords", 1, 1)), template).collect()
    types = spark.createDataFrame([(0, 31.0), (1, 46.0)], "place int, occupancy double")
    assert [r.atom_type for r in library.atom_types(types).orderBy("place").collect()] == [31, 46]
    with pytest.raises(Exception, match="no atom type"):
        library.atom_types(types.withColumn("occupancy", F.col("occupancy") + 0.5)).collect()
