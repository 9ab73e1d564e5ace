"""Growing: all poses of the next fragment that overlap a pose of this one.

A target pose is accepted when the shared nucleotide's RMSD to the source pose is
below the overlap threshold and the two conformers are compatible.  The squared
deviation is a rotation part plus a translation part, so

1. distinct source rotations meet target rotamers by an equi-join on conformer and
   on six-dimensional cells of two projections that never differ by more than the
   rotation part allows;
2. the translation ball of each surviving rotation pair is enumerated axis by axis, without
   waste; grid points are integers, so it is the same about every source pose; and
3. source poses are joined with these steps.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.constants import GRID_SPACING, MAX_GRID, MAX_INDEX, MAX_OVRMSD, MIN_GRID, POSE
from strandloom.functions import vectors as v
from strandloom.operators.pool import pose_columns
from strandloom.staging import row_bound, skew_join, spread, stage

FEW_POSES = 500_000  # steps, or blocks of poses, that are sent to every task, about 50 MB


def valid_ovrmsd(value: float) -> float:
    value = float(value)
    if not math.isfinite(value) or not 0 < value <= MAX_OVRMSD:
        raise ValueError(f"overlap RMSD must be in (0, {MAX_OVRMSD:.10g}]")
    return value


def _axes(conformers: DataFrame) -> list[list[float]]:
    """Up to two orthonormal weights over atoms, along the longest axes of one shape.

    Any such weights give a valid bound.  Two long axes together pin the rotation; with one,
    everything that differs by a turn about it would still meet.
    """
    coords = np.asarray(conformers.orderBy("conformer").select("coords").first()[0], dtype=float)
    u, _, _ = np.linalg.svd(coords - coords.mean(axis=0), full_matrices=False)
    return u[:, :2].T.tolist()


def _shapes(conformers: DataFrame, axes: list[list[float]], prefix: str) -> DataFrame:
    """Centroid, scatter, centred coordinates and projected points of each conformer."""
    checked = F.when(F.size("coords") == len(axes[0]), F.col("coords")).otherwise(
        F.raise_error(F.lit("shared nucleotide differs in atoms"))
    )
    df = conformers.select("conformer", checked.alias("coords")).withColumn(
        "mean", v.centroid(F.col("coords"))
    )
    df = df.withColumn("c", v.centred(F.col("coords"), F.col("mean")))
    points = []
    for weights in axes:
        weighted = F.zip_with("c", F.lit(weights), lambda a, w: F.transform(a, lambda x: x * w))
        points.append(F.array(*[v.axis_sum(weighted, k) for k in range(3)]))
    return df.select(
        F.col("conformer").alias(f"{prefix}_conf"),
        F.col("mean").alias(f"{prefix}_mean"),
        F.col("c").alias(f"{prefix}_c"),
        v.square_sum(F.col("c")).alias(f"{prefix}_scatter"),
        F.array(*points).alias(f"{prefix}_points"),
    )


def rotation_candidates(
    source_rotations: DataFrame,
    source_conformers: DataFrame,
    target_conformers: DataFrame,
    target_rotamers: DataFrame,
    conformer_pairs: DataFrame,
    ovrmsd: float,
) -> DataFrame:
    """Source and target rotations that meet in a cell, with all that their RMSD needs.

    A cell spans the three coordinates of each projected point.  A source rotation lies in
    one cell; a target rotation is put into every cell it may be near enough to, at most two
    an axis.  Both sides are written first, so hot cells are known and split.
    """
    axes = _axes(target_conformers)
    atoms = len(axes[0])
    # |w C_s R_s - w C_t R_t| <= sqrt(atoms) * rmsd for unit w (Cauchy-Schwarz).
    reach = math.sqrt(atoms) * valid_ovrmsd(ovrmsd) * (1 + 1e-9)
    width = 2.0 * reach
    cells = [f"x{n}" for n in range(3 * len(axes))]
    source_shapes = _shapes(source_conformers, axes, "s")
    target_shapes = _shapes(target_conformers, axes, "t")

    pairs = (
        conformer_pairs.select(F.col("source").alias("s_conf"), F.col("target").alias("t_conf"))
        .join(source_shapes, "s_conf")
        .join(target_shapes.drop("t_points"), "t_conf")
        .select(
            "s_conf",
            "t_conf",
            v.cross_moment(F.col("s_c"), F.col("t_c")).alias("moment"),
            ((F.col("s_scatter") + F.col("t_scatter")) / atoms).alias("base"),
            "s_mean",
            "s_points",
        )
    )
    m = F.col("m")
    # Moment transposed times the source rotation: nine numbers per source rotation.
    turned = [
        sum(
            (v.component(F.col("moment"), 3 * i + j) * v.component(m, 3 * i + k) for i in (1, 2)),
            v.component(F.col("moment"), j) * v.component(m, k),
        )
        for j in range(3)
        for k in range(3)
    ]

    def projected(points):
        return [c for n in range(len(axes)) for c in v.rotate(F.get(points, F.lit(n)), m)]

    left = source_rotations.join(pairs, F.col("conformer") == F.col("s_conf")).select(
        "conformer",
        "rotamer",
        "t_conf",
        "base",
        F.array(*turned).alias("turned"),
        F.array(*v.rotate(F.col("s_mean"), m)).alias("s_at"),
        *[F.floor(c / width).alias(x) for c, x in zip(projected(F.col("s_points")), cells)],
    )
    right = target_rotamers.join(
        target_shapes.drop("t_c", "t_scatter"), F.col("conformer") == F.col("t_conf")
    ).select(
        "t_conf",
        F.col("rotamer").alias("t_rot"),
        m.alias("t_m"),
        F.array(*v.rotate(F.col("t_mean"), m)).alias("t_at"),
        *[
            F.sequence(F.floor((c - reach) / width), F.floor((c + reach) / width)).alias(x)
            for c, x in zip(projected(F.col("t_points")), cells)
        ],
    )
    for x in cells:
        right = right.withColumn(x, F.explode(x))
    left, right = stage(left, "source-cells"), stage(right, "target-cells")
    return skew_join(left, right, ["t_conf", *cells]).drop(*cells)


def rotation_pairs(
    source_rotations: DataFrame,
    source_conformers: DataFrame,
    target_conformers: DataFrame,
    target_rotamers: DataFrame,
    conformer_pairs: DataFrame,
    ovrmsd: float,
) -> DataFrame:
    """Source and target rotations whose rotation part alone is within the threshold.

    Gives ``(conformer, rotamer, t_conf, t_rot, rotated, a0..a2)``: the mean square
    rotation part and the difference of the two turned centroids.
    """
    atoms = len(target_conformers.orderBy("conformer").select("coords").first()[0])
    met = rotation_candidates(
        source_rotations, source_conformers, target_conformers, target_rotamers, conformer_pairs, ovrmsd
    )
    rotated = F.greatest(
        F.col("base") - v.dot(F.col("turned"), F.col("t_m"), 9) * (2.0 / atoms), F.lit(0.0)
    )
    return met.withColumn("rotated", rotated).where(F.col("rotated") < ovrmsd * ovrmsd).select(
        "conformer",
        "rotamer",
        "t_conf",
        "t_rot",
        "rotated",
        *[(F.get("s_at", F.lit(k)) - F.get("t_at", F.lit(k))).alias(f"a{k}") for k in range(3)],
    )


def lattice_ball(candidates: DataFrame, centre: list[str], square: Column) -> DataFrame:
    """Rows with every grid point strictly inside ``square`` of the centre.

    ``centre`` and ``square`` are in grid units.  Axes are expanded one after the
    other, each within what the earlier ones leave.
    """
    cx, cy, cz = (F.col(c) for c in centre)
    slack = 1e-9  # the strict test below decides; this only keeps candidates
    rest = square + slack
    df = candidates.withColumn("gx", F.explode(v.ball_axis(cx, rest)))
    used_x = (F.col("gx") - cx) * (F.col("gx") - cx)
    df = df.withColumn("gy", F.explode(v.ball_axis(cy, rest - used_x)))
    used_y = used_x + (F.col("gy") - cy) * (F.col("gy") - cy)
    df = df.withColumn("gz", F.explode(v.ball_axis(cz, rest - used_y)))
    used = used_y + (F.col("gz") - cz) * (F.col("gz") - cz)
    return df.where(used < square)


def grow(
    source: DataFrame,
    source_conformers: DataFrame,
    source_rotamers: DataFrame,
    target_conformers: DataFrame,
    target_rotamers: DataFrame,
    crmsds: DataFrame,
    *,
    crmsd: float,
    ovrmsd: float,
    restrict: DataFrame | None = None,
) -> DataFrame:
    """Grown poses with the source pose as ``parent_id``; copies are kept.

    Both conformer tables hold the shared nucleotide's atoms only.
    ``crmsds(source, target, crmsd)`` decides which conformers may follow.
    """
    pairs = crmsds.where((F.col("crmsd") < crmsd) & ~F.isnan("crmsd"))
    if restrict is not None:
        restrict = stage(_blocks(restrict), "restrict")
        rotations = restrict.select("conformer", "rotamer").distinct()
        target_rotamers = target_rotamers.join(rotations, ["conformer", "rotamer"], "left_semi")
        pairs = pairs.join(
            rotations.select(F.col("conformer").alias("target")).distinct(), "target", "left_semi"
        )
    used = source.select("conformer", "rotamer").distinct()
    source_rotations = used.join(source_rotamers, ["conformer", "rotamer"])
    matched = stage(
        rotation_pairs(
            source_rotations, source_conformers, target_conformers, target_rotamers, pairs, ovrmsd
        ),
        "rotation-pairs",
    )
    return _translate(source, matched, ovrmsd, restrict)


_BLOCK = [f"_{g}" for g in ("gx", "gy", "gz")]


def _block_place():
    """Bit of a grid point in its block of 4 x 4 x 4."""
    x, y, z = (F.col(g).bitwiseAND(F.lit(3)).cast("int") for g in ("gx", "gy", "gz"))
    return x * 16 + y * 4 + z


def _with_block(poses):
    return poses.withColumns({b: F.shiftright(F.col(g).cast("bigint"), 2) for g, b in zip(("gx", "gy", "gz"), _BLOCK)})


def _blocks(poses):
    """Distinct poses as blocks of grid points, a bit each."""
    # Powers of two as SQL, as a shift by a column has no function.
    bit = F.expr("shiftleft(1L, _bit)")
    marked = _with_block(poses).withColumn("_bit", _block_place())
    return marked.groupBy("conformer", "rotamer", *_BLOCK).agg(F.bit_or(bit).alias("_points"))


def _translate(source, matched, ovrmsd, restrict):
    limit = F.lit(ovrmsd * ovrmsd)
    away = [F.col(f"a{k}") / GRID_SPACING for k in range(3)]
    centred = matched.withColumns({f"c{k}": c for k, c in enumerate(away)})
    square = (limit - F.col("rotated")) / GRID_SPACING**2
    near = lattice_ball(spread(centred, row_bound(matched)), ["c0", "c1", "c2"], square)
    steps = stage(
        near.select("conformer", "rotamer", "t_conf", "t_rot", *[F.col(g).alias(f"d{g}") for g in ("gx", "gy", "gz")]),
        "steps",
    )
    poses = source.select(
        F.col("pose_id").alias("parent_id"),
        "conformer",
        "rotamer",
        *[F.col(g).alias(f"s{g}") for g in ("gx", "gy", "gz")],
    )
    rows, known = row_bound(source), row_bound(steps)
    poses = spread(poses, rows, "parent_id")
    if known <= FEW_POSES:
        met = poses.join(F.broadcast(steps), ["conformer", "rotamer"])
    else:
        met = skew_join(poses, steps, ["conformer", "rotamer"], left_rows=rows, right_rows=known, counted=source)
    grid = [F.col(f"s{g}") + F.col(f"d{g}") for g in ("gx", "gy", "gz")]
    if restrict is None:
        return met.select(*pose_columns(F.col("t_conf"), F.col("t_rot"), *grid), "parent_id")
    grown = met.select("t_conf", "t_rot", *[c.cast("bigint").alias(f"t{g}") for g, c in zip(("gx", "gy", "gz"), grid)], "parent_id")
    pose = [F.col(c) for c in ("t_conf", "t_rot", "tgx", "tgy", "tgz")]
    looked = _looked_up(grown, pose, restrict)
    return looked.select(*[c.cast("int").alias(n) for c, n in zip(pose, POSE)], "parent_id")


def _looked_up(grown, pose, restrict):
    """Rows of ``grown`` whose ``pose`` is one of the blocks ``restrict``; a pose that fits no field is an error.

    Most rows find nothing, so a row costs one hash of its block.  A broadcast table is looked up by that hash alone,
    which is one number and never null; the fields themselves are compared where it is found.
    """
    fields = [c.cast("bigint") for c in pose]
    block = [*fields[:2], *[F.shiftright(c, 2) for c in fields[2:]]]
    limits = [(0, MAX_INDEX)] * 2 + [(MIN_GRID, MAX_GRID)] * 3
    fits = functools.reduce(operator.and_, [c.between(*x) for c, x in zip(fields, limits)])
    key = F.when(fits, F.xxhash64(*block)).otherwise(F.xxhash64(*pose_columns(*pose)))
    on = ["conformer", "rotamer", *_BLOCK]
    blocks = restrict.select(F.xxhash64(*[F.col(c).cast("bigint") for c in on]).alias("_key"), *on, "_points")
    keyed = grown.withColumn("_key", key)
    if row_bound(restrict) <= FEW_POSES:
        looked = keyed.join(F.broadcast(blocks), "_key")
    else:
        # A block grown from very many parents is split over tasks.
        looked = skew_join(stage(keyed, "grown"), blocks, ["_key"], right_rows=0)
    # Exclusive or, as an equality of both sides would be taken for a further key of the join.
    differ = functools.reduce(Column.bitwiseOR, [c.bitwiseXOR(F.col(n).cast("bigint")) for c, n in zip(block, on)])
    x, y, z = (c.bitwiseAND(F.lit(3)) for c in fields[2:])
    looked = looked.withColumn("_bit", (x * 16 + y * 4 + z).cast("int"))
    return looked.where((differ == 0) & F.expr("shiftright(_points, _bit) & 1L = 1L"))


def anchor_at_reference(
    reference: list[list[float]],
    target_conformers: DataFrame,
    target_rotamers: DataFrame,
    *,
    ovrmsd: float,
) -> DataFrame:
    """All poses whose overlap with one fixed reference nucleotide is near enough.

    The same join with a single source pose at the origin, and no lineage.
    """
    spark = target_conformers.sparkSession
    identity = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    shape = spark.createDataFrame(
        [(0, [[float(x) for x in atom] for atom in reference])], "conformer int, coords array<array<double>>"
    )
    pose = spark.createDataFrame(
        [(0, 0, 0, 0, 0, 0)], "pose_id bigint, conformer int, rotamer int, gx int, gy int, gz int"
    )
    rotation = spark.createDataFrame(
        [(0, 0, identity)], "conformer int, rotamer int, m array<double>"
    )
    pairs = target_conformers.select(
        F.lit(0).alias("source"), F.col("conformer").alias("target")
    )
    matched = rotation_pairs(rotation, shape, target_conformers, target_rotamers, pairs, ovrmsd)
    matched = stage(matched, "reference-pairs")
    return _translate(pose, matched, ovrmsd, None).drop("parent_id")


def discrete_ball(centres: DataFrame, centre: list[str], radius: Column) -> DataFrame:
    """Grid points strictly within ``radius`` (grid units) of each row's centre."""
    return lattice_ball(centres, centre, radius * radius)
