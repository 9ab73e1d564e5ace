"""Gaussian stacking score, its named filters and the grids it is evaluated on.

A ring placement has three descriptors: distance d, displacement phi from the
protein ring normal, and tilt theta between the normals.  The translation lattice
has integer points (i, j, k) a quarter Angstrom apart; rotations fall into Hopf
cells, six cube faces of 16 x 16 directions with 64 turns each.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.decimals import floor_decimal
from strandloom.functions.vectors import component

# Mean, precision matrix and normalizer of the Gaussian model over
# (distance in Angstrom, displacement in rad, tilt in rad).
MEAN = (3.778988652846167, 0.3359170155526752, 0.21710309041293038)
PRECISION = (
    (13.055035569772702, -9.829936278368704, -7.388302029768115),
    (-9.829936278368704, 31.531026898594526, -5.996886272605505),
    (-7.388302029768115, -5.996886272605505, 35.02664194314763),
)
NORMALIZER = 0.17639457343866755
# Variances of the three descriptors.
VARIANCE = (0.13402643421739668, 0.05051245758442225, 0.039514509672839315)

# Score cutoff of each recall target, before it is floored to 1e-5.
RAW_CUTOFFS = {
    50: 3.3038440180955031,
    60: 2.9043182397831022,
    70: 2.0419804149333398,
    80: 1.1974880057674258,
    90: 0.27592087772968793,
    95: 0.061416348507101752,
}
# Targets with a tilt and a displacement variant.
VARIANT_TARGETS = (90, 95)
# Limits of the common mask and of the two variants.
MAX_DISTANCE, MAX_DISPLACEMENT_DEG, TILT_DEG, DISPLACEMENT_DEG = 5, 60, 30, 45

# Shape of the rotation and translation grids.
HOPF_N, HOPF_TURNS = 16, 64
HOPF_CELLS = 6 * HOPF_N * HOPF_N * HOPF_TURNS
LATTICE_HALF, LATTICE_STEP = 20, 0.25

# Fixed value: least relative distance of a score from its cutoff.
AUDIT_MARGIN = 1e-10


def parse_name(name: str) -> tuple[int, bool, bool]:
    """Recall target and variant flags of a filter name such as ``rrm90-tilt30``."""
    found = re.fullmatch(r"rrm(\d+)(-tilt30)?(-disp45)?", name)
    if not found or int(found[1]) not in RAW_CUTOFFS:
        raise ValueError(f"invalid filter name {name!r}")
    target, tilt, displacement = int(found[1]), bool(found[2]), bool(found[3])
    if (tilt or displacement) and target not in VARIANT_TARGETS:
        raise ValueError(f"filter {name!r}: only targets {VARIANT_TARGETS} have variants")
    return target, tilt, displacement


def filter_names() -> list[str]:
    names = []
    for target in RAW_CUTOFFS:
        names.append(f"rrm{target}")
        if target in VARIANT_TARGETS:
            names += [f"rrm{target}{s}" for s in ("-tilt30", "-disp45", "-tilt30-disp45")]
    return names


def cutoff(name: str) -> float:
    return float(floor_decimal(RAW_CUTOFFS[parse_name(name)[0]]))


def contains(wide: str, narrow: str) -> bool:
    """Everything ``narrow`` accepts is accepted by ``wide``."""
    _, wide_tilt, wide_disp = parse_name(wide)
    _, tilt, disp = parse_name(narrow)
    return (
        wide != narrow
        and cutoff(narrow) >= cutoff(wide)
        and wide_tilt <= tilt
        and wide_disp <= disp
    )


def filter_table(spark: SparkSession) -> DataFrame:
    """The twelve filters: ``(filter, cutoff, tilt30, disp45)``."""
    rows = [(n, cutoff(n), *parse_name(n)[1:]) for n in filter_names()]
    return spark.createDataFrame(rows, "filter string, cutoff double, tilt30 boolean, disp45 boolean")


def containment_pairs(filters: DataFrame) -> DataFrame:
    """``(narrow, wide)`` pairs by cutoff and prefilters; twelve rows squared at most."""
    narrow = filters.select(*[F.col(c).alias(f"n_{c}") for c in filters.columns])
    wide = filters.select(*[F.col(c).alias(f"w_{c}") for c in filters.columns])
    return narrow.join(
        F.broadcast(wide),
        (F.col("n_filter") != F.col("w_filter"))
        & (F.col("n_cutoff") >= F.col("w_cutoff"))
        & (~F.col("w_tilt30") | F.col("n_tilt30"))
        & (~F.col("w_disp45") | F.col("n_disp45")),
    ).select(F.col("n_filter").alias("narrow"), F.col("w_filter").alias("wide"))


def score(d: Column, phi: Column, theta: Column) -> Column:
    x, y, z = (c - F.lit(m) for c, m in zip((d, phi, theta), MEAN))
    p = PRECISION
    q = (
        x * x * p[0][0]
        + y * y * p[1][1]
        + z * z * p[2][2]
        + (x * y * p[0][1] + x * z * p[0][2] + y * z * p[1][2]) * 2.0
    )
    return F.exp(q * -0.5) / NORMALIZER


def descriptors(r33: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(d, phi, theta); phi is NULL at d = 0, so nothing there is ever accepted."""
    d = F.sqrt(x * x + y * y + z * z)
    phi = F.when(d > 0, F.acos(F.abs(z) / d))
    return d, phi, F.acos(F.least(F.lit(1.0), F.abs(r33)))


def accept(d: Column, phi: Column, theta: Column, score_cutoff, tilt30, disp45) -> Column:
    """Acceptance of descriptors; the score passes at or above its cutoff."""
    passes = (
        (d < MAX_DISTANCE)
        & (phi < math.radians(MAX_DISPLACEMENT_DEG))
        & (~_flag(tilt30) | (theta < math.radians(TILT_DEG)))
        & (~_flag(disp45) | (phi < math.radians(DISPLACEMENT_DEG)))
        & (score(d, phi, theta) >= score_cutoff)
    )
    return F.coalesce(passes, F.lit(False))


def _flag(value) -> Column:
    return value if isinstance(value, Column) else F.lit(bool(value))


def translation_mask(i: Column, j: Column, k: Column, disp45=False) -> Column:
    """Exact integer form of the distance and displacement limits."""
    side = i * i + j * j
    return (
        (side + k * k < 400) & (k * k * 3 > side) & (~_flag(disp45) | (k * k > side))
    )


def rotation_mask(r33: Column, tilt30=False) -> Column:
    """Exact form of the tilt limit."""
    return ~_flag(tilt30) | (r33 * r33 * 4.0 > 3.0)


# ---------------------------------------------------------------- grids


def hopf_cell(matrix) -> Column:
    """Hopf cell of a rotation, read straight off the matrix.

    With base direction s and turn psi, the first row holds s as (s_z, -s_y, s_x)
    and the first column holds the base direction turned by psi.
    """
    m = [component(matrix, n) for n in range(9)]
    s = (m[2], -m[1], m[0])
    turn = (
        F.when(m[0] > 1.0 - 1e-12, F.atan2(m[7], m[8]))
        .when(m[0] < -1.0 + 1e-12, F.lit(0.0))
        .otherwise(F.atan2(m[3], -m[6]) - F.atan2(-m[1], m[2]))
    )
    psi = F.pmod(turn, F.lit(2 * math.pi))
    size = [F.abs(c) for c in s]
    x_major = (size[0] >= size[1]) & (size[0] >= size[2])
    y_major = ~x_major & (size[1] >= size[2])

    def pick(x, y, z):
        return F.when(x_major, x).when(y_major, y).otherwise(z)

    top = pick(*s)
    face = pick(F.lit(0), F.lit(2), F.lit(4)) + F.when(top < 0, 1).otherwise(0)

    def direction(value):
        bin_ = F.floor((F.atan(value / F.abs(top)) * (4 / math.pi) + 1.0) * HOPF_N / 2.0)
        return F.least(F.greatest(bin_, F.lit(0)), F.lit(HOPF_N - 1))

    p = direction(pick(s[1], s[0], s[0]))
    q = direction(pick(s[2], s[2], s[1]))
    t = F.least(F.floor(psi * HOPF_TURNS / (2 * math.pi)), F.lit(HOPF_TURNS - 1))
    return (((face * HOPF_N + p) * HOPF_N + q) * HOPF_TURNS + t).cast("int")


def _fibre(cell: Column) -> dict[str, Column]:
    """Half polar angle, azimuth and half turn of the centre of a Hopf cell."""
    turn = cell % HOPF_TURNS
    q = F.floor(cell / HOPF_TURNS) % HOPF_N
    p = F.floor(cell / (HOPF_TURNS * HOPF_N)) % HOPF_N
    face = F.floor(cell / (HOPF_TURNS * HOPF_N * HOPF_N))
    axis, sign = F.floor(face / 2), F.when(face % 2 == 0, 1.0).otherwise(-1.0)

    def minor(bin_):
        return F.tan(((bin_ + 0.5) * 2.0 / HOPF_N - 1.0) * (math.pi / 4))

    a, b = minor(p), minor(q)

    def pick(x, y, z):
        return F.when(axis == 0, x).when(axis == 1, y).otherwise(z)

    sx, sy, sz = pick(sign, a, a), pick(a, sign, b), pick(b, b, sign)
    return {
        "half": F.acos(sz / F.sqrt(a * a + b * b + 1.0)) / 2.0,
        "phi": F.atan2(sy, sx),
        "turn": (turn + 0.5) * (math.pi / HOPF_TURNS),
    }


def hopf_r33(cell: Column) -> Column:
    """Last matrix entry at the centre of a cell, the cosine of the tilt."""
    f = _fibre(cell)
    x = F.cos(f["half"]) * F.sin(f["turn"])
    y = F.sin(f["half"]) * F.cos(f["phi"] + f["turn"])
    return 1.0 - (x * x + y * y) * 2.0


def cell_tilts(spark: SparkSession) -> DataFrame:
    """``(cell, r33)`` of all 98,304 cells."""
    cell = F.col("id").cast("int")
    return spark.range(HOPF_CELLS).select(cell.alias("cell"), hopf_r33(cell).alias("r33"))


def hopf_cells(spark: SparkSession) -> DataFrame:
    """All cells with the rotation at their centre."""
    cells = spark.range(HOPF_CELLS).select(F.col("id").cast("int").alias("cell"))
    half, phi, turn = F.col("half"), F.col("phi"), F.col("turn")
    w, x, y, z = (F.col(c) for c in "wxyz")
    return (
        cells.withColumns(_fibre(F.col("cell")))
        .withColumns(
            {
                "w": F.cos(half) * F.cos(turn),
                "x": F.cos(half) * F.sin(turn),
                "y": F.sin(half) * F.cos(phi + turn),
                "z": F.sin(half) * F.sin(phi + turn),
            }
        )
        .select(
            "cell",
            F.array(
                1.0 - (y * y + z * z) * 2.0, (x * y - w * z) * 2.0, (x * z + w * y) * 2.0,
                (x * y + w * z) * 2.0, 1.0 - (x * x + z * z) * 2.0, (y * z - w * x) * 2.0,
                (x * z - w * y) * 2.0, (y * z + w * x) * 2.0, 1.0 - (x * x + y * y) * 2.0,
            ).alias("rotation"),
        )
    )


def lattice(spark: SparkSession) -> DataFrame:
    """Lattice points ``(i, j, k)`` without the origin: 68,920 rows."""
    side = 2 * LATTICE_HALF + 1
    n = F.col("id")
    return spark.range(side**3).select(
        (F.floor(n / side**2) - LATTICE_HALF).cast("int").alias("i"),
        (F.floor(n / side) % side - LATTICE_HALF).cast("int").alias("j"),
        (n % side - LATTICE_HALF).cast("int").alias("k"),
    ).where("i <> 0 OR j <> 0 OR k <> 0")


def lattice_keys(spark: SparkSession, disp45: bool) -> DataFrame:
    """All that a score depends on in the masked lattice: ``(d2, side, k, d, phi)``.

    ``side`` is i*i + j*j and k is positive; points with -k have the same score.  There are
    at most 400 x 20 rows.
    """
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    side, d2 = F.col("side"), F.col("side") + k * k
    masked = lattice(spark).where("k > 0").where(translation_mask(i, j, k, disp45))
    d = F.sqrt(d2 * LATTICE_STEP**2)
    return masked.select((i * i + j * j).alias("side"), "k").distinct().select(
        d2.alias("d2"), side, "k", d.alias("d"), F.acos(k * LATTICE_STEP / d).alias("phi")
    )


def lattice_sides(spark: SparkSession) -> DataFrame:
    """``(side, points)``: the (i, j) of each i*i + j*j, at most 1,681 points in all."""
    i, j = F.col("i"), F.col("j")
    flat = lattice(spark).where("k = 1").select((i * i + j * j).alias("side"), F.struct("i", "j").alias("p"))
    return flat.groupBy("side").agg(F.collect_list("p").alias("points"))


def scored_keys(cells: DataFrame, name: str) -> DataFrame:
    """``(cell, r33, side, k, score)`` of every lattice key that a cell may accept.

    ``cells`` has distinct cells with their ``r33``.  The score limit bounds distance and
    tilt, so a cell only meets the keys of possible squared distances: an equi-join with a
    table of fixed size, and never more scores than cells times keys.
    """
    _, tilt30, disp45 = parse_name(name)
    q_max = -2.0 * math.log(cutoff(name) * NORMALIZER)
    reach = [math.sqrt(q_max * v) + 1e-9 for v in VARIANCE]
    low = max(1, math.floor(((MEAN[0] - reach[0]) / LATTICE_STEP) ** 2))
    high = min(399, math.ceil(((MEAN[0] + reach[0]) / LATTICE_STEP) ** 2))
    theta = F.acos(F.least(F.lit(1.0), F.abs(F.col("r33"))))
    possible = cells.select("cell", "r33", theta.alias("theta")).where(
        rotation_mask(F.col("r33"), tilt30)
        & F.col("theta").between(MEAN[2] - reach[2], MEAN[2] + reach[2])
    )
    keys = F.broadcast(lattice_keys(cells.sparkSession, disp45))
    met = possible.withColumn("d2", F.explode(F.sequence(F.lit(low), F.lit(high)))).join(keys, "d2")
    return met.select("cell", "r33", "side", "k", score(F.col("d"), F.col("phi"), F.col("theta")).alias("score"))


def accept_rows(cells: DataFrame, name: str) -> DataFrame:
    """``(cell, accepted, size)`` of the distinct ``cells`` that accept any translation.

    ``accepted`` lists, by ``side``, a bitmap of the accepted k; ``size`` counts the points.
    """
    kept = scored_keys(cells, name).where(F.col("score") >= cutoff(name))
    bitmaps = kept.groupBy("cell", "side").agg(F.expr("bit_or(shiftleft(1, k))").alias("bits"))
    counts = lattice_sides(cells.sparkSession).select("side", F.size("points").alias("n"))
    return (
        bitmaps.join(F.broadcast(counts), "side")
        .groupBy("cell")
        .agg(
            F.sort_array(F.collect_list(F.struct("side", "bits"))).alias("accepted"),
            F.sum(F.bit_count("bits") * F.col("n") * 2).cast("int").alias("size"),
        )
    )


def accepted_points(rows: DataFrame) -> DataFrame:
    """One row per accepted lattice point ``(i, j, k)`` of rows with ``accepted``."""
    sides = F.broadcast(lattice_sides(rows.sparkSession))
    kept = [c for c in rows.columns if c != "accepted"]
    each = F.expr(f"filter(sequence(1, {LATTICE_HALF}), k -> (shiftright(_bits, k) & 1) = 1)")
    found = rows.withColumn("_a", F.explode("accepted")).select(
        *kept, F.col("_a.side").alias("side"), F.col("_a.bits").alias("_bits")
    )
    found = found.withColumn("_k", each).join(sides, "side").drop("side", "_bits")
    found = found.withColumn("_p", F.explode("points")).withColumn("_k", F.explode("_k"))
    return found.select(
        *kept, F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), F.explode(F.array("_k", -F.col("_k"))).alias("k")
    )


def filter_pairs(spark: SparkSession, name: str) -> DataFrame:
    """All accepted ``(cell, i, j, k)`` pairs of a filter."""
    return accepted_points(accept_rows(cell_tilts(spark), name).select("cell", "accepted"))


def audit(scored: DataFrame, name: str) -> DataFrame:
    """Least margins of ``(r33, score)`` rows from the cutoff and the tilt limit.

    A score or tilt nearer than ``AUDIT_MARGIN`` could fall on either side by rounding.
    """
    return scored.agg(
        F.min(F.abs(F.col("score") / cutoff(name) - 1.0)).alias("min_rel_margin"),
        F.min(F.abs(F.col("r33") * F.col("r33") * 4.0 - 3.0)).alias("min_tilt_gap"),
    )
