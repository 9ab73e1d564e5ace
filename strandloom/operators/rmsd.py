"""RMSD of poses to a reference and between poses.

A placed conformer differs from the reference by a rotation part and a centroid
part.  Both follow from a few moments per conformer, so a pose costs nine products
whatever the number of atoms.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.constants import GRID_SPACING, RMSD_DECIMALS
from strandloom.functions import vectors as v
from strandloom.operators import chains
from strandloom.operators.library import placed
from strandloom.staging import dense_ids, row_bound, skew_join, spread, stage, with_bound


def reference_moments(conformers: DataFrame, reference: list[list[float]]) -> DataFrame:
    """Per conformer: centroid, scatter and cross moments with the reference."""
    target = np.asarray(reference, dtype=float)
    centre = target.mean(axis=0)
    shifted = F.lit([[float(x) for x in atom] for atom in target - centre])
    checked = F.when(F.size("coords") == len(target), F.col("coords")).otherwise(
        F.raise_error(F.lit("reference and library differ in atoms"))
    )
    shaped = conformers.withColumn("coords", checked).withColumn("_mean", v.centroid(F.col("coords")))
    shaped = shaped.withColumn("_c", v.centred(F.col("coords"), F.col("_mean")))
    return shaped.select(
        "conformer",
        F.col("_mean").alias("mean"),
        (v.square_sum(F.col("_c")) + float(((target - centre) ** 2).sum())).alias("scatter"),
        v.cross_moment(F.col("_c"), shifted).alias("cross"),
    )


def pose_rmsd(
    pool: DataFrame,
    conformers: DataFrame,
    rotamers: DataFrame,
    reference: list[list[float]],
    *,
    name: str = "rmsd",
) -> DataFrame:
    """``(pose_id, rmsd)`` to one reference fragment, rounded half-even."""
    moments = reference_moments(conformers, reference)
    moments = moments.select("conformer", F.struct("mean", "scatter", "cross").alias("_m"))
    value = _placed_rmsd(F.col("_m"), reference)
    return placed(pool, moments, rotamers).select("pose_id", value.alias(name))


def _placed_rmsd(moments: Column, reference: list[list[float]]) -> Column:
    """RMSD of a pose from its conformer's moments, rotation and grid point."""
    atoms = len(reference)
    centre = np.asarray(reference, dtype=float).mean(axis=0)
    moved = v.rotate(moments["mean"], F.col("m"))
    off = [
        moved[k] + F.col(g) * GRID_SPACING - float(centre[k]) for k, g in enumerate(("gx", "gy", "gz"))
    ]
    turned = F.greatest(moments["scatter"] - v.dot(moments["cross"], F.col("m"), 9) * 2.0, F.lit(0.0))
    return F.bround(F.sqrt(turned / atoms + v.dot(off, off)), RMSD_DECIMALS)


def ensemble_rmsd(
    pool: DataFrame, conformers: DataFrame, rotamers: DataFrame, reference: list[list[float]], split: int
) -> DataFrame:
    """Full, first- and second-nucleotide RMSD of every pose; ``split`` atoms come first."""
    parts = {"rmsd": (0, len(reference)), "first": (0, split), "second": (split, len(reference) - split)}
    moments = None
    for name, (first, count) in parts.items():
        part = conformers.withColumn("coords", F.slice("coords", first + 1, count))
        found = reference_moments(part, reference[first : first + count])
        found = found.select("conformer", F.struct("mean", "scatter", "cross").alias(f"_{name}"))
        moments = found if moments is None else moments.join(found, "conformer")
    joined = placed(pool, moments, rotamers)
    return joined.select(
        "pose_id",
        *[
            _placed_rmsd(F.col(f"_{name}"), reference[first : first + count]).alias(name)
            for name, (first, count) in parts.items()
        ],
    )


def direct_rmsd(a: Column, b: Column, atoms: float | None = None) -> Column:
    """RMSD of two flat coordinate arrays, by direct differences; they need not be counted if ``atoms`` is given."""
    square = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )
    return F.sqrt(square / (F.size(a) / 3 if atoms is None else F.lit(float(atoms))))


PIVOTS = 4  # directions whose cells candidates meet in: at most 2**4 cells a structure
PIVOT_SAMPLE = 2_000  # structures that directions are fitted on; any directions are exact
WIDER = (8, 4, 2)  # cells so many times wider than need be save copies where structures are sparse
SENT_ROTATIONS = 100_000  # turned halves of poses that are sent to every task
PAIRS_PER_STRUCTURE = 16  # pairs in a cell that are worth it


def pivot_directions(structures: DataFrame, count: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> list[list[float]]:
    """Orthonormal directions over flat coordinates along which a sample varies most."""
    rows = structures.orderBy(F.xxhash64("id"), "id").limit(sample).select("coords").collect()
    if not rows:
        return []
    if len({len(r.coords) for r in rows}) > 1:
        raise ValueError("structures differ in atoms")
    points = np.asarray([r.coords for r in rows], dtype=float)
    _, _, directions = np.linalg.svd(points - points.mean(axis=0), full_matrices=False)
    return directions[:count].tolist()


def near_candidates(
    structures: DataFrame, threshold: float, directions: list[list[float]], *, hot_rows: int | None = None
) -> DataFrame:
    """Pairs ``(i, j, _a, _b)``, i < j, that projections do not tell apart.

    Two structures of n atoms whose RMSD is below the threshold differ by less than
    ``sqrt(n) * threshold`` in their projections on orthonormal directions taken together.
    Each projection is cut into cells at least twice that wide; a structure is put into the
    cells it may be near enough to (at most two a direction), so candidates meet by equi-join.
    A cell that holds a large share of all structures is split by salts on both sides.
    Only numbers and projections meet; coordinates are looked up for the pairs that are left.
    """
    atoms = len(directions[0]) / 3
    slack = math.sqrt(atoms) * threshold * (1 + 1e-9)
    keys = range(len(directions))
    rows = row_bound(structures)
    if "_row" not in structures.columns:
        structures = _rows_named(structures)
    same = F.when(F.size("coords") == len(directions[0]), F.col("coords")).otherwise(
        F.raise_error(F.lit("structures differ in atoms"))
    )

    def along(direction):
        product = F.zip_with(same, F.lit(direction), lambda x, w: x * w)
        return F.aggregate(product, F.lit(0.0), lambda total, x: total + x)

    located = stage(
        structures.select("_row", "id", *[along(d).alias(f"c{k}") for k, d in enumerate(directions)]), "projections"
    )
    width = 2.0 * slack * _widening(located, 2.0 * slack, rows)
    right = located.select(
        F.col("_row").alias("_j"),
        F.col("id").alias("j"),
        *[F.col(f"c{k}").alias(f"e{k}") for k in keys],
        *[F.floor(F.col(f"c{k}") / width).alias(f"x{k}") for k in keys],
    )
    left = located.withColumnsRenamed({"_row": "_i", "id": "i"})
    for k in keys:
        cells = F.sequence(
            F.floor((F.col(f"c{k}") - slack) / width), F.floor((F.col(f"c{k}") + slack) / width)
        )
        left = left.withColumn(f"x{k}", F.explode(cells))
    met = skew_join(
        spread(left, rows, "i"),
        right,
        [f"x{k}" for k in keys],
        left_rows=2 ** len(directions) * rows,
        right_rows=rows,
        hot_rows=hot_rows,
        counted=left,
    ).where("i < j")
    apart = [F.col(f"c{k}") - F.col(f"e{k}") for k in keys]
    near = met.where(v.dot(apart, apart, len(apart)) <= slack * slack).select("i", "j", "_i", "_j")
    pairs = found = stage(near, "near-rows")
    for row, coords in (("_i", "_a"), ("_j", "_b")):
        looked = structures.select(F.col("_row").alias(row), F.col("coords").alias(coords))
        found = skew_join(
            found, looked, [row], left_rows=row_bound(pairs), right_rows=0, hot_rows=hot_rows, counted=pairs
        )
    return found.select("i", "j", "_a", "_b")


def _rows_named(structures: DataFrame) -> DataFrame:
    """Structures, written with a number of each row, as ids may repeat."""
    return stage(structures.select("id", "coords", F.monotonically_increasing_id().alias("_row")), "structures")


def _widening(located: DataFrame, width: float, rows: int) -> int:
    """How much wider than ``width`` cells may be with few pairs in them, from whole cells of a sample."""
    share = 1 + rows // 1_000_000
    columns = [c for c in located.columns if c not in ("_row", "id")]
    wide = located.withColumn("_w", F.explode(F.array(*[F.lit(w) for w in WIDER])))
    cells = wide.select("_w", *[F.floor(F.col(c) / (F.col("_w") * width)).alias(c) for c in columns])
    some = cells.where(F.pmod(F.xxhash64("_w", *columns), F.lit(share)) == 0)
    sizes = some.groupBy("_w", *columns).agg(F.count("*").cast("double").alias("_n"))
    pairs = {r._w: r.pairs * share for r in sizes.groupBy("_w").agg(F.sum(F.col("_n") * F.col("_n")).alias("pairs")).collect()}
    few = [w for w in WIDER if pairs.get(w, 0.0) <= PAIRS_PER_STRUCTURE * rows]
    return few[0] if few else 1


def pairs_below(structures: DataFrame, threshold: float, *, hot_rows: int | None = None) -> DataFrame:
    """Pairs ``(i, j, rmsd)``, i < j, of ``(id, flat coords)`` nearer than ``threshold``."""
    if not threshold > 0:
        raise ValueError("threshold must be positive")
    structures = _rows_named(structures)
    directions = pivot_directions(structures)
    if not directions:
        none = structures.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("rmsd"))
        return none.limit(0)
    met = near_candidates(structures, threshold, directions, hot_rows=hot_rows)
    return met.withColumn("rmsd", direct_rmsd(F.col("_a"), F.col("_b"))).where(
        F.col("rmsd") < threshold
    ).select("i", "j", "rmsd")


def triangle_offset(i: Column, j: Column, n: int) -> Column:
    """Place of pair (i, j), i < j, in the row-wise upper triangle."""
    return i * n - F.floor(i * (i + 1) / 2) + (j - i - 1)


def triangle_pair(offset: int, n: int) -> tuple[int, int]:
    """Inverse of ``triangle_offset``."""
    if not 0 <= offset < n * (n - 1) // 2:
        raise ValueError("offset outside the triangle")
    from_end = n * (n - 1) // 2 - 1 - offset
    row = (math.isqrt(8 * from_end + 1) - 1) // 2  # rows counted from the last one
    i = n - 2 - row
    return i, offset - (i * n - i * (i + 1) // 2) + i + 1


def _wide_values(numbered: DataFrame, names: list[str], values: DataFrame) -> DataFrame:
    """``numbered`` with the columns ``_first_j`` and ``_second_j`` of each layer's node.

    One join per layer, many chains to one node; rows never multiply.
    """
    rows = row_bound(numbered)
    known = row_bound(values)
    wide = numbered.select("chain", *names)
    for j, name in enumerate(names):
        layer = values.where(F.col("layer") == j).select(
            (F.col("node") + 1).alias(name), F.col("first").alias(f"_first_{j}"), F.col("second").alias(f"_second_{j}")
        )
        wide = skew_join(wide, layer, [name], left_rows=rows, right_rows=known, counted=numbered)
    return wide


def chain_rmsd(numbered: DataFrame, names: list[str], values: DataFrame) -> DataFrame:
    """RMSD of whole chains from ``values(layer, node, first, second)``.

    A nucleotide shared by two fragments counts with the mean of its two RMSDs; the
    chain RMSD is the root mean square over the k+1 nucleotides.
    """
    wide = _wide_values(numbered, names, values)
    k = len(names)
    each = [F.col("_first_0")]
    each += [(F.col(f"_second_{j}") + F.col(f"_first_{j + 1}")) / 2.0 for j in range(k - 1)]
    each.append(F.col(f"_second_{k - 1}"))
    square = sum((x * x for x in each[1:]), each[0] * each[0])
    return wide.select("chain", F.bround(F.sqrt(square / (k + 1)), RMSD_DECIMALS).alias("chain_rmsd"))


def _placed_halves(numbered: DataFrame, turned: DataFrame, count: int, suffix: str = "", *, turns: bool = False) -> DataFrame:
    """``numbered`` with the columns ``_first_j`` and ``_second_j``: the halves of each layer's pose, placed.

    ``turned(layer, conformer, rotamer, first, second)`` has them at the grid's origin; it is
    as small as the library, so it is sent to every task unless that is very large.  With
    ``turns`` packed poses have the number of a row of ``turned`` instead of conformer and rotamer.
    """
    wide, rows = numbered, row_bound(numbered)
    few = row_bound(turned) <= SENT_ROTATIONS
    for j in range(count):
        pose = chains.unpacked_pose(j)
        halves = turned.where(F.col("layer") == j).select(
            (F.col("turn") if turns else _rotation("conformer", "rotamer")).alias("_rotation"),
            F.col("first").alias(f"_f{j}"),
            F.col("second").alias(f"_s{j}"),
        )
        wide = wide.withColumn("_rotation", _turn(j) if turns else _rotation(pose["conformer"], pose["rotamer"]))
        if few:
            wide = wide.join(F.broadcast(halves), "_rotation")
        else:
            wide = skew_join(wide, halves, ["_rotation"], left_rows=rows, right_rows=0)
        at = F.array(*[pose[g] * F.lit(GRID_SPACING) for g in ("gx", "gy", "gz")])
        wide = wide.withColumn("_at", at)
        for given, name in ((f"_f{j}", f"_first_{j}"), (f"_s{j}", f"_second_{j}")):
            wide = wide.withColumn(name + suffix, F.transform(given, lambda x, n: x + F.get("_at", n % 3)))
        wide = wide.drop("_rotation", "_at", f"_f{j}", f"_s{j}")
    return wide


def _turn(layer: int) -> Column:
    """Number of the row of turned halves in a packed pose that has it."""
    return F.shiftright(chains.packed(layer)[0], 32)


def _rotation(conformer, rotamer) -> Column:
    """Conformer and rotamer as one number."""
    conformer, rotamer = (c if isinstance(c, Column) else F.col(c) for c in (conformer, rotamer))
    return F.shiftleft(conformer.cast("bigint"), 16).bitwiseOR(rotamer.cast("bigint"))


def _nucleotides(count: int, suffix: str = "") -> list[Column]:
    """Flat coordinates of each nucleotide; the two copies of a shared one are averaged."""
    each = [F.col(f"_first_0{suffix}")]
    each += [
        F.zip_with(f"_second_{j}{suffix}", f"_first_{j + 1}{suffix}", lambda x, y: (x + y) / 2.0) for j in range(count - 1)
    ]
    each.append(F.col(f"_second_{count - 1}{suffix}"))
    return each


def chain_coordinates(numbered: DataFrame, turned: DataFrame, count: int) -> DataFrame:
    """Coordinates per chain and nucleotide from the poses of numbered chains of ``count`` layers.

    ``turned(layer, conformer, rotamer, first, second)``: flat coordinates of the two
    nucleotides of a pose at the origin.  Chains are neither joined with nodes nor moved.
    """
    wide = _placed_halves(numbered, turned, count)
    return wide.select("chain", F.posexplode(F.array(*_nucleotides(count))).alias("nucleotide", "xyz"))


UNITS = 62  # projections are whole numbers, so many to the radius
REACH = 64  # and two more, as each of up to four is rounded down
CELL_BITS = 63  # of the number of a cell
FIELD = 14  # bits of a place in a cell, which is less than REACH * (2 * WIDER[0] + 2)


def _projections(turned: DataFrame, sizes: list[int], directions: list[list[float]]) -> tuple[DataFrame, list]:
    """Projections of the turned halves of each layer, and what a grid step adds to them.

    A shared nucleotide is the mean of two halves, so each counts half.
    """
    count = len(sizes) - 1
    starts = np.cumsum([0, *sizes])
    weights, steps = [], []
    for j in range(count):
        first, second = (
            np.asarray([d[starts[n] : starts[n + 1]] for d in directions]) * (1.0 if n in (0, count) else 0.5) for n in (j, j + 1)
        )
        weights.append((first, second))
        steps.append([[float(first[d, a::3].sum() + second[d, a::3].sum()) * GRID_SPACING for a in range(3)] for d in range(len(directions))])

    def along(column, given):
        same = F.when(F.size(column) == len(given), F.col(column)).otherwise(F.raise_error(F.lit("structures differ in atoms")))
        product = F.zip_with(same, F.lit([float(x) for x in given]), lambda x, w: x * w)
        return F.aggregate(product, F.lit(0.0), lambda total, x: total + x)

    layers = None
    for j, (first, second) in enumerate(weights):
        own = turned.where(F.col("layer") == j).select(
            "layer", "turn", _rotation("conformer", "rotamer").alias("_rotation"),
            *[(along("first", first[d]) + along("second", second[d])).alias(f"p{d}") for d in range(len(directions))],
        )
        layers = own if layers is None else layers.unionByName(own)
    return with_bound(stage(layers, "projected"), row_bound(turned)), steps


def _located(numbered: DataFrame, projected: DataFrame, steps: list, unit: float) -> DataFrame:
    """``numbered`` with the projections ``u0, u1, ...`` of its chains in units, as whole numbers.

    Packed poses get the number of the turned halves, as a library may have several of a rotation.
    """
    count, rows = len(steps), row_bound(numbered)
    keys = range(len(steps[0]))
    wide = numbered.withColumns({f"c{d}": F.lit(0.0) for d in keys})
    for j in range(count):
        pose = chains.unpacked_pose(j)
        own = projected.where(F.col("layer") == j).drop("layer")
        wide = wide.withColumn("_rotation", _rotation(pose["conformer"], pose["rotamer"]))
        if row_bound(projected) <= SENT_ROTATIONS:
            wide = wide.join(F.broadcast(own), "_rotation")
        else:
            wide = skew_join(wide, own, ["_rotation"], left_rows=rows, right_rows=0)
        grid = [pose[g].cast("double") for g in ("gx", "gy", "gz")]
        wide = wide.withColumns({f"c{d}": F.col(f"c{d}") + F.col(f"p{d}") + v.dot(grid, [F.lit(x) for x in steps[j][d]]) for d in keys})
        packed = F.shiftleft("turn", 32).bitwiseOR(F.col(chains.packed(j)[0]).bitwiseAND(F.lit((1 << 32) - 1)))
        wide = wide.withColumn(chains.packed(j)[0], packed).drop("_rotation", "turn", *[f"p{d}" for d in keys])
    located = wide.withColumns({f"u{d}": F.floor(F.col(f"c{d}") / unit) for d in keys}).drop(*[f"c{d}" for d in keys])
    return with_bound(located, rows)


def _in_cells(located: DataFrame, keys: int, bounds: list[tuple[int, int]], width: int) -> DataFrame:
    """Rows of ``located`` in their own cell and in those they are near enough to.

    ``_cell`` is the number of the cell; ``_place`` has the place in it along each direction
    and, above these, a bit of the copies outside their own cell.
    """
    rows = located
    for d in range(keys):
        u = F.col(f"u{d}")
        rows = rows.withColumn(f"x{d}", F.explode(F.sequence(F.floor((u - REACH) / width), F.floor((u + REACH) / width))))
    cell, place, away = F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(False)
    for d, (least, bits) in enumerate(bounds):
        x, within = F.col(f"x{d}"), F.col(f"u{d}") - F.col(f"x{d}") * width
        cell = F.shiftleft(cell, bits).bitwiseOR(x - least)
        place = F.shiftleft(place, FIELD).bitwiseOR(within + REACH)
        away = away | (within < 0) | (within >= width)
    place = place.bitwiseOR(F.when(away, F.lit(1 << FIELD * PIVOTS).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    kept = [c for c in located.columns if c not in {f"u{d}" for d in range(keys)}]
    return rows.select(cell.alias("_cell"), place.alias("_place"), *kept)


def chain_pairs_below(
    numbered: DataFrame, turned: DataFrame, count: int, threshold: float, *, hot_rows: int | None = None
) -> DataFrame:
    """Pairs ``(i, j, rmsd)``, i < j, of chains nearer than ``threshold`` in one frame.

    Chains are structures of all their averaged nucleotides; near ones meet by pivots, so a
    complete matrix is never made.  See ``near_candidates`` for the cells.  What meets is the
    number and packed poses of a chain, so coordinates are made only of pairs that the
    projections do not tell apart, and never written or moved.  Copies in neighbouring cells and
    the chains themselves are one table, which is dealt out once and joined with itself.
    """
    if not threshold > 0:
        raise ValueError("threshold must be positive")
    sample = numbered.orderBy(F.xxhash64("chain"), "chain").limit(PIVOT_SAMPLE)
    sample = _placed_halves(with_bound(sample, PIVOT_SAMPLE), turned, count)
    sample = stage(sample.select(F.col("chain").alias("id"), F.array(*_nucleotides(count)).alias("parts")), "pivots")
    directions = pivot_directions(sample.select("id", F.flatten("parts").alias("coords")))
    if not directions:
        none = numbered.select(F.col("chain").alias("i"), F.col("chain").alias("j"), F.lit(0.0).alias("rmsd"))
        return none.limit(0)
    sizes = [len(part) for part in sample.first().parts]
    slack = math.sqrt(sum(sizes) / 3) * threshold * (1 + 1e-9)
    turned = dense_ids(turned, ["layer", "conformer", "rotamer"], "turn", "turns")
    projected, steps = _projections(turned, sizes, directions)
    located = _located(numbered, projected, steps, slack / UNITS)
    axes = [f"u{d}" for d in range(len(directions))]
    rows, *ends = located.agg(F.count("*"), *[f(c) for c in axes for f in (F.min, F.max)]).first()
    width = 2 * REACH * _widening(located.select(F.col("chain").alias("id"), *axes), 2.0 * REACH, rows)
    bounds = []
    for low, high in zip(ends[::2], ends[1::2]):
        least = (low - REACH) // width
        bounds.append((least, ((high + REACH) // width - least).bit_length()))
    while len(bounds) > 1 and sum(bits for _, bits in bounds) > CELL_BITS:
        bounds.pop()  # fewer directions tell fewer chains apart, and lose none
    keys = len(bounds)
    cells = _in_cells(located, keys, bounds, width).repartition("_cell")
    poses = [c for j in range(count) for c in chains.packed(j)]
    sides = [
        cells.select("_cell", F.col("_place").alias(f"_at{side}"), F.col("chain").alias(side), *[F.col(c).alias(c + side) for c in poses])
        for side in ("i", "j")
    ]
    met = skew_join(*sides, ["_cell"], left_rows=2**keys * rows, right_rows=2**keys * rows, hot_rows=hot_rows)

    def place(side, d):
        return F.shiftright(f"_at{side}", FIELD * (keys - 1 - d)).bitwiseAND(F.lit((1 << FIELD) - 1))

    # Whether j is in its own cell; in terms of both sides, as one that is read by one side alone would part the shared table.
    own = F.col("_atj").bitwiseAND(F.lit(1 << FIELD * PIVOTS)) <= F.col("_ati").bitwiseAND(F.lit(0).cast("bigint"))
    apart = [place("i", d) - place("j", d) for d in range(keys)]
    near = met.where((F.col("i") < F.col("j")) & own & (v.dot(apart, apart, keys) <= REACH * REACH))
    for side in ("i", "j"):
        near = _placed_halves(_renamed(near, poses, side, ""), turned, count, side, turns=True)
        near = _renamed(near, poses, "", side)
    whole = [F.flatten(F.array(*_nucleotides(count, side))) for side in ("i", "j")]
    # Exploded, as a filter would work the value out once more.
    below = F.filter(F.array(direct_rmsd(*whole, sum(sizes) / 3)), lambda d: d < threshold)
    return near.select("i", "j", F.explode(below).alias("rmsd"))


def _renamed(df: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    return with_bound(df.withColumnsRenamed({c + old: c + new for c in columns}), 0)
