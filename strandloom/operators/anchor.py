"""Anchoring: poses whose nucleotide ring stacks on a protein ring.

Each rotamer turns the nucleotide ring into some Hopf cell relative to the protein
ring.  What that cell accepts is kept once a cell, as bitmaps over the lattice; the accepted
translations are rounded to pose grid points, and a grid point is kept when enough of its
cell is accepted.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.constants import GRID_SPACING, MIN_CELL_FRACTION
from strandloom.functions import gaussian
from strandloom.functions import vectors as v
from strandloom.functions.superpose import ring_rotation, superposing_rotation
from strandloom.operators.pool import pose_columns
from strandloom.staging import row_bound, skew_join, stage, task_count

TRANSLATIONS = 2_000  # about what a rotamer has, for the number of tasks
ROWS_PER_TASK = 4_000_000
FEW_CELLS = 20_000  # accepting cells that are sent to every task, 1 or 2 KB each
PHASES = 64  # bins per axis of the place of a pose cell within a lattice cell


def protein_frame(ring: list[list[float]], reference: list[list[float]]) -> tuple[list[float], list[float]]:
    """Rotation of the protein reference ring onto the ring, and the ring centre."""
    ring, reference = np.asarray(ring, dtype=float), np.asarray(reference, dtype=float)
    turn = ring_rotation(reference, ring)
    return [float(x) for x in turn.ravel()], [float(x) for x in ring.mean(axis=0)]


def ring_shapes(conformers: DataFrame, ring_atoms: list[int], reference: list[list[float]]) -> DataFrame:
    """Per conformer: rotation of its ring onto the reference ring, and ring centre."""
    ring = F.array(*[F.get("coords", F.lit(n)) for n in ring_atoms])
    flat = F.lit([float(x) for atom in reference for x in atom])
    return conformers.select(
        "conformer",
        superposing_rotation(F.flatten(ring), flat).alias("to_reference"),
        v.centroid(ring).alias("ring_centre"),
    )


def _phase_bins(centre: list[Column]) -> list[Column]:
    """Bin of a world position within the lattice cell, per lattice axis."""
    bins = []
    for c in centre:
        scaled = c / gaussian.LATTICE_STEP
        bins.append(F.least(F.floor((scaled - F.floor(scaled)) * PHASES), F.lit(PHASES - 1)).cast("int"))
    return bins


def capacities(bins: DataFrame, frame: list[float]) -> DataFrame:
    """Lattice points in a pose cell, for each distinct phase bin ``(b0, b1, b2)``.

    There are at most 64^3 bins whatever the pool.
    """
    half = GRID_SPACING / (2 * gaussian.LATTICE_STEP)
    reach = math.ceil(half * math.sqrt(3)) + 1
    axis = F.sequence(F.lit(-reach), F.lit(reach))
    points = (
        bins.withColumn("x", F.explode(axis))
        .withColumn("y", F.explode(axis))
        .withColumn("z", F.explode(axis))
    )
    delta = [F.col(a) - (F.col(f"b{k}") + 0.5) / PHASES for k, a in enumerate("xyz")]
    inside = F.lit(True)
    for c in v.rotate(delta, [F.lit(x) for x in frame]):
        inside = inside & (F.abs(c) <= half)
    return points.groupBy("b0", "b1", "b2").agg(F.count_if(inside).cast("int").alias("capacity"))


def candidate_cells(
    rotamers: DataFrame,
    shapes: DataFrame,
    filter_name: str,
    frame: list[float],
    centre: list[float],
    *,
    keys: list[str] | None = None,
    accepted: DataFrame | None = None,
) -> DataFrame:
    """Pose cells with accepted translations: ``count`` of them and ``capacity``.

    ``frame`` turns the protein reference into the world; ``centre`` is the protein
    ring centre.  What a Hopf cell accepts is worked out once for each distinct cell, or
    read from ``accepted`` (see ``filter_cache``), and joined to the rotamers by cell.
    Rotamers are distributed once; the translations of a rotamer are generated, rounded
    and counted where it lies, without another shuffle.
    """
    keys = keys or ["conformer", "rotamer"]
    w = [F.lit(float(x)) for x in frame]
    m = F.col("m")
    relative = v.multiply(v.multiply(v.transpose(F.col("to_reference")), m), v.transpose(w))
    ring = v.rotate(F.col("ring_centre"), m)
    turned = rotamers.join(shapes, "conformer").select(
        *keys,
        *[c.alias(f"q{n}") for n, c in enumerate(relative)],
        *[(F.lit(float(centre[k])) - ring[k]).alias(f"o{k}") for k in range(3)],
    )
    # Written once: the optimizer would otherwise push conditions on the cell below
    # the matrix product and expand it into every use of an entry.
    located = stage(
        turned.select(
            *keys,
            gaussian.hopf_cell([F.col(f"q{n}") for n in range(9)]).alias("cell"),
            "o0",
            "o1",
            "o2",
        ),
        "ring-cells",
    )
    if accepted is None:
        accepted = gaussian.accept_rows(cell_tilts_of(located), filter_name)
    accepted = stage(accepted.select("cell", "accepted"), "accepted")
    # Each small row yields thousands of translations, so tasks follow what comes out.
    tasks = max(task_count(rotamers.sparkSession), -(-row_bound(located) * TRANSLATIONS // ROWS_PER_TASK))
    if row_bound(accepted) <= FEW_CELLS:
        rows = located.repartition(tasks, *keys).join(F.broadcast(accepted), "cell").drop("cell")
    else:
        rows = skew_join(located, accepted, ["cell"], right_rows=0).drop("cell").repartition(tasks, *keys)
    points = gaussian.accepted_points(rows)
    moved = v.rotate([F.col(a) * gaussian.LATTICE_STEP for a in "ijk"], w)
    grid = [
        F.rint((F.col(f"o{k}") + moved[k]) / GRID_SPACING).cast("int").alias(g)
        for k, g in enumerate(("gx", "gy", "gz"))
    ]
    offsets = [f"o{k}" for k in range(3)]
    cells = (
        points.select(*keys, *offsets, *grid)
        .groupBy(*keys, *offsets, "gx", "gy", "gz")
        .agg(F.count("*").alias("count"))
    )
    world = [F.col(g) * GRID_SPACING - F.col(f"o{k}") for k, g in enumerate(("gx", "gy", "gz"))]
    bins = _phase_bins(v.rotate(world, v.transpose(w)))
    cells = cells.select(
        *keys, "gx", "gy", "gz", "count", *[b.alias(f"b{k}") for k, b in enumerate(bins)]
    )
    # At most 64^3 distinct bins: the capacity table has a fixed bound.
    table = F.broadcast(capacities(all_bins(rotamers.sparkSession), frame))
    return cells.join(table, ["b0", "b1", "b2"]).drop("b0", "b1", "b2")


def cell_tilts_of(located: DataFrame) -> DataFrame:
    """Distinct Hopf cells of ``located`` with the tilt at their centre."""
    return located.select("cell").distinct().select("cell", gaussian.hopf_r33(F.col("cell")).alias("r33"))


def all_bins(spark) -> DataFrame:
    n = F.col("id")
    return spark.range(PHASES**3).select(
        F.floor(n / PHASES**2).cast("int").alias("b0"),
        (F.floor(n / PHASES) % PHASES).cast("int").alias("b1"),
        (n % PHASES).cast("int").alias("b2"),
    )


def anchor(
    rotamers: DataFrame,
    shapes: DataFrame,
    filter_name: str,
    frame: list[float],
    centre: list[float],
    *,
    min_fraction: float = MIN_CELL_FRACTION,
) -> DataFrame:
    """Poses whose cell is filled to at least ``min_fraction``."""
    cells = candidate_cells(rotamers, shapes, filter_name, frame, centre)
    kept = cells.where(F.col("count") >= F.col("capacity") * F.lit(min_fraction))
    return kept.select(
        *pose_columns(*[F.col(c) for c in ("conformer", "rotamer", "gx", "gy", "gz")])
    )


def ring_descriptors(rings: DataFrame, frame: list[float], centre: list[float]) -> DataFrame:
    """Descriptors and score of placed rings ``(to_reference, ring_centre)``.

    ``to_reference`` turns the placed ring onto its reference ring.
    """
    w = [F.lit(float(x)) for x in frame]
    relative = v.multiply(v.transpose(F.col("to_reference")), v.transpose(w))
    moved = [v.component(F.col("ring_centre"), k) - float(centre[k]) for k in range(3)]
    x, y, z = v.rotate(moved, v.transpose(w))
    d, phi, theta = gaussian.descriptors(relative[8], x, y, z)
    return rings.withColumns({"d": d, "phi": phi, "theta": theta}).withColumn(
        "score", gaussian.score(F.col("d"), F.col("phi"), F.col("theta"))
    )


def check_filters(jobs: DataFrame, filters: list[str] | None = None) -> DataFrame:
    """Evaluate every filter on jobs ``(job, d, phi, theta)``, widest filters first.

    A filter inside one that already rejected is implied; it is reported with the
    narrowest rejecting filter instead of being evaluated.
    """
    names = filters or gaussian.filter_names()
    wider = {n: [o for o in names if gaussian.contains(o, n)] for n in names}
    order = sorted(names, key=lambda n: (len(wider[n]), n))
    passed = {n: F.col(f"_{i}") for i, n in enumerate(order)}
    evaluated = jobs.select(
        "job",
        *[
            gaussian.accept(
                F.col("d"), F.col("phi"), F.col("theta"), gaussian.cutoff(n), *gaussian.parse_name(n)[1:]
            ).alias(f"_{i}")
            for i, n in enumerate(order)
        ],
    )
    # Containment is transitive: a filter is evaluated if every wider one passed.
    rejected = {}
    for name in order:
        rejected[name] = ~passed[name]
        for wide in wider[name]:
            rejected[name] = rejected[name] & passed[wide]
    entries = []
    for name in order:
        narrowest_first = sorted(wider[name], key=lambda o: (len(wider[o]), o), reverse=True)
        implied = F.coalesce(
            *[F.when(rejected[o], F.lit(o)) for o in narrowest_first], F.lit(None).cast("string")
        )
        state = (
            F.when(implied.isNotNull(), F.lit("implied"))
            .when(passed[name], F.lit("accepted"))
            .otherwise(F.lit("rejected"))
        )
        entries.append(
            F.struct(F.lit(name).alias("filter"), state.alias("state"), implied.alias("implied_by"))
        )
    return evaluated.select("job", F.explode(F.array(*entries)).alias("e")).select("job", "e.*")
