"""Base names, base mutation and sequence overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.vectors import centred, centroid, component, dot

# Heavy atoms of each nucleotide.
ATOMS = {"A": 22, "C": 20, "G": 23, "U": 20}
# The amino atom of G in the frame of its six-ring, and the 0-based
# atoms of A that span the frame (origin, x axis, plane); it goes in at place 12.
G_AMINO = (4.66517696, -0.69231318, 0.0)
G_FRAME = (8, 11, 13)
G_PLACE = 12
# Bases that share a library, by representative.
REPRESENTATIVE = {"A": "A", "G": "A", "C": "C", "U": "C"}


def representative(sequence: str) -> str:
    return "".join(REPRESENTATIVE[base] for base in sequence)


def base_of(resname: Column, rna: bool = True) -> Column:
    """One-letter base of a residue name (``A`` or ``RA``; ``DA`` for DNA), else NULL."""
    bases, prefix = (["A", "C", "G", "U"], "R") if rna else (["A", "C", "G", "T"], "D")
    name = F.trim(resname)
    return F.when(name.isin(bases), name).when(
        name.isin([prefix + b for b in bases]), F.substring(name, 2, 1)
    )


def overlaps(lower: Column, upper: Column) -> Column:
    """The last base of one fragment is the first of the next."""
    return F.substring(lower, -1, 1) == F.substring(upper, 1, 1)


# Which atom of the source stands at each place of the target; None is the amino atom.
MOVES = {
    ("A", "G"): [*range(G_PLACE), None, *range(G_PLACE, ATOMS["A"])],
    ("G", "A"): [n for n in range(ATOMS["G"]) if n != G_PLACE],
    **{(a, b): list(range(ATOMS[a])) for a, b in ("AA", "GG", "CC", "UU", "CU", "UC")},
}


def _amino(coords: Column, start: int) -> Column:
    """The amino atom of G over the base of the A whose atoms begin at ``start``."""
    origin, along, plane = (F.get(coords, F.lit(start + n)) for n in G_FRAME)
    x = [component(along, k) - component(origin, k) for k in range(3)]
    p = [component(plane, k) - component(origin, k) for k in range(3)]
    share = dot(p, x) / dot(x, x)
    y = [p[k] - share * x[k] for k in range(3)]  # in the plane, at a right angle to x
    return F.array(
        *[
            component(origin, k) + x[k] / F.sqrt(dot(x, x)) * G_AMINO[0] + y[k] / F.sqrt(dot(y, y)) * G_AMINO[1]
            for k in range(3)
        ]
    )


def mutate(coords: Column, source: str, target: str, *, centre: bool = True) -> Column:
    """Coordinates of ``target`` from a fragment of ``source`` (A and G, C and U or same)."""
    if len(source) != len(target):
        raise ValueError("sequences differ in length")
    if unknown := [pair for pair in zip(source, target) if pair not in MOVES]:
        raise ValueError("cannot mutate {} to {}".format(*unknown[0]))
    starts = [sum(ATOMS[b] for b in source[:n]) for n in range(len(source))]
    size = sum(ATOMS[b] for b in source)
    coords = F.when(F.size(coords) == size, coords).otherwise(
        F.raise_error(F.lit(f"expected {size} atoms for {source}"))
    )
    whole = F.array(
        *[
            _amino(coords, start) if place is None else F.get(coords, F.lit(start + place))
            for start, pair in zip(starts, zip(source, target))
            for place in MOVES[pair]
        ]
    )
    return centred(whole, centroid(whole)) if centre else whole
