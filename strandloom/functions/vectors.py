"""Fixed-size vector algebra as column expressions.

Rotations are arrays of nine doubles in row-major order and act on row vectors:
``placed = coordinate * rotation + grid * spacing``.  Everything is unrolled so
that it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def component(vector, index: int) -> Column:
    """``index``-th entry of an array column or of a list of columns."""
    return vector[index] if isinstance(vector, (list, tuple)) else F.get(vector, F.lit(index))


def shared(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` refers to it.

    The optimizer puts an expression into every place that names it; the variable of a
    lambda keeps its value.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a, b, size: int = 3) -> Column:
    total = component(a, 0) * component(b, 0)
    for k in range(1, size):
        total = total + component(a, k) * component(b, k)
    return total


def cross(a, b) -> list[Column]:
    """Vector product."""
    return [
        component(a, (k + 1) % 3) * component(b, (k + 2) % 3) - component(a, (k + 2) % 3) * component(b, (k + 1) % 3)
        for k in range(3)
    ]


def rotate(vector, rotation) -> list[Column]:
    """Row vector times rotation."""
    return [
        component(vector, 0) * component(rotation, k)
        + component(vector, 1) * component(rotation, 3 + k)
        + component(vector, 2) * component(rotation, 6 + k)
        for k in range(3)
    ]


def multiply(a, b) -> list[Column]:
    """Matrix product of two row-major 3x3 matrices."""
    return [
        component(a, 3 * i) * component(b, k)
        + component(a, 3 * i + 1) * component(b, 3 + k)
        + component(a, 3 * i + 2) * component(b, 6 + k)
        for i in range(3)
        for k in range(3)
    ]


def transpose(m) -> list[Column]:
    return [component(m, 3 * k + i) for i in range(3) for k in range(3)]


def rotvec_matrix(rx, ry, rz) -> Column:
    """Matrix that rotates column vectors by the rotation vector (Rodrigues)."""
    rx, ry, rz = (c if isinstance(c, Column) else F.col(c) for c in (rx, ry, rz))
    square = rx * rx + ry * ry + rz * rz
    angle = F.sqrt(square)
    tiny = square < F.lit(1e-24)
    a = F.when(tiny, F.lit(1.0)).otherwise(F.sin(angle) / angle)
    b = F.when(tiny, F.lit(0.5)).otherwise((F.lit(1.0) - F.cos(angle)) / square)
    one = F.lit(1.0)
    return F.array(
        one - b * (ry * ry + rz * rz), b * rx * ry - a * rz, b * rx * rz + a * ry,
        b * rx * ry + a * rz, one - b * (rx * rx + rz * rz), b * ry * rz - a * rx,
        b * rx * rz - a * ry, b * ry * rz + a * rx, one - b * (rx * rx + ry * ry),
    )


def axis_sum(coords: Column, k: int) -> Column:
    """Sum of one coordinate over an array of [x, y, z] arrays."""
    return F.aggregate(coords, F.lit(0.0), lambda total, x: total + F.get(x, F.lit(k)))


def flat_axis_mean(flat: Column, k: int) -> Column:
    """Mean of one coordinate of a flat array x0, y0, z0, x1, ..."""
    chosen = F.filter(flat, lambda _, n: n % 3 == k)
    return F.aggregate(chosen, F.lit(0.0), lambda total, x: total + x) / (F.size(flat) / 3)


def centroid(coords: Column) -> Column:
    """Mean of an array of [x, y, z] arrays."""
    size = F.size(coords).cast("double")
    return F.array(*[axis_sum(coords, k) / size for k in range(3)])


def centred(coords: Column, mean: Column) -> Column:
    return F.transform(
        coords,
        lambda x: F.array(*[F.get(x, F.lit(k)) - F.get(mean, F.lit(k)) for k in range(3)]),
    )


def square_sum(coords: Column) -> Column:
    """Sum of squares over all atoms."""
    return F.aggregate(
        coords,
        F.lit(0.0),
        lambda acc, x: acc
        + F.get(x, F.lit(0)) * F.get(x, F.lit(0))
        + F.get(x, F.lit(1)) * F.get(x, F.lit(1))
        + F.get(x, F.lit(2)) * F.get(x, F.lit(2)),
    )


def cross_moment(a: Column, b: Column) -> Column:
    """Nine sums over atoms of a[i] * b[j], row-major."""

    def entry(i: int, j: int) -> Column:
        products = F.zip_with(a, b, lambda p, q: F.get(p, F.lit(i)) * F.get(q, F.lit(j)))
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    return F.array(*[entry(i, j) for i in range(3) for j in range(3)])


def ball_axis(centre: Column, reach2: Column) -> Column:
    """Integers x with (x - centre)^2 <= reach2, as an array (empty when none)."""
    reach = F.sqrt(F.greatest(reach2, F.lit(0.0)))
    low = F.ceil(centre - reach)
    high = F.floor(centre + reach)
    return F.when(
        (reach2 >= 0) & (low <= high), F.sequence(low, high)
    ).otherwise(F.array().cast("array<bigint>"))
