"""Vector metrics and rotations as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import c


def doubles(x: str | Column) -> Column:
    return F.transform(c(x), lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def minus(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def rmse(a, b) -> Column:
    d = minus(a, b)
    return F.sqrt(F.try_divide(dot(d, d), F.size(d).cast("double")))


def mean_abs(a, b) -> Column:
    d = F.transform(minus(a, b), lambda x: F.abs(x))
    return F.try_divide(total(d), F.size(d).cast("double"))


def max_abs(a, b) -> Column:
    return F.array_max(F.transform(minus(a, b), lambda x: F.abs(x)))


def distance(a, b) -> Column:
    return norm(minus(a, b))


def cosine(a, b) -> Column:
    """NaN if either vector has length zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(float("nan")))


def channel_normalise(x, mean, inverse_std) -> Column:
    """(x - mean) * (1 / std) of each channel, by arrays of the channels' means and inverse deviations."""
    return F.transform(doubles(x), lambda v, i: (v - F.get(c(mean), i)) * F.get(c(inverse_std), i))


def bound(x, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(c(x)), f)[0]


def quaternion_product(p, q) -> Column:
    """Hamilton product of (w, x, y, z) arrays."""
    p, q = c(p), c(q)
    w1, x1, y1, z1 = (p[i] for i in range(4))
    w2, x2, y2, z2 = (q[i] for i in range(4))
    return F.array(
        w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2, w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2,
        w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2, w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2,
    )


def quaternion_inverse(q) -> Column:
    """Of a unit quaternion."""
    q = c(q)
    return F.array(q[0], -q[1], -q[2], -q[3])


def quaternion_unit(q) -> Column:
    size = norm(q)
    return F.transform(doubles(q), lambda v: v / size)


def quaternion_to_euler(q) -> Column:
    """Roll, pitch, yaw about fixed x, y, z axes."""
    q = c(q)
    w, x, y, z = (q[i] for i in range(4))
    sine = F.greatest(F.least(2 * (w * y - z * x), F.lit(1.0)), F.lit(-1.0))
    return F.array(
        F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(sine), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)),
    )


def euler_to_quaternion(roll, pitch, yaw) -> Column:
    """(w, x, y, z) of a rotation about fixed x, then y, then z."""
    cr, sr = F.cos(c(roll) / 2), F.sin(c(roll) / 2)
    cp, sp = F.cos(c(pitch) / 2), F.sin(c(pitch) / 2)
    cy, sy = F.cos(c(yaw) / 2), F.sin(c(yaw) / 2)
    return F.array(
        cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy,
    )


def quaternion_to_matrix(q) -> Column:
    """Nine entries, row by row."""

    def entries(q: Column) -> Column:
        w, x, y, z = (q[i] for i in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
            2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
        )

    return bound(quaternion_unit(q), entries)


def matrix_to_euler(m) -> Column:
    """Roll, pitch, yaw about fixed x, y, z axes from nine row-major entries."""
    m = c(m)
    flat = F.sqrt(m[0] * m[0] + m[3] * m[3])
    steep = flat < 1e-12
    return F.array(
        F.when(steep, F.atan2(-m[5], m[4])).otherwise(F.atan2(m[7], m[8])), F.atan2(-m[6], flat),
        F.when(steep, F.lit(0.0)).otherwise(F.atan2(m[3], m[0])),
    )


def quaternion_to_axis_angle(q) -> Column:
    """(x, y, z, angle); the x axis and 0 for no rotation."""
    u = quaternion_unit(q)
    side = F.sqrt(u[1] * u[1] + u[2] * u[2] + u[3] * u[3])
    still = side < 1e-12
    axis = [F.when(still, F.lit(1.0 if i == 1 else 0.0)).otherwise(u[i] / side) for i in (1, 2, 3)]
    return F.array(*axis, F.when(still, F.lit(0.0)).otherwise(2 * F.atan2(side, u[0])))


def axis_angle_to_quaternion(axis, angle) -> Column:
    """(w, x, y, z) of a turn about an axis of any length; no rotation for an axis of none."""
    size, half = norm(axis), c(angle) / 2
    part = lambda i: F.when(size > 0, doubles(axis)[i] / size * F.sin(half)).otherwise(F.lit(0.0))
    return F.array(F.when(size > 0, F.cos(half)).otherwise(F.lit(1.0)), part(0), part(1), part(2))


#: The 24 conventions of three angles: 's' turns about fixed axes, 'r' about turning ones; then the axes in order.
CONVENTIONS = [frame + i + j + k for frame in "sr" for i in "xyz" for j in "xyz" for k in "xyz" if i != j != k]


def _turning(convention: str | Column) -> tuple[list[Column], Column]:
    """Axes 0 to 2 as those of turns about turning axes, and whether the angles come in reverse for that: x then y fixed is y then x turning."""
    if isinstance(convention, str):
        if convention not in CONVENTIONS:
            raise ValueError(f"unknown convention: {convention}")
        convention = F.lit(convention)
    reverse = F.substring(convention, 1, 1) == "s"
    axis = lambda n: F.ascii(F.substring(convention, n + 2, 1)) - ord("x")
    return [F.when(reverse, axis(2 - n)).otherwise(axis(n)) for n in range(3)], reverse


def angles_to_quaternion(angles, convention: str | Column) -> Column:
    """(w, x, y, z) of three angles by a convention; a column may name another one in each row."""
    axes, reverse = _turning(convention)

    def product(parts: Column) -> Column:
        def turn(n: int) -> Column:
            half = F.get(parts, F.when(reverse, F.lit(2 - n)).otherwise(F.lit(n)))
            return F.array(half["cos"], *[F.when(axes[n] == k, half["sin"]).otherwise(F.lit(0.0)) for k in range(3)])

        return bound(turn(0), lambda p: bound(turn(1), lambda q: bound(turn(2), lambda r: bound(quaternion_product(p, q), lambda pq: quaternion_product(pq, r)))))

    return bound(F.transform(c(angles), lambda x: F.struct(F.cos(x / 2).alias("cos"), F.sin(x / 2).alias("sin"))), product)


def matrix_to_angles(m, convention: str | Column) -> Column:
    """Three angles by a convention from nine row-major entries; where two axes fall together the first turn is 0."""
    (i, j, last), reverse = _turning(convention)
    # k is the axis that isn't among the first two, sign the parity of (i, j, k)
    places = F.struct(i.alias("i"), j.alias("j"), (3 - i - j).alias("k"), (last == i).alias("again"), F.when(F.pmod(j - i, F.lit(3)) == 1, 1.0).otherwise(-1.0).alias("sign"))

    def angles(m: Column, p: Column) -> Column:
        at = lambda r, s: F.get(m, p[r] * 3 + p[s])
        sign, again = p["sign"], p["again"]
        flat = F.when(again, F.hypot(at("i", "j"), at("i", "k"))).otherwise(F.hypot(at("i", "i"), at("i", "j")))
        first = F.when(again, F.atan2(at("j", "i"), -sign * at("k", "i"))).otherwise(F.atan2(-sign * at("j", "k"), at("k", "k")))
        second = F.when(again, F.atan2(flat, at("i", "i"))).otherwise(F.atan2(sign * at("i", "k"), flat))
        third = F.when(again, F.atan2(at("i", "j"), sign * at("i", "k"))).otherwise(F.atan2(-sign * at("i", "j"), at("i", "i")))
        alone = F.when(again, F.atan2(-sign * at("j", "k"), at("j", "j"))).otherwise(F.atan2(sign * at("j", "i"), at("j", "j")))
        together = flat < 1e-9
        found = F.array(F.when(together, F.lit(0.0)).otherwise(first), second, F.when(together, alone).otherwise(third))
        return F.when(reverse, F.reverse(found)).otherwise(found)

    return bound(m, lambda m: bound(places, lambda p: angles(m, p)))


def quaternion_to_angles(q, convention: str | Column) -> Column:
    return matrix_to_angles(quaternion_to_matrix(q), convention)


def is_rotation(m, tolerance: float = 1e-6) -> Column:
    """Whether nine row-major entries are orthonormal with determinant 1."""
    m = c(m)
    rows = [[m[3 * i + j] for j in range(3)] for i in range(3)]
    orthonormal = F.lit(True)
    for i in range(3):
        for j in range(i, 3):
            product = sum((rows[i][k] * rows[j][k] for k in range(1, 3)), rows[i][0] * rows[j][0])
            orthonormal = orthonormal & (F.abs(product - (1.0 if i == j else 0.0)) <= tolerance)
    (a, b, d), (e, f, g), (h, i, j) = rows
    determinant = a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)
    return orthonormal & (F.abs(determinant - 1.0) <= tolerance)


def compose_pose(base_xyz, base_q, delta_xyz, delta_q) -> tuple[Column, Column]:
    """Translations add, rotations multiply."""
    moved = F.zip_with(doubles(base_xyz), doubles(delta_xyz), lambda x, y: x + y)
    return moved, quaternion_unit(quaternion_product(base_q, delta_q))
