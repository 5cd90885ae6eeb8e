"""Camera algebra as Column expressions.

Matrices are row-major arrays of doubles: 9 for rotations and intrinsics, 12 for projections,
16 for homogeneous poses. NULL in, NULL out. Functions take array columns or ``Matrix`` and
give ``Matrix``, a list of entries: products of products then hold each entry once instead of
whole arrays over and over. ``column`` turns either into an array column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Matrix(list):
    """Entries of a matrix as Columns, row by row."""

    def alias(self, name: str) -> Column:
        return column(self).alias(name)


def column(m) -> Column:
    return F.array(*m) if isinstance(m, list) else m


def at(m, i: int) -> Column:
    return m[i] if isinstance(m, list) else F.get(m, i)


def matmul(a: Column, b: Column, n: int, k: int, m: int) -> Matrix:
    """Product of an n*k and a k*m matrix."""
    terms = lambda r, c: [at(a, r * k + i) * at(b, i * m + c) for i in range(k)]
    return Matrix(sum(terms(r, c)[1:], terms(r, c)[0]) for r in range(n) for c in range(m))


def transpose(a: Column, n: int = 3, m: int = 3) -> Matrix:
    return Matrix(at(a, r * m + c) for c in range(m) for r in range(n))


def negate(a, n: int = 3) -> Matrix:
    return Matrix(-at(a, i) for i in range(n))


def intrinsics(w: Column, h: Column, fov: Column, given: Column | None = None) -> Column:
    """3x3 intrinsics: those given, or from the field of view of the longer side in degrees."""
    f = F.greatest(w, h) / F.tan(F.radians(fov / 2)) / 2
    z, one = F.lit(0.0), F.lit(1.0)
    made = F.when(fov.isNotNull(), F.array(f, z, w / 2.0, z, f, h / 2.0, z, z, one))
    return made if given is None else F.coalesce(given, made)


def pose_matrix(r: Column, t: Column) -> Matrix:
    """Homogeneous 4x4 pose [R T; 0 0 0 1]."""
    rows = [x for i in range(3) for x in (at(r, 3 * i), at(r, 3 * i + 1), at(r, 3 * i + 2), at(t, i))]
    return Matrix([*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)])


def rotation_of(e: Column) -> Column:
    return F.when(e.isNotNull(), F.array(*[at(e, 4 * r + c) for r in range(3) for c in range(3)]))


def translation_of(e: Column) -> Column:
    return F.when(e.isNotNull(), F.array(at(e, 3), at(e, 7), at(e, 11)))


def camera_center(r: Column, t: Column) -> Matrix:
    """Position of a camera: -R^T T."""
    return negate(matmul(transpose(r), t, 3, 3, 1))


def translation_from_center(r: Column, c: Column) -> Matrix:
    return negate(matmul(r, c, 3, 3, 1))


def projection_matrix(k: Column, r: Column, t: Column) -> Matrix:
    """3x4 projection [K R | K T]."""
    kr, kt = matmul(k, r, 3, 3, 3), matmul(k, t, 3, 3, 1)
    return Matrix(x for i in range(3) for x in (*kr[3 * i : 3 * i + 3], kt[i]))


def relative_rotation(r1: Column, r2: Column) -> Matrix:
    return matmul(r2, transpose(r1), 3, 3, 3)


def relative_translation(r1: Column, t1: Column, r2: Column, t2: Column) -> Matrix:
    moved = matmul(relative_rotation(r1, r2), t1, 3, 3, 1)
    return Matrix(at(t2, i) - moved[i] for i in range(3))


def rotation_y(degrees: Column) -> Matrix:
    a = F.radians(degrees)
    z, one = F.lit(0.0), F.lit(1.0)
    return Matrix([F.cos(a), z, F.sin(a), z, one, z, -F.sin(a), z, F.cos(a)])


def _clipped_acos(x: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))))


def rotation_error(r1: Column, r2: Column) -> Column:
    """Angle in degrees between two rotations; the trace of R1^T R2 is the sum of products of their entries."""
    trace = at(r1, 0) * at(r2, 0)
    for i in range(1, 9):
        trace = trace + at(r1, i) * at(r2, i)
    return _clipped_acos((trace - 1) / 2)


def vector_angle(a: Column, b: Column) -> Column:
    """Angle in degrees between two 3-vectors; NULL if one is zero."""
    dot = sum([at(a, i) * at(b, i) for i in (1, 2)], at(a, 0) * at(b, 0))
    n = lambda v: F.sqrt(at(v, 0) * at(v, 0) + at(v, 1) * at(v, 1) + at(v, 2) * at(v, 2))
    return F.when((n(a) > 0) & (n(b) > 0), _clipped_acos(dot / (n(a) * n(b))))


def folded(angle: Column) -> Column:
    """Angle between directions whose sign is open."""
    return F.least(angle, 180 - angle)


def quaternion_to_matrix(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Rotation of a quaternion of any length but zero."""
    n = w * w + x * x + y * y + z * z
    s = F.lit(2.0) / n
    return F.when(
        n > 0,
        F.array(
            1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
            s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w),
            s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y),
        ),
    )


def matrix_to_quaternion(r: Column) -> Column:
    """Unit quaternion (w, x, y, z) with w >= 0, by the largest of the four candidate components."""
    m = [[at(r, 3 * i + j) for j in range(3)] for i in range(3)]
    t = m[0][0] + m[1][1] + m[2][2]
    half = lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) / 2
    w, x, y, z = half(1 + t), half(1 + m[0][0] - m[1][1] - m[2][2]), half(1 - m[0][0] + m[1][1] - m[2][2]), half(1 - m[0][0] - m[1][1] + m[2][2])
    by_w = F.array(w, (m[2][1] - m[1][2]) / (4 * w), (m[0][2] - m[2][0]) / (4 * w), (m[1][0] - m[0][1]) / (4 * w))
    by_x = F.array((m[2][1] - m[1][2]) / (4 * x), x, (m[0][1] + m[1][0]) / (4 * x), (m[0][2] + m[2][0]) / (4 * x))
    by_y = F.array((m[0][2] - m[2][0]) / (4 * y), (m[0][1] + m[1][0]) / (4 * y), y, (m[1][2] + m[2][1]) / (4 * y))
    by_z = F.array((m[1][0] - m[0][1]) / (4 * z), (m[0][2] + m[2][0]) / (4 * z), (m[1][2] + m[2][1]) / (4 * z), z)
    q = F.when((w >= x) & (w >= y) & (w >= z), by_w).when((x >= y) & (x >= z), by_x).when(y >= z, by_y).otherwise(by_z)
    return F.when(F.get(q, 0) < 0, F.transform(q, lambda v: -v)).otherwise(q)


def assembled(w: Column, h: Column, fov: Column, k: Column, e: Column, dist: Column) -> Column:
    """struct(w, h, K, dist, R, T): a camera from metadata; K as given or from the field of view, R and T from the pose."""
    return F.struct(w.alias("w"), h.alias("h"), intrinsics(w, h, fov, k).alias("K"), dist.alias("dist"), rotation_of(e).alias("R"), translation_of(e).alias("T"))


def homogeneous(x: Column) -> Column:
    """Coordinates with a one at the end."""
    return F.concat(x, F.array(F.lit(1.0)))


def turned_pose(e: Column, quarter_turns: Column) -> Matrix:
    """A 4x4 pose turned about the optical axis by quarter turns; the turn by n is one of -90 n degrees."""
    q = F.pmod(quarter_turns, F.lit(4))
    c, s = F.when(q == 0, 1.0).when(q == 2, -1.0).otherwise(0.0), F.when(q == 1, -1.0).when(q == 3, 1.0).otherwise(0.0)
    first = [c * at(e, i) - s * at(e, 4 + i) for i in range(4)]
    second = [s * at(e, i) + c * at(e, 4 + i) for i in range(4)]
    return Matrix([*first, *second, *[at(e, i) for i in range(8, 16)]])


def pose_errors(r1: Column, t1: Column, r2: Column, t2: Column) -> Column:
    """struct(t_err, r_err) in degrees: the folded angle of translation directions and the angle of rotations."""
    return F.struct(folded(vector_angle(t1, t2)).alias("t_err"), rotation_error(r1, r2).alias("r_err"))


def resized(w: Column, h: Column, size: tuple[int, ...]) -> Column:
    """struct(w, h): size (n,) makes the longer side n, (-1,) keeps it, (a, b) is exact; sizes round half to even."""
    if len(size) == 2:
        return F.struct(F.lit(size[0]).alias("w"), F.lit(size[1]).alias("h"))
    scale = F.lit(1.0) if size[0] < 0 else F.lit(float(size[0])) / F.greatest(w, h)
    return F.struct(F.bround(w * scale, 0).cast("int").alias("w"), F.bround(h * scale, 0).cast("int").alias("h"))


def scaled_intrinsics(k: Column, sx: Column, sy: Column) -> Column:
    """Intrinsics after dividing pixel coordinates by the axis scales."""
    z, one = F.lit(0.0), F.lit(1.0)
    return F.array(at(k, 0) / sx, z, at(k, 2) / sx, z, at(k, 4) / sy, at(k, 5) / sy, z, z, one)


def rotated_intrinsics(k: Column, w: Column, h: Column, quarter_turns: Column) -> Column:
    """Intrinsics after turning the pixel grid by quarter turns against the clock."""
    fx, fy, cx, cy = at(k, 0), at(k, 4), at(k, 2), at(k, 5)
    z, one = F.lit(0.0), F.lit(1.0)
    make = lambda fx, fy, cx, cy: F.array(fx, z, cx, z, fy, cy, z, z, one)
    q = F.pmod(quarter_turns, F.lit(4))
    return (
        F.when(q == 0, make(fx, fy, cx, cy))
        .when(q == 1, make(fy, fx, cy, w - 1 - cx))
        .when(q == 2, make(fx, fy, w - 1 - cx, h - 1 - cy))
        .otherwise(make(fy, fx, h - 1 - cy, cx))
    )


def epipolar_error(x0: Column, y0: Column, x1: Column, y1: Column, r: Column, t: Column) -> Column:
    """Symmetric squared epipolar distance of normalised points, with E = [t]x R."""
    z = F.lit(0.0)
    cross = Matrix([z, -at(t, 2), at(t, 1), at(t, 2), z, -at(t, 0), -at(t, 1), at(t, 0), z])
    e = matmul(cross, r, 3, 3, 3)
    row = lambda i: at(e, 3 * i) * x0 + at(e, 3 * i + 1) * y0 + at(e, 3 * i + 2)
    col = lambda j: at(e, j) * x1 + at(e, 3 + j) * y1 + at(e, 6 + j)
    p = x1 * row(0) + y1 * row(1) + row(2)
    return p * p * (1 / (row(0) * row(0) + row(1) * row(1)) + 1 / (col(0) * col(0) + col(1) * col(1)))


def downscaled(w: Column, h: Column, target: int) -> Column:
    """(scale, w, h): shrinks so that the longer side is ``target``, never enlarges; sizes round half to even."""
    scale = F.least(F.lit(1.0), F.lit(float(target)) / F.greatest(w, h))
    return F.struct(scale.alias("scale"), F.bround(w * scale, 0).cast("int").alias("w"), F.bround(h * scale, 0).cast("int").alias("h"))
