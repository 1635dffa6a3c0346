"""Points, rotations and affine maps as expressions: vectors are lists of columns, matrices lists of rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]
Matrix = list[list[Column]]


def dot(u: Vector, v: Vector) -> Column:
    return reduce(lambda a, b: a + b, (x * y for x, y in zip(u, v)))


def minus(u: Vector, v: Vector) -> Vector:
    return [x - y for x, y in zip(u, v)]


def cross(u: Vector, v: Vector) -> Vector:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def norm(u: Vector) -> Column:
    return F.sqrt(dot(u, u))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[dot(row, [r[j] for r in b]) for j in range(len(b[0]))] for row in a]


def transpose(m: Matrix) -> Matrix:
    return [list(column) for column in zip(*m)]


def det(m: Matrix) -> Column:
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    return dot(m[0], cross(m[1], m[2]))


def inverse(m: Matrix) -> Matrix:
    """By cofactors, up to 3 x 3."""
    if len(m) == 1:
        return [[1 / m[0][0]]]
    d = det(m)
    if len(m) == 2:
        return [[m[1][1] / d, -m[0][1] / d], [-m[1][0] / d, m[0][0] / d]]
    cofactors = [cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1])]
    return [[cofactors[j][i] / d for j in range(3)] for i in range(3)]


def cholesky(m: Matrix) -> Matrix:
    """The lower triangle whose product with its transpose is a symmetric positive definite matrix."""
    n = len(m)
    out: Matrix = [[F.lit(0.0)] * n for _ in range(n)]
    for i in range(n):
        for j in range(i + 1):
            rest = m[i][j]
            for k in range(j):
                rest = rest - out[i][k] * out[j][k]
            out[i][j] = F.sqrt(F.greatest(rest, F.lit(0.0))) if i == j else rest / out[j][j]
    return out


def forward(lower: Matrix, b: Vector) -> Vector:
    """x of L x = b."""
    out: Vector = []
    for i, row in enumerate(lower):
        rest = b[i]
        for k, x in enumerate(out):
            rest = rest - row[k] * x
        out.append(rest / row[i])
    return out


def cholesky_solve(lower: Matrix, b: Vector) -> Vector:
    """x of L L^T x = b."""
    y = forward(lower, b)
    turned = [row[::-1] for row in transpose(lower)[::-1]]
    return forward(turned, y[::-1])[::-1]


def rotation(angles: Vector, deg: bool = True) -> Matrix:
    """A planar rotation by one angle, or the intrinsic rotation about x, then y, then z by three."""
    turned = [F.radians(a) if deg else a for a in angles]
    if len(turned) == 1:
        c, s = F.cos(turned[0]), F.sin(turned[0])
        return [[c, -s], [s, c]]
    (a, b, c), (x, y, z) = ([f(t) for t in turned] for f in (F.cos, F.sin))
    one, none = F.lit(1.0), F.lit(0.0)
    about_x = [[one, none, none], [none, a, -x], [none, x, a]]
    about_y = [[b, none, y], [none, one, none], [-y, none, b]]
    about_z = [[c, -z, none], [z, c, none], [none, none, one]]
    return product(product(about_x, about_y), about_z)


def rotation_angles(m: Matrix, deg: bool = True) -> Vector:
    """The angles of `rotation`; where the second is a right angle, the first is 0."""
    if len(m) == 2:
        found = [F.atan2(m[1][0], m[0][0])]
    else:
        clip = lambda v: clamp(v, -1.0, 1.0)
        second = F.asin(clip(m[0][2]))
        c = F.cos(second)
        locked = F.abs(F.abs(second) - math.pi / 2) < 1e-6
        first = F.when(locked, 0.0).otherwise(F.atan2(clip(-m[1][2] / c), clip(m[2][2] / c)))
        third = F.when(locked, F.atan2(clip(m[1][0]), clip(m[1][1]))).otherwise(F.atan2(clip(-m[0][1] / c), clip(m[0][0] / c)))
        found = [first, second, third]
    return [F.degrees(a) for a in found] if deg else found


def affine(par: Vector, ndim: int, deg: bool = True, shift_scale: bool = False) -> Matrix:
    """Translation, rotation, scale and shear, in this order, as an ndim x (ndim + 1) matrix; what is missing is the identity's."""
    turns = ndim * (ndim - 1) // 2
    identity = [0.0] * (ndim + turns) + [0.0 if shift_scale else 1.0] * ndim + [0.0] * turns
    full = [*par, *map(F.lit, identity[len(par) :])]
    shift, angles, scale, shear = full[:ndim], full[ndim : ndim + turns], full[ndim + turns : 2 * ndim + turns], full[2 * ndim + turns :]
    scale = [1 + s for s in scale] if shift_scale else scale
    upper = iter(shear)
    skewed = [[scale[i] * (F.lit(1.0) if i == j else next(upper)) if j >= i else F.lit(0.0) for j in range(ndim)] for i in range(ndim)]
    linear = product(rotation(angles, deg), skewed)
    return [[*row, t] for row, t in zip(linear, shift)]


def affine_params(m: Matrix, deg: bool = True) -> Vector:
    """The parameters of `affine`, by the triangle of M^T M; a reflection shows in the sign of the first scale."""
    n = len(m[0]) - 1
    linear, shift = [row[:n] for row in m[:n]], [row[n] for row in m[:n]]
    lower = cholesky(product(transpose(linear), linear))
    scale = [lower[i][i] for i in range(n)]
    scale[0] = scale[0] * F.signum(det(linear))
    shear = [lower[j][i] / scale[i] for i in range(n) for j in range(i + 1, n)]
    upper = iter(shear)
    skewed = [[scale[i] * (F.lit(1.0) if i == j else next(upper)) if j >= i else F.lit(0.0) for j in range(n)] for i in range(n)]
    return [*shift, *rotation_angles(product(linear, inverse(skewed)), deg), *scale, *shear]


def squared_affine(m: Matrix) -> Matrix:
    """With the homogeneous last row."""
    n = len(m[0])
    return m if len(m) == n else [*m, [F.lit(float(j == n - 1)) for j in range(n)]]


def compose(maps: list[Matrix]) -> Matrix:
    """The product of homogeneous maps; the last one is applied first."""
    return reduce(product, map(squared_affine, maps))


def inverse_affine(m: Matrix) -> Matrix:
    n = len(m[0]) - 1
    linear = inverse([row[:n] for row in m[:n]])
    return [[*row, -dot(row, [r[n] for r in m[:n]])] for row in linear]


def apply_affine(m: Matrix, point: Vector, center: Vector | None = None) -> Vector:
    """The map of a point; with a centre, about it."""
    n = len(point)
    own = point if center is None else minus(point, center)
    moved = [dot(row[:n], own) + row[n] for row in m[:n]]
    return moved if center is None else [a + b for a, b in zip(moved, center)]


def rigid_exp(params: Vector) -> Matrix:
    """(angle, tx, ty), or rotation vector and translation in space: the homogeneous map, by Rodrigues' formula."""
    if len(params) == 3:
        return squared_affine([[*row, t] for row, t in zip(rotation(params[:1], deg=False), params[1:])])
    w, shift = params[:3], params[3:]
    square = dot(w, w)
    small = square < 1e-12
    safe = F.when(small, 1.0).otherwise(square)
    theta = F.sqrt(safe)
    a = F.when(small, 1 - square / 6).otherwise(F.sin(theta) / theta)
    b = F.when(small, 0.5 - square / 24).otherwise((1 - F.cos(theta)) / safe)
    none = F.lit(0.0)
    k = [[none, -w[2], w[1]], [w[2], none, -w[0]], [-w[1], w[0], none]]
    kk = product(k, k)
    return squared_affine([[*(float(i == j) + a * k[i][j] + b * kk[i][j] for j in range(3)), shift[i]] for i in range(3)])


def rigid_log(m: Matrix) -> Vector:
    """The parameters of `rigid_exp`; rotations by half a turn have none."""
    if len(m[0]) == 3:
        return [*rotation_angles([row[:2] for row in m[:2]], deg=False), m[0][2], m[1][2]]
    theta = F.acos(clamp((m[0][0] + m[1][1] + m[2][2] - 1) / 2, -1.0, 1.0))
    small = theta < 1e-6
    factor = F.when(small, 0.5 + theta * theta / 12).otherwise(theta / (2 * F.when(small, 1.0).otherwise(F.sin(theta))))
    axis = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]]
    return [*(factor * v for v in axis), *(row[3] for row in m[:3])]


def latlong_to_cartesian(lat: Column, lon: Column, r: float = 1.0) -> Vector:
    return [r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat)]


def cartesian_to_latlong(p: Vector) -> Vector:
    return [F.atan2(p[2], F.sqrt(p[0] * p[0] + p[1] * p[1])), F.atan2(p[1], p[0])]


def geodesic(u: Vector, v: Vector, r: float = 1.0) -> Column:
    """Great-circle distance of points on a sphere."""
    return r * F.atan2(norm(cross(u, v)), dot(u, v))


def segment_distance2(p1: Vector, q1: Vector, p2: Vector, q2: Vector, least: float = 1e-12) -> Column:
    """Squared distance of two segments: the stationary point, clamped to both; a segment may be a point."""
    d1, d2, r = minus(q1, p1), minus(q2, p2), minus(p1, p2)
    a, e, f, c, b = dot(d1, d1), dot(d2, d2), dot(d2, r), dot(d1, r), dot(d1, d2)
    a_, e_ = F.when(a > least, a).otherwise(1.0), F.when(e > least, e).otherwise(1.0)
    apart = a * e - b * b
    s = clamp(F.when(apart > least, (b * f - c * e) / apart).otherwise(0.0))
    t = (b * s + f) / e_
    s = F.when(t < 0, clamp(-c / a_)).when(t > 1, clamp((b - c) / a_)).otherwise(s)
    t = clamp(t)
    point1, point2 = a <= least, e <= least
    s = F.when(point1, 0.0).when(point2, clamp(-c / a_)).otherwise(s)
    t = F.when(point1 & point2, 0.0).when(point1, clamp(f / e_)).when(point2, 0.0).otherwise(t)
    gap = [x + s * u - y - t * v for x, u, y, v in zip(p1, d1, p2, d2)]
    return dot(gap, gap)


def spherical_area(a: Vector, b: Vector, c: Vector) -> Column:
    """Signed solid angle of a triangle of points as seen from the origin."""
    la, lb, lc = norm(a), norm(b), norm(c)
    return 2 * F.atan2(dot(a, cross(b, c)), la * lb * lc + dot(a, b) * lc + dot(b, c) * la + dot(c, a) * lb)
