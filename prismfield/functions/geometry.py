"""Rigid motion, quaternions, cameras and planes as column expressions (no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def transform(p: Vec, r, t) -> Vec:
    """p @ R.T + t for a 3x3 matrix and a vector of numbers or columns."""
    return tuple(p[0] * r[i][0] + p[1] * r[i][1] + p[2] * r[i][2] + t[i] for i in range(3))


def inverse_transform(p: Vec, r, t) -> Vec:
    d = tuple(p[i] - t[i] for i in range(3))
    return tuple(d[0] * r[0][i] + d[1] * r[1][i] + d[2] * r[2][i] for i in range(3))


def rotate_z(p: Vec, degrees: float) -> Vec:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return p[0] * c - p[1] * s, p[0] * s + p[1] * c, p[2]


def quaternion_matrix(q) -> list[list[Column]]:
    """Rotation matrix of (x, y, z, w), normalised; the identity if its norm is below 1e-12."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    ok = n >= 1e-12
    x, y, z, w = (F.when(ok, c / n).otherwise(F.lit(float(i == 3))) for i, c in enumerate(q))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def quaternion_rotate(q, v: Vec) -> Vec:
    """v + 2 u x (u x v + w v) for a unit quaternion (u, w)."""
    ux, uy, uz, w = q
    cx, cy, cz = uy * v[2] - uz * v[1] + w * v[0], uz * v[0] - ux * v[2] + w * v[1], ux * v[1] - uy * v[0] + w * v[2]
    return v[0] + 2 * (uy * cz - uz * cy), v[1] + 2 * (uz * cx - ux * cz), v[2] + 2 * (ux * cy - uy * cx)


def slerp(a, b, f: Column) -> list[Column]:
    """Shortest-arc interpolation of quaternions; linear and renormalised if they nearly agree."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    d = F.least(F.abs(dot), F.lit(1.0))
    theta = F.acos(d)
    near = d > 0.9995
    wa = F.when(near, 1 - f).otherwise(F.sin((1 - f) * theta) / F.when(near, 1.0).otherwise(F.sin(theta)))
    wb = F.when(near, f).otherwise(F.sin(f * theta) / F.when(near, 1.0).otherwise(F.sin(theta))) * sign
    out = [wa * x + wb * y for x, y in zip(a, b, strict=True)]
    n = F.sqrt(out[0] * out[0] + out[1] * out[1] + out[2] * out[2] + out[3] * out[3])
    return [c / n for c in out]


def project(p: Vec, k: dict, width: int, height: int) -> tuple[Column, Column, Column]:
    """(u, v, valid) of camera-frame points: pinhole with Brown distortion (k1, k2, p1, p2, k3)."""
    z = F.when(p[2] > 0, p[2])
    x, y = p[0] / z, p[1] / z
    r2 = x * x + y * y
    radial = 1 + k["k1"] * r2 + k["k2"] * r2 * r2 + k["k3"] * r2 * r2 * r2
    xd = x * radial + 2 * k["p1"] * x * y + k["p2"] * (r2 + 2 * x * x)
    yd = y * radial + k["p1"] * (r2 + 2 * y * y) + 2 * k["p2"] * x * y
    u, v = k["fx"] * xd + k["cx"], k["fy"] * yd + k["cy"]
    return u, v, F.coalesce((u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def pixel(c: Column, size: int) -> Column:
    """Half-even rounding, clipped into the raster."""
    return F.greatest(F.least(F.rint(c), F.lit(size - 1.0)), F.lit(0.0)).cast("int")


def plane_distance(p: Vec, normal, d: float) -> Column:
    n = math.sqrt(sum(c * c for c in normal))
    return F.abs(p[0] * normal[0] + p[1] * normal[1] + p[2] * normal[2] + d) / n


def canonical_sign(n: Vec) -> Column:
    """-1 if the component of largest magnitude (the first of equals) is negative, else 1."""
    a, b, c = (F.abs(x) for x in n)
    lead = F.when((a >= b) & (a >= c), n[0]).when(b >= c, n[1]).otherwise(n[2])
    return F.when(lead < 0, -1.0).otherwise(1.0)


def snapped_axis(n: Vec) -> Column:
    a, b, c = (F.abs(x) for x in n)
    name = lambda v, s: F.when(v < 0, f"-{s}").otherwise(f"+{s}")
    return F.when((a >= b) & (a >= c), name(n[0], "x")).when(b >= c, name(n[1], "y")).otherwise(name(n[2], "z"))


def tilt(nz: Column) -> Column:
    """Degrees off the nearest of vertical and horizontal."""
    angle = F.degrees(F.acos(F.least(F.abs(nz), F.lit(1.0))))
    return F.least(angle, F.abs(90 - angle))


def bearing(nx: Column, ny: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(nx, ny)), F.lit(360.0))


def box_gap(a_low: Vec, a_high: Vec, b_low: Vec, b_high: Vec) -> Column:
    """Distance of two axis-aligned boxes, 0 if they touch."""
    gaps = [F.greatest(bl - ah, al - bh, F.lit(0.0)) for al, ah, bl, bh in zip(a_low, a_high, b_low, b_high, strict=True)]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])


def zone(bbox, cy: Column, area: Column, height: int) -> Column:
    """floor, ceiling, vertical or any, by the shape and place of a region's box (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = bbox
    w, h = F.greatest(x1 - x0, F.lit(1)), F.greatest(y1 - y0, F.lit(1))
    c = cy / height
    return (
        F.when((c > 0.55) & (w > 1.6 * h) & (y1 >= height - 3) & (area / (w * h) > 0.5), "floor")
        .when((c < 0.30) & (w > 0.8 * h), "ceiling").when(h > 1.3 * w, "vertical").otherwise("any")
    )


def rescaled_intrinsics(k, size, new_size) -> tuple:
    """(fx, fy, cx, cy) for an image of another size."""
    sx, sy = new_size[0] / size[0], new_size[1] / size[1]
    return k[0] * sx, k[1] * sy, k[2] * sx, k[3] * sy


def ray_plane(origin, direction: Vec, normal, offset: float, least_cos: float, most_depth: float) -> Column:
    """Distance along a unit ray to the plane n.p = offset; null if the ray grazes it, for hits behind and beyond the depth."""
    cos = sum((n * d for n, d in zip(normal, direction, strict=True)), F.lit(0.0))
    t = (offset - sum(n * o for n, o in zip(normal, origin, strict=True))) / F.when(F.abs(cos) >= least_cos, cos)
    return F.when((t > 0) & (t <= most_depth), t)
