"""Geometry of points and oriented boxes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO_PI = 2.0 * math.pi
#: Overlaps count up to this slack; shorter box sides have no normal.
EPS = 1e-9


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pick(prefix: str, *names: str) -> list[Column]:
    return [F.col(f"{prefix}.{n}" if prefix else n) for n in names]


def cell(v: Column | str, size: float, rule: str = "floor") -> Column:
    """Index of the cell of this size: floor, round (half to even) or trunc."""
    q = col(v) / F.lit(float(size))
    if rule == "floor":
        return F.floor(q).cast("int")
    if rule == "round":
        return F.bround(q).cast("int")
    if rule == "trunc":
        return q.cast("int")
    raise ValueError(f"no cell rule {rule!r}")


def wrap_angle(theta: Column | str) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(col(theta) + F.lit(math.pi), F.lit(TWO_PI)) - F.lit(math.pi)


def bearing(dx: Column, dy: Column, convention: str = "ccw_x") -> Column:
    """Degrees in [0, 360): counter-clockwise from +x, or clockwise from +y."""
    angle = F.atan2(dy, dx) if convention == "ccw_x" else F.atan2(dx, dy)
    return F.pmod(F.degrees(angle), F.lit(360.0))


def rigid(matrix: list[list[float]], x: Column, y: Column, z: Column) -> list[Column]:
    """A 4 x 4 transform of a point."""
    return [F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3])) for r in matrix[:3]]


def affine2(vertices: Column, rotation: list[list[float]], mean: tuple[float, float], shift: tuple[float, float]) -> Column:
    """(p - mean) R^T + t of every vertex {x, y} of an array."""

    def one(p: Column) -> Column:
        dx, dy = p["x"] - F.lit(mean[0]), p["y"] - F.lit(mean[1])
        return F.struct(
            (dx * F.lit(rotation[0][0]) + dy * F.lit(rotation[0][1]) + F.lit(shift[0])).alias("x"),
            (dx * F.lit(rotation[1][0]) + dy * F.lit(rotation[1][1]) + F.lit(shift[1])).alias("y"),
        )

    return F.transform(vertices, one)


def corners(x: Column, y: Column, length: Column, width: Column, theta: Column) -> Column:
    """The four corners of a box's footprint, clockwise from (+, +)."""
    c, s = F.cos(theta), F.sin(theta)
    out = []
    for a, b in ((0.5, 0.5), (0.5, -0.5), (-0.5, -0.5), (-0.5, 0.5)):
        u, v = F.lit(a) * length, F.lit(b) * width
        out.append(F.struct((x + u * c - v * s).alias("x"), (y + u * s + v * c).alias("y")))
    return F.array(*out)


def bottom(z: Column, height: Column) -> Column:
    return z - height / F.lit(2.0)


def top(z: Column, height: Column) -> Column:
    return z + height / F.lit(2.0)


def footprint_radius(length: Column, width: Column) -> Column:
    return F.lit(0.5) * F.hypot(length, width)


def obb_overlap(a: str, b: str, margin: float = 0.0) -> Column:
    """Whether the footprints of the boxes in ``a`` and ``b`` (x, y, l, w, th)
    meet: on none of the four side normals are the projections apart. A side
    without length has no normal."""
    ax, ay, al, aw, at = pick(a, "x", "y", "l", "w", "th")
    bx, by, bl, bw, bt = pick(b, "x", "y", "l", "w", "th")
    al, aw = al + F.lit(2 * margin), aw + F.lit(2 * margin)
    bl, bw = bl + F.lit(2 * margin), bw + F.lit(2 * margin)
    dx, dy = bx - ax, by - ay
    c, s = F.abs(F.cos(bt - at)), F.abs(F.sin(bt - at))
    half = F.lit(0.5)

    def near(axis_x, axis_y, own, u, v, side):
        apart = F.abs(dx * axis_x + dy * axis_y) > half * (own + u + v) + F.lit(EPS)
        return (side < F.lit(EPS)) | ~apart

    return (
        near(F.cos(at), F.sin(at), al, bl * c, bw * s, aw)
        & near(-F.sin(at), F.cos(at), aw, bl * s, bw * c, al)
        & near(F.cos(bt), F.sin(bt), bl, al * c, aw * s, bw)
        & near(-F.sin(bt), F.cos(bt), bw, al * s, aw * c, bl)
    )


def height_level(low: Column, high: Column) -> Column:
    return F.when(high > 1.8, "high").when((low < 0.25) & (high > 0.175), "low").otherwise("mid")


def mounting_note(z: Column, height: Column, floor_z: Column) -> Column:
    """Where the base hangs: above 2.0 m, above 0.5 m, or on the floor."""
    base = F.bround(z - height / F.lit(2.0) - floor_z, 2)
    return F.when(base > 2.0, "mounted near the ceiling").when(base > 0.5, "elevated above the floor").otherwise("on or near the floor")


def pca_yaw(vxx: Column, vxy: Column, vyy: Column) -> Column:
    """Direction of the major axis from (population) second moments, mod pi."""
    return F.lit(0.5) * F.atan2(F.lit(2.0) * vxy, vxx - vyy)


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule against an array of {x, y}; open rings are closed."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        p, q = F.element_at(ring, i + 1), F.element_at(ring, F.pmod(i + 1, n).cast("int") + 1)
        spans = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]
        return F.when(spans & (x < at), 1).otherwise(0)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda a, v: a + v)
    return F.when(n >= 3, F.pmod(total, F.lit(2)) == 1).otherwise(F.lit(False))


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance to the nearest edge of a ring."""
    n = F.size(ring)

    def to_edge(i: Column) -> Column:
        p, q = F.element_at(ring, i + 1), F.element_at(ring, F.pmod(i + 1, n).cast("int") + 1)
        ex, ey = q["x"] - p["x"], q["y"] - p["y"]
        d2 = ex * ex + ey * ey
        t = F.when(d2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - p["x"]) * ex + (y - p["y"]) * ey) / d2))).otherwise(F.lit(0.0))
        return F.hypot(x - p["x"] - t * ex, y - p["y"] - t * ey)

    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), to_edge))


def aabb(x: Column, y: Column, z: Column, low: tuple[float, float, float], high: tuple[float, float, float]) -> Column:
    return x.between(low[0], high[0]) & y.between(low[1], high[1]) & z.between(low[2], high[2])


def half_space(x: Column, y: Column, z: Column, plane: tuple[float, float, float, float], side: int, margin: float) -> Column:
    a, b, c, d = plane
    return (x * a + y * b + z * c + F.lit(d)) * side >= margin


def finite(*cs: Column) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return out
