"""Walls, floors, ceilings: plane removal, remnant and hybrid filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .aggregates import floor_height, moments, plane_stats
from .clustering import dilate
from .components import keep


def _fit(row) -> tuple[np.ndarray, float]:
    """Plane n.p + d = 0 of the least spread, from a row of moments."""
    m = np.array([row["mx"], row["my"], row["mz"]])
    c = np.array([[row["cxx"], row["cxy"], row["cxz"]], [row["cxy"], row["cyy"], row["cyz"]], [row["cxz"], row["cyz"], row["czz"]]])
    n = np.linalg.eigh(c)[1][:, 0]
    return n, -float(n @ m)


def ransac_plane(points: DataFrame, dist: float = 0.05, hypotheses: int = 200, seed: int = 0) -> tuple[np.ndarray, float, int]:
    """(normal, d, inliers) of the plane that most points are near to.

    Triples come from the points of the smallest seeded hashes, so the draw is
    the same on every run whatever the partitioning. All hypotheses are scored
    in one pass: each task counts inliers of its points for every hypothesis,
    and the counts are added. The winner is fitted again to its inliers'
    moments. Only triples, counts and moments come to the driver."""
    rows = points.orderBy(F.xxhash64(F.lit(seed), "point_id"), "point_id").limit(3 * hypotheses).select("x", "y", "z").collect()
    p = np.array([(r["x"], r["y"], r["z"]) for r in rows], float)
    p = p[: len(p) // 3 * 3].reshape(-1, 3, 3)
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]) if len(p) else np.zeros((0, 3))
    size = np.linalg.norm(n, axis=1)
    p, n = p[size > 1e-9], n[size > 1e-9] / size[size > 1e-9, None]
    if not len(n):
        return np.array([0.0, 0.0, 1.0]), 0.0, 0
    d = -(n * p[:, 0]).sum(1)

    def count(batches):
        import pyarrow as pa

        total = np.zeros(len(n), np.int64)
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
            for at in range(0, len(x), 20_000):
                total += (np.abs(x[at : at + 20_000] @ n.T + d) < dist).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(total, pa.int64())], ["h", "n"])

    best = points.select("x", "y", "z").mapInArrow(count, "h int, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "h").first()
    k, near = int(best["h"]), F.abs(F.col("x") * float(n[best["h"]][0]) + F.col("y") * float(n[best["h"]][1]) + F.col("z") * float(n[best["h"]][2]) + float(d[best["h"]])) < dist
    if best["n"] < 3:
        return n[k], float(d[k]), int(best["n"])
    normal, off = _fit(moments(points.where(near).withColumn("_g", F.lit(0)), "_g").head())
    return normal, off, int(best["n"])


def distance_to(normal: np.ndarray, d: float):
    return F.abs(F.col("x") * float(normal[0]) + F.col("y") * float(normal[1]) + F.col("z") * float(normal[2]) + F.lit(float(d)))


def remove_structure(points: DataFrame, dist: float = 0.05, least_share: float = 0.04, most: int = 10, horizontal: float = 0.85, vertical: float = 0.2, seed: int = 0, hypotheses: int = 200) -> tuple[DataFrame, list[dict]]:
    """Takes away large horizontal and vertical planes until the largest plane
    is small or slanted, or few points are left."""
    first = points.count()
    left, planes, n = points, [], first
    for k in range(most):
        if n < 2000:
            break
        normal, d, inliers = ransac_plane(left, dist, hypotheses, seed + k)
        nz = abs(float(normal[2]))
        if inliers < least_share * first or not (nz >= horizontal or nz <= vertical):
            break
        left = keep(left.where(distance_to(normal, d) >= dist))
        planes.append({"normal": normal.tolist(), "d": d, "inliers": inliers, "kind": "horizontal" if nz >= horizontal else "vertical"})
        n = left.count()
    return left, planes


# Normals above the first are horizontal planes, below the second
# vertical ones; a repeated floor lies within the third of the room's low end.
LEVEL, UPRIGHT, FLOOR_BAND = 0.9, 0.2, 0.10


def plane_role(normal: np.ndarray, centroid: np.ndarray, low: np.ndarray, high: np.ndarray, edge: float) -> str:
    """What a plane of a room is: ceiling, floor, wall X+ X- Y+ Y-, inner (a
    vertical plane away from the room's edge) or slanted."""
    if abs(normal[2]) > LEVEL:
        return "ceiling" if centroid[2] > (low[2] + high[2]) / 2 else "floor"
    if abs(normal[2]) >= UPRIGHT:
        return "slanted"
    axis = int(np.argmax(np.abs(normal[:2])))
    band = (high[axis] - low[axis]) * edge
    if low[axis] + band <= centroid[axis] <= high[axis] - band:
        return "inner"
    return f"wall {'XY'[axis]}{'+' if centroid[axis] > (low[axis] + high[axis]) / 2 else '-'}"


def slice_structure(points: DataFrame, dist: float = 0.03, wall_margin: float = 0.02, floor_margin: float = 0.02, wall_margins: dict[str, float] | None = None, most: int = 20, least: int = 150_000, edge: float = 0.12, seed: int = 0, hypotheses: int = 200) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Cuts floor, outer walls and ceiling off a room. The largest plane of what
    is left decides each round: a ceiling's points go; the first floor and the
    first wall of each side cut away all that is not ``margin`` inside of them; a
    second floor near the room's low end goes; every other plane (inner or
    slanted, a table's top, what leans at a wall) is put aside and returned with
    the rest. Returns the points and (role, points taken away) of each cut."""
    ends = points.agg(*(F.percentile(c, F.array(F.lit(0.01), F.lit(0.99))).alias(c) for c in "xyz")).head()
    if ends["x"] is None:
        return points, []
    low, high = (np.array([ends[c][k] for c in "xyz"]) for k in (0, 1))
    left, aside, cuts = points, None, []
    for k in range(most):
        n = left.count()
        if n < least:
            break
        normal, d, inliers = ransac_plane(left, dist, hypotheses, seed + k)
        if inliers < least:
            break
        on = distance_to(normal, d) < dist
        centre = left.where(on).agg(*(F.avg(c) for c in "xyz")).head()
        role = plane_role(normal, np.array(centre, float), low, high, edge)
        first = role not in {r for r, _ in cuts}
        if role == "ceiling" or role == "floor" and not first and centre[2] < low[2] + FLOOR_BAND:
            gone = on
        elif role in ("inner", "slanted") or not first:
            part = keep(left.where(on))
            aside = part if aside is None else aside.unionByName(part)
            left = keep(left.where(~on))
            continue
        else:
            margin = floor_margin if role == "floor" else (wall_margins or {}).get(role[-2:], wall_margin)
            side = 1.0 if float((low + high) / 2 @ normal) + d >= 0 else -1.0
            inside = F.col("x") * float(normal[0]) + F.col("y") * float(normal[1]) + F.col("z") * float(normal[2]) + F.lit(float(d))
            gone = inside * side < margin
        left = keep(left.where(~gone))
        cuts.append((role, n - left.count()))
    return (left if aside is None else left.unionByName(aside)), cuts


def icp(moving: DataFrame, fixed: DataFrame, reach: float, start: np.ndarray | None = None, rounds: int = 30, normal_radius: float | None = None) -> tuple[np.ndarray, float, float]:
    """(4 x 4 transform, share of matched points, root mean square distance) that
    lays ``moving`` (point_id, x, y, z) onto ``fixed``, from a rough ``start``:
    point-to-plane steps. Each joins points with the nearest fixed point within
    reach and adds up the normal equations; 28 sums a step come to the driver."""
    from ..functions.geometry import rigid
    from .joins import radius_join

    base = keep(fixed.select("point_id", "x", "y", "z"))
    flat = keep(base.join(estimate_normals(base, normal_radius or 2 * reach), "point_id"))
    src = keep(moving.select("point_id", "x", "y", "z"))
    total, t, share, rmse = max(src.count(), 1), np.eye(4) if start is None else np.array(start, float), 0.0, 0.0
    for _ in range(rounds):
        x, y, z = rigid(t.tolist(), F.col("x"), F.col("y"), F.col("z"))
        now = src.select("point_id", x.alias("x"), y.alias("y"), z.alias("z"))
        best = radius_join(now, flat, reach).groupBy(F.col("a.point_id").alias("point_id")).agg(F.min_by(F.struct("a.x", "a.y", "a.z", F.col("b.x").alias("qx"), F.col("b.y").alias("qy"), F.col("b.z").alias("qz"), "b.nx", "b.ny", "b.nz", "d2"), F.struct("d2", "b.point_id")).alias("m")).select("m.*")
        px, py, pz, nx, ny, nz = (F.col(c) for c in ("x", "y", "z", "nx", "ny", "nz"))
        row = [py * nz - pz * ny, pz * nx - px * nz, px * ny - py * nx, nx, ny, nz]
        off = (px - F.col("qx")) * nx + (py - F.col("qy")) * ny + (pz - F.col("qz")) * nz
        sums = [F.sum(row[i] * row[j]) for i in range(6) for j in range(i, 6)] + [F.sum(r * off) for r in row]
        got = best.agg(F.count(F.lit(1)), F.sum("d2"), *sums).head()
        if got[0] < 6:
            break
        a, at = np.zeros((6, 6)), 2
        for i in range(6):
            for j in range(i, 6):
                a[i, j] = a[j, i] = got[at]
                at += 1
        step = np.linalg.lstsq(a, -np.array(got[at:], float), rcond=None)[0]
        angle = float(np.linalg.norm(step[:3]))
        k = step[:3] / angle if angle > 1e-15 else np.zeros(3)
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        move = np.eye(4)
        move[:3, :3] += np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross
        move[:3, 3] = step[3:]
        t, share, rmse = move @ t, got[0] / total, float(np.sqrt(got[1] / got[0]))
        if np.abs(step).max() < 1e-7:
            break
    return t, share, rmse


def ceiling_cut(points: DataFrame, percentile: float = 0.01, height: float = 2.4) -> DataFrame:
    """Drops what is higher above the low percentile of z than ``height``."""
    low = points.agg(F.percentile("z", F.lit(percentile)).alias("_lo"))
    return points.crossJoin(F.broadcast(low)).where(F.col("z") <= F.col("_lo") + height).drop("_lo")


def in_cells(points: DataFrame, cells: DataFrame, size: float, rule: str = "trunc", inside: bool = True) -> DataFrame:
    """Points in (or outside of) a set of cells (i, j)."""
    from ..functions.geometry import cell

    t = points.withColumn("i", cell("x", size, rule)).withColumn("j", cell("y", size, rule))
    return t.join(cells.select("i", "j").distinct(), ["i", "j"], "left_semi" if inside else "left_anti").drop("i", "j")


def room_mask(cells: DataFrame, size: float, margin: float) -> DataFrame:
    """The room's cells grown by a margin, 4-connected."""
    return dilate(cells, max(1, round(margin / size)), diagonal=False)


def grid_lookup(points: DataFrame, grid: DataFrame, res: float, origin: tuple[float, float], shape: tuple[int, int]) -> DataFrame:
    """``value`` of the map cell under each point; indices are clipped to the
    map's edge."""
    rows, cols = shape

    def index(c, o, n):
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), ((F.col(c) - F.lit(o)) / F.lit(res)).cast("int")))

    t = points.withColumn("col", index("x", origin[0], cols)).withColumn("row", index("y", origin[1], rows))
    return t.join(grid.select("row", "col", "value"), ["row", "col"], "left")


def ceiling_remnants(points: DataFrame, reference: DataFrame, max_nz: float = 0.25, max_thick: float = 0.03, max_height: float = 0.6, min_above_floor: float = 1.5, band: float = 0.45, min_points: int = 40, pad: float = 0.3) -> DataFrame:
    """Clusters that are strips below a ceiling's edge. Cheap tests first: low
    height and distance to the floor, then the plane from moments; only the
    clusters left meet the reference cloud, in 1 m cells."""
    floor = floor_height(reference)
    box = points.where("inst >= 0").groupBy("inst").agg(F.count(F.lit(1)).alias("n_points"), *(F.min(c).alias(f"lo_{c}") for c in "xyz"), *(F.max(c).alias(f"hi_{c}") for c in "xyz"))
    box = box.crossJoin(F.broadcast(floor)).where((F.col("hi_z") - F.col("lo_z") <= max_height) & (F.col("lo_z") - F.col("floor_z") >= min_above_floor))
    flat = plane_stats(points.join(box.select("inst"), "inst", "left_semi"), "inst").where((F.col("normal_z") <= max_nz) & (F.col("thickness") <= max_thick))
    cand = keep(box.join(flat, "inst"))

    def reach(lo, hi):
        return F.sequence(F.floor(F.col(lo) - pad).cast("long"), F.floor(F.col(hi) + pad).cast("long"))

    cells = cand.withColumn("_i", F.explode(reach("lo_x", "hi_x"))).withColumn("_j", F.explode(reach("lo_y", "hi_y")))
    ref = reference.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.floor("x").cast("long").alias("_i"), F.floor("y").cast("long").alias("_j"))
    over = cells.join(ref, ["_i", "_j"]).where((F.col("px") > F.col("lo_x") - pad) & (F.col("px") < F.col("hi_x") + pad) & (F.col("py") > F.col("lo_y") - pad) & (F.col("py") < F.col("hi_y") + pad) & (F.col("pz") > F.col("hi_z") + 0.02))
    over = keep(over.select("inst", "pz", "hi_z"))
    near = over.where(F.col("pz") < F.col("hi_z") + band)
    low = near.groupBy("inst").agg(F.min("pz").alias("z0"), F.count(F.lit(1)).alias("n_above")).where(F.col("n_above") >= min_points)
    bins = near.join(low, "inst").groupBy("inst", "z0", "n_above", F.floor((F.col("pz") - F.col("z0")) / 0.035).alias("bin")).count()
    mode = bins.groupBy("inst", "n_above", "z0").agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("bin"))
    mode = mode.select("inst", "n_above", (F.col("z0") + F.col("bin") * 0.035).alias("edge"))
    seen = over.join(mode, "inst").groupBy("inst", "n_above", "edge").agg(
        F.count_if((F.col("pz") < F.col("hi_z") + band) & (F.col("pz") > F.col("edge") - 0.035) & (F.col("pz") < F.col("edge") + 0.07)).alias("slab"),
        F.count_if((F.col("pz") > F.col("edge") + 0.17) & (F.col("pz") < F.col("edge") + 1.57)).alias("higher"),
    )
    ok = seen.where((F.col("slab") / F.col("n_above") >= 0.6) & (F.col("higher") <= 0.2 * F.col("slab")))
    return cand.join(ok, "inst").select(
        "inst", "n_points", F.bround(F.col("slab") / F.col("n_above"), 2).alias("ceiling_layer_frac"), F.bround("lo_z", 2).alias("zmin"), F.bround("hi_z", 2).alias("zmax"),
        F.bround(F.col("hi_z") - F.col("lo_z"), 2).alias("height"), F.bround(F.col("lo_z") - F.col("floor_z"), 2).alias("above_floor"),
        F.bround("normal_z", 3).alias("normal_z"), F.bround("thickness", 4).alias("rms_thickness"), F.col("n_above").alias("ceiling_pts_above"),
    )


def wall_filter(points: DataFrame, walls: DataFrame, floor_z: float, wall_eps: float = 0.15, outside_frac: float = 0.5, ceil_bottom: float = 2.2, hug_frac: float = 0.6, sheet_thin: float = 0.25, full_height: float = 2.2) -> DataFrame:
    """``why`` for clusters that are outside the room, ceiling fixtures, wall
    sheets or full-height wall bands (first that holds; null: kept).

    ``walls``: point_id -> wall_dist, room_dist (from the map). Thickness is
    that of the covariance's minor axis, overall and in 1 m segments along the
    major axis, solved from moments."""
    t = keep(points.join(walls, "point_id"))
    stat = t.groupBy("inst").agg(F.avg((F.col("wall_dist") < wall_eps).cast("double")).alias("hug"), F.avg((F.col("room_dist") <= 0).cast("double")).alias("outside"), (F.min("z") - floor_z).alias("bottom"), (F.max("z") - F.min("z")).alias("zspan"))

    def solve(batches):
        import pyarrow as pa

        for b in batches:
            d = b.to_pydict()
            rows = [[], [], [], []]
            for i in range(b.num_rows):
                k = d["n"][i] / max(d["n"][i] - 1, 1)
                c = np.array([[d["cxx"][i], d["cxy"][i], d["cxz"][i]], [d["cxy"][i], d["cyy"][i], d["cyz"][i]], [d["cxz"][i], d["cyz"][i], d["czz"][i]]], float) * k
                w, v = np.linalg.eigh(c)
                size = float(np.hypot(v[0, 2], v[1, 2])) or 1.0
                for r, value in zip(rows, (4.0 * np.sqrt(max(w[0], 0.0)), abs(v[2, 0]), v[0, 2] / size, v[1, 2] / size)):
                    r.append(float(value))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r, pa.float64()) for r in rows)], [b.schema.names[0], "minor", "axis_z", "ux", "uy"])

    def solved(df, by):
        m = moments(df, by)
        return m.mapInArrow(solve, f"{by} {dict(m.dtypes)[by]}, minor double, axis_z double, ux double, uy double")

    whole = keep(solved(t, "inst"))
    along = t.join(whole.select("inst", "ux", "uy"), "inst").withColumn("t", F.col("x") * F.col("ux") + F.col("y") * F.col("uy"))
    span = along.groupBy("inst").agg(F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("length"))
    seg = along.join(span, "inst").withColumn("seg", F.struct("inst", F.floor(F.col("t") - F.col("t0")).cast("long").alias("k")))
    big = seg.groupBy("seg").count().where("count >= 30").select("seg")
    local = solved(seg.join(big, "seg", "left_semi").withColumn("segment", F.to_json("seg")), "segment")
    local = local.select(F.get_json_object("segment", "$.inst").cast(dict(points.dtypes)["inst"]).alias("inst"), "minor").groupBy("inst").agg(F.percentile("minor", 0.5).alias("local"))
    out = stat.join(whole, "inst").join(span, "inst").join(local, "inst", "left").withColumn("local", F.coalesce("local", "minor"))
    why = (
        F.when(F.col("outside") > outside_frac, "outside room")
        .when(F.col("bottom") > ceil_bottom, "ceiling fixture")
        .when((F.col("hug") > hug_frac) & (F.col("minor") < sheet_thin) & (F.col("axis_z") < 0.4), "wall remnant")
        .when((F.col("hug") > hug_frac) & (F.col("zspan") > full_height) & (F.col("local") < 0.3) & (F.col("length") > 2.0), "full-height wall band")
    )
    return out.select("inst", why.alias("why"), "hug", "outside", "minor", "local", "zspan", "bottom", "length")


def outliers(points: DataFrame, k: int = 20, sigmas: float = 2.0, size: float = 0.2) -> DataFrame:
    """Drops points whose mean distance to k neighbours exceeds the mean of all
    by this many deviations."""
    from .joins import knn_join

    near = knn_join(points.select("point_id", "x", "y", "z"), points.select(F.col("point_id").alias("other"), "x", "y", "z"), k + 1, "point_id", "other", size)
    mean = keep(near.where("point_id <> other").groupBy("point_id").agg(F.avg(F.sqrt("d2")).alias("d")))
    lim = mean.agg((F.avg("d") + sigmas * F.stddev_pop("d")).alias("_lim"))
    return points.join(mean.crossJoin(F.broadcast(lim)).where("d <= _lim").select("point_id"), "point_id", "left_semi")


def baseline_segments(points: DataFrame, normals: DataFrame, floor_band: float = 0.15, ceiling_band: float = 0.15) -> DataFrame:
    """ceiling / floor / wall / clutter by normals and height; later rules win."""
    ends = points.agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    t = points.join(normals.select("point_id", "nz"), "point_id").crossJoin(F.broadcast(ends))
    flat, steep = F.abs("nz") > 0.85, F.abs("nz") < 0.3
    label = F.when(flat & (F.col("z") > F.col("_hi") - ceiling_band), "ceiling").when(flat & (F.col("z") < F.col("_lo") + floor_band), "floor").when(steep, "wall").otherwise("clutter")
    return t.withColumn("label", label).drop("_lo", "_hi", "nz")


def estimate_normals(points: DataFrame, radius: float = 0.15) -> DataFrame:
    """point_id, nx, ny, nz from the moments of the neighbours within a radius.
    Points of one place count together on either side."""
    from .components import keep
    from .joins import radius_join

    p = points.select("point_id", "x", "y", "z")
    places = keep(p.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("_n")).withColumn("_place", F.monotonically_increasing_id()))
    # from the place itself, so that products stay small
    near = radius_join(places, places, radius).select(F.col("a._place").alias("_place"), F.col("b._n").cast("double").alias("n"), *((F.col(f"b.{c}") - F.col(f"a.{c}")).alias(c) for c in "xyz"))
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = near.groupBy("_place").agg(*((mean(F.col(a) * F.col(b)) - mean(F.col(a)) * mean(F.col(b))).alias(f"c{a}{b}") for a, b in pairs))

    def solve(batches):
        import pyarrow as pa

        for b in batches:
            d = b.to_pydict()
            c = np.zeros((b.num_rows, 3, 3))
            for name, i, j in (("cxx", 0, 0), ("cxy", 0, 1), ("cxz", 0, 2), ("cyy", 1, 1), ("cyz", 1, 2), ("czz", 2, 2)):
                c[:, i, j] = c[:, j, i] = np.nan_to_num(np.array(d[name], float))
            n = np.linalg.eigh(c)[1][:, :, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, k], pa.float64()) for k in range(3))], ["_place", "nx", "ny", "nz"])

    normals = sums.mapInArrow(solve, "_place long, nx double, ny double, nz double")
    return p.join(places.drop("_n"), ["x", "y", "z"]).join(normals, "_place").select("point_id", "nx", "ny", "nz")
