"""Places: rooms from occupancy grids, membership, adjacency and ring codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..operators.clustering import neighbours
from ..operators.components import keep
from ..operators.joins import grid_join, knn_join, nearest_cell


def _boxes(places: DataFrame) -> DataFrame:
    """Places with the centre and the half sides of their ring's box."""
    side = {c: (F.array_min(F.transform("polygon", lambda p: p[c])), F.array_max(F.transform("polygon", lambda p: p[c]))) for c in "xy"}  # noqa: B023
    return places.select("place", "ord", "polygon", *(((lo + hi) / 2).alias(c) for c, (lo, hi) in side.items()), *(((hi - lo) / 2).alias(f"h{c}") for c, (lo, hi) in side.items()))


def in_polygons(objects: DataFrame, places: DataFrame, size: float = 4.0) -> DataFrame:
    """id -> the first place (by ord) whose ring holds the object, or null.
    Objects meet the places whose box touches their cell."""
    inside = (F.abs(F.col("a.x") - F.col("p.x")) <= F.col("p.hx")) & (F.abs(F.col("a.y") - F.col("p.y")) <= F.col("p.hy")) & G.point_in_ring(F.col("a.x"), F.col("a.y"), F.col("p.polygon"))
    hit = grid_join(objects.select("id", "x", "y"), _boxes(places), F.lit(0.0), F.greatest("hx", "hy"), inside, size, ("a", "p"))
    first = hit.groupBy(F.col("a.id").alias("id")).agg(F.min_by(F.col("p.place"), F.col("p.ord")).alias("place"))
    return objects.select("id").join(first, "id", "left")


def in_or_near_polygons(objects: DataFrame, places: DataFrame, size: float = 4.0) -> DataFrame:
    """As in_polygons; objects outside of all go to the nearest ring (ties: by
    ord). The nearest corner of any ring bounds how far that is, and only rings
    whose box comes so near are measured."""
    found = in_polygons(objects, places, size)
    lost = objects.join(found.where("place is null").select("id"), "id", "left_semi").select("id", "x", "y")
    corners = places.select(F.explode("polygon").alias("p")).select("p.x", "p.y").distinct().withColumn("_corner", F.xxhash64("x", "y"))
    reach = knn_join(lost, corners, 1, "id", "_corner", size, ("x", "y")).select("id", F.sqrt("d2").alias("reach"))
    apart = [F.greatest(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) - F.col(f"b.h{c}"), F.lit(0.0)) for c in "xy"]
    close = F.hypot(*apart) <= F.col("a.reach") * 1.000001 + 1e-9
    # objects far from all rings look in coarser cells, so that none touches more than nine
    away = keep(lost.join(reach, "id").withColumn("level", F.greatest(F.ceil(F.log2(F.col("reach") / F.lit(size) + 1e-9)), F.lit(0)).cast("int")))
    levels = [r[0] for r in away.select("level").distinct().collect()]  # of doublings: some tens at most
    side = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level"))
    boxes = _boxes(places).withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    pairs = grid_join(away, boxes, F.col("reach") * 1.000001 + 1e-9, F.greatest("hx", "hy"), close, side, ("a", "b"), keys=("level",))
    near = pairs.groupBy(F.col("a.id").alias("id")).agg(F.min_by(F.col("b.place"), F.struct(G.ring_distance(F.col("a.x"), F.col("a.y"), F.col("b.polygon")), F.col("b.ord"))).alias("near"))
    return found.join(near, "id", "left").select("id", F.coalesce("place", "near").alias("place"))


def in_cells(objects: DataFrame, cells: DataFrame, size: float, rule: str = "floor") -> DataFrame:
    """id -> place of the cell under the object; without one no row."""
    o = objects.select("id", G.cell("x", size, rule).alias("i"), G.cell("y", size, rule).alias("j"))
    return o.join(cells.select("i", "j", "place"), ["i", "j"]).select("id", "place")


def in_or_near_cells(objects: DataFrame, cells: DataFrame, size: float, rule: str = "floor") -> DataFrame:
    """As in_cells; objects off the map go to the nearest cell by squared index
    distance (ties: smallest i, then j)."""
    o = objects.select("id", G.cell("x", size, rule).alias("i"), G.cell("y", size, rule).alias("j"))
    hit = o.join(cells.select("i", "j", "place"), ["i", "j"], "left")
    near = nearest_cell(hit.where("place is null").select("id", "i", "j"), cells, "id", "place").withColumnRenamed("place", "near")
    return hit.join(near, "id", "left").select("id", F.coalesce("place", "near").alias("place"))


def attributes(cells: DataFrame, res: float, origin: tuple[float, float], aspect: float = 3.0, width: float = 2.0) -> DataFrame:
    """Area, centroid, box and kind of every place."""
    s = cells.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.avg("i").alias("mi"), F.avg("j").alias("mj"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    w, h = (F.col("i1") - F.col("i0")) * F.lit(res), (F.col("j1") - F.col("j0")) * F.lit(res)
    narrow = (F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1e-6)) >= aspect) & (F.least(w, h) <= width)
    return s.select(
        "place", F.when(narrow, "corridor").otherwise("room").alias("type"), (F.col("n") * F.lit(res * res)).alias("area_m2"),
        (F.lit(origin[0]) + F.col("mi") * F.lit(res)).alias("cx"), (F.lit(origin[1]) + F.col("mj") * F.lit(res)).alias("cy"),
        *((F.lit(origin[0 if c[0] == "i" else 1]) + F.col(c) * F.lit(res)).alias(n) for c, n in (("i0", "x0"), ("j0", "y0"), ("i1", "x1"), ("j1", "y1"))),
    )


def connectivity(cells: DataFrame, res: float, origin: tuple[float, float], least: int = 3) -> DataFrame:
    """Pairs of places (a < b) with at least ``least`` cells of a that touch b,
    and the doorway: the mean of those cells."""
    moved = neighbours(cells.select("i", "j", F.col("place").alias("b"), F.col("i").alias("bi"), F.col("j").alias("bj")), False)
    border = moved.join(cells.select("i", "j", F.col("place").alias("a")), ["i", "j"]).where("a < b").select("a", "b", "i", "j").distinct()
    return border.groupBy("a", "b").agg(F.count(F.lit(1)).alias("border_cells"), (F.lit(origin[0]) + F.avg("i") * F.lit(res)).alias("door_x"), (F.lit(origin[1]) + F.avg("j") * F.lit(res)).alias("door_y")).where(F.col("border_cells") >= least)


def adjacency(cells: DataFrame) -> DataFrame:
    """Unordered pairs of places that share an edge of two cells."""
    right = cells.select((F.col("i") - 1).alias("i"), "j", F.col("place").alias("q"))
    up = cells.select("i", (F.col("j") - 1).alias("j"), F.col("place").alias("q"))
    t = cells.select("i", "j", "place").join(right.unionAll(up), ["i", "j"]).where("place <> q")
    return t.select(F.least("place", "q").alias("a"), F.greatest("place", "q").alias("b")).distinct()


def ring_code(members: DataFrame, centers: DataFrame, convention: str = "ccw_x", rounded: bool = False, verified_only: bool = True) -> DataFrame:
    """place -> ordered [{bearing, type, name}] around its centre, and counts.
    members: place, id, name, type, status, x, y."""
    t = members.join(centers.select("place", "cx", "cy"), "place")
    b = G.bearing(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), convention)
    t = t.withColumn("bearing", F.bround(b, 1) if rounded else b)
    ok = F.col("status").startswith("verified")
    item = F.struct("bearing", "type", "name")
    ring = F.array_sort(F.collect_list(F.when(ok, item) if verified_only else item))
    return t.groupBy("place").agg(ring.alias("ring"), F.count(F.lit(1)).alias("members"), F.count_if(ok).alias("verified"))


def place_name(rings: DataFrame) -> DataFrame:
    """Places with an empty ring are unknown; others wait for a namer."""
    return rings.withColumn("name", F.when(F.size("ring") == 0, "unknown_area"))


def enclosing_place(objects: DataFrame, margin: float = 0.5) -> DataFrame:
    """One room around all objects."""
    r = G.footprint_radius(F.col("l"), F.col("w"))
    return objects.agg(*((F.min(F.col(c) - r) - margin).alias(f"{c}0") for c in "xy"), *((F.max(F.col(c) + r) + margin).alias(f"{c}1") for c in "xy")).selectExpr("*", "(x1 - x0) * (y1 - y0) as area_m2", "(x0 + x1) / 2 as cx", "(y0 + y1) / 2 as cy")


def merge_names(places: DataFrame, names: DataFrame) -> DataFrame:
    """Named places keep their name, others are numbered."""
    return places.join(names, "place", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("place_"), F.lpad(F.col("place").cast("string"), 2, "0"))))


# rooms of a raster map: one grid is one task


def distance_transform(free: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of free cells to the nearest other cell: columns
    first, then the lower envelope along rows by squares."""
    far = float(sum(free.shape) + 1)
    d = np.where(free, far, 0.0)
    for r in range(1, d.shape[0]):
        d[r] = np.minimum(d[r], d[r - 1] + 1)
    for r in range(d.shape[0] - 2, -1, -1):
        d[r] = np.minimum(d[r], d[r + 1] + 1)
    sq, cols = d * d, np.arange(d.shape[1])
    out = np.empty_like(sq)
    gap = (cols[:, None] - cols[None, :]) ** 2
    for r in range(len(sq)):
        out[r] = (sq[r][None, :] + gap).min(1)
    return np.sqrt(out)


def _label(mask: np.ndarray) -> np.ndarray:
    """4-connected components, numbered from 1 in scan order."""
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        stack = [start]
        out[start] = n
        while stack:
            r, c = stack.pop()
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not out[q]:
                    out[q] = n
                    stack.append(q)
    return out


def flood(markers: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Every free cell gets the marker that reaches it in the fewest steps
    (ties: the smaller marker)."""
    out = markers.copy()
    front = out > 0
    while front.any():
        best = np.full(out.shape, np.iinfo(int).max)
        src = np.where(front, out, np.iinfo(int).max)
        best[1:] = np.minimum(best[1:], src[:-1])
        best[:-1] = np.minimum(best[:-1], src[1:])
        best[:, 1:] = np.minimum(best[:, 1:], src[:, :-1])
        best[:, :-1] = np.minimum(best[:, :-1], src[:, 1:])
        front = free & (out == 0) & (best < np.iinfo(int).max)
        out[front] = best[front]
    return out


def segment_rooms(value: np.ndarray, res: float, door_radius: float = 0.6, min_room_m2: float = 2.0, peak_min_dist: float = 1.5, merge_width: float = 2.0, free_above: int = 250) -> np.ndarray:
    """Rooms of a map: cores farther from walls than a door's radius grow over
    the free cells, basins with a wide border are joined, small ones dropped."""
    free = value >= free_above
    dist = distance_transform(free) * res
    reach = max(1, int(round(peak_min_dist / res)))
    top = dist.copy()
    for axis in (0, 1):
        acc = top.copy()
        for k in range(1, reach + 1):
            for sign in (1, -1):
                moved = np.roll(top, sign * k, axis)
                edge = [slice(None)] * 2
                edge[axis] = slice(0, k) if sign > 0 else slice(-k, None)
                moved[tuple(edge)] = 0
                acc = np.maximum(acc, moved)
        top = acc
    labels = flood(_label((dist >= top) & (dist > door_radius)), free)
    parent = list(range(labels.max() + 1))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    width: dict[tuple[int, int], float] = {}
    for a, b, d in ((labels[1:], labels[:-1], np.minimum(dist[1:], dist[:-1])), (labels[:, 1:], labels[:, :-1], np.minimum(dist[:, 1:], dist[:, :-1]))):
        m = (a != b) & (a > 0) & (b > 0)
        for x, y, v in zip(a[m].tolist(), b[m].tolist(), d[m].tolist()):
            k = (min(x, y), max(x, y))
            width[k] = max(width.get(k, 0.0), v)
    for (x, y), v in sorted(width.items()):
        if 2 * v > merge_width:
            p, q = root(x), root(y)
            parent[max(p, q)] = min(p, q)
    labels = np.array([root(k) for k in range(len(parent))])[labels]
    out, n = np.zeros_like(labels), 0
    for k in np.unique(labels[labels > 0]):
        if (labels == k).sum() * res * res >= min_room_m2:
            n += 1
            out[labels == k] = n
    return out


def smoothed(cells: DataFrame, sigma: float = 4.0, reach: int | None = None) -> DataFrame:
    """cells (i, j, place) with the place that weighs most around each: votes of
    the cells within reach, by a Gaussian of their distance (ties: the smaller
    place)."""
    n = reach or max(1, round(3 * sigma))
    steps = F.sequence(F.lit(-n), F.lit(n))
    votes = cells.select("i", "j", "place").withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps))
    weight = F.exp(-(F.col("a") * F.col("a") + F.col("b") * F.col("b")) / F.lit(2.0 * sigma * sigma))
    votes = votes.groupBy((F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j"), "place").agg(F.sum(weight).alias("w"))
    best = votes.join(cells.select("i", "j"), ["i", "j"], "left_semi").groupBy("i", "j")
    return best.agg(F.max_by("place", F.struct(F.round("w", 9), -F.col("place"))).alias("place"))


def distances(cells: DataFrame, by: str = "map_id", free_above: int = 250) -> DataFrame:
    """cells (map_id, row, col, value) -> map_id, i (col), j (row), cells to the
    nearest cell that is not free. A map is one task."""

    def run(pdf):
        import pandas as pd

        grid = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), int)
        grid[pdf["row"], pdf["col"]] = pdf["value"]
        d = distance_transform(grid >= free_above)
        r, c = np.nonzero(d)
        return pd.DataFrame({by: pdf[by].iloc[0], "i": c.astype("int32"), "j": r.astype("int32"), "dist": d[r, c]})

    return cells.select(by, "row", "col", "value").groupBy(by).applyInPandas(run, f"{by} {dict(cells.dtypes)[by]}, i int, j int, dist double")


def rooms(cells: DataFrame, res: float, by: str = "map_id", **options) -> DataFrame:
    """cells (map_id, row, col, value) -> map_id, i (col), j (row), place."""

    def run(pdf):
        import pandas as pd

        grid = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), int)
        grid[pdf["row"], pdf["col"]] = pdf["value"]
        lab = segment_rooms(grid, res, **options)
        r, c = np.nonzero(lab)
        return pd.DataFrame({by: pdf[by].iloc[0], "i": c.astype("int32"), "j": r.astype("int32"), "place": lab[r, c].astype("int32")})

    return cells.select(by, "row", "col", "value").groupBy(by).applyInPandas(run, f"{by} {dict(cells.dtypes)[by]}, i int, j int, place int")


def slic_places(cells: DataFrame, k: int, res: float, min_m2: float = 1.5, rounds: int = 10, by: str = "map_id") -> DataFrame:
    """Masked k-means of cell positions into about k compact regions; pieces
    under min_m2 go to the nearest region left."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["i", "j"]).reset_index(drop=True)
        p = pdf[["i", "j"]].to_numpy(float)
        c = p[np.linspace(0, len(p) - 1, min(k, len(p))).astype(int)]
        for _ in range(rounds):
            near = ((p[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([p[near == n].mean(0) if (near == n).any() else c[n] for n in range(len(c))])
        i0, j0 = int(p[:, 0].min()), int(p[:, 1].min())
        grid = np.zeros((int(p[:, 0].max()) - i0 + 1, int(p[:, 1].max()) - j0 + 1), int)
        at = (p[:, 0].astype(int) - i0, p[:, 1].astype(int) - j0)
        grid[at] = near + 1
        out, n, small = np.zeros(len(p), int), 0, []
        for v in range(1, len(c) + 1):
            parts = _label(grid == v)
            for q in range(1, parts.max() + 1):
                m = parts[at] == q
                if m.sum() * res * res >= min_m2:
                    n += 1
                    out[m] = n
                else:
                    small.append(m)
        for m in small:
            if n:
                done = out > 0
                d = ((p[m][:, None, :] - p[done][None]) ** 2).sum(2).argmin(1)
                out[m] = out[done][d]
        return pd.DataFrame({by: pdf[by], "i": pdf["i"], "j": pdf["j"], "place": out.astype("int32")})

    return cells.select(by, "i", "j").groupBy(by).applyInPandas(run, f"{by} {dict(cells.dtypes)[by]}, i int, j int, place int")
