"""Splitting compound clusters, ensembles over conditions, superpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .clustering import dbscan, neighbours
from .components import keep
from .joins import knn_by_place


def pole_cells(points: DataFrame, by: str, floor_z: float, size: float = 0.15, span: float = 1.3, ground: float = 0.35) -> DataFrame:
    """Columns that stand on the floor and are tall: by, i, j."""
    c = points.groupBy(by, F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j")).agg((F.max("z") - F.min("z")).alias("s"), F.min("z").alias("z0"))
    return c.where((F.col("s") > span) & (F.col("z0") < floor_z + ground)).select(by, "i", "j")


def support_height(points: DataFrame, by: str, floor_z: float, bins: int = 60, low: float = 0.5, high: float = 0.95, share: float = 0.03) -> DataFrame:
    """Height of the strongest bin between ``low`` and ``high`` above the floor,
    if it holds more than ``share`` of the points: by, zd."""
    e = points.groupBy(by).agg(F.min("z").alias("z0"), F.max("z").alias("z1"), F.count(F.lit(1)).alias("n"))
    w = (F.col("z1") - F.col("z0")) / bins
    b = points.join(e, by).where("z1 > z0").withColumn("bin", F.least(F.floor((F.col("z") - F.col("z0")) / w), F.lit(bins - 1)))
    h = b.groupBy(by, "bin", "z0", "z1", "n").agg(F.count(F.lit(1)).alias("k")).withColumn("zc", F.col("z0") + (F.col("bin") + 0.5) * w)
    h = h.where((F.col("zc") > floor_z + low) & (F.col("zc") < floor_z + high))
    best = h.groupBy(by).agg(F.max_by(F.struct("zc", "k", "n"), F.struct("k", -F.col("bin"))).alias("b"))
    return best.where(F.col("b.k") > share * F.col("b.n")).select(by, F.col("b.zc").alias("zd"))


def split_compound(points: DataFrame, by: str, floor_z: float, least: int = 150) -> DataFrame:
    """point_id, by, unit (null: left over). Poles, then the layers at, above
    and below the support plane; pieces of a layer are clustered in the plane.
    Pieces below that lie under the slab and reach near it belong to the desk."""
    size, column, by = 0.15, by, "_parent"
    points = points.withColumnRenamed(column, by)
    p = points.withColumn("i", F.floor(F.col("x") / size)).withColumn("j", F.floor(F.col("y") / size))
    pole = p.join(pole_cells(points, by, floor_z).withColumn("_p", F.lit(True)), [by, "i", "j"], "left").drop("i", "j")
    zd = support_height(pole.where("_p is null"), by, floor_z)
    layer = F.when(F.col("_p"), "pole").when(F.col("zd").isNull(), "c").when(F.col("z") > F.col("zd") + 0.08, "above").when(F.col("z") < F.col("zd") - 0.12, "below").otherwise("slab")
    t = keep(pole.join(zd, by, "left").withColumn("layer", layer).drop("_p"))
    key = F.concat_ws("/", F.col(by).cast("string"), "layer")
    parts = None
    for name, eps, k in (("pole", 0.25, 20), ("above", 0.18, 25), ("below", 0.18, 30), ("c", 0.18, 30)):
        one = dbscan(t.where(F.col("layer") == name).withColumn("key", key), eps, k, by="key", three_d=False)
        parts = one if parts is None else parts.unionByName(one)
    parts = keep(parts.where("inst >= 0"))
    n = parts.groupBy(by, "layer", "inst").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("top"), F.first("zd").alias("zd"))
    good = n.where((F.col("n") >= least) | (F.col("layer") == "pole"))
    cells = [F.floor(F.col("x") / 0.10).alias("i"), F.floor(F.col("y") / 0.10).alias("j")]
    slab = t.where("layer = 'slab'").select(by, *cells).distinct()
    under = parts.where("layer = 'below'").select(by, "inst", *cells).distinct()
    over = under.join(slab.withColumn("_s", F.lit(1)), [by, "i", "j"], "left").groupBy(by, "inst").agg(F.avg(F.coalesce("_s", F.lit(0)).cast("double")).alias("ov"))
    stored = good.where("layer = 'below'").join(over, [by, "inst"]).where((F.col("ov") >= 0.6) & (F.col("top") >= F.col("zd") - 0.30)).select(by, "inst", F.lit(True).alias("_d"))
    named = parts.join(good.select(by, "layer", "inst"), [by, "layer", "inst"], "left_semi").join(stored, [by, "inst"], "left")
    unit = F.when(F.col("_d") & (F.col("layer") == "below"), F.lit("desk")).otherwise(F.concat("layer", F.col("inst").cast("string")))
    found = named.select("point_id", unit.alias("unit")).unionAll(t.where("layer = 'slab'").select("point_id", F.lit("desk").alias("unit")))
    return points.select("point_id", by).join(found, "point_id", "left").withColumnRenamed(by, column)


def panel_columns(points: DataFrame, by: str, bin_: float = 0.03, sliver: float = 0.30) -> DataFrame:
    """point_id, by, column: cuts a bank of panels along its major axis where
    two or more bins in a row hold few points; narrow pieces join the one
    before."""
    from .aggregates import moments
    from .windows import low_runs

    m = moments(points, by)
    yaw = F.lit(0.5) * F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy"))
    m = m.select(by, "mx", "my", yaw.alias("yaw"))
    z = points.groupBy(by).agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    t = points.join(m, by).join(z, by).withColumn("u", (F.col("x") - F.col("mx")) * F.cos("yaw") + (F.col("y") - F.col("my")) * F.sin("yaw"))
    t = keep(t.withColumn("bin", F.floor(F.col("u") / bin_).cast("long")).select("point_id", by, "u", "bin", ((F.col("z") > F.col("z0") + 0.10) & (F.col("z") < F.col("z1") - 0.05)).alias("mid")))
    ends = t.groupBy(by).agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.min("u").alias("u0"), F.max("u").alias("u1"))
    every = ends.withColumn("bin", F.explode(F.sequence("b0", "b1"))).select(by, "bin")
    h = every.join(t.where("mid").groupBy(by, "bin").agg(F.count(F.lit(1)).alias("k")), [by, "bin"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    mid = h.where("k > 0").groupBy(by).agg(F.percentile("k", 0.5).alias("med"))
    h = h.join(mid, by).withColumn("low", F.col("k") < F.greatest(F.lit(4.0), F.col("med") / 2))
    runs = low_runs(h, by, "bin", F.col("low"))
    cuts = runs.select(by, ((F.col("first") + F.col("last") + 1) / 2 * bin_).alias("cut"))
    c = ends.join(cuts.groupBy(by).agg(F.array_sort(F.collect_list("cut")).alias("cuts")), by, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    # fold: a piece narrower than the sliver takes the next cut as its end
    start = F.struct(F.array().cast("array<double>").alias("kept"), (F.col("u0") - 0.01).alias("last"))
    step = lambda a, x: F.when(F.size(a["kept"]) == 0, F.struct(F.array_append(a["kept"], x).alias("kept"), x.alias("last"))).when(x - a["last"] < sliver, F.struct(F.concat(F.slice(a["kept"], 1, F.size(a["kept"]) - 1), F.array(x)).alias("kept"), x.alias("last"))).otherwise(F.struct(F.array_append(a["kept"], x).alias("kept"), x.alias("last")))
    c = c.select(by, F.aggregate("cuts", start, step)["kept"].alias("cuts"))
    return t.join(c, by).select("point_id", by, F.size(F.filter("cuts", lambda x: x <= F.col("u"))).alias("column"))


def square_up(points: DataFrame, units: DataFrame, pad: float = 0.06) -> DataFrame:
    """Points inside (or near) a panel's box go to it, the first unit winning:
    points (point_id, by parent, x, y, z), units (parent, unit, ord, box)."""
    box = points.alias("p").join(units.alias("u"), F.col("p.parent") == F.col("u.parent"))
    inside = box.where((F.col("x") >= F.col("x0") - pad) & (F.col("x") <= F.col("x1") + pad) & (F.col("y") >= F.col("y0") - pad) & (F.col("y") <= F.col("y1") + pad) & (F.col("z") >= F.col("z0") - 0.05) & (F.col("z") <= F.col("z1") + 0.05))
    return inside.groupBy("point_id").agg(F.min_by("unit", "ord").alias("unit"))


def evidence(objects: DataFrame, least_points: int = 250, least_fill: float = 0.1, most_area: float = 5.0, desk_area: float = 12.0, least_height: float = 0.1) -> DataFrame:
    """Candidates with enough evidence; desks may be larger."""
    area = F.when(F.col("type") == "desk", desk_area).otherwise(most_area)
    return objects.where((F.col("n_points") >= least_points) & (F.col("fill") >= least_fill) & (F.col("l") * F.col("w") <= area) & (F.col("h") >= least_height))


def merged_candidates(objects: DataFrame, footprint: float = 1.5, aspect: float = 4.0) -> DataFrame:
    """Clusters wide enough to hold several objects, but no long sheets."""
    a, b = F.greatest("l", "w"), F.least("l", "w")
    return objects.where((a >= footprint) & (a / F.greatest(b, F.lit(1e-6)) <= aspect))


def support(candidates: DataFrame, objects: DataFrame) -> DataFrame:
    """id -> conditions in which a matching candidate was found (sorted)."""
    from ..plans.graph import _extents
    from .joins import radius_join

    near = radius_join(objects, candidates, 0.5, condition=_extents("a", "b"))
    hit = near.groupBy(F.col("a.id").alias("id")).agg(F.array_sort(F.collect_set(F.col("b.condition"))).alias("found_in"))
    return objects.select("id").join(hit, "id", "left").withColumn("found_in", F.coalesce("found_in", F.array().cast("array<string>")))


def discoveries(candidates: DataFrame, objects: DataFrame) -> DataFrame:
    """Candidates that match no object, those of several conditions joined (the
    first stands), and the object each is a variant of, if one is near. Ordered
    by number of conditions, then points."""
    from ..plans.graph import _extents
    from .joins import radius_join

    known = radius_join(candidates, objects, 0.5, condition=_extents("a", "b")).select(F.col("a.name").alias("name")).distinct()
    new = keep(candidates.join(known, "name", "left_anti"))
    pair = radius_join(new, new, 0.5, three_d=False, condition=(F.col("a.ord") > F.col("b.ord")) & _extents("a", "b")).where("d2 < 0.25").select(F.col("a.ord").alias("ord"), F.col("b.ord").alias("other"), F.col("a.map_id").alias("map_id"))

    def fold(table):
        import pyarrow as pa

        rows: dict[int, list[int]] = {}
        for o, q in zip(table.column("ord").to_pylist(), table.column("other").to_pylist()):
            rows.setdefault(o, []).append(q)
        first: dict[int, int] = {}
        for o in sorted(rows):
            heads = [q for q in sorted(rows[o]) if q not in first]
            if heads:
                first[o] = heads[0]
        return pa.table({"ord": pa.array(list(first), pa.int64()), "head": pa.array(list(first.values()), pa.int64())})

    dup = pair.groupBy("map_id").applyInArrow(fold, "ord long, head long")
    t = new.join(dup, "ord", "left").withColumn("head", F.coalesce("head", "ord"))
    g = t.groupBy("head").agg(F.array_sort(F.collect_set("condition")).alias("conditions"), F.min_by(F.struct("name", "x", "y", "z", "l", "w", "h", "n_points"), "ord").alias("f"))
    g = g.select(F.col("head").alias("ord"), "f.*", "conditions")
    near = radius_join(g, objects.select(F.col("id").alias("oid"), "x", "y"), 0.7, three_d=False).where("d2 < 0.49").groupBy(F.col("a.ord").alias("ord")).agg(F.min(F.col("b.oid")).alias("variant_of"))
    return g.join(near, "ord", "left").orderBy(F.col("variant_of").isNotNull(), -F.size("conditions"), F.col("n_points").desc(), "ord")


def superpoints(points: DataFrame, normals: DataFrame, k: int = 16, threshold: float = 0.04, least: int = 20, size: float = 0.1) -> DataFrame:
    """point_id, segment: edges to k neighbours, weighted by how much normals
    differ and by distance, merge segments in rising order while an edge is not
    heavier than what both hold inside; small segments join a neighbour. The
    graph comes from a distributed neighbour join; merging is sequential."""
    p = points.select("scan_id", "point_id", "x", "y", "z")
    near = knn_by_place(p, p.select(F.col("point_id").alias("other"), "x", "y", "z"), k + 1, "point_id", "other", size).where("point_id <> other")
    n = normals.select("point_id", "nx", "ny", "nz")
    e = near.join(n, "point_id").join(n.select(F.col("point_id").alias("other"), F.col("nx").alias("mx"), F.col("ny").alias("my"), F.col("nz").alias("mz")), "other")
    e = e.join(p.select("point_id", "scan_id"), "point_id")
    d = F.sqrt("d2")
    mid = F.percentile(d, F.lit(0.5)).over(Window.partitionBy("scan_id"))
    w = 1 - F.least(F.lit(1.0), F.abs(F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))) + 0.2 * d / (mid + 1e-9)
    e = e.withColumn("w", w).select("scan_id", F.least("point_id", "other").alias("a"), F.greatest("point_id", "other").alias("b"), "w").groupBy("scan_id", "a", "b").agg(F.min("w").alias("w"))

    def merge(table):
        import pyarrow as pa

        rows = sorted(zip(table.column("w").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist()))
        parent, count, inside = {}, {}, {}

        def root(v):
            parent.setdefault(v, v)
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        def join(x, y, weight):
            if count.get(x, 1) < count.get(y, 1):
                x, y = y, x
            parent[y] = x
            count[x] = count.get(x, 1) + count.get(y, 1)
            inside[x] = max(inside.get(x, 0.0), inside.get(y, 0.0), weight)

        for weight, a, b in rows:
            x, y = root(a), root(b)
            if x != y and weight <= min(inside.get(x, 0.0) + threshold / count.get(x, 1), inside.get(y, 0.0) + threshold / count.get(y, 1)):
                join(x, y, weight)
        for weight, a, b in rows:
            x, y = root(a), root(b)
            if x != y and min(count.get(x, 1), count.get(y, 1)) < least:
                join(x, y, weight)
        ids = sorted(parent)
        roots = [root(v) for v in ids]
        low: dict[int, int] = {}
        for v, r in zip(ids, roots):
            low[r] = min(low.get(r, v), v)
        return pa.table({"point_id": pa.array(ids, pa.int64()), "segment": pa.array([low[r] for r in roots], pa.int64())})

    return e.groupBy("scan_id").applyInArrow(merge, "point_id long, segment long")


def hug_fraction(points: DataFrame, walls: DataFrame, by: str, eps: float = 0.15) -> DataFrame:
    """Share of each cluster's points near a wall; walls: point_id, wall_dist."""
    return points.join(walls, "point_id").groupBy(by).agg(F.avg((F.col("wall_dist") < eps).cast("double")).alias("hug"), F.count_if(F.col("wall_dist") >= eps).alias("off_wall"))


def residual_counts(points: DataFrame, walls: DataFrame, unit: str, eps: float = 0.15) -> DataFrame:
    """Where points without a unit lie: wall band, outside, or residual."""
    left = points.where(F.col(unit).isNull()).join(walls, "point_id")
    where = F.when(F.col("room_dist") <= 0, "outside").when(F.col("wall_dist") < eps, "wall band").otherwise("residual")
    return left.groupBy(where.alias("where")).agg(F.count(F.lit(1)).alias("n"))


def ring_of(cells: DataFrame) -> DataFrame:
    """Cells just outside of a set."""
    return neighbours(cells.select("i", "j"), True).distinct().join(cells.select("i", "j"), ["i", "j"], "left_anti")


def wall_compounds(points: DataFrame, walls: DataFrame, by: str, eps: float = 0.15, hug: float = 0.25, off_wall: int = 250, span: float = 2.0) -> DataFrame:
    """Clusters that hug a wall, but have enough points off it and are wide:
    things that stand against the wall and were clustered with it."""
    wide = points.groupBy(by).agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    return hug_fraction(points, walls, by, eps).join(wide, by).where((F.col("hug") >= hug) & (F.col("off_wall") >= off_wall) & (F.col("span") >= span))
