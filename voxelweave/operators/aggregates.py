"""Aggregates of points and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G


def voxel_downsample(points: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), by: tuple[str, ...] = ()) -> DataFrame:
    """Mean position and colour of every occupied voxel, with its count. One
    partial aggregation before the shuffle."""
    cells = [F.floor((F.col(c) - F.lit(o)) / F.lit(size)).cast("long").alias(f"v{c}") for c, o in zip("xyz", origin)]
    means = [F.avg(c).alias(c) for c in ("x", "y", "z", "r", "g", "b") if c in points.columns]
    return points.groupBy(*by, *cells).agg(*means, F.count(F.lit(1)).alias("n"))


def voxel_first(points: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """(voxel, its first point) and (point_id, voxel)."""
    cells = [F.floor(F.col(c) / F.lit(size)).cast("long").alias(f"v{c}") for c in "xyz"]
    inverse = points.select("point_id", *cells)
    return inverse.groupBy("vx", "vy", "vz").agg(F.min("point_id").alias("first")), inverse


def object_table(points: DataFrame, min_points: int = 50) -> DataFrame:
    """Per cluster: count, centroid, box; noise and small clusters left out."""
    out = points.where("inst >= 0").groupBy("inst").agg(
        F.count(F.lit(1)).alias("n_points"),
        *(F.avg(c).alias(f"c{c}") for c in "xyz"),
        *(F.min(c).alias(f"min_{c}") for c in "xyz"),
        *(F.max(c).alias(f"max_{c}") for c in "xyz"),
    )
    return out.where(F.col("n_points") >= min_points)


def manifest(objects: DataFrame) -> DataFrame:
    """objects.csv: rounded centroids and sizes."""
    return objects.select(
        F.col("inst").alias("id"), F.format_string("obj_%04d.ply", "inst").alias("file"), "n_points",
        *(F.bround(f"c{c}", 3).alias(f"c{c}") for c in "xyz"),
        *(F.bround(F.col(f"max_{c}") - F.col(f"min_{c}"), 3).alias(f"size_{c}") for c in "xyz"),
    )


def yaw_and_footprint(points: DataFrame, by: str = "inst") -> DataFrame:
    """Direction of the major axis (mod pi) and the tight extents along it.
    Two passes of plain aggregates: moments, then ranges in the turned frame.
    Fewer than three points: yaw 0 and plain ranges."""
    m = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("vxx"), F.covar_pop("x", "y").alias("vxy"), F.var_pop("y").alias("vyy"))
    m = m.select(by, F.when(F.col("n") >= 3, G.pca_yaw(F.col("vxx"), F.col("vxy"), F.col("vyy"))).otherwise(0.0).alias("yaw"))
    t = points.join(m, by)
    u = F.col("x") * F.cos("yaw") + F.col("y") * F.sin("yaw")
    v = F.col("y") * F.cos("yaw") - F.col("x") * F.sin("yaw")
    return t.groupBy(by).agg(F.first("yaw").alias("yaw"), (F.max(u) - F.min(u)).alias("length"), (F.max(v) - F.min(v)).alias("width"), (F.max("z") - F.min("z")).alias("height"), *(((F.max(c) + F.min(c)) / 2).alias(c) for c in "xyz"))


def moments(points: DataFrame, by: str) -> DataFrame:
    """Ten sums of a group, from which planes are fitted: no points move."""
    p = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{c}") for c in "xyz"), *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in p))


def plane_stats(points: DataFrame, by: str) -> DataFrame:
    """|z| of the best plane's normal and the spread off it, from moments."""

    def solve(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            d = b.to_pydict()
            nz, thick = [], []
            for i in range(b.num_rows):
                a, bb, c, e, f, g = (d[k][i] or 0.0 for k in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz"))
                w, v = np.linalg.eigh(np.array([[a, bb, c], [bb, e, f], [c, f, g]]))
                nz.append(abs(float(v[2, 0])))
                thick.append(float(np.sqrt(max(w[0], 0.0))))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(by)), pa.array(nz, pa.float64()), pa.array(thick, pa.float64())], [by, "normal_z", "thickness"])

    m = moments(points, by)
    return m.mapInArrow(solve, f"{by} {dict(m.dtypes)[by]}, normal_z double, thickness double")


def floor_height(points: DataFrame, size: float = 0.05) -> DataFrame:
    """Centre of the densest bin below the median height (first of ties)."""
    low = points.crossJoin(F.broadcast(points.agg(F.percentile("z", 0.5).alias("_m")))).where("z < _m")
    base = low.agg(F.min("z").alias("_lo"))
    bins = low.crossJoin(F.broadcast(base)).groupBy(F.floor((F.col("z") - F.col("_lo")) / F.lit(size)).alias("bin"), "_lo").count()
    return bins.agg(F.max_by(F.struct("bin", "_lo"), F.struct(F.col("count"), -F.col("bin"))).alias("b")).select((F.col("b._lo") + (F.col("b.bin") + 0.5) * F.lit(size)).alias("floor_z"))


def floor_from_records(objects: DataFrame) -> DataFrame:
    """The bottom at position n / 4 of the sorted bottoms."""
    from .components import numbered

    n = objects.select((F.col("z") - F.col("h") / 2).alias("bottom"), "id")
    return numbered(n, [F.col("bottom"), F.col("id")], "_r").where(F.col("_r") == n.count() // 4).select(F.col("bottom").alias("floor_z"))


def fill_ratio(points: DataFrame, by: str, size: float = 0.1) -> DataFrame:
    """Occupied cells of the footprint over the cells of its box."""
    i, j = (F.floor(F.col(c) / F.lit(size)) for c in "xy")
    t = points.select(by, i.alias("i"), j.alias("j")).distinct()
    box = (F.max("i") - F.min("i") + 1) * (F.max("j") - F.min("j") + 1)
    return t.groupBy(by).agg((F.count(F.lit(1)) / box).alias("fill"), (box * F.lit(size * size)).alias("area"))


def occupancy(points: DataFrame, size: float, rule: str = "floor") -> DataFrame:
    return points.groupBy(G.cell("x", size, rule).alias("i"), G.cell("y", size, rule).alias("j")).agg(F.count(F.lit(1)).alias("n"))


def yaw_histogram(normals: DataFrame, bins: int = 180) -> DataFrame:
    """The commonest direction modulo 90 degrees: centre of the fullest bin."""
    a = F.pmod(F.degrees(F.atan2("ny", "nx")), F.lit(90.0))
    b = F.least(F.floor(a / F.lit(90.0 / bins)), F.lit(bins - 1)).alias("bin")
    n = normals.groupBy(b).count()
    return n.agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("bin")).select(((F.col("bin") + 0.5) * F.lit(90.0 / bins)).alias("yaw_deg"))


def normalize(points: DataFrame) -> DataFrame:
    """x and y less their means, z less its minimum."""
    m = points.agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"), F.min("z").alias("_z"))
    return points.crossJoin(F.broadcast(m)).withColumns({c: F.col(c) - F.col(f"_{c}") for c in "xyz"}).drop("_x", "_y", "_z")


def unit_sphere(points: DataFrame, by: str) -> DataFrame:
    """Centred on the mean and scaled to the farthest point's distance."""
    c = points.groupBy(by).agg(*(F.avg(a).alias(f"_{a}") for a in "xyz"))
    t = points.join(c, by).withColumns({a: F.col(a) - F.col(f"_{a}") for a in "xyz"}).drop("_x", "_y", "_z")
    far = t.groupBy(by).agg(F.sqrt(F.max(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("_far"))
    return t.join(far, by).withColumns({a: F.col(a) / F.greatest(F.col("_far"), F.lit(1e-12)) for a in "xyz"}).drop("_far")


def center_shift(points: DataFrame, apply_z: bool = True) -> DataFrame:
    """Moves the box's centre to the origin; z to its minimum, if at all."""
    m = points.agg(((F.min("x") + F.max("x")) / 2).alias("_x"), ((F.min("y") + F.max("y")) / 2).alias("_y"), F.min("z").alias("_z"))
    out = points.crossJoin(F.broadcast(m)).withColumns({"x": F.col("x") - F.col("_x"), "y": F.col("y") - F.col("_y")})
    return (out.withColumn("z", F.col("z") - F.col("_z")) if apply_z else out).drop("_x", "_y", "_z")


def depth_grid(points: DataFrame, views: list[tuple[float, float]], cells: int = 64, by: str = "inst") -> DataFrame:
    """Greatest depth per view, row and column: azimuth and elevation in
    degrees; points in the unit sphere."""
    spark = points.sparkSession
    v = F.broadcast(spark.createDataFrame([(i, float(a), float(e)) for i, (a, e) in enumerate(views)], "view int, az double, el double"))
    t = points.crossJoin(v)
    a, e = F.radians("az"), F.radians("el")
    u = F.col("x") * F.cos(a) + F.col("y") * F.sin(a)
    w = F.col("y") * F.cos(a) - F.col("x") * F.sin(a)
    row = F.col("z") * F.cos(e) - u * F.sin(e)
    depth = u * F.cos(e) + F.col("z") * F.sin(e)

    def index(c):
        return F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor((c + 1) / 2 * cells))).cast("int")

    return t.groupBy(by, "view", index(row).alias("row"), index(w).alias("col")).agg(F.max(depth).alias("depth"))
