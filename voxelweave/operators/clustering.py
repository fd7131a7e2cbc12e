"""Density clustering on grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .components import components, dense_ids, keep
from .joins import radius_join


def dbscan(points: DataFrame, eps: float, min_points: int, by: str | None = None, three_d: bool = True) -> DataFrame:
    """points (point_id, x, y, z) with ``inst``: -1 for noise.

    A point with at least min_points neighbours within eps, itself included, is
    a core. Cores within eps of each other form a cluster; a border point joins
    the cluster of its smallest core. Clusters are numbered by their smallest
    core. ``by``: cluster within each value of this column.

    The neighbour count is exact; cells of size eps bound what a point meets.
    Cores of one cell of side eps / sqrt(dims) are always neighbours and count
    as one node, so links join cells, not points.
    """
    axes = ("x", "y", "z") if three_d else ("x", "y")
    keys = [by] if by else []
    p = keep(points.select("point_id", *axes, *keys))
    same = F.col(f"a.{by}") == F.col(f"b.{by}") if by else None
    # points of one fine cell are neighbours: a cell of min_points is all core,
    # and only points of other cells count theirs
    fine = eps / (len(axes) ** 0.5)
    cells = [F.floor(F.col(c) / F.lit(fine)).cast("long") for c in axes]
    marked = p.withColumns({f"_f{c}": e for c, e in zip(axes, cells)})
    full = marked.groupBy(*(f"_f{c}" for c in axes), *keys).count().where(F.col("count") >= min_points).drop("count")
    dense = marked.join(full, [*(f"_f{c}" for c in axes), *keys], "left_semi").select(*p.columns)
    sparse = marked.join(full, [*(f"_f{c}" for c in axes), *keys], "left_anti").select(*p.columns)
    pairs = radius_join(sparse, p, eps, three_d=three_d, condition=same)
    n = pairs.groupBy(F.col("a.point_id").alias("point_id")).agg(F.count(F.lit(1)).alias("n"))
    core = dense.unionByName(sparse.join(n.where(F.col("n") >= min_points).select("point_id"), "point_id", "left_semi"))
    # cores of one fine cell are one node: its smallest core
    core = core.withColumn("node", F.min("point_id").over(Window.partitionBy(*cells, *keys)))
    core = keep(core)
    links = radius_join(core, core, eps, three_d=three_d, condition=(F.col("a.node") < F.col("b.node")) & (same if by else F.lit(True)))
    links = links.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    comp = components(links)
    label = core.join(comp, core["node"] == comp["node"], "left").select("point_id", *axes, *keys, F.coalesce("comp", core["node"]).alias("_lab"))
    label = keep(label)
    rest = p.join(label.select("point_id"), "point_id", "left_anti")
    border = radius_join(rest, label, eps, three_d=three_d, condition=same).groupBy(F.col("a.point_id").alias("point_id")).agg(F.min_by(F.col("b._lab"), F.col("b.point_id")).alias("_lab"))
    found = label.select("point_id", "_lab").unionAll(border)
    out = dense_ids(points.join(found, "point_id", "left"), "_lab", "inst")
    return out.withColumn("inst", F.coalesce("inst", F.lit(-1))).drop("_lab")


def dbscan_split(points: DataFrame, eps: float = 0.30, min_points: int = 100, footprint: float = 1.2, split_eps: float = 0.12, split_min_points: int = 60) -> tuple[DataFrame, int]:
    """dbscan, then clusters whose x or y extent exceeds ``footprint`` are
    clustered again with the tighter setting. A split counts if it leaves two
    clusters of split_min_points; its other points become noise. Returns the
    points with ``inst`` and the number of splits."""
    base = keep(dbscan(points, eps, min_points))
    span = base.where("inst >= 0").groupBy("inst").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("foot"))
    wide = base.join(span.where(F.col("foot") > footprint).select("inst"), "inst", "left_semi").withColumnRenamed("inst", "base")
    sub = keep(dbscan(wide, split_eps, split_min_points, by="base").withColumnRenamed("inst", "part"))
    good = sub.where("part >= 0").groupBy("base", "part").count().where(F.col("count") >= split_min_points)
    accepted = good.groupBy("base").count().where("count >= 2").select("base")
    n_split = accepted.count()
    parts = sub.join(accepted, "base", "left_semi").join(good.select("base", F.col("part").alias("good")), ["base"], "left").where("part = good").select("point_id", F.col("part").alias("new"))
    marked = base.join(accepted.withColumnRenamed("base", "inst").withColumn("split", F.lit(True)), "inst", "left").join(parts, "point_id", "left")
    key = F.when(F.col("inst") < 0, None).when(F.coalesce("split", F.lit(False)), F.when(F.col("new").isNotNull(), F.struct("inst", F.col("new").alias("part")))).otherwise(F.struct("inst", F.lit(0).alias("part")))
    out = dense_ids(marked.withColumn("_key", key).drop("inst", "split", "new"), "_key", "inst")
    return out.withColumn("inst", F.coalesce("inst", F.lit(-1))).drop("_key"), n_split


def cluster_instances(points: DataFrame, label: str, eps: float = 0.12, min_points: int = 40) -> DataFrame:
    """dbscan within each class; classes with fewer points are noise."""
    enough = points.groupBy(label).count().where(F.col("count") >= min_points).select(label)
    found = dbscan(points.join(enough, label, "left_semi"), eps, min_points, by=label)
    return points.join(found.select("point_id", "inst"), "point_id", "left").withColumn("inst", F.coalesce("inst", F.lit(-1)))


def neighbours(cells: DataFrame, diagonal: bool, i: str = "i", j: str = "j", itself: bool = False) -> DataFrame:
    """Every cell moved to the cells around it."""
    offsets = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (itself or (a, b) != (0, 0)) and (diagonal or abs(a) + abs(b) <= 1)]
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets)))
    rest = [c for c in cells.columns if c not in (i, j)]
    return cells.withColumn("_o", o).select((F.col(i) + F.col("_o.a")).alias(i), (F.col(j) + F.col("_o.b")).alias(j), *rest)


def dilate(cells: DataFrame, times: int = 1, diagonal: bool = False) -> DataFrame:
    """The cells (i, j) and those around them, ``times`` over."""
    out = cells.select("i", "j").distinct()
    for _ in range(times):
        out = neighbours(out, diagonal, itself=True).distinct()
    return out


def erode(cells: DataFrame, times: int = 1, diagonal: bool = False) -> DataFrame:
    """Cells all of whose neighbours are cells too."""
    out, need = cells.select("i", "j").distinct(), 9 if diagonal else 5
    for _ in range(times):
        hit = neighbours(out, diagonal, itself=True).groupBy("i", "j").count().where(F.col("count") == need).select("i", "j")
        out = out.join(hit, ["i", "j"], "left_semi")
    return out


def closing(cells: DataFrame, times: int = 1, diagonal: bool = False) -> DataFrame:
    return erode(dilate(cells, times, diagonal), times, diagonal)


def cell_components(cells: DataFrame, diagonal: bool = True, by: str | None = None) -> DataFrame:
    """cells (i, j) with ``comp``: the smallest cell number of its component."""
    keys = [by] if by else []
    node = F.xxhash64(*keys, "i", "j")
    c = keep(cells.select(*keys, "i", "j").distinct().withColumn("node", node))
    around = neighbours(c.withColumnRenamed("node", "a"), diagonal)
    links = around.join(c.select(*keys, "i", "j", F.col("node").alias("b")), [*keys, "i", "j"]).select("a", "b")
    comp = components(links)
    return c.join(comp, "node", "left").select(*keys, "i", "j", F.coalesce("comp", "node").alias("comp"))


def erosion_components(points: DataFrame, by: str, size: float = 0.1, min_points: int = 8, min_neighbours: int = 3) -> DataFrame:
    """Core cells (min_points points, min_neighbours occupied neighbours) of a
    parent, in 8-connected components."""
    cells = points.groupBy(by, F.floor(F.col("x") / F.lit(size)).cast("int").alias("i"), F.floor(F.col("y") / F.lit(size)).cast("int").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    cells = keep(cells)
    near = neighbours(cells.select(by, "i", "j"), True).groupBy(by, "i", "j").agg(F.count(F.lit(1)).alias("around"))
    core = cells.join(near, [by, "i", "j"]).where((F.col("n") >= min_points) & (F.col("around") >= min_neighbours))
    return cell_components(core, True, by)


def fill_holes(cells: DataFrame) -> DataFrame:
    """The cells and all that no 4-connected path reaches from outside."""
    box = cells.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).head()
    if box[0] is None:
        return cells.select("i", "j")
    spark = cells.sparkSession
    rows = spark.range(box[0] - 1, box[1] + 2).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(box[2] - 1), F.lit(box[3] + 1))))
    free = rows.join(cells.select("i", "j"), ["i", "j"], "left_anti")
    comp = keep(cell_components(free, False))
    outside = comp.where((F.col("i") == box[0] - 1) & (F.col("j") == box[2] - 1)).select("comp").distinct()
    return cells.select("i", "j").distinct().unionAll(comp.join(outside, "comp", "left_anti").select("i", "j"))
