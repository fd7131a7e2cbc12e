"""Structure filters and compound splits on small synthetic scenes."""

import numpy as np
from pyspark.sql import functions as F

from voxelweave.operators import compound as M, joins as J, structure as S
from voxelweave.plans import objects as O

XYZ = "point_id long, inst int, x double, y double, z double"


def frame(spark, parts):
    rows, k = [], 0
    for inst, pts in parts:
        for p in pts:
            rows.append((k, inst, *map(float, p)))
            k += 1
    return spark.createDataFrame(rows, XYZ)


def test_soffit_strip_is_flagged_and_a_shelf_is_not(spark):
    rng = np.random.default_rng(0)
    u = lambda lo, hi, n: rng.uniform(lo, hi, n)
    strip = np.column_stack([u(0, 2, 300), np.full(300, 1.0) + rng.normal(0, 0.004, 300), u(2.2, 2.5, 300)])
    shelf = np.column_stack([u(4, 5, 300), u(1, 1.4, 300), u(1.7, 1.75, 300)])
    floor = np.column_stack([u(0, 6, 1500), u(0, 3, 1500), rng.normal(0, 0.01, 1500)])
    ceiling = np.column_stack([u(-0.3, 2.3, 900), u(0.6, 1.4, 900), np.full(900, 2.6)])
    clusters = frame(spark, [(1, strip), (2, shelf)])
    reference = frame(spark, [(0, np.concatenate([strip, shelf, floor, ceiling]))])
    got = S.ceiling_remnants(clusters, reference).collect()
    assert [r["inst"] for r in got] == [1] and got[0]["ceiling_layer_frac"] >= 0.6


def test_wall_filter_cases(spark):
    rng = np.random.default_rng(1)
    sheet = np.column_stack([rng.uniform(0, 1, 400), rng.normal(0, 0.01, 400), rng.uniform(0.2, 1.5, 400)])
    box = np.column_stack([rng.uniform(3, 4, 400), rng.uniform(2, 3, 400), rng.uniform(0, 1, 400)])
    lamp = box + [0, 0, 2.5]
    out = box + [20, 0, 0]
    p = frame(spark, [(1, sheet), (2, box), (3, lamp), (4, out)])
    walls = p.select("point_id", F.abs("y").alias("wall_dist"), F.when(F.col("x") > 10, 0.0).otherwise(1.0).alias("room_dist"))
    got = {r["inst"]: r["why"] for r in S.wall_filter(p, walls, 0.0).collect()}
    assert got == {1: "wall remnant", 2: None, 3: "ceiling fixture", 4: "outside room"}


def test_compound_has_desk_pole_and_items(spark):
    rng = np.random.default_rng(2)
    top = np.column_stack([rng.uniform(0, 2, 1500), rng.uniform(0, 1, 1500), rng.normal(0.72, 0.01, 1500)])
    item = np.column_stack([rng.uniform(0.2, 0.5, 400), rng.uniform(0.2, 0.5, 400), rng.uniform(0.9, 1.2, 400)])
    pole = np.column_stack([rng.uniform(3.0, 3.05, 300), rng.uniform(0.0, 0.05, 300), np.linspace(0.05, 2.0, 300)])
    drawer = np.column_stack([rng.uniform(1.4, 1.8, 500), rng.uniform(0.2, 0.6, 500), rng.uniform(0.1, 0.58, 500)])
    p = frame(spark, [(7, np.concatenate([top, item, pole, drawer]))])
    got = {(r["unit"] or "-").rstrip("0123456789"): r["n"] for r in M.split_compound(p, "inst", 0.0).groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) >= {"desk", "above", "pole"} and got["desk"] > 1900


def test_outside_boxes_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = rng.uniform(0, 6, (400, 3))
    boxes = [(*c, *(c + s)) for c, s in zip(rng.uniform(0, 5, (8, 3)), rng.uniform(0.2, 2, (8, 3)))]
    p = frame(spark, [(0, pts)])
    b = spark.createDataFrame([tuple(map(float, x)) for x in boxes], "x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    got = {r["point_id"] for r in J.outside_boxes(p, b, 0.1).collect()}
    inside = [any(all(x[a] - 0.1 <= q[a] <= x[a + 3] + 0.1 for a in range(3)) for x in boxes) for q in pts]
    assert got == {i for i, f in enumerate(inside) if not f}


def test_superpoints_part_two_walls(spark):
    g = np.stack(np.meshgrid(np.arange(8) * 0.1, np.arange(8) * 0.1), -1).reshape(-1, 2)
    a = np.column_stack([g, np.zeros(len(g))])
    b = np.column_stack([np.zeros(len(g)), g[:, 0], g[:, 1] + 0.1])
    pts = np.concatenate([a, b])
    p = frame(spark, [(0, pts)]).withColumn("scan_id", F.lit("s"))
    normals = p.select("point_id", F.when(F.col("point_id") < 64, 0.0).otherwise(1.0).alias("nx"), F.lit(0.0).alias("ny"), F.when(F.col("point_id") < 64, 1.0).otherwise(0.0).alias("nz"))
    # a threshold that lets smooth edges merge, but not those across the corner
    got = {r["point_id"]: r["segment"] for r in M.superpoints(p, normals, k=4, threshold=20.0, least=5, size=0.15).collect()}
    assert len({got[i] for i in range(64)}) == 1 and len(got) == 128


def test_edits_of_a_scene(spark):
    p = frame(spark, [(1, np.zeros((3, 3))), (2, np.ones((4, 3))), (3, np.ones((5, 3)))])
    e = spark.createDataFrame([(1, "remove", None, None, None, None), (2, "move", 1.0, None, None, None), (3, "insert", 0.0, 2.0, 0.0, 9)], "inst int, op string, dx double, dy double, dz double, copy_as int")
    got = {(r["inst"], r["x"], r["y"]): r["n"] for r in O.edit_scene(p, e).groupBy("inst", "x", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(2, 2.0, 1.0): 4, (3, 1.0, 1.0): 5, (9, 1.0, 3.0): 5}


def test_outliers_and_normals(spark):
    rng = np.random.default_rng(5)
    flat = np.column_stack([rng.uniform(0, 1, (200, 2)), np.zeros(200)])
    p = frame(spark, [(0, np.concatenate([flat, [[5, 5, 5]]]))])
    assert S.outliers(p, k=6, size=0.3).where("point_id = 200").count() == 0
    n = S.estimate_normals(p.where("point_id < 200"), 0.3).agg(F.min(F.abs("nz"))).head()[0]
    assert n > 0.99


def room(rng, n):
    u = lambda lo, hi, k: rng.uniform(lo, hi, k)
    flat = lambda z, k: np.column_stack([u(0, 6, k), u(0, 4, k), np.full(k, z)])
    parts = {
        "floor": flat(0.0, 3 * n), "ceiling": flat(3.0, 2 * n),
        "X-": np.column_stack([np.zeros(2 * n), u(0, 4, 2 * n), u(0, 3, 2 * n)]), "X+": np.column_stack([np.full(2 * n, 6.0), u(0, 4, 2 * n), u(0, 3, 2 * n)]),
        "table": np.column_stack([u(2, 4, n), u(1, 3, n), np.full(n, 0.75)]), "screen": np.column_stack([np.full(n, 3.0), u(1, 3, n), u(0.8, 2, n)]),
    }
    return {k: p + rng.normal(0, 0.003, p.shape) for k, p in parts.items()}


def test_slicing_leaves_furniture(spark):
    parts = room(np.random.default_rng(7), 600)
    p = frame(spark, list(enumerate(parts.values())))
    got, cuts = S.slice_structure(p, least=400)
    left = {r["inst"]: r["n"] for r in got.groupBy("inst").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = list(parts)
    assert {r for r, _ in cuts} >= {"floor", "ceiling", "wall X-", "wall X+"}
    for k in ("floor", "ceiling", "X-", "X+"):
        assert left.get(names.index(k), 0) < 0.05 * len(parts[k]), k
    for k in ("table", "screen"):
        assert left[names.index(k)] > 0.95 * len(parts[k]), k


def test_plane_roles():
    low, high = np.zeros(3), np.array([6.0, 4, 3])
    cases = [((0, 0, 1), (3, 2, 2.9), "ceiling"), ((0, 0, -1), (3, 2, 0.1), "floor"), ((1, 0, 0), (0.2, 2, 1), "wall X-"), ((0, 1, 0), (3, 3.9, 1), "wall Y+"), ((1, 0.1, 0), (3, 2, 1), "inner"), ((0.6, 0, 0.8), (3, 2, 1), "slanted")]
    for n, c, want in cases:
        n = np.array(n, float)
        assert S.plane_role(n / np.linalg.norm(n), np.array(c, float), low, high, 0.12) == want


def test_icp_finds_the_transform(spark):
    rng = np.random.default_rng(8)
    walls = [np.column_stack([rng.uniform(0, 2, 500), rng.uniform(0, 2, 500), np.zeros(500)]), np.column_stack([np.zeros(500), rng.uniform(0, 2, 500), rng.uniform(0, 2, 500)]), np.column_stack([rng.uniform(0, 2, 500), np.zeros(500), rng.uniform(0, 2, 500)])]
    fixed = np.concatenate(walls)
    a, shift = 0.03, np.array([0.02, -0.03, 0.015])
    turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    moving = (fixed - shift) @ turn  # turn.T of the shifted points
    t, share, rmse = S.icp(frame(spark, [(0, moving)]), frame(spark, [(0, fixed)]), 0.15, rounds=12, normal_radius=0.2)
    assert share > 0.9 and np.abs(t[:3, :3] - turn).max() < 0.005 and np.abs(t[:3, 3] - shift).max() < 0.01


def test_a_bank_of_panels_is_cut_at_its_gaps(spark):
    rng = np.random.default_rng(9)
    one = lambda a, b: np.column_stack([rng.uniform(a, b, 900), rng.normal(0, 0.02, 900), rng.uniform(0, 2, 900)])
    p = frame(spark, [(1, np.concatenate([one(0, 0.6), one(0.72, 1.3), one(1.42, 2.0)]))])
    got = M.panel_columns(p, "inst").join(p.select("point_id", "x"), "point_id").groupBy("column").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r["n"] for r in got) == [900] * 3
    assert sorted((round(r["a"], 1), round(r["b"], 1)) for r in got) == [(0.0, 0.6), (0.7, 1.3), (1.4, 2.0)]
