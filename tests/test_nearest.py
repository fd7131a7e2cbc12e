"""Nearest neighbours without cross joins, against brute force."""

import numpy as np
import pytest

from voxelweave.operators import joins as J
from voxelweave.plans import places as P


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("far", [0.0, 50.0, 1e5])
def test_knn_with_outliers(spark, far):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(far, 1, (4, 3)), np.full((6, 3), -far)])
    rows = [(i, *map(float, p)) for i, p in enumerate(x)]
    d = spark.createDataFrame(rows, "id long, x double, y double, z double")
    out = J.knn_join(d, d.withColumnRenamed("id", "other"), 3, "id", "other", 0.2)
    assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"]))
    for i in range(len(x)):
        d2 = ((x - x[i]) ** 2).sum(1)
        assert [o for _, o in sorted(got[i])] == np.lexsort((np.arange(len(x)), d2))[:3].tolist()


def test_knn_of_few_rows(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 900.0, 0.0, 0.0)], "id long, x double, y double, z double")
    b = spark.createDataFrame([(7, 1.0, 0.0, 0.0), (8, -1.0, 0.0, 0.0)], "other long, x double, y double, z double")
    got = sorted((r["id"], r["rank"], r["other"]) for r in J.knn_join(a, b, 5, "id", "other", 0.1).collect())
    assert got == [(1, 1, 7), (1, 2, 8), (2, 1, 7), (2, 2, 8)]
    assert J.knn_join(a, b.limit(0), 5, "id", "other", 0.1).collect() == []
    assert J.knn_join(a.limit(0), b, 5, "id", "other", 0.1).collect() == []


def test_nearest_cells_and_rings(spark):
    rng = np.random.default_rng(4)
    cells = sorted({(int(i), int(j)) for i, j in rng.integers(-30, 30, (60, 2))})
    objects = [(k, int(i), int(j)) for k, (i, j) in enumerate(rng.integers(-200, 200, (80, 2)))]
    c = spark.createDataFrame([(i, j, 100 * i + j) for i, j in cells], "i int, j int, place int")
    out = J.nearest_cell(spark.createDataFrame(objects, "id long, i int, j int"), c, "id", "place")
    assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)
    want = {k: min(((i - a) ** 2 + (j - b) ** 2, a, b) for a, b in cells) for k, i, j in objects}
    assert {r["id"]: r["place"] for r in out.collect()} == {k: 100 * a + b for k, (_, a, b) in want.items()}


def segment(px, py, a, b):
    (ax, ay), (bx, by) = a, b
    t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
    return float(np.hypot(ax + t * (bx - ax) - px, ay + t * (by - ay) - py))


def test_polygons_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rings = [[(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))] for x, y, w, h in zip(rng.uniform(0, 60, 12), rng.uniform(0, 60, 12), rng.uniform(1, 20, 12), rng.uniform(1, 20, 12))]
    places = spark.createDataFrame([(k, k, [{"x": x, "y": y} for x, y in ring]) for k, ring in enumerate(rings)], "place int, ord int, polygon array<struct<x double, y double>>".replace("struct<x double, y double>", "struct<x:double,y:double>"))
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([rng.uniform(-10, 80, (150, 2)), rng.uniform(-3000, 3000, (20, 2))]))]
    objects = spark.createDataFrame(points, "id long, x double, y double")
    inside = {k: next((n for n, r in enumerate(rings) if r[0][0] < x < r[1][0] and r[0][1] < y < r[2][1]), None) for k, x, y in points}
    assert {r["id"]: r["place"] for r in P.in_polygons(objects, places).collect()} == inside
    got = {r["id"]: r["place"] for r in P.in_or_near_polygons(objects, places).collect()}
    for k, x, y in points:
        d = [min(segment(x, y, a, b) for a, b in zip(r, [*r[1:], r[0]])) for r in rings]
        assert got[k] == inside[k] if inside[k] is not None else abs(d[got[k]] - min(d)) < 1e-6
