"""Queries without a SQL twin read their whole view, against brute force."""

import math

import pytest

from voxelweave.plans import graph as K
from voxelweave.queries import base, knowledge, more, scene  # noqa: F401

IDS = [3, 4, 5, *range(401, 461)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("small"))
    part = spark.createDataFrame([(i, f"T{i}", i % 50) for i in IDS], "p_partkey long, p_type string, p_size int")
    lines = [(n, IDS[n * 8 % len(IDS)], n * 11 % 90, n % 5 + 1, float(n % 50 + 1), (n % 11) / 100, (n % 9) / 100, "RAN"[n % 3]) for n in range(500)]
    line = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string")
    part.write.parquet(f"{where}/part.parquet")
    line.write.parquet(f"{where}/lineitem.parquet")
    return where


def test_depth_grid_of_every_instance(spark, small):
    by = {}
    for r in base.view(spark, small, "v_point").collect():
        by.setdefault(r["inst"], []).append((r["x"], r["y"], r["z"]))
    want = {}
    for inst, rows in by.items():
        mid = [sum(c) / len(rows) for c in zip(*rows)]
        rows = [[a - b for a, b in zip(p, mid)] for p in rows]
        far = max(math.sqrt(sum(a * a for a in p)) for p in rows)
        for view, (az, el) in enumerate([(0, 0), (90, 0), (45, 30)]):
            a, e, sure, maybe = math.radians(az), math.radians(el), set(), set()
            for x, y, z in ([c / max(far, 1e-12) for c in p] for p in rows):
                u, w = x * math.cos(a) + y * math.sin(a), y * math.cos(a) - x * math.sin(a)
                # a point on the border of two cells may round either way
                row, col = ({min(15, max(0, math.floor((c + 1) / 2 * 16 + d))) for d in (-1e-9, 1e-9)} for c in (z * math.cos(e) - u * math.sin(e), w))
                cells = {(i, j) for i in row for j in col}
                maybe |= cells
                sure |= cells if len(cells) == 1 else set()
            want[inst, view] = (len(sure), len(maybe))
    got = {(r["inst"], r["view"]): r["cells"] for r in base.QUERIES["prj19_depth_grid"](spark, small).collect()}
    assert got.keys() == want.keys() and len(by) == len({i % 100 for i in IDS})
    assert all(a <= got[k] <= b for k, (a, b) in want.items())


def test_novelty_of_every_mask(spark, small):
    masks = {}
    for r in base.view(spark, small, "v_vote").collect():
        m = masks.setdefault(r["obj"], [0.0, set()])
        m[0] = max(m[0], r["confidence"])
        m[1].add(r["ord"] % 40)
    want, seen = set(), {}
    for obj, (_, members) in sorted(masks.items(), key=lambda m: (-m[1][0], m[0])):
        new = members - seen.setdefault(obj % 5, set())
        if len(new) / len(members) >= 0.5:
            want.add((obj % 5, obj, len(new)))
            seen[obj % 5] |= new
    got = {(r["g"], r["m"], r["n_new"]) for r in base.QUERIES["win11_novelty"](spark, small).collect()}
    assert got == want and max(m for _, m, _ in want) > 400


def test_revision_of_every_object(spark, small):
    lost = sum(i % 17 == 0 for i in IDS)
    moved = sum(i % 17 != 0 and i % 13 == 0 for i in IDS)
    updated = sum(i % 17 != 0 and i % 13 != 0 and i % 5 == 0 for i in IDS)
    r = base.QUERIES["agg36_revision_states"](spark, small).first()
    assert (r["moved"], r["absent"], r["inserted"], r["updated"]) == (moved, lost, 0, updated)


def test_feedback_keeps_every_object(spark, small, monkeypatch):
    graphs, old = [], K.feedback

    def seen(graph, *rest):
        graphs.append(graph)
        return old(graph, *rest)

    monkeypatch.setattr(more.K, "feedback", seen)
    got = {(r["event"], r["field"]): r["n"] for r in base.QUERIES["kg07_feedback"](spark, small).collect()}
    assert got == {("owner", "presence"): 1, ("owner", "type"): 2, ("owner", "status"): 2}
    assert sorted(r["name"] for r in graphs[0].nodes.collect()) == sorted(f"obj_{i}" for i in IDS)


def test_every_object_has_a_superpoint(spark, small):
    got = base.QUERIES["cl13_superpoints"](spark, small).collect()
    assert sum(r["n"] for r in got) == len(IDS)
