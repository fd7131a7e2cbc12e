"""The graph stream's state, its log, and rebuilds that fail."""

import json

import pytest
from pyspark.sql import functions as F

from voxelweave.operators import components as C
from voxelweave.plans import graph as K
from voxelweave.sources import documents as D, points as P
from voxelweave.streaming import rescans

REC = "ord long, name string, type string, x double, y double, z double, th double, l double, w double, h double, color string, confidence double, status string, implicit string, map_id string"


def scene(spark, n, shift=0.0):
    return spark.createDataFrame([(i, f"o{i}", "chair", 3.0 * i + shift, 0.0, 0.5, 0.0, 0.5, 0.5, 1.0, "red", 0.5, "verified", "{}", "lab") for i in range(n)], REC)


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_restart_goes_on_from_the_last_revision(spark, tmp_path):
    where = f"file://{tmp_path}/state"
    scans = [scene(spark, 6).withColumn("ts", F.lit("t1")), scene(spark, 5, 0.1).withColumn("ts", F.lit("t2")), scene(spark, 7, 0.1).withColumn("ts", F.lit("t3"))]
    one = rescans.GraphStream(K.new_graph(spark))
    for k, s in enumerate(scans):
        one.apply(s, k)
    for k, s in enumerate(scans):
        # a new process for every batch; each gets the batch before once more
        two = rescans.GraphStream(K.new_graph(spark), folder=where)
        assert two.last_batch == k - 1 and two.graph.revision == k
        if k:
            two.apply(scans[k - 1], k - 1)
        two.apply(s, k)
    last = rescans.GraphStream(K.new_graph(spark), folder=where)
    assert last.graph.revision == 3 and last.last_batch == 2
    for part in ("nodes", "history", "updates", "edges"):
        assert rows(getattr(last.graph, part)) == rows(getattr(one.graph, part))


def test_the_log_is_joined_now_and_then(spark, monkeypatch):
    monkeypatch.setattr(K, "COMPACT_EVERY", 2)
    g, whole = K.new_graph(spark), []
    for k in range(1, 5):
        g = K.upsert(g, scene(spark, 2 + k % 2), f"t{k}")
        whole.append(g.history.count())
    assert whole == sorted(whole) and {r["revision"] for r in g.history.collect()} == {1, 2, 3, 4}


def test_a_failing_rebuild_is_not_committed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"id": 1}))
    seen, fail = [], [True]

    def rebuild(df):
        if fail[0]:
            seen.append("tried")
            raise ValueError("no")
        seen.append(sorted(r["id"] for r in df.collect()))

    start = lambda: rescans.watch(spark, f"{tmp_path}/in", "id long", rebuild, f"{tmp_path}/ck", once=True)
    with pytest.raises(Exception, match="no"):
        start().awaitTermination(60)
    assert seen == ["tried"] * 3
    fail[0] = False
    start().awaitTermination(60)
    assert seen[-1] == [1]


def test_rows_are_numbered_in_order(spark):
    d = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k")).repartition(7)
    got = C.numbered(d, [F.col("k").desc()], "n").collect()
    assert sorted((r["n"], r["k"]) for r in got) == [(i, 499 - i) for i in range(500)]
    assert C.numbered(d.limit(0), [F.col("k")], "n").collect() == []


@pytest.mark.parametrize("limit", [0, 100_000])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "ONE_TASK", limit)
    links = [(i, i + 1) for i in range(40)] + [(101, 100), (100, 101), (7, 7), (200, 150), (150, 199)]
    got = {r["node"]: r["comp"] for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 199: 150, 200: 150}
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_config_text():
    text = "a:\n  b: [1, 2.5, 'x']\n  c:\n    - p\n    - true\n# note\nd: null\ne: 'k: v # no'\n"
    assert D.parse_config(text) == {"a": {"b": [1, 2.5, "x"], "c": ["p", True]}, "d": None, "e": "k: v # no"}
    assert D.parse_config("") == {} and D.parse_config("- 1\n- 2\n") == [1, 2]


def test_transform_files(spark, tmp_path):
    import numpy as np

    m = np.arange(16.0).reshape(4, 4)
    np.save(tmp_path / "m.npy", m)
    np.savez(tmp_path / "m.npz", b=m + 1, a=m)
    assert P.load_transform(spark, f"{tmp_path}/m.npy") == m.tolist()
    assert P.load_transform(spark, f"{tmp_path}/m.npz") == m.tolist()
    assert P.load_transform(spark, f"{tmp_path}/m.npz", "b") == (m + 1).tolist()
