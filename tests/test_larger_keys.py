"""Queries whose tables hold keys and contents that the small tables lack."""

from pyspark.sql import functions as F

from voxelweave.plans import graph as K, objects as O
from voxelweave.queries import base, knowledge, more, scene, wide  # noqa: F401


def parts(spark, where, ids):
    t = spark.createDataFrame([(i, f"T{i % 3}", 7) for i in ids], "p_partkey long, p_type string, p_size int")
    t.coalesce(1).write.parquet(f"{where}/part.parquet")
    return str(where)


def test_checkpoint_keys_do_not_meet_the_view(spark, tmp_path):
    d = parts(spark, tmp_path, [1, 10, 100_010])
    got = sorted((r["id"], r["status"]) for r in base.QUERIES["src10_checkpoint"](spark, d).collect())
    assert got == [(1, "verified_escalated"), (10, "unverified"), (100_010, "again"), (100_010, "unverified"), (200_010, "again")]


def test_every_earlier_record_of_one_content(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    before = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "content string, ord long, status string")
    rows = lambda order: sorted(map(tuple, O.carry_over(now, before, "content", order, ["status"]).collect()), key=str)
    assert rows(None) == [(1, "a", "x", True), (1, "a", "y", True), (2, "b", None, False)]
    assert rows("ord") == [(1, "a", "y", True), (2, "b", None, False)]


def test_strict_scan_keeps_records_of_one_anchor(spark):
    o = spark.createDataFrame([(1, "p", 0.01), (2, "q", 0.02)], "ord long, name string, x double")
    o = o.select("*", *(F.lit(v).alias(c) for c, v in {"y": 0.0, "z": 0.0, "th": 0.0, "l": 0.5, "w": 0.5, "h": 0.5, "type": "t", "color": "red", "confidence": 0.5, "status": "verified", "implicit": "{}", "map_id": "lab"}.items()))
    e = spark.createDataFrame([("p", "isNextTo", "q")], "subject string, predicate string, object string")
    g = K.upsert(K.new_graph(spark), o, "t1", e, strict=True)
    assert g.nodes.count() == 2 and g.edges.count() == 1
    assert K.upsert(K.new_graph(spark), o, "t1", e).nodes.count() == 1
