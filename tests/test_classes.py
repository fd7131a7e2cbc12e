"""Many equal objects: joins work on classes and lose no row."""

import random

from pyspark.sql import functions as F

from voxelweave.functions import text as X
from voxelweave.operators import joins as J, structure as S
from voxelweave.plans import exports, graph as K, metrics, questions as Q, relations as R
from voxelweave.queries import knowledge, scene  # noqa: F401  (register)
from voxelweave.queries.base import QUERIES

from .conftest import SF

BOX = "id long, x double, y double, z double, th double, l double, w double, h double"


def boxes(spark, places, copies):
    """``copies`` equal boxes at each place (x, y, z)."""
    return spark.createDataFrame([(i * copies + k, *p, 0.0, 0.5, 0.5, 0.4) for i, p in enumerate(places) for k in range(copies)], BOX)


def test_classes_hold_every_row_in_bounded_parts(spark):
    d = boxes(spark, [(0.0, 0.0, 0.0), (9.0, 9.0, 0.0)], J.TOGETHER + 7)
    t = J.classes(d, ["x", "y", "z"], ["id"])
    assert sorted(r[0] for r in t.select(F.size("_ids")).collect()) == [7, 7, J.TOGETHER, J.TOGETHER]
    assert sorted(r[0] for r in t.select(F.explode("_ids._id")).collect()) == list(range(2 * J.TOGETHER + 14))


def test_relation_counts_over_copies(spark):
    n = 600  # more than stand in one class row
    got = dict(R.relations(boxes(spark, [(0.0, 0.0, 0.0), (0.1, 0.0, 0.45)], n)).groupBy("predicate").count().collect())
    assert got == {"isNextTo": 2 * n * (n - 1) // 2, "isOn": n * n}


def test_radius_counts_of_many_equal_rows(spark):
    d = boxes(spark, [(0.0, 0.0, 0.0), (0.5, 0.0, 0.0), (9.0, 0.0, 0.0)], 30_000)  # 2.7 thousand million pairs
    got = J.radius_counts(d, d, 1.0).groupBy("x", "n").count().collect()
    assert sorted(map(tuple, got)) == [(0.0, 60_000, 30_000), (0.5, 60_000, 30_000), (9.0, 30_000, 30_000)]


def test_radius_counts_broadcast_neither_rows_nor_places(spark):
    # the tables are far below the size that Spark broadcasts at
    t = QUERIES["jn09_radius"](spark, SF)
    assert t.count() == 200 and "Broadcast" not in t._jdf.queryExecution().executedPlan().toString()


def joined_rows(df):
    """Rows that the joins of a plan made."""
    df.write.format("noop").mode("overwrite").save()
    got, todo = [], [df._jdf.queryExecution().executedPlan()]
    df.collect()
    while todo:
        p = todo.pop()
        if "AdaptiveSparkPlan" in p.nodeName():
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
            continue
        if "Join" in p.nodeName():
            got.append(p.metrics().get("numOutputRows").get().value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return got


def test_next_to_joins_classes(spark):
    t = R.next_to(boxes(spark, [(0.0, 0.0, 0.0), (0.4, 0.0, 0.0)], 100))
    assert t.count() == 200 * 199 // 2 and t.where("subject >= object").isEmpty()
    assert joined_rows(t) == [4]


def test_stacked_joins_classes(spark):
    t = R.stacked(boxes(spark, [(0.0, 0.0, 0.0), (0.1, 0.0, 0.45), (0.0, 0.1, 2.0)], 50))
    assert {tuple(r) for r in t.groupBy("predicate").count().collect()} == {("isOn", 2500), ("isAboveOf", 5000)}
    assert joined_rows(t) == [3]


def test_facing_joins_classes(spark):
    t = R.facing(boxes(spark, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)], 60), 1.2)
    assert {tuple(r) for r in t.groupBy("predicate").count().collect()} == {("isInFrontOf", 2 * 60 * 59 + 3600), ("isBehindOf", 3600)}
    assert joined_rows(t) == [4]


def test_facing_makes_rows_of_plain_ids_in_small_parts(spark):
    d = boxes(spark, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)], 2 * J.FEW + 3)
    d = d.withColumn("th", F.when(F.col("id") % 5 == 0, 1.2).otherwise(F.col("th")))
    d = d.unionAll(d.limit(2).withColumn("id", F.lit(None).cast("long")))
    t = R.facing(d, 1.2)
    turn = "pmod(degrees(atan2(a.y - b.y, a.x - b.x) - b.th) + 180d, 360d) - 180d"
    want = d.alias("a").join(d.alias("b"), F.expr(f"a.id <> b.id and (abs({turn}) <= 45 or abs({turn}) >= 135)"))
    want = want.selectExpr("a.id", f"if(abs({turn}) <= 45, 'isInFrontOf', 'isBehindOf')", "b.id")
    got = t.select("subject", "predicate", "object")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 40_000
    assert not any(got.schema[c].nullable for c in ("subject", "object"))
    assert J.classes(d, ["x", "y"], "id", most=J.FEW).select(F.max(F.size("_ids"))).head()[0] == J.FEW


def test_stacked_targets_equal_lists_of_stacked(spark):
    d = boxes(spark, [(0.0, 0.0, 0.0), (0.1, 0.0, 0.45), (0.0, 0.1, 2.0)], 520)
    want = R.stacked(d).groupBy("subject", "predicate").agg(F.array_sort(F.collect_list("object")).alias("objects"))
    assert R.stacked_targets(d).exceptAll(want).isEmpty() and R.stacked_targets(d).count() == want.count() == 2 * 520


def test_counts_in_equal_boxes(spark):
    p = spark.createDataFrame([(0.1, 0.1, 0.1)] * 20_000 + [(5.0, 5.0, 5.0)], "x double, y double, z double")
    b = spark.range(20_000).selectExpr("id", "0d as x0", "1d as x1", "0d as y0", "1d as y1", "0d as z0", "1d as z1")  # 400 million pairs
    assert [tuple(r) for r in J.inside_counts(p, b, 0.3, 0.3).groupBy("n").count().collect()] == [(20_000, 20_000)]


def test_resolved_objects_give_the_edges_of_names(spark):
    d = boxes(spark, [(0.0, 0.0, 0.0), (0.4, 0.0, 0.0)], 3)
    o = d.withColumns({"name": F.concat(F.lit("n"), (F.col("id") % 5).cast("string")), "ord": F.col("id"), "presence": F.when(F.col("id") == 3, "absent").otherwise("present")})
    names = R.next_to(o, label="name")
    want = K.resolve_edges(names, o, 1).select("subj", "obj")
    got = R.next_to(K.resolved(o, o, "node"), label="node").select("subject", "object")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_first_targets(spark):
    t = R.relations(boxes(spark, [(0.0, 0.0, 0.0), (0.1, 0.0, 0.45)], 12))
    for kinds in (["isNextTo"], ["isOn", "isAboveOf"]):
        assert Q.first_targets(t, kinds, 4).collect() and sorted(Q.first_targets(t, kinds, 4).collect()) == Q.targets(t, kinds).orderBy("subject", "predicate").limit(4).collect()


def test_greedy_claims_equal_greedy_match(spark):
    rng = random.Random(5)
    rows = lambda n, k: [("m" if rng.random() < 0.7 else "o", f"{k}{i:03d}", i * 7 % n, float(rng.randrange(4)), float(rng.randrange(4)), 0.0) for i in range(n)]
    a = spark.createDataFrame(rows(90, "l"), "g string, l string, ord int, x double, y double, z double")
    b = spark.createDataFrame(rows(70, "r"), "g string, r string, ord int, x double, y double, z double").drop("ord")
    near = lambda x, y: J.radius_join(x, y, 2.0, condition=F.col("a.g") == F.col("b.g"))
    pairs = near(a, b).select("a.g", "a.l", "b.r", "a.ord", "d2")
    want = J.greedy_match(pairs, "l", "r", "ord", "d2", "g")
    got = J.greedy_claims(a, b, near, "l", "r", "ord", "d2", "g", ["x", "y", "z"], ["x", "y", "z"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 40
    twice = b.unionAll(b.withColumn("x", F.col("x") + 1.0))  # one right row at two places
    want = J.greedy_match(near(a, twice).select("a.g", "a.l", "b.r", "a.ord", "d2"), "l", "r", "ord", "d2", "g")
    got = J.greedy_claims(a, twice, near, "l", "r", "ord", "d2", "g", ["x", "y", "z"], ["x", "y", "z"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_claims_of_many_equal_rows(spark):
    m = F.lit("m").alias("map_id")
    d = boxes(spark, [(0.0, 0.0, 0.0), (0.5, 0.0, 0.0)], 4_000)  # 64 million pairs
    got = metrics.detection_match(d.select(m, "id", F.col("id").alias("ord"), "x", "y"), d.select(m, "id", "x", "y"), 1.0)
    assert got.where("gt = det and d2 = 0").count() == got.count() == 8_000


def test_prims_by_class_equal_prims_by_edge(spark):
    o = boxes(spark, [(0.0, 0.0, 0.0), (0.1, 0.0, 0.45), (0.0, 0.1, 2.0), (9.0, 9.0, 0.0)], 20)
    o = o.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("obj "), F.col("id").cast("string")).alias("name"), F.lit("t").alias("type"), F.lit("s").alias("status"), *"xyz", "th", "l", "w", "h")
    want = exports.usda(o, R.stacked(o, label="name"), o.limit(0).select("name")).select("text")
    got = exports.usda_prims(R.with_stacked_text(o.withColumn("prim", X.identifier(F.col("name"))), "prim", exports.object_line, "rels")).select("text")
    texts = lambda t: [r[0] for r in t.collect()]
    assert sorted(texts(got)) == sorted(texts(want)) and got.count() == 82
    assert texts(got)[0].startswith("#usda") and texts(got)[-1] == "}"


def test_cypher_without_a_sort_keeps_its_parts_in_order(spark):
    n = spark.createDataFrame([(str(i), "n", "t", "m", 0.0, 0.0, 0.0, 0.5, "s", "present", "{}") for i in range(50)], "id string, name string, type string, map_id string, x double, y double, z double, confidence double, status string, presence string, implicit string")
    e = n.select(F.col("id").alias("subj"), F.lit("isOn").alias("pred"), F.col("id").alias("obj")).repartition(3)
    t = exports.cypher(n, e, ordered=False)
    assert "Exchange rangepartitioning" not in t._jdf.queryExecution().toString()
    texts = [r["text"] for r in t.collect()]
    assert [x[:5] for x in texts] == ["MATCH"] + ["MERGE"] * 50 + ["MATCH"] * 50 and "DETACH" in texts[0]


def test_neighbours_by_place_equal_neighbours(spark):
    rng = random.Random(3)
    d = spark.createDataFrame([(i, *(float(rng.randrange(4)) for _ in "xyz")) for i in range(300)], "id long, x double, y double, z double")
    o = d.withColumnRenamed("id", "other")
    want, got = J.knn_join(d, o, 5, "id", "other", 1.0), J.knn_by_place(d, o, 5, "id", "other", 1.0)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_normals_of_many_points_of_one_place(spark):
    places = [(float(i), float(j), 0.0) for i in range(4) for j in range(4)]
    t = S.estimate_normals(boxes(spark, places, 1_000).withColumnRenamed("id", "point_id"), 1.5)  # 100 million pairs
    assert t.count() == 16_000 and t.where(F.abs("nz") < 0.999999).isEmpty()


def test_edges_among_nodes_are_pairs_of_nodes(spark):
    d = boxes(spark, [(0.0, 0.0, 0.0), (0.4, 0.0, 0.0)], 6)
    nodes = d.where("id % 3 <> 0")
    want = J.semi_edges(R.next_to(d), nodes, "subject", "object").select("subject", "object")
    got = R.next_to(d.join(nodes.select("id"), "id", "left_semi")).select("subject", "object")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 28


def above_expansion(df):
    """Lines of the plan that work on rows, not on classes."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return "\n".join(lines[: next(i for i, line in enumerate(lines) if "Generate explode" in line)])


def test_gaps_are_rounded_once_a_pair_of_classes(spark):
    d = boxes(spark, [(0.0, 0.0, 0.0), (0.4, 0.3, 0.0), (0.9, 0.1, 0.0)], 6)
    want = R.next_to(d).withColumn("gap_m", F.round("gap_m", 4))
    got = R.next_to(d, digits=4)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 100
    assert "round(" in above_expansion(want) and "round(" not in above_expansion(QUERIES["jn03_is_next_to"](spark, SF))


def test_footprints_meet_once_for_all_heights(spark):
    heights = [0.0, 0.45, 0.9, 2.0]
    d = boxes(spark, [(x, 0.0, z) for x in (0.0, 0.1) for z in heights], 3)
    t = R.stacked(d)
    want = d.alias("a").join(d.alias("b"), F.expr("a.z > b.z")).selectExpr("a.id", "if(a.z - b.z < 0.5, 'isOn', 'isAboveOf')", "b.id")
    got = t.select("subject", "predicate", "object")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() == 6 * 4 * 9
    assert joined_rows(t) == [4]


def test_footprints_hold_every_class_in_bounded_rows(spark):
    d = boxes(spark, [(0.0, 0.0, float(z)) for z in range(20)], 600)
    t = R._footprints(d, (), "id").selectExpr("explode(_levels) as u", "size(_levels) as n", "_span[0] as high", "_span[1] as low")
    assert sorted(r[0] for r in t.select(F.explode("u._ids._id")).collect()) == list(range(12_000))
    assert t.select(F.max("n")).head()[0] < 20 and t.where("high < u.z - u.h / 2 or low > u.z + u.h / 2").isEmpty()


def test_lists_of_targets_are_not_joined_to_rows(spark):
    d = boxes(spark, [(0.0, 0.0, 0.0), (0.1, 0.0, 0.45), (0.0, 0.1, 2.0)], 520)
    t = R.stacked_targets(d)
    assert len(joined_rows(t)) == 1  # of footprints
    assert t.select("subject", F.explode("objects")).count() == R.stacked(d).count() == 3 * 520 * 520


def test_counts_by_classes_equal_rows_of_next_to(spark):
    d = boxes(spark, [(0.0, 0.0, 0.0), (0.4, 0.0, 0.0), (0.8, 0.0, 0.1), (9.0, 9.0, 0.0)], 520)  # two rows a class
    again = d.where("id % 97 = 0").withColumn("x", F.col("x") + F.when(F.col("id") % 2 == 0, 0.1).otherwise(0.0))  # ids twice, in one class or two
    for t in (d, d.unionAll(again).unionAll(d.limit(3).withColumn("id", F.lit(None).cast("long")))):
        assert R.next_to_counts(t).agg(F.sum("n")).head()[0] == R.next_to(t).count() > 10**6


def test_kg10_counts_by_classes(spark):
    assert "Generate explode(_bids" not in QUERIES["kg10_unified"](spark, SF)._jdf.queryExecution().executedPlan().toString()
