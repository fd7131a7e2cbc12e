"""Questions over objects with computed answers, and their scoring.

objects: ord, id, name, type, x, y, z, l, w, h, quality, is_movable, is_key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import norm_name
from ..operators.windows import middle_row, stride_sample

# Types that are not counted, and types asked for in vain.
COUNT_SKIP = ("clutter", "display", "tv", "monitor", "keyboard", "shelf", "ladder", "panel", "wall panel", "stair")
ABSENT = ("sofa", "refrigerator", "bicycle", "printer", "microwave oven", "potted plant")


def scoped(objects: DataFrame) -> DataFrame:
    return objects.where(~F.coalesce("structure_artifact", F.lit(False)) & ~F.coalesce("out_of_scope", F.lit(False)))


def type_counts(objects: DataFrame) -> DataFrame:
    """type, n for types all of whose objects are confirmed."""
    t = objects.groupBy(F.lower("type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("quality") == "confirmed", F.lit(False))).alias("sure"))
    return t.where(F.col("sure") & ~F.col("type").isin(*COUNT_SKIP)).select("type", "n")


def existence(objects: DataFrame, asked: DataFrame) -> DataFrame:
    """type, present for asked types."""
    have = objects.select(F.lower("type").alias("type")).distinct().withColumn("_y", F.lit(True))
    return asked.join(have, "type", "left").select("type", F.coalesce("_y", F.lit(False)).alias("present"))


def tallest(objects: DataFrame) -> DataFrame:
    return objects.agg(F.max_by("name", F.struct("h", -F.col("ord"))).alias("name"))


def largest_footprint(objects: DataFrame) -> DataFrame:
    return objects.agg(F.max_by("name", F.struct(F.col("l") * F.col("w"), -F.col("ord"))).alias("name"))


def movable(objects: DataFrame, most: int = 4) -> DataFrame:
    """The first movable and the first fixed objects; unknown ones left out."""
    from ..operators.windows import top_per_group

    return top_per_group(objects.where("is_movable is not null"), ["is_movable"], [F.col("ord")], most).select("name", F.when(F.col("is_movable"), "yes").otherwise("no").alias("answer"))


def key_names(objects: DataFrame) -> DataFrame:
    return objects.where("is_key").agg(F.array_sort(F.collect_list("name")).alias("names"))


def targets(relations: DataFrame, predicates: list[str]) -> DataFrame:
    """subject, predicate -> sorted objects; the subject's side only."""
    return relations.where(F.col("predicate").isin(*predicates)).groupBy("subject", "predicate").agg(F.array_sort(F.collect_list("object")).alias("objects"))


def first_targets(relations: DataFrame, predicates: list[str], most: int) -> DataFrame:
    """The first rows of targets() by subject and predicate. Lists are made for
    these alone."""
    rows = relations.where(F.col("predicate").isin(*predicates)).select("subject", "predicate", "object")
    first = rows.select("subject", "predicate").distinct().orderBy("subject", "predicate").limit(most)
    return targets(rows.join(F.broadcast(first), ["subject", "predicate"], "left_semi"), predicates)


def within(objects: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    return objects.where((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2 <= radius * radius)


def near_middle(objects: DataFrame, radius: float = 1.5) -> DataFrame:
    """Names within the radius of the object in the middle of the list."""
    m = middle_row(objects, [F.col("ord")]).select(F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    t = objects.crossJoin(F.broadcast(m)).where("id <> _id")
    return t.where(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) <= radius).select("name")


def trap(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """How many exposed nodes carry a type that only failed labels have."""
    n = nodes.groupBy(F.lower("type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(n, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def generate(objects: DataFrame, relations: DataFrame, traps: list[str]) -> DataFrame:
    """All questions: type, kind, topic, gt."""
    spark = objects.sparkSession

    def q(df: DataFrame, type_: str, kind: str, topic: Column, gt: Column) -> DataFrame:
        return df.select(F.lit(type_).alias("type"), F.lit(kind).alias("kind"), topic.alias("topic"), gt.cast("string").alias("gt"))

    counts = type_counts(objects)
    out = q(counts, "symbolic", "count", F.col("type"), F.col("n"))
    out = out.unionAll(q(counts.orderBy("type").limit(4), "symbolic", "yesno", F.col("type"), F.lit("yes")))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(ABSENT)], "i int, type string")
    gone = asked.join(objects.select(F.lower("type").alias("type")), "type", "left_anti").orderBy("i").limit(4)
    out = out.unionAll(q(gone, "symbolic", "yesno", F.col("type"), F.lit("no")))
    out = out.unionAll(q(tallest(objects), "explicit", "name", F.lit("tallest"), F.col("name")))
    out = out.unionAll(q(largest_footprint(objects), "explicit", "name", F.lit("largest"), F.col("name")))
    out = out.unionAll(q(stride_sample(objects, [F.col("ord")], 6, 6), "explicit", "number", F.col("name"), F.bround("h", 2)))
    xy = F.concat_ws(", ", F.bround("x", 2).cast("string"), F.bround("y", 2).cast("string"))
    out = out.unionAll(q(stride_sample(objects, [F.col("ord")], 4, 4, start=1), "explicit", "xy", F.col("name"), xy))
    out = out.unionAll(q(movable(objects), "implicit", "yesno", F.col("name"), F.col("answer")))
    out = out.unionAll(q(key_names(objects).where(F.size("names") > 0), "implicit", "set", F.lit("keyObjects"), F.array_join("names", ",")))
    t = first_targets(relations, ["isNextTo"], 4)
    out = out.unionAll(q(t, "scene", "set", F.col("subject"), F.array_join("objects", ",")))
    t = first_targets(relations, ["isOn", "isAboveOf"], 4)
    out = out.unionAll(q(t, "scene", "set", F.col("subject"), F.array_join("objects", ",")))
    near = near_middle(objects).agg(F.array_sort(F.collect_list("name")).alias("n")).select(F.when(F.size("n") == 0, "none").otherwise(F.array_join("n", ",")).alias("gt"))
    out = out.unionAll(q(near, "scene", "set", F.lit("middle"), F.col("gt")))
    for t in traps:
        for gt in ("no-or-abstain", "0-or-abstain"):
            out = out.unionAll(spark.createDataFrame([("trap", "trap", t, gt)], out.schema))
    return out


def score(kind: Column, gt: Column, answer: Column, abstain: Column) -> Column:
    """correct, wrong or abstained."""
    a = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    g = F.lower(gt)
    word = F.regexp_replace(F.element_at(F.split(a, r"\s+"), 1), r"\.+$", "")
    number = word.try_cast("double")
    target = g.try_cast("double")
    close = F.abs(number - target) <= F.greatest(F.lit(0.05), F.lit(0.1) * target)
    parts, goal = F.split(F.regexp_replace(a, r"[()]", " "), ","), F.split(g, ",")

    def at(p: Column, i: int) -> Column:
        return F.trim(F.get(p, F.lit(i))).try_cast("double")

    xy = F.hypot(at(parts, 0) - at(goal, 0), at(parts, 1) - at(goal, 1)) <= 0.3

    def names(c: Column) -> Column:
        n = F.transform(F.split(c, ","), norm_name)
        return F.array_distinct(F.filter(n, lambda x: (x != "") & (x != "none")))

    gs, as_ = names(g), names(a)
    inter = F.size(F.array_intersect(gs, as_))
    prec = F.when(F.size(as_) > 0, inter / F.size(as_)).otherwise(F.when(F.size(gs) == 0, 1.0).otherwise(0.0))
    rec = F.when(F.size(gs) > 0, inter / F.size(gs)).otherwise(F.when(F.size(as_) == 0, 1.0).otherwise(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    ok = (
        F.when(kind == "yesno", F.startswith(a, g)).when(kind == "count", word == g).when(kind == "number", close).when(kind == "xy", xy)
        .when(kind == "name", F.contains(norm_name(a), norm_name(g))).when(kind == "set", f1 >= 0.8).otherwise(a == g)
    )
    denied = a.rlike("^(no|none|0|uncertain|unknown)")
    gone = F.coalesce(abstain, F.lit(False))
    return (
        F.when(kind == "trap", F.when(gone | denied, "correct").otherwise("wrong"))
        .when(gone, "abstained").when(F.coalesce(ok, F.lit(False)), "correct").otherwise("wrong")
    )
