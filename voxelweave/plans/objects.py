"""From points to object records, messages and verification requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G, text as X
from ..operators import aggregates as A
from ..operators.joins import last_wins


def build_objects(points: DataFrame, map_id: str = "map", min_points: int = 50) -> DataFrame:
    """One record a cluster: box, yaw, colour, anchor id."""
    t = A.object_table(points, min_points).select("inst", "n_points")
    shape = A.yaw_and_footprint(points, "inst")
    color = points.groupBy("inst").agg(*(F.avg(c).alias(c) for c in "rgb"))
    o = t.join(shape, "inst").join(color, "inst")
    return o.select(
        "inst", "n_points", "x", "y", "z", F.col("yaw").alias("th"), F.col("length").alias("l"), F.col("width").alias("w"), F.col("height").alias("h"),
        X.nearest_color(F.col("r"), F.col("g"), F.col("b")).alias("color"),
        X.anchor_id(F.lit(map_id), *(F.col(c) for c in ("x", "y", "z", "length", "width", "height"))).alias("id"),
    )


def with_classes(objects: DataFrame, classes: DataFrame, order: str) -> DataFrame:
    """Left join by file; the last of repeated files wins; default type ''."""
    c = last_wins(classes, "file", order).select("file", "class", "score")
    return objects.join(c, "file", "left").withColumn("class", F.coalesce("class", F.lit("")))


def record(o: DataFrame, map_id: str) -> DataFrame:
    """Rows -> nested records."""
    return o.select(
        F.col("type"), F.col("id"), F.col("name"), F.col("x").alias("poseX"), F.col("y").alias("poseY"), F.col("th").alias("poseTheta"),
        F.struct(F.col("l").alias("length"), F.col("w").alias("width"), F.col("h").alias("height")).alias("dimensions"),
        F.lit(map_id).alias("mapId"), F.struct(F.col("z").alias("poseZ")).alias("properties"),
    )


def message(records: DataFrame, timestamp: str, header: int = 1, maker: str = "", serial: str = "", order: str = "id") -> DataFrame:
    """One envelope with all records, in order. For documents of one map: the
    array is one row."""
    by_order = lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)  # noqa: E731  (maps have no order)
    rows = records.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*records.columns).alias("r"))), by_order).alias("rows"))
    return rows.select(
        F.lit(header).cast("long").alias("headerId"), F.lit(timestamp).alias("timestamp"), F.lit("1.0.0").alias("version"), F.lit(maker).alias("manufacturer"),
        F.lit(serial).alias("serialNumber"), F.transform("rows", lambda x: x["r"]).alias("semanticObjects"),
    )


def unwrap(messages: DataFrame, field: str = "semanticObjects") -> DataFrame:
    return messages.select(F.explode(field).alias("o")).select("o.*")


def apply_symbolic(records: DataFrame, corrected: Column, confidence: Column, reason: Column) -> DataFrame:
    """A verified label replaces type, name keeps its number."""
    p = F.col("properties").withField("symbolicVerified", F.lit(True)).withField("symbolicReason", reason)
    return records.withColumns({"type": corrected, "confidence": confidence, "properties": p})


def apply_implicit(records: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Sets the flags that are not null; a null leaves what stands."""
    p = F.col("properties")
    for k, v in values.items():
        p = p.withField(k, F.coalesce(v, F.col(f"properties.{k}")) if k in values else v)
    return records.withColumn("properties", p)


def verification_request(objects: DataFrame, vocabulary: list[str], floor_z: float) -> DataFrame:
    """The context a verifier gets for each object, as JSON."""
    base = F.bround(F.col("z") - F.col("h") / 2 - F.lit(floor_z), 2)
    mounting = F.struct(base.alias("bottom_above_floor_m"), G.mounting_note(F.col("z"), F.col("h"), F.lit(floor_z)).alias("note"))
    body = F.struct("id", "type", F.struct("l", "w", "h").alias("dimensions"), mounting.alias("mounting"), F.array(*map(F.lit, vocabulary)).alias("allowed_types"))
    return objects.select("id", F.to_json(body).alias("request"))


def candidates(names: DataFrame, order: str, name: str) -> DataFrame:
    """Names without regard to case, the first spelling and place winning."""
    first = names.groupBy(F.lower(F.trim(name)).alias("k")).agg(F.min_by(F.trim(name), order).alias(name), F.min(order).alias(order))
    return first.where("k <> ''").drop("k")


def carry_over(now: DataFrame, before: DataFrame, content: str, order: str | None, verdicts: list[str]) -> DataFrame:
    """Verdicts of the last earlier record with the same content hash (without
    an ``order``: of each such record, in a row of its own); the rest have
    carriedOver = false and are verified anew."""
    if order:
        prev = before.groupBy(F.md5(content).alias("_h")).agg(F.max_by(F.struct(*verdicts), order).alias("_v"))
    else:
        prev = before.select(F.md5(content).alias("_h"), F.struct(*verdicts).alias("_v"))
    t = now.withColumn("_h", F.md5(content)).join(prev, "_h", "left")
    return t.select(*[c for c in now.columns if c not in verdicts], *(F.col(f"_v.{v}").alias(v) for v in verdicts), F.col("_v").isNotNull().alias("carriedOver"))


def edit_scene(points: DataFrame, edits: DataFrame) -> DataFrame:
    """A synthetic re-scan: edits (inst, op, dx, dy, dz, copy_as): remove,
    move or insert (a moved copy under a new number)."""
    e = F.broadcast(edits)
    kept = points.join(e.where("op in ('remove', 'move')").select("inst"), "inst", "left_anti")
    shift = {c: F.col(c) + F.coalesce(f"d{c}", F.lit(0.0)) for c in "xyz"}
    moved = points.join(e.where("op = 'move'").select("inst", "dx", "dy", "dz"), "inst").withColumns(shift).select(*points.columns)
    new = points.join(e.where("op = 'insert'").select("inst", "dx", "dy", "dz", "copy_as"), "inst").withColumns(shift).withColumn("inst", F.col("copy_as")).select(*points.columns)
    return kept.unionByName(moved).unionByName(new)


def selected(records: DataFrame, wanted: list[str], order: str, most: int | None = None, by: tuple[str, ...] = ("name", "id", "file")) -> DataFrame:
    """Records any of whose names is wanted (none wanted: all), the first
    ``most`` of them in order."""
    hit = F.lit(not wanted)
    for c in by:
        if c in records.columns:
            hit = hit | F.coalesce(F.col(c).cast("string").isin(*wanted), F.lit(False))
    out = records.where(hit)
    return out if most is None else out.orderBy(order).limit(most)


def raw_context(records: DataFrame) -> DataFrame:
    """What a reader without the graph gets of each record: its label and
    geometry, no status and no flags."""
    return records.select("name", "type", "confidence", F.col("x").alias("poseX"), F.col("y").alias("poseY"), F.struct(F.col("l").alias("length"), F.col("w").alias("width"), F.col("h").alias("height")).alias("dimensions"), "color")


# What a record's card says of its status.
STATUS_TEXT = {"verified": "true (VLM 4-view unanimous)", "verified_escalated": "true (escalated 12-view)", "unverified": "false → demoted at query time"}


def cards(records: DataFrame) -> DataFrame:
    """id -> symbolic, explicit, implicit: maps of the texts of a record's card.
    An unverified type is shown as unknown, with the label that failed."""

    def number(c: str) -> Column:
        return F.format_string("%.2f", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))

    def pairs(**texts: Column) -> Column:
        return F.create_map(*(x for k, v in texts.items() for x in (F.lit(k), v)))

    type_ = F.when(F.col("status") == "unverified", F.concat(F.lit("unknown (gated; was '"), F.col("type"), F.lit("')"))).otherwise(F.col("type"))
    told = F.create_map(*(F.lit(x) for kv in STATUS_TEXT.items() for x in kv))
    flag = lambda c: F.lower(F.coalesce(F.col(c), F.lit(False)).cast("string"))
    return records.select(
        "id", pairs(type=type_, name=F.col("name"), verified=F.coalesce(told[F.coalesce("status", F.lit("?"))], "status", F.lit("?"))).alias("symbolic"),
        pairs(pose=F.concat(F.lit("x "), number("x"), F.lit("  y "), number("y"), F.lit("  z "), number("z"), F.lit(" m  (map)")), theta=F.concat(number("th"), F.lit(" rad")), dims=F.concat_ws(" x ", number("l"), number("w"), F.concat(number("h"), F.lit(" m"))), confidence=number("confidence")).alias("explicit"),
        pairs(keyObject=flag("is_key"), movable=flag("is_movable")).alias("implicit"),
    )


def union_of_candidates(first: Column, extra: Column, most: int = 4, without: str = "clutter") -> Column:
    """The first ``most`` candidates and the extra ones that are not among
    them, in order."""
    head = F.slice(F.filter(first, lambda c: c != without), 1, most)
    return F.concat(head, F.filter(extra, lambda c: ~F.array_contains(head, c)))


def recovery_jobs(targets: DataFrame, records: DataFrame, candidates_: DataFrame, extra: list[str], floor_z: float) -> DataFrame:
    """One re-verification job for each target (kg, det, file): the record of
    its detection, candidate labels and the four views to look at."""
    t = targets.join(records.select(F.col("name").alias("det"), F.col("type").alias("old_type"), "z", "h"), "det").join(candidates_.select("file", "candidates"), "file", "left")
    cands = union_of_candidates(F.coalesce("candidates", F.array().cast("array<string>")), F.array(*map(F.lit, extra)).cast("array<string>"))
    views = F.transform(F.array(*map(F.lit, (0, 90, 180, 270))), lambda a: F.concat(F.lit("views/"), F.regexp_replace("file", r"\.ply$", ""), F.lit("/view_"), F.lpad(a.cast("string"), 3, "0"), F.lit(".png")))
    return t.select(F.col("kg").alias("key"), "det", "old_type", cands.alias("candidates"), views.alias("views"), F.bround(F.col("z") - F.col("h") / 2 - F.lit(floor_z), 2).alias("bottom_above_floor_m"))
