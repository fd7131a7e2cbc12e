"""The revisioned graph: matching a re-scan, change capture, views, feedback.

nodes: id, name, type, map_id, x, y, z, th, l, w, h, color, confidence, status,
implicit (JSON), presence, first_seen, last_seen, ord. records: the same without
id, presence and times. The history is an append-only table; the state is the
nodes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import anchor_id
from ..operators.components import keep
from ..operators.joins import greedy_claims, last_wins, radius_join, semi_edges
from ..sources.points import write_bytes

# Labels that carry no identity.
GENERIC = ("clutter", "unknown", "misc", "object")
TRACKED = ("type", "confidence", "status", "implicit", "color", "pose", "dimensions")
NODE_SCHEMA = "id string, name string, type string, map_id string, x double, y double, z double, th double, l double, w double, h double, color string, confidence double, status string, implicit string, presence string, first_seen string, last_seen string, ord long"
HISTORY_SCHEMA = "node_id string, revision int, ts string, event string, field string, old_json string, new_json string"
FIELDS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
SEEN = ["name", "type", "x", "y", "z", "th", "l", "w", "h", "color", "confidence", "status", "implicit"]


@dataclass
class Graph:
    nodes: DataFrame
    history: DataFrame
    edges: DataFrame
    updates: DataFrame
    revision: int


def new_graph(spark: SparkSession) -> Graph:
    return Graph(
        spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], HISTORY_SCHEMA), spark.createDataFrame([], "subj string, pred string, obj string, revision int"),
        spark.createDataFrame([], "revision int, ts string, updated long, unchanged long, moved long, inserted long, absent long"), 0,
    )


#: After so many revisions the log's parts are written as one table.
COMPACT_EVERY = 32


def appended(log: DataFrame, rows: DataFrame, revision: int) -> DataFrame:
    """The log with new rows, which alone are written; its parts are joined into
    one table now and then, so that plans stay short."""
    out = log.unionByName(keep(rows))
    return keep(out) if revision % COMPACT_EVERY == 0 else out


def save(graph: Graph, folder: str, batch: int = -1) -> None:
    """Writes the graph's state and the log's new rows, then a pointer to them,
    in this order: a crash in between leaves the last state valid."""
    spark = graph.nodes.sparkSession
    at = f"{folder}/revision-{graph.revision}"
    before = load(spark, folder)
    since = before[0].revision if before else 0
    graph.nodes.write.mode("overwrite").parquet(f"{at}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{at}/edges")
    graph.updates.write.mode("overwrite").parquet(f"{at}/updates")
    graph.history.where(F.col("revision") > since).write.mode("overwrite").parquet(f"{at}/log")
    logs = [*(before[2] if before else []), *([f"{at}/log"] if graph.revision > since else [])]
    pointer = json.dumps({"revision": graph.revision, "batch": batch, "at": at, "logs": logs})
    write_bytes(spark, f"{folder}/pointer-{graph.revision:08d}-{batch + 1:08d}.json", pointer.encode())


def load(spark: SparkSession, folder: str) -> tuple[Graph, int, list[str]] | None:
    """(graph, last batch, log folders) of the latest pointer; None without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
    pointers = [n for n in names if n.startswith("pointer-")]
    if not pointers:
        return None
    p = json.loads(spark.read.text(f"{folder}/{pointers[-1]}", wholetext=True).head()[0])
    empty = new_graph(spark)
    read = lambda where, like: spark.read.schema(like.schema).parquet(*where)
    history = read(p["logs"], empty.history) if p["logs"] else empty.history
    return Graph(read([f"{p['at']}/nodes"], empty.nodes), history, read([f"{p['at']}/edges"], empty.edges), read([f"{p['at']}/updates"], empty.updates), p["revision"]), p["batch"], p["logs"]


def _extents(a: str, b: str) -> Column:
    out = F.lit(True)
    for c in "lwh":
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        out = out & (F.abs(x - y) <= F.greatest(F.lit(0.3) * F.greatest(x, y), F.lit(0.15)))
    return out


def _flat2(a: str, b: str) -> Column:
    return (F.col(f"{a}.x") - F.col(f"{b}.x")) ** 2 + (F.col(f"{a}.y") - F.col(f"{b}.y")) ** 2


def match(nodes: DataFrame, records: DataFrame, max_center: float = 0.5, max_move: float = 6.0) -> tuple[DataFrame, DataFrame]:
    """(rec, node) pairs that stayed, and pairs that moved. Records claim nodes
    in their order; candidates come from grid joins of places and extents."""
    live, shape = nodes.where("presence = 'present'").withColumnRenamed("id", "node"), ["x", "y", "z", "l", "w", "h"]
    records = records.withColumn("rec", F.col("ord"))
    here = F.col("a.map_id") == F.col("b.map_id")

    def near(a: DataFrame, b: DataFrame) -> DataFrame:
        return radius_join(a, b, max_center, condition=_extents("a", "b") & here).withColumn("cost", _flat2("a", "b"))

    stayed = keep(greedy_claims(records, live, near, "rec", "node", "ord", "cost", "map_id", shape, shape).select("map_id", "rec", "node"))
    kind = F.lower(F.trim("type")).alias("kind")
    rest = records.join(stayed.select("map_id", "rec"), ["map_id", "rec"], "left_anti").select("*", kind).where(~F.col("kind").isin(*GENERIC))
    free = live.join(stayed.select("node"), "node", "left_anti").select("*", kind)

    def far(a: DataFrame, b: DataFrame) -> DataFrame:
        return radius_join(a, b, max_move, three_d=False, condition=(F.col("a.kind") == F.col("b.kind")) & here & _extents("a", "b"))

    shape = ["x", "y", "l", "w", "h", "kind"]
    moved = keep(greedy_claims(rest, free, far, "rec", "node", "ord", "d2", "map_id", shape, shape).select("map_id", "rec", "node"))
    return stayed, moved


def _json(prefix: str, field: str) -> Column:
    c = lambda n: F.col(f"{prefix}.{n}")
    if field == "pose":
        return F.to_json(F.struct(c("x").alias("x"), c("y").alias("y"), c("z").alias("z"), c("th").alias("theta")))
    if field == "dimensions":
        return F.to_json(F.struct(c("l").alias("length"), c("w").alias("width"), c("h").alias("height")))
    return F.to_json(F.struct(c(field).alias("v")))


def changes(old: str, new: str, always: tuple[str, ...] = ()) -> Column:
    """The tracked fields that differ, as an array of {field, old, new}."""
    one = [F.when(~_json(old, f).eqNullSafe(_json(new, f)) | F.lit(f in always), F.struct(F.lit(f).alias("field"), _json(old, f).alias("old_json"), _json(new, f).alias("new_json"))) for f in TRACKED]
    return F.array_compact(F.array(*one))


def upsert(graph: Graph, records: DataFrame, timestamp: str, edges: DataFrame | None = None, strict: bool = False) -> Graph:
    """The graph after a re-scan. Classes: unchanged, updated, moved, inserted,
    absent. A record that is left over and whose anchor equals that of a node
    revives it, even a present one, unless ``strict``, which gives it a new
    suffixed id. Of left-over records with one anchor the first is inserted and
    the last one's label stands; if ``strict``, the first has the anchor and each
    other one is a node with a suffixed id. ``edges`` (subject, predicate, object by name)
    replace the old ones; None keeps them; names without a present node drop
    out. name_of nodes is never changed by a match."""
    rev = graph.revision + 1
    records, nodes = keep(records), graph.nodes
    stayed, moved = match(nodes, records)
    r = records.select("map_id", F.col("ord").alias("rec"), *SEEN)
    pairs = stayed.withColumn("moved", F.lit(False)).unionByName(moved.withColumn("moved", F.lit(True)))
    met = pairs.alias("p").join(nodes.alias("o"), F.col("p.node") == F.col("o.id")).join(r.alias("n"), (F.col("p.rec") == F.col("n.rec")) & (F.col("p.map_id") == F.col("n.map_id")))
    what = F.when(F.col("p.moved"), changes("o", "n", ("pose",))).otherwise(changes("o", "n"))
    met = keep(met.select("o.*", *(F.col(f"n.{c}").alias(f"n_{c}") for c in SEEN), "p.moved", what.alias("changes")))
    kind = F.when(F.col("moved"), "moved").when(F.size("changes") > 0, "updated").otherwise("unchanged")
    after_met = met.select("id", "name", "map_id", *(F.col(f"n_{c}").alias(c) for c in SEEN if c != "name"), "presence", "first_seen", F.lit(timestamp).alias("last_seen"), "ord")

    left = records.join(pairs.select("map_id", F.col("rec").alias("ord")), ["map_id", "ord"], "left_anti")
    left = left.withColumn("id", anchor_id(F.col("map_id"), *(F.col(c) for c in ("x", "y", "z", "l", "w", "h"))))
    if strict:
        taken = nodes.where("presence = 'present'").select("id").distinct().withColumn("_t", F.lit(True))
        again = F.row_number().over(Window.partitionBy("id").orderBy("ord")) > 1
        left = left.withColumn("_again", again).join(taken, "id", "left").withColumn("_t", F.coalesce("_t", F.lit(False)) | F.col("_again")).drop("_again")
        left = left.withColumn("id", F.when(F.col("_t"), F.concat("id", F.lit(f"-{rev}-"), F.col("ord").cast("string"))).otherwise(F.col("id"))).drop("_t")
    g = left.groupBy("id").agg(F.min_by(F.struct(*left.columns), "ord").alias("first"), F.max_by(F.struct("type", "confidence", "status", "implicit"), "ord").alias("last"), F.count(F.lit(1)).alias("times"))
    g = keep(g)
    relabel = ("type", "confidence", "status", "implicit")
    back = nodes.alias("o").join(g.alias("g"), "id")
    gone_met = met.select("id")
    base = nodes.join(gone_met, "id", "left_anti").unionByName(after_met.select(*FIELDS))
    revived = base.join(g.select("id", "last"), "id").select("id", *(F.col(f"last.{c}").alias(c) if c in relabel else F.lit("present").alias(c) if c == "presence" else F.lit(timestamp).alias(c) if c == "last_seen" else F.col(c) for c in FIELDS if c != "id"))
    fresh = g.join(nodes.select("id"), "id", "left_anti")
    inserted = fresh.select("id", *(F.col(f"last.{c}").alias(c) if c in relabel else F.lit("present").alias(c) if c == "presence" else F.lit(timestamp).alias(c) if c in ("first_seen", "last_seen") else F.col(f"first.{c}").alias(c) for c in FIELDS if c != "id"))
    rest = base.join(g.select("id"), "id", "left_anti")
    live = nodes.where("presence = 'present'").select("id")
    lost = live.join(gone_met, "id", "left_anti").join(g.select("id"), "id", "left_anti")
    rest = rest.join(lost.withColumn("_lost", F.lit(True)), "id", "left").withColumn("presence", F.when(F.col("_lost"), "absent").otherwise(F.col("presence"))).drop("_lost")
    new_nodes = keep(rest.select(*FIELDS).unionByName(revived.select(*FIELDS)).unionByName(inserted.select(*FIELDS)))

    quoted = lambda v: F.lit(None).cast("string") if v is None else F.lit(f'{{"v":"{v}"}}')

    def presence(df: DataFrame, old: str | None, new: str) -> DataFrame:
        return df.select(F.col("id").alias("node_id"), F.lit(rev).alias("revision"), F.lit(timestamp).alias("ts"), F.lit("presence").alias("event"), F.lit("presence").alias("field"), quoted(old).alias("old_json"), quoted(new).alias("new_json"))

    log = met.where(F.size("changes") > 0).select(F.col("id").alias("node_id"), F.lit(rev).alias("revision"), F.lit(timestamp).alias("ts"), F.when(F.col("moved"), "moved").otherwise("updated").alias("event"), F.explode("changes").alias("c")).select("node_id", "revision", "ts", "event", "c.*")
    revived_ids = back.select("id")
    again = fresh.where("times > 1").select("id")
    log = log.unionByName(presence(revived_ids.unionAll(again), "absent", "present")).unionByName(presence(fresh.select("id"), None, "present")).unionByName(presence(lost, "present", "absent"))
    history = appended(graph.history, log, rev)
    classes = met.select(kind.alias("kind")).unionAll(back.select(F.lit("updated").alias("kind"))).unionAll(again.select(F.lit("updated"))).unionAll(fresh.select(F.lit("inserted"))).unionAll(lost.select(F.lit("absent")))
    diff = classes.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("updated", "unchanged", "moved", "inserted", "absent"))).select(F.lit(rev).alias("revision"), F.lit(timestamp).alias("ts"), "*")
    new_edges = graph.edges if edges is None else resolve_edges(edges, new_nodes, rev)
    return Graph(new_nodes, history, keep(new_edges), keep(graph.updates.unionByName(diff)), rev)


def _ids(nodes: DataFrame) -> DataFrame:
    return last_wins(nodes.where("presence = 'present'").select("name", "id", "ord"), "name", "ord").select("name", "id")


def resolved(objects: DataFrame, nodes: DataFrame, into: str) -> DataFrame:
    """Objects whose name is that of a present node, with its id: relations
    among them are edges that resolve_edges gives."""
    return objects.join(_ids(nodes).withColumnRenamed("id", into), "name")


def resolve_edges(edges: DataFrame, nodes: DataFrame, revision: int) -> DataFrame:
    """Names -> ids of present nodes; of nodes that share a name the last."""
    ids = _ids(nodes)
    s, o = ids.select(F.col("name").alias("subject"), F.col("id").alias("subj")), ids.select(F.col("name").alias("object"), F.col("id").alias("obj"))
    return edges.join(s, "subject").join(o, "object").select("subj", F.col("predicate").alias("pred"), "obj", F.lit(revision).alias("revision"))


def diff_summary(history: DataFrame, revision: int) -> DataFrame:
    """Counts of a revision from the log alone."""
    h = history.where(F.col("revision") == revision).groupBy("node_id").agg(F.max(F.when(F.col("field") == "presence", F.coalesce("new_json", F.lit(""))).otherwise(F.lit(""))).alias("p"), F.max(F.when(F.col("field") == "presence", F.col("old_json"))).alias("q"), F.max(F.col("event") == "moved").alias("m"))
    return h.agg(F.count_if(F.col("m")).alias("moved"), F.count_if(F.col("p").contains("absent")).alias("absent"), F.count_if(F.col("p").contains("present") & F.col("q").isNull()).alias("inserted"), F.count_if(~F.col("m") & ((F.col("p") == "") | F.col("q").contains("absent"))).alias("updated"))


# views


def exposed(nodes: DataFrame, mode: str) -> DataFrame:
    """What a reader sees. ungated: every label; verified_only: without
    unverified nodes; gated: unverified labels become unknown, with the label
    that failed beside."""
    n = nodes.where(F.coalesce("presence", F.lit("")) != "absent")
    if mode == "ungated":
        return n.withColumn("failed_type", F.lit(None).cast("string"))
    if mode == "verified_only":
        return n.where("status <> 'unverified'").withColumn("failed_type", F.lit(None).cast("string"))
    if mode == "gated":
        bad = F.col("status") == "unverified"
        return n.withColumn("failed_type", F.when(bad, F.col("type"))).withColumn("type", F.when(bad, "unknown").otherwise(F.col("type")))
    raise ValueError(f"no view {mode!r}")


def exposed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between exposed nodes only, by name."""
    names = nodes.select("id", "name")
    e = semi_edges(edges, nodes)
    return e.join(names.select(F.col("id").alias("subj"), F.col("name").alias("subject")), "subj").join(names.select(F.col("id").alias("obj"), F.col("name").alias("object")), "obj").select("subject", F.col("pred").alias("predicate"), "object")


# mutation by people


def feedback(graph: Graph, refuted: DataFrame, corrected: DataFrame, adopted: DataFrame, timestamp: str) -> Graph:
    """Owner's word as a revision: refuted (name) become absent, corrected
    (name, type) are relabelled, adopted (name, type) recover; edges stay where
    both ends are present."""
    rev = graph.revision + 1
    n = graph.nodes.where("presence = 'present'")
    twice = n.groupBy("name").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("names of present nodes must be unique")
    c = corrected.select("name", F.col("type").alias("_c"))
    a = adopted.select("name", F.col("type").alias("_a"))
    t = graph.nodes.join(refuted.select("name").withColumn("_r", F.lit(True)), "name", "left").join(c, "name", "left").join(a, "name", "left")
    here = F.col("presence") == "present"
    new = t.withColumns({
        "presence": F.when(here & F.col("_r"), "absent").otherwise(F.col("presence")),
        "type": F.when(here, F.coalesce("_c", "_a", "type")).otherwise(F.col("type")),
        "status": F.when(here & F.col("_c").isNotNull(), "verified_owner").when(here & F.col("_a").isNotNull(), "verified_recovery").otherwise(F.col("status")),
    }).select(*FIELDS)
    new = keep(new)
    old, now = graph.nodes.alias("o"), new.alias("n")
    both = old.join(now, F.col("o.id") == F.col("n.id"))
    rows = None
    for f in ("presence", "type", "status"):
        d = both.where(F.col(f"o.{f}") != F.col(f"n.{f}")).select(F.col("o.id").alias("node_id"), F.lit(rev).alias("revision"), F.lit(timestamp).alias("ts"), F.lit("owner").alias("event"), F.lit(f).alias("field"), _json("o", f).alias("old_json"), _json("n", f).alias("new_json"))
        rows = d if rows is None else rows.unionByName(d)
    edges = semi_edges(graph.edges, new.where("presence = 'present'"))
    return Graph(new, appended(graph.history, rows, rev), keep(edges.withColumn("revision", F.lit(rev))), graph.updates, rev)


def adjudicate(first: Column, second: Column, owner: Column, share: Column, least: float = 0.6) -> Column:
    """Label of two judges: the owner's word; agreement (equal, or one within
    the other); else the second if its share suffices; else null."""
    a, b = F.lower(F.trim(first)), F.lower(F.trim(second))
    agree = (a == b) | a.contains(b) | b.contains(a)
    return F.when(owner.isNotNull(), owner).when(agree, a).when(share >= least, b)


def replace_by_id(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def unified(objects: DataFrame, relations: DataFrame, places: DataFrame, inside: DataFrame, connected: DataFrame, times: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One node table and one edge table of objects and places. ``times``: a
    column of relations that says how many edges a row stands for; it is kept."""
    nodes = objects.select("id", "name", "type", F.lit("object").alias("layer")).unionByName(places.select("id", "name", "type", F.lit("place").alias("layer")))
    many, one = ([], []) if times is None else ([times], [F.lit(1).cast("long").alias(times)])
    inside = inside.select(F.col("id").alias("subject"), F.lit("isInsideOf").alias("predicate"), F.col("place").alias("object"), *one)
    connected = connected.select("subject", F.lit("isConnectedTo").alias("predicate"), "object", *one)
    return nodes, relations.select("subject", "predicate", "object", *many).unionByName(inside).unionByName(connected)
