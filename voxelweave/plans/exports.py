"""Text exports: Cypher, USD, point files. Rows of (ord, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import identifier, quote


def cypher(nodes: DataFrame, edges: DataFrame, ordered: bool = True) -> DataFrame:
    """MERGE statements: nodes with their non-null properties (implicit flags
    with i_ before), then edges with upper-case types. Not ``ordered``: nodes
    and edges stand in any order among themselves, which spares a sort of all
    edges; the parts follow each other all the same."""
    props = F.array(
        F.concat(F.lit("name: "), quote(F.col("name"))), F.concat(F.lit("type: "), quote(F.col("type"))), F.concat(F.lit("mapId: "), quote(F.col("map_id"))),
        *(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("x", "y", "z", "confidence")), F.concat(F.lit("status: "), quote(F.col("status"))), F.concat(F.lit("presence: "), quote(F.col("presence"))),
    )
    flags = F.transform(F.map_entries(F.coalesce(F.from_json("implicit", "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.lit("i_"), e["key"], F.lit(": "), F.when(e["value"].isin("true", "false"), e["value"]).otherwise(quote(e["value"]))))
    body = F.array_join(F.concat(F.array_compact(props), F.array_sort(flags)), ", ")
    n = nodes.select(F.struct(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).alias("ord"), F.concat(F.lit("MERGE (n:Object {id: "), quote(F.col("id")), F.lit("}) SET n += {"), body, F.lit("};")).alias("text"))
    e = edges.select(F.struct(F.lit(2).alias("part"), F.col("subj").alias("a"), F.col("pred").alias("b"), F.col("obj").alias("c")).alias("ord"), F.concat(F.lit("MATCH (a {id: "), quote(F.col("subj")), F.lit("}), (b {id: "), quote(F.col("obj")), F.lit("}) MERGE (a)-[:"), F.upper("pred"), F.lit("]->(b);")).alias("text"))
    head = nodes.sparkSession.range(1).select(F.struct(F.lit(0).alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).alias("ord"), F.lit("MATCH (n) DETACH DELETE n;").alias("text"))
    t = head.unionAll(n).unionAll(e)
    return t.orderBy("ord") if ordered else t


def place_cypher(inside: DataFrame, connected: DataFrame) -> DataFrame:
    """isIn of members and connectsTo {via} of places."""
    a = inside.select(F.concat(F.lit("MATCH (a {id: "), quote(F.col("id")), F.lit("}), (p:Place {id: "), quote(F.col("place").cast("string")), F.lit("}) MERGE (a)-[:isIn]->(p);")).alias("text"))
    b = connected.select(F.concat(F.lit("MATCH (p:Place {id: "), quote(F.col("a").cast("string")), F.lit("}), (q:Place {id: "), quote(F.col("b").cast("string")), F.lit("}) MERGE (p)-[:connectsTo {via: ["), F.col("door_x").cast("string"), F.lit(", "), F.col("door_y").cast("string"), F.lit("]}]->(q);")).alias("text"))
    return a.unionAll(b).orderBy("text")


def relation_targets(relations: DataFrame, objects: DataFrame, places: DataFrame) -> DataFrame:
    """Scene path of every relation's target: an object, else a place; those
    that are neither drop out. One row per subject and predicate."""
    o = objects.select(F.col("name").alias("object"), F.concat(F.lit("/World/Objects/"), identifier(F.col("name"))).alias("op")).dropDuplicates(["object"])
    p = places.select(F.col("name").alias("object"), F.concat(F.lit("/World/Places/"), identifier(F.col("name"))).alias("pp")).dropDuplicates(["object"])
    t = relations.join(o, "object", "left").join(p, "object", "left").withColumn("path", F.coalesce("op", "pp")).where("path is not null")
    return t.groupBy("subject", "predicate").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def _vec(*cs: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *(F.bround(c, 6).cast("string") for c in cs)), F.lit(")"))


def relation_line(predicate: Column, paths: Column, folder: str = "") -> Column:
    """A relation of a prim to scene paths (in a folder), of which there are some."""
    listed = F.concat(F.lit(f"<{folder}"), F.array_join(paths, f">, <{folder}"), F.lit(">"))
    return F.concat(F.lit("        rel "), identifier(predicate), F.lit(" = ["), listed, F.lit("]"))


def object_line(predicate: Column, prims: Column) -> Column:
    """relation_line to objects by their sorted identifiers."""
    return relation_line(predicate, prims, "/World/Objects/")


def usda(objects: DataFrame, relations: DataFrame, places: DataFrame, stage: str = "World") -> DataFrame:
    """A USD scene: one prim an object, with its box, record and relations."""
    rel = relation_targets(relations, objects, places)
    lines = rel.select(F.col("subject").alias("name"), relation_line(F.col("predicate"), F.col("paths")).alias("line"))
    per = lines.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("rels"))
    return usda_prims(objects.join(per, "name", "left"), stage).orderBy("ord")


def usda_prims(o: DataFrame, stage: str = "World") -> DataFrame:
    """usda() of objects that have the lines of their relations (rels); prims
    stand in any order between head and tail, which spares a sort of all text."""
    data = F.concat(F.lit("        customData = {\n            string id = "), quote(F.col("id")), F.lit("\n            string type = "), quote(F.col("type")), F.lit("\n            string status = "), quote(F.col("status")), F.lit("\n        }"))
    body = F.concat_ws(
        "\n", F.concat(F.lit('    def Cube "'), identifier(F.col("name")), F.lit('" (')), data, F.lit("    ) {"),
        F.concat(F.lit("        double3 xformOp:translate = "), _vec(F.col("x"), F.col("y"), F.col("z"))), F.concat(F.lit("        double xformOp:rotateZ = "), F.bround(F.degrees("th"), 6).cast("string")),
        F.concat(F.lit("        double3 xformOp:scale = "), _vec(F.col("l") / 2, F.col("w") / 2, F.col("h") / 2)), F.coalesce("rels", F.lit("")), F.lit("    }"),
    )
    head = o.sparkSession.range(1).select(F.lit("").alias("ord"), F.lit(f'#usda 1.0\n(\n    defaultPrim = "{stage}"\n    upAxis = "Z"\n    metersPerUnit = 1\n)\ndef Xform "{stage}" {{').alias("text"))
    tail = o.sparkSession.range(1).select(F.lit("￿").alias("ord"), F.lit("}").alias("text"))
    return head.unionAll(o.select(F.col("name").alias("ord"), body.alias("text"))).unionAll(tail)


def envelope_rows(df: DataFrame) -> DataFrame:
    """One JSON document a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("text"))


def inspected(objects: DataFrame, names: list[str], keys: tuple[str, ...] = ("id", "name", "type", "status", "confidence")) -> DataFrame:
    """What a viewer shows of selected objects: name, key, value in the order of
    the keys; absent values are left out."""
    rows = F.array(*(F.struct(F.lit(n).alias("nth"), F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for n, k in enumerate(keys)))
    picked = objects.where(F.col("name").isin(*names)).select(F.col("name").alias("object"), F.explode(rows).alias("r"))
    return picked.where("r.value is not null").select("object", "r.nth", "r.key", "r.value")
