"""Records, tables, robots and configuration."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schema as S
from ..operators.joins import last_wins


def load_records(spark: SparkSession, path: str, schema: T.StructType = S.SEMANTIC_OBJECT, field: str = "semanticObjects") -> DataFrame:
    """A JSON document that is a bare list or wraps one: one row a record."""
    text = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", T.ArrayType(schema))
    wrapped = F.from_json("value", T.StructType([T.StructField(field, T.ArrayType(schema))]))[field]
    return text.select(F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)).alias("o")).select("o.*")


def load_checkpoint(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """JSON lines, a torn line left out; of lines with one key the last."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return last_wins(rows.where(F.col(key).isNotNull()).withColumn("_n", F.monotonically_increasing_id()), key, "_n").drop("_n")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def top_k_lists(table: DataFrame, k: int = 5) -> DataFrame:
    """file, n_points, top1, score1, top2, ... -> file, rank, class, score."""
    have = [i for i in range(1, k + 1) if f"top{i}" in table.columns]
    item = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.col(f"top{i}").alias("class"), F.col(f"score{i}").cast("double").alias("score")) for i in have)))
    return table.select("file", item.alias("t")).select("file", "t.*").where("class is not null")


def wide_top_k(rows: DataFrame, k: int = 5) -> DataFrame:
    """The other way: one row a file."""
    return rows.groupBy("file").agg(*(e for i in range(1, k + 1) for e in (F.max(F.when(F.col("rank") == i, F.col("class"))).alias(f"top{i}"), F.max(F.when(F.col("rank") == i, F.col("score"))).alias(f"score{i}"))))


def list_objects(spark: SparkSession, folder: str) -> DataFrame:
    """obj_*.ply files of a folder in order, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "obj_*.ply").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length").orderBy("file")


def load_urdf(spark: SparkSession, path: str) -> DataFrame:
    """Robot name, links, joints and sensors of a URDF file."""
    t = spark.read.text(path, wholetext=True)
    return t.select(
        F.element_at(F.xpath("value", F.lit("/robot/@name")), 1).alias("name"), F.xpath("value", F.lit("/robot/link/@name")).alias("links"),
        F.xpath("value", F.lit("/robot/joint/@name")).alias("joints"), F.xpath("value", F.lit("/robot/gazebo/sensor/@type | /robot/sensor/@type")).alias("sensors"),
        F.xpath_double("value", F.lit("sum(/robot/link/inertial/mass/@value)")).alias("mass"),
    )


def parameters(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Values of ``name: value`` lines of a parameter file."""
    t = spark.read.text(path, wholetext=True)
    return t.select(*(F.regexp_extract("value", rf"(?m)^\s*{re.escape(n)}\s*:\s*([-+0-9.eE]+)", 1).try_cast("double").alias(n) for n in names))


def parse_config(text: str) -> dict:
    """Mappings, lists and scalars of a YAML document in block style, with
    flow lists; comments are left out. Anchors, tags and folded texts are not
    read."""

    def scalar(v: str):
        v = v.strip()
        if v[:1] in "'\"" and v[-1:] == v[:1] and len(v) > 1:
            return v[1:-1]
        if v.startswith("[") and v.endswith("]"):
            return [scalar(x) for x in v[1:-1].split(",") if x.strip()]
        if v.lower() in ("true", "false"):
            return v.lower() == "true"
        if v.lower() in ("", "null", "~"):
            return None
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                continue
        return v

    lines = []
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip() if not re.search(r"['\"][^'\"]*#", line) else line.rstrip()
        if bare.strip() and bare.strip() != "---":
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def block(at: int, depth: int):
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out = []
            while at < len(lines) and lines[at][0] == depth and lines[at][1][:1] == "-":
                item = lines[at][1][1:].strip()
                if item:
                    out.append(scalar(item))
                    at += 1
                else:
                    value, at = block(at + 1, lines[at + 1][0])
                    out.append(value)
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == depth:
            key, _, value = lines[at][1].partition(":")
            at += 1
            if value.strip():
                out[scalar(key)] = scalar(value)
            elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1][:1] == "-"):
                out[scalar(key)], at = block(at, lines[at][0])
            else:
                out[scalar(key)] = None
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def load_config(spark: SparkSession, path: str) -> dict:
    return parse_config(spark.read.text(path, wholetext=True).head()[0])


def edit_spec(spark: SparkSession, path: str) -> DataFrame:
    """remove / move / insert / occlude of a synthetic re-scan as rows."""
    part = "array<struct<name:string,copy_of:string,axis:string,fraction:double,dx:double,dy:double,dz:double>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<remove:array<string>,move:{part},insert:{part},occlude:{part}>").alias("s"))
    out = raw.select(F.explode("s.remove").alias("name")).select(F.lit("remove").alias("op"), "name", F.lit(None).cast("string").alias("axis"), *(F.lit(None).cast("double").alias(c) for c in ("fraction", "dx", "dy", "dz")))
    for op in ("move", "insert", "occlude"):
        out = out.unionByName(raw.select(F.explode(f"s.{op}").alias("e")).select(F.lit(op).alias("op"), F.coalesce("e.name", "e.copy_of").alias("name"), F.col("e.axis").alias("axis"), *(F.col(f"e.{c}").alias(c) for c in ("fraction", "dx", "dy", "dz"))))
    return out


# sinks


def write_lines(rows: DataFrame, path: str) -> None:
    """Ordered (…, text) rows as one text file: exports of one scene."""
    rows.select("text").coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_objects(points: DataFrame, path: str, min_points: int = 50) -> DataFrame:
    """One binary PLY a cluster as rows (file, content), and the manifest;
    earlier output of the folder is replaced."""
    from ..operators.aggregates import manifest, object_table
    from .points import ply_bytes

    table = object_table(points, min_points)
    points.join(table.select("inst"), "inst", "left_semi").write.mode("overwrite").partitionBy("inst").parquet(f"{path}/clusters")
    out = manifest(table)
    write_csv(out, f"{path}/objects")

    def encode(pdf):
        import pandas as pd

        p = pdf.sort_values("point_id")
        rows = list(p[["x", "y", "z", "r", "g", "b"]].itertuples(index=False, name=None))
        return pd.DataFrame({"file": [f"obj_{int(p['inst'].iloc[0]):04d}.ply"], "content": [ply_bytes(rows)]})

    return points.join(table.select("inst"), "inst", "left_semi").groupBy("inst").applyInPandas(encode, "file string, content binary")


def labeled(points: DataFrame, label: str, instance: str | None = None) -> DataFrame:
    cols = ["x", "y", "z", label] + ([instance] if instance else [])
    return points.select(*cols)
