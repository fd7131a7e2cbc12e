"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. At each level
every child draws -ln(u) / weight, u in (0, 1) being a hash of the row's key and
the child's path; the smallest draw wins. A child so wins in proportion to its
weight, and a draw depends on nothing but the key and that child: if one weight
changes, rows move only to or from the subtree whose weight changed, and rows
that stay in a region keep their rack and shard there.

Defined results: a null key descends like any other value (all null keys meet
in one shard); equal keys share a shard; an empty table gives no rows; other
columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, gapless


@dataclass(frozen=True)
class Node:
    """A region or rack (with children) or a shard (with its number)."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def uniform_tree(regions: int, racks: int, shards: int) -> Node:
    """regions x racks x shards, all shards of weight 1."""
    n, out = 0, []
    for r in range(regions):
        cells = []
        for k in range(racks):
            leaves = tuple(Node(f"s{n + i}", 1.0, shard=n + i) for i in range(shards))
            n += shards
            cells.append(Node(f"k{k}", float(shards), leaves))
        out.append(Node(f"r{r}", float(racks * shards), tuple(cells)))
    return Node("root", float(n), tuple(out))


def leaves(tree: Node) -> list[Node]:
    return [tree] if tree.shard is not None else [x for c in tree.children for x in leaves(c)]


def grow(tree: Node, weight: float = 1.0) -> Node:
    """One more shard, in a region of its own: the weights of all other
    subtrees stay, so rows move to the new shard and nowhere else."""
    n = len(leaves(tree))
    leaf = Node(f"s{n}", weight, shard=n)
    region = Node(f"r{len(tree.children)}", weight, (Node("k0", weight, (leaf,)),))
    return Node(tree.name, tree.weight + weight, (*tree.children, region))


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) * (2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def shard_of(key: Column, tree: Node, path: str = "") -> Column:
    """The shard as an expression of whole-stage code: no join, no Python."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    live = [(i, c) for i, c in enumerate(tree.children) if c.weight > 0]
    if len(live) == 1:
        return shard_of(key, live[0][1], f"{path}/{live[0][1].name}")
    best = F.least(*(F.struct(_draw(key, f"{path}/{c.name}", c.weight).alias("d"), F.lit(i).alias("i")) for i, c in live))["i"]
    out = None
    for i, c in live[:-1]:
        below = shard_of(key, c, f"{path}/{c.name}")
        out = F.when(best == i, below) if out is None else out.when(best == i, below)
    return out.otherwise(shard_of(key, live[-1][1], f"{path}/{live[-1][1].name}"))


def hash_tree_shards(df: DataFrame, tree: Node, key: str = "doc_id", into: str = "shard") -> DataFrame:
    return df.withColumn(into, shard_of(F.col(key).cast("long"), tree).cast("int"))


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 by the law ``key``. A null text has
    size 1 and the CRC of no bytes, 0."""
    tree = uniform_tree(4, 2, 2)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = hash_tree_shards(rows, tree)
    rows = hash_tree_shards(rows, grow(tree), into="grown_shard")
    out = gapless(Scratch(spark, "op1"), rows, ["shard"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
