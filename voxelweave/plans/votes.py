"""Fusing the labels that views of an object were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import SYNONYM_SETS, type_match


def fuse(votes: DataFrame, by: str = "obj", order: str = "ord") -> DataFrame:
    """Confidence-weighted vote: by, top, share, unanimous, n_votes, scores.

    Two aggregations: sums and first place of every label, then the label of
    the greatest sum (ties, up to nine places as sums have no order: seen first). No votes: no row."""
    label = F.lower(F.trim("type"))
    s = votes.groupBy(by, label.alias("label")).agg(F.sum("confidence").alias("score"), F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    total = F.sum("score")
    return s.groupBy(by).agg(
        F.max_by("label", F.struct(F.round("score", 9), -F.col("first"))).alias("top"),
        (F.max("score") / F.when(total == 0, 1.0).otherwise(total)).alias("share"),
        (F.count(F.lit(1)) == 1).alias("unanimous"),
        F.sum("n").alias("n_votes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.bround("score", 3).alias("s"))))).alias("scores"),
    )


def status(unanimous: Column, escalated: Column, share: Column, resolve: float = 0.6, rounded: bool = True) -> Column:
    """verified / verified_escalated / verified_majority / unverified. The
    online tree compares the share rounded to three places."""
    s = F.bround(share, 3) if rounded else share
    return F.when(unanimous, "verified").when(s < resolve, "unverified").when(escalated, "verified_escalated").otherwise("verified_majority")


def base_votes(votes: DataFrame) -> DataFrame:
    """The four unzoomed views at right angles."""
    return votes.where(~F.col("zoom") & F.col("azimuth").isin(0, 90, 180, 270))


def late_fusion(votes: DataFrame, escalate: bool = True) -> DataFrame:
    """Base views first; only objects whose base vote is split use all views."""
    base = fuse(base_votes(votes)).select("obj", F.col("top").alias("base_top"), F.col("share").alias("base_share"), F.col("unanimous").alias("base_unanimous"))
    split = base.where(~F.col("base_unanimous")).select("obj")
    full = fuse(votes.join(split, "obj", "left_semi")) if escalate else fuse(base_votes(votes.join(split, "obj", "left_semi")))
    t = base.join(full.select("obj", "top", "share", "n_votes"), "obj", "left")
    share = F.coalesce("share", "base_share")
    return t.select("obj", F.coalesce("top", "base_top").alias("type"), share.alias("share"), F.lit(escalate).alias("_e"), "base_top", "base_unanimous").select(
        "obj", "type", "share", "base_top", (F.col("_e") & ~F.col("base_unanimous")).alias("escalated"), status(F.col("base_unanimous"), F.col("_e") & ~F.col("base_unanimous"), F.col("share")).alias("status"),
    )


def escalation_summary(fused: DataFrame, truth: DataFrame, call_cost: float = 0.0091) -> DataFrame:
    """Accuracy before and after escalation against graded objects (obj,
    gt_type, quality): one row of conditional aggregates."""
    t = fused.join(truth, "obj").withColumn("base_ok", type_match(F.col("base_top"), F.col("gt_type"), SYNONYM_SETS)).withColumn("final_ok", type_match(F.col("type"), F.col("gt_type"), SYNONYM_SETS))
    strict, lenient = F.col("quality") == "confirmed", F.col("quality").isin("confirmed", "plausible")

    def acc(ok: str, where: Column) -> Column:
        return F.avg(F.when(where, F.col(ok).cast("double")))

    return t.agg(
        F.count(F.lit(1)).alias("objects"), F.avg(F.col("escalated").cast("double")).alias("trigger_rate"),
        acc("base_ok", strict).alias("base_strict"), acc("base_ok", lenient).alias("base_lenient"), acc("final_ok", strict).alias("final_strict"), acc("final_ok", lenient).alias("final_lenient"),
        F.count_if(F.col("escalated") & ~F.col("base_ok") & F.col("final_ok")).alias("recoveries"), F.count_if(F.col("escalated") & F.col("base_ok") & ~F.col("final_ok")).alias("regressions"),
    )


def consensus(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """Labels on which two passes agree."""
    b = second.select(key, F.lower(F.trim(label)).alias("_b"))
    return first.join(b, key).where(F.lower(F.trim(label)) == F.col("_b")).drop("_b")


def votes_by_view(votes: DataFrame) -> DataFrame:
    """First vote at every (azimuth, zoom), one column each."""
    key = F.concat(F.lit("v"), F.col("azimuth"), F.when(F.col("zoom"), "_z").otherwise(""))
    return votes.groupBy("obj").pivot("view", [f"v{a}{z}" for a in (0, 90, 180, 270) for z in ("", "_z")]).agg(F.min_by("type", "ord")) if "view" in votes.columns else votes_by_view(votes.withColumn("view", key))
