"""Evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import greedy_claims, radius_join


def confusion(df: DataFrame, truth: str, pred: str, classes: int, ignore: int = -1) -> DataFrame:
    """gt, pred, n; predictions outside the classes don't count."""
    ok = (F.col(truth) != ignore) & F.col(truth).between(0, classes - 1) & F.col(pred).between(0, classes - 1)
    return df.where(ok).groupBy(F.col(truth).alias("gt"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def iou(conf: DataFrame) -> DataFrame:
    """Per class of the truth: intersection over union."""
    row = conf.groupBy(F.col("gt").alias("c")).agg(F.sum("n").alias("r"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    col = conf.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("k"))
    t = row.join(col, "c", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return t.select("c", (F.col("tp") / (F.col("r") + F.col("k") - F.col("tp"))).alias("iou"))


def mean_iou(conf: DataFrame) -> DataFrame:
    return iou(conf).agg(F.avg("iou").alias("miou"))


def accuracy(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("accuracy"))


def outcomes(points: DataFrame, cluster: str, truth: str, min_points: int) -> DataFrame:
    """Per true instance: recovered, split, merged or missing, by the overlap
    of clusters of min_points and instances (share 0.2, IoU 0.5)."""
    size = points.where(F.col(truth) >= 0).groupBy(F.col(truth).alias("g")).agg(F.count(F.lit(1)).alias("tot"))
    csize = points.where(F.col(cluster) >= 0).groupBy(F.col(cluster).alias("c")).agg(F.count(F.lit(1)).alias("cn")).where(F.col("cn") >= min_points)
    ov = points.where((F.col(truth) >= 0) & (F.col(cluster) >= 0)).groupBy(F.col(cluster).alias("c"), F.col(truth).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    ov = ov.join(csize, "c").join(size, "g").withColumn("big", F.col("n") >= 0.2 * F.col("tot"))
    ov = ov.withColumn("bigs_of_c", F.count_if("big").over(Window.partitionBy("c")))
    best = ov.groupBy("g").agg(F.max_by(F.struct("c", "n", "cn", "tot", "big", "bigs_of_c"), F.struct("n", -F.col("c"))).alias("b"), F.count_if("big").alias("bigs"))
    other = F.col("b.bigs_of_c") - F.col("b.big").cast("int") > 0
    overlap = F.col("b.n") / (F.col("b.tot") + F.col("b.cn") - F.col("b.n"))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("bigs") >= 2, "split").when(other, "merged").when(overlap >= 0.5, "recovered").otherwise("missing")
    return size.join(best, "g", "left").select("g", kind.alias("outcome"), F.col("b.c").alias("c"), overlap.alias("iou"))


def detection_match(truth: DataFrame, found: DataFrame, dist: float) -> DataFrame:
    """Greedy one-to-one matches in the order of the truth (map_id, id, ord, x,
    y): strictly nearer than dist, nearest first."""
    near = lambda a, b: radius_join(a, b, dist, three_d=False, condition=F.col("a.map_id") == F.col("b.map_id")).where(F.col("d2") < dist * dist)
    return greedy_claims(truth.withColumnRenamed("id", "gt"), found.withColumnRenamed("id", "det"), near, "gt", "det", "ord", "d2", "map_id", ["x", "y"], ["x", "y"])


def flags(df: DataFrame, flagged: Column, truth: Column) -> DataFrame:
    """TP, FP, FN, precision, recall of a flag."""
    c = df.agg(F.count_if(flagged & truth).alias("tp"), F.count_if(flagged & ~truth).alias("fp"), F.count_if(~flagged & truth).alias("fn"))
    return c.select("*", (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("recall"))


def by_condition(results: DataFrame, ok: Column, condition: str, kind: str) -> DataFrame:
    """Scores per condition and per condition and kind, in one pass."""
    return results.groupingSets([[F.col(condition)], [F.col(condition), F.col(kind)]], condition, kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("correct"), F.count_if(F.col("verdict") == "abstained").alias("abstained"))


def usage(calls: DataFrame, cost: Column, by: list[str]) -> DataFrame:
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *(F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "tokens_cached")), F.sum(cost).alias("cost_usd"))


def detection_scores(truth: DataFrame, found: DataFrame, matches: DataFrame, type_: str = "type") -> DataFrame:
    """Recall, precision and the share of right types among the matches, of
    truth (id, type) and detections (id, type) and their matches (gt, det)."""
    t = matches.join(truth.select(F.col("id").alias("gt"), F.lower(F.trim(type_)).alias("_a")), "gt").join(found.select(F.col("id").alias("det"), F.lower(F.trim(type_)).alias("_b")), "det")
    c = t.agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("_a") == F.col("_b")).alias("right_type"))
    sizes = truth.agg(F.count(F.lit(1)).alias("n_gt")).crossJoin(found.agg(F.count(F.lit(1)).alias("n_det")))
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return c.crossJoin(sizes).select("n_gt", "n_det", "matched", "right_type", ratio("matched", "n_gt").alias("recall"), ratio("matched", "n_det").alias("precision"), ratio("right_type", "matched").alias("type_accuracy"))
