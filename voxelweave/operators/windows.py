"""Ordered selections: top k, strides, runs, ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import numbered


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    out = df.withColumn(rank or "_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank or "_r") <= k)
    return out if rank else out.drop("_r")


def key_objects(objects: DataFrame, place: str, flagged: Column, generic: Column, confidence: Column, order: Column) -> DataFrame:
    """One object a place: flagged ones before specific before generic types;
    then the most confident, then the first."""
    tier = F.when(flagged, 0).when(~generic, 1).otherwise(2)
    return top_per_group(objects, [place], [tier, confidence.desc(), order])


def stride_sample(df: DataFrame, order: list[Column], parts: int, most: int, start: int = 0) -> DataFrame:
    """Every max(1, n / parts)-th row from ``start``, at most ``most``."""
    n = df.count()
    step = max(1, n // parts)
    r = numbered(df, order, "_r")
    return r.where((F.col("_r") >= start) & (F.pmod(F.col("_r") - start, F.lit(step)) == 0) & (F.col("_r") < start + most * step)).drop("_r")


def middle_row(df: DataFrame, order: list[Column]) -> DataFrame:
    n = df.count()
    return numbered(df, order, "_r").where(F.col("_r") == n // 2).drop("_r")


def even_sample(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """Rows at k positions spread evenly from first to last, per group; all rows
    of groups that have no more than k."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else df.agg(F.count(F.lit(1)).alias("_n"))
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) if by else numbered(df, order, "_r")
    r = r.join(n, by) if by else r.crossJoin(F.broadcast(n))
    # position p is taken if some t in 0..k-1 has floor(t (n-1) / (k-1)) = p
    step = (F.col("_n") - 1) / F.lit(float(max(1, k - 1)))
    t = F.ceil(F.col("_r") / step - 1e-9)
    hit = (t <= k - 1) & (F.floor(t * step + 1e-9) == F.col("_r"))
    return r.where((F.col("_n") <= k) | hit).drop("_r", "_n")


def hashed_sample(df: DataFrame, by: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows a group in the order of a hash: the same on every run."""
    return top_per_group(df, by, [F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), F.col(key)], k)


def pages(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    return numbered(df, order, "_r").withColumn("page", F.floor(F.col("_r") / F.lit(size)).cast("int")).drop("_r")


def low_runs(bins: DataFrame, by: str, bin_: str, low: Column, least: int = 2) -> DataFrame:
    """Runs of consecutive low bins: by, first, last, length. Runs that touch a
    group's first or last bin don't count."""
    ends = bins.groupBy(by).agg(F.min(bin_).alias("_lo"), F.max(bin_).alias("_hi"))
    w = Window.partitionBy(by).orderBy(bin_)
    run = bins.where(low).withColumn("_g", F.col(bin_) - F.row_number().over(w))
    out = run.groupBy(by, "_g").agg(F.min(bin_).alias("first"), F.max(bin_).alias("last"), F.count(F.lit(1)).alias("length")).join(ends, by)
    return out.where((F.col("length") >= least) & (F.col("first") > F.col("_lo")) & (F.col("last") < F.col("_hi"))).select(by, "first", "last", "length")


def merge_slivers(cuts: DataFrame, by: str, at: str, low: str, high: str, least: float) -> DataFrame:
    """Drops cuts that leave a piece shorter than ``least``: a fold over the
    sorted cuts of each group."""
    sorted_ = F.array_sort(F.collect_list(at))
    g = cuts.groupBy(by).agg(sorted_.alias("_c"), F.first(low).alias("_lo"), F.first(high).alias("_hi"))
    start = F.struct(F.array().cast("array<double>").alias("kept"), F.col("_lo").alias("last"))

    def step(acc: Column, c: Column) -> Column:
        ok = (c - acc["last"] >= least) & (F.col("_hi") - c >= least)
        return F.when(ok, F.struct(F.array_append(acc["kept"], c).alias("kept"), c.alias("last"))).otherwise(acc)

    return g.select(by, F.aggregate("_c", start, step)["kept"].alias("cuts"))


def quantile_cut(points: DataFrame, by: str, axis: str, fraction: float) -> DataFrame:
    """Drops the points of each group whose coordinate exceeds the quantile
    1 - fraction. Exact linear percentiles."""
    cut = points.groupBy(by).agg(F.percentile(axis, F.lit(1.0 - fraction)).alias("_cut"))
    return points.join(cut, by).where(F.col(axis) <= F.col("_cut")).drop("_cut")


def paint(masks: DataFrame, point: str, mask: str, confidence: str, reference_order: bool = False) -> DataFrame:
    """Mask on top of each point. The most confident wins; with
    ``reference_order`` the last painted, which is the least confident."""
    key = F.struct(F.col(confidence) * (-1 if reference_order else 1), F.col(mask))
    return masks.groupBy(point).agg(F.max_by(mask, key).alias(mask))


def greedy_novelty(masks: DataFrame, group: str, mask: str, score: str, member: str, least: float) -> DataFrame:
    """Masks in falling score that bring at least this share of new members."""
    sets = masks.groupBy(group, mask).agg(F.max(score).alias(score), F.collect_set(member).alias("_m"))

    def fold(table):
        import pyarrow as pa

        rows = sorted(zip(*(table.column(c).to_pylist() for c in (score, mask, "_m"))), key=lambda r: (-r[0], r[1]))
        seen, kept = set(), []
        for s, m, members in rows:
            new = set(members) - seen
            if members and len(new) / len(members) >= least:
                kept.append((m, s, len(new)))
                seen |= new
        g = table.column(group)[0].as_py()
        return pa.table({group: pa.array([g] * len(kept), table.schema.field(group).type), mask: pa.array([k[0] for k in kept], table.schema.field(mask).type), score: pa.array([k[1] for k in kept], pa.float64()), "n_new": pa.array([k[2] for k in kept], pa.int64())})

    kinds = dict(sets.dtypes)
    return sets.groupBy(group).applyInArrow(fold, f"{group} {kinds[group]}, {mask} {kinds[mask]}, {score} double, n_new long")


def farthest_points(points: DataFrame, by: str, k: int) -> DataFrame:
    """Farthest point sampling within each group, from its smallest id on."""

    def sample(pdf):
        import numpy as np

        pdf = pdf.sort_values("point_id")
        x = pdf[["x", "y", "z"]].to_numpy(float)
        picked, d = [0], np.full(len(x), np.inf)
        while len(picked) < min(k, len(x)):
            d = np.minimum(d, ((x - x[picked[-1]]) ** 2).sum(1))
            picked.append(int(d.argmax()))
        out = pdf.iloc[picked].copy()
        out["ord"] = range(len(picked))
        return out[[by, "point_id", "x", "y", "z", "ord"]]

    t = points.select(by, "point_id", "x", "y", "z")
    return t.groupBy(by).applyInPandas(sample, f"{by} {dict(t.dtypes)[by]}, point_id long, x double, y double, z double, ord int")
