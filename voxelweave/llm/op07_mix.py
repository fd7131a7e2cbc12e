"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow that sends its shuffled documents one after the other,
and all of them a second time after that. A document's virtual finish time is
the flow's words up to and including it, divided by the flow's target. Copies
are served in order of finish time (ties: source, hash, doc_id) as long as their
words fit the total budget. DataFrame functions only.

No task holds a source: a source's rows are cut into ranges of their shuffle
hash, ranges are summed first, and running sums start from the range's offset.
The budget's cut is found from two histograms of finish times and the order of
one fine cell; three scalars come to the driver.

Defined results: null text has size 0; a null source is a source of its own, the
last; sources without words have target 0; null doc_ids and repeated rows are
documents like any other (a null doc_id is shuffled by its text; rows that repeat
a doc_id share a hash range); an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import WORD, Scratch

WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, share: float = 1.5, stop: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (flow, source_size) gets ``target``: least(stop x size,
    level x weight), the level being such that targets add up to the budget,
    which is what resharing the excess by weight comes to. Sources are few
    against documents: their windows run over one row a source."""
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(Window.orderBy("flow")) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(stop))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "flow")
    t = t.withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    t = t.withColumn("used", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.max((F.col("budget") - F.col("used")) / F.col("left")).over(Window.partitionBy()))
    return t.withColumn("target", F.least("cap", F.col("level") * F.col("w"))).select("flow", "source_size", "target")


def fair_queue(docs: DataFrame, share: float = 1.5, stop: float = 2.0, weights: tuple[int, ...] = WEIGHTS, rows_a_range: int = 20_000, seed: str = "mix", key: tuple[str, ...] = ()) -> tuple[DataFrame, Scratch]:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target,
    copies (0, 1 or 2: how often the mix takes the document), taken, and the
    columns ``key`` of docs, which tell rows apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "op7")
    # flow orders like the source by code points, null last
    flow = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text")), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")
    t = scratch.keep(docs.select("doc_id", "source", flow.alias("flow"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h"), F.xxhash64("text").alias("tie"), *key))
    n = t.count()
    if n == 0:
        return t.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"), *key), scratch
    ranges = max(64, -(-n // rows_a_range))
    t = t.withColumn("cut", F.floor(F.col("h") / F.lit(float(16**15)) * ranges).cast("long"))
    cells = t.groupBy("flow", "cut").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("flow").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("from", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    goal = targets(cells.groupBy("flow").agg(F.sum("cell_size").alias("source_size")), share, stop, weights)
    cells = cells.join(goal, "flow").drop("cell_size")
    order = ["flow", "h", "doc_id", "size"]
    within = Window.partitionBy("flow", "cut").orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    q = t.join(cells, ["flow", "cut"]).withColumn("end", F.col("from") + F.sum("size").over(within))
    q = q.withColumn("v1", F.try_divide("end", "target")).withColumn("v2", F.try_divide(F.col("end") + F.col("source_size"), F.col("target")))
    q = scratch.keep(q.select("doc_id", "source", "flow", "size", "h", "source_size", "target", "v1", "v2", *key))

    def fine(v):
        return F.floor(F.least(F.coalesce(F.col(v), F.lit(0.0)), F.lit(float(2**30))) * F.lit(float(2**30))).cast("long")

    both = q.select(*order, F.col("v1").alias("v"), fine("v1").alias("fine")).unionAll(q.select(*order, F.col("v2").alias("v"), fine("v2").alias("fine")))
    both = both.withColumn("coarse", F.least(F.shiftright("fine", 20), F.lit(65536)))
    budget = float(q.agg(F.sum("size")).head()[0]) * share

    def cut_at(cells: DataFrame, cell: str, used: float):
        """The first cell in which the budget ends, and the words before it."""
        run = Window.orderBy(cell)
        c = cells.groupBy(cell).agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(run) + F.lit(used))
        row = c.where(F.col("upto") > budget).orderBy(cell).select(cell, (F.col("upto") - F.col("words")).alias("before")).head()
        return (None, 0.0) if row is None else (row[0], float(row[1]))

    coarse, used = cut_at(both, "coarse", 0.0)
    if coarse is None:
        in1 = in2 = F.lit(1)
    else:
        cell, used = cut_at(both.where(F.col("coarse") == coarse), "fine", used)
        run = Window.orderBy("v", *order).rowsBetween(Window.unboundedPreceding, 0)
        last = both.where((F.col("coarse") == coarse) & (F.col("fine") == cell)).withColumn("upto", F.sum("size").over(run) + F.lit(used)).where(F.col("upto") <= budget).orderBy(F.col("upto").desc(), *(F.col(c).desc() for c in ("v", *order))).head()

        def taken(v):
            same = F.lit(False)
            if last is not None:
                same = F.struct(F.col(v).alias("v"), *order) <= F.struct(F.lit(last["v"]).alias("v"), *(F.lit(last[c]).cast(q.schema[c].dataType).alias(c) for c in order))
            return F.when((fine(v) < cell) | ((fine(v) == cell) & same), F.lit(1)).otherwise(F.lit(0))

        in1, in2 = taken("v1"), taken("v2")
    out = q.withColumn("copies", in1 + in2).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "copies", "taken", *key), scratch


def op7_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = fair_queue(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with d as (
  select doc_id, case when source is null then '1' else '0' || source end as flow,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'text ' || text, '')), 1, 15))::bigint as h
  from documents),
s as (select flow, sum(size)::bigint as source_size from d group by flow),
w as (select *, [5e0, 2e0, 1e0][((row_number() over (order by flow) - 1) % 3 + 1)::int] as w, source_size * 2e0 as cap from s),
l as (select *, sum(source_size) over () * 1.5e0 as budget,
    coalesce(sum(cap) over (order by cap / w, flow rows between unbounded preceding and 1 preceding), 0e0) as used,
    sum(w) over (order by cap / w, flow rows between current row and unbounded following) as rest from w),
t as (select flow, source_size, budget, least(cap, max((budget - used) / rest) over () * w) as target from l),
q as (select d.*, source_size, target, budget,
    sum(size) over (partition by flow order by h, doc_id, size rows unbounded preceding)::bigint as upto from d join t using (flow)),
c as (select *, upto / nullif(target, 0) as v from q union all select *, (upto + source_size) / nullif(target, 0) as v from q),
r as (select doc_id, flow, size, source_size, target, case when sum(size) over (order by v, flow, h, doc_id, size rows unbounded preceding) <= budget then size else 0 end as t from c)
select doc_id, size, source_size, coalesce(target, 0e0) as target, sum(t)::bigint as taken from r group by doc_id, flow, size, source_size, target
"""
