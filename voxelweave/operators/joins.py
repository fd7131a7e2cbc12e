"""Spatial joins on grids of cells, nearest neighbours and greedy matching.

Catalyst plans an inequality join as a nested loop. Here both sides are cut
into cells first, so that the join has an equality to hash or sort by, and the
inequality stays as a residual condition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import keep


def _cells(df: DataFrame, x: Column, y: Column, reach: Column, size: float | Column, tag: str) -> DataFrame:
    """One row for each cell that the square around (x, y) touches, with the
    square's lowest cell."""
    s = size if isinstance(size, Column) else F.lit(float(size))
    lo = {a: F.floor((v - reach) / s).cast("long") for a, v in (("i", x), ("j", y))}
    hi = {a: F.floor((v + reach) / s).cast("long") for a, v in (("i", x), ("j", y))}
    out = df.withColumn(f"_{tag}i0", lo["i"]).withColumn(f"_{tag}j0", lo["j"])
    out = out.withColumn("_ci", F.explode(F.sequence(lo["i"], hi["i"])))
    return out.withColumn("_cj", F.explode(F.sequence(lo["j"], hi["j"])))


#: So many ids of equal rows stand in one row at most.
TOGETHER = 512


#: And so many where pairs of rows are made of pairs of classes: Spark holds all rows
#: that one pair makes at a time, 4,096 of them and not 262,144.
FEW = 64


def classes(df: DataFrame, shape: Sequence[str], carry: Sequence[str] | str, numbered: bool = False, most: int = TOGETHER) -> DataFrame:
    """Rows that are equal in ``shape`` as one: shape, _ids (their ``carry``
    columns as an array of structs; of a single name the values, without nulls), at
    most ``most`` in a row; ``numbered``: and _part, the row's number within the
    shape. A join of such rows tests a pair of shapes once, however often it
    occurs."""
    single = isinstance(carry, str)
    names = [carry] if single else carry
    w = Window.partitionBy(*shape).orderBy(*names)
    t = df.select(*dict.fromkeys([*shape, *names]), F.floor((F.row_number().over(w) - 1) / most).alias("_part"))
    each = F.col(carry) if single else F.struct(*(F.col(c).alias(f"_{c}") for c in names))
    t = t.groupBy(*shape, "_part").agg(F.collect_list(each).alias("_ids"))
    return t if numbered else t.drop("_part")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Dealt by the columns into a fixed number of parts: few class rows make many
    pairs, so that Spark must not put small parts together."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def grid_join(left: DataFrame, right: DataFrame, reach_left: Column, reach_right: Column, condition: Column, size: float | Column = 1.0, names: tuple[str, str] = ("a", "b"), how: str = "inner", keys: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """Pairs whose squares of half side ``reach`` around (x, y) meet and for
    which ``condition`` on a.* and b.* holds. A pair that shares many cells is
    made once, in the highest of both lowest cells. ``keys``: columns that must
    be equal besides (a map, a scan, a level with its own ``size``). ``dealt``: see
    spread()."""
    a, b = names
    x = _cells(left, F.col("x"), F.col("y"), reach_left, size, "a")
    y = _cells(right, F.col("x"), F.col("y"), reach_right, size, "b")
    if dealt:
        x, y = spread(x, "_ci", "_cj", *keys), spread(y, "_ci", "_cj", *keys)
    x, y = x.alias(a), y.alias(b)
    on = (F.col(f"{a}._ci") == F.col(f"{b}._ci")) & (F.col(f"{a}._cj") == F.col(f"{b}._cj"))
    for k in keys:
        on = on & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    once = (F.col(f"{a}._ci") == F.greatest(F.col("_ai0"), F.col("_bi0"))) & (F.col(f"{a}._cj") == F.greatest(F.col("_aj0"), F.col("_bj0")))
    return x.join(y, on & once & condition, how)


def expanded(pairs: DataFrame, *columns: str) -> DataFrame:
    """The rows behind pairs of classes (_aids, _bids): columns, _a, _b."""
    return pairs.select(*columns, F.explode("_aids").alias("_a"), "_bids").select(*columns, "_a", F.explode("_bids").alias("_b"))


def radius_join(left: DataFrame, right: DataFrame, radius: float, names: tuple[str, str] = ("a", "b"), three_d: bool = True, condition: Column | None = None) -> DataFrame:
    """Pairs within a radius: cells of the radius' size, the right side once in
    its own cell, the left side in it and the cells around."""
    a, b = names
    axes = ("x", "y", "z") if three_d else ("x", "y")
    s = F.lit(float(radius))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    x, y = left, right

    def cells(c: str) -> Column:
        return F.transform(around, lambda d: F.floor(F.col(c) / s).cast("long") + d)

    for c in axes:
        x = x.withColumn(f"_c{c}", F.explode(cells(c)))
        y = y.withColumn(f"_c{c}", F.floor(F.col(c) / s).cast("long"))
    d2 = sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) ** 2 for c in axes[1:]), (F.col(f"{a}.{axes[0]}") - F.col(f"{b}.{axes[0]}")) ** 2)
    on = d2 <= s * s
    for c in axes:
        on = on & (F.col(f"{a}._c{c}") == F.col(f"{b}._c{c}"))
    if condition is not None:
        on = on & condition
    return x.alias(a).join(y.alias(b), on).withColumn("d2", d2)


def radius_counts(left: DataFrame, right: DataFrame, radius: float, into: str = "n") -> DataFrame:
    """Left rows with the number of right rows within a radius, if there are
    any; places are joined, not rows. Neither join broadcasts: by a file's size,
    which is what Spark goes by, a million rows or 27 cells a place look small."""
    axes = ["x", "y", "z"]
    places = right.groupBy(*axes).agg(F.count(F.lit(1)).alias("_n"))
    near = radius_join(left.select(*axes).distinct(), places.hint("merge"), radius)
    per = near.groupBy(*(F.col(f"a.{c}").alias(c) for c in axes)).agg(F.sum("b._n").alias(into))
    return left.join(per.hint("shuffle_hash"), axes)


def _box_distance(lo: Column, hi: Column, v: Column) -> tuple[Column, Column]:
    """Least and greatest distance from v to the interval, per axis."""
    return F.greatest(lo - v, v - hi, F.lit(0.0)), F.greatest(F.abs(v - lo), F.abs(v - hi))


def _descend(left: DataFrame, right: DataFrame, k: int, left_id: str, size: float, axes: tuple[str, ...]) -> DataFrame:
    """left_id and the cells (of ``size``) that can hold its k nearest right
    rows. Cells of halving size are looked at level by level, from the ones
    that cover everything: a cell stays if its near side is no farther than the
    far side of the cells that hold k rows already. A left row keeps a few cells
    a level, however far it lies from the right side's rows."""
    cells = [f"_c{c}" for c in axes]
    fine = keep(right.groupBy(*(F.floor(F.col(c) / F.lit(size)).cast("long").alias(f"_c{c}") for c in axes)).agg(F.count(F.lit(1)).alias("_n")))
    reach = fine.agg(F.max(F.greatest(*(F.abs(F.col(c)) for c in cells)))).head()[0]
    if reach is None:
        return left.select(left_id, *(F.lit(0).cast("long").alias(c) for c in cells)).limit(0)
    top = max(1, int(reach).bit_length())
    # at the top level cells are 0 or -1 along each axis
    pairs = left.select(left_id, *axes)
    for c in cells:
        pairs = pairs.withColumn(c, F.explode(F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"))))
    for level in range(top, -1, -1):
        side = F.lit(float(size) * 2.0**level)
        level_cells = fine.groupBy(*(F.shiftright(c, level).alias(c) for c in cells)).agg(F.sum("_n").alias("_n"))
        near, far = F.lit(0.0), F.lit(0.0)
        for c in axes:
            n, f = _box_distance(F.col(f"_c{c}") * side, (F.col(f"_c{c}") + 1) * side, F.col(c))
            near, far = near + n * n, far + f * f
        met = pairs.join(level_cells, cells).withColumn("_near", near).withColumn("_far", far)
        upto = F.sum("_n").over(Window.partitionBy(left_id).orderBy("_far").rangeBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("_upto", upto)
        bound = F.min(F.when(F.col("_upto") >= k, F.col("_far"))).over(Window.partitionBy(left_id))
        met = met.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound") * 1.000001 + 1e-12))
        pairs = keep(met.select(left_id, *axes, *cells))
        if level:
            for c in cells:
                pairs = pairs.withColumn(c, F.explode(F.array(2 * F.col(c), 2 * F.col(c) + 1)))
    return pairs.select(left_id, *cells)


def knn_join(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, size: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The k nearest right rows of every left row: left_id, right_id, d2, rank;
    ties go to the smaller id; all right rows if there are fewer than k.

    Most rows find k within ``size``, by one radius join; the others descend a
    pyramid of cells of the right side. Either part is written, so that plans
    stay short."""
    w = Window.partitionBy(left_id).orderBy("d2", right_id)
    left, right = left.select(left_id, *axes), right.select(right_id, *axes)
    near = radius_join(left, right, size, three_d=len(axes) > 2).select(F.col(f"a.{left_id}").alias(left_id), F.col(f"b.{right_id}").alias(right_id), "d2")
    ranked = keep(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    done = ranked.where(F.col("rank") == k).select(left_id)
    found = ranked.join(done, left_id, "left_semi")
    todo = keep(left.join(done, left_id, "left_anti"))
    if todo.isEmpty():
        return found
    some = _descend(todo, right, k, left_id, size, axes).join(todo, left_id).alias("a")
    b = right.withColumns({f"_c{c}": F.floor(F.col(c) / F.lit(size)).cast("long") for c in axes}).alias("b")
    on, d2 = F.lit(True), F.lit(0.0)
    for c in axes:
        on, d2 = on & (F.col(f"a._c{c}") == F.col(f"b._c{c}")), d2 + (F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2
    rest = some.join(b, on).select(F.col(f"a.{left_id}").alias(left_id), F.col(f"b.{right_id}").alias(right_id), d2.alias("d2"))
    return found.unionByName(rest.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def knn_by_place(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, size: float) -> DataFrame:
    """knn_join where many rows share a place: left rows of one place have the
    same neighbours, and of the right rows of one place only the k smallest can
    be among them."""
    axes = ["x", "y", "z"]
    places = keep(left.select(*axes).distinct().withColumn("_place", F.monotonically_increasing_id()))
    first = F.row_number().over(Window.partitionBy(*axes).orderBy(right_id))
    some = right.select(right_id, *axes).withColumn("_k", first).where(F.col("_k") <= k).drop("_k")
    near = knn_join(places, keep(some), k, "_place", right_id, size)
    return left.select(left_id, *axes).join(places, axes).join(near, "_place").select(left_id, right_id, "d2", "rank")


def nearest_cell(left: DataFrame, cells: DataFrame, left_id: str, take: str) -> DataFrame:
    """For each left row (i, j) the nearest cell by squared index distance
    (ties: smallest i, then j): left_id, ``take`` of the cell."""
    a = left.select(left_id, F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"))
    # an id in the order of (i, j): indices are 32-bit
    c = cells.select(F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), (F.shiftleft(F.col("i").cast("long"), 32) + F.col("j").cast("long")).alias("_cell"), take)
    near = knn_join(a, c.groupBy("_cell", "x", "y").agg(F.min(take).alias(take)), 1, left_id, "_cell", 4.0, ("x", "y"))
    return near.join(c.groupBy("_cell").agg(F.min(take).alias(take)), "_cell").select(left_id, take)


def greedy_match(pairs: DataFrame, left: str, right: str, order: str, cost: str, group: str) -> DataFrame:
    """One-to-one claims in the order of the left rows: each takes its cheapest
    candidate (ties: ``right``) that no earlier one has. ``pairs`` holds the
    candidates only, which a grid join made; the claim itself is sequential, so
    each ``group`` (a map) is one task of its candidates."""

    def claim(table):
        import pyarrow as pa

        rows = sorted(zip(table.column(order).to_pylist(), table.column(cost).to_pylist(), table.column(right).to_pylist(), table.column(left).to_pylist()))
        taken_left, taken_right, out = set(), set(), []
        for _, c, r, l in rows:
            if l not in taken_left and r not in taken_right:
                taken_left.add(l)
                taken_right.add(r)
                out.append((l, r, c))
        g = table.column(group)[0].as_py()
        return pa.table({group: pa.array([g] * len(out), table.schema.field(group).type), left: pa.array([o[0] for o in out], table.schema.field(left).type), right: pa.array([o[1] for o in out], table.schema.field(right).type), cost: pa.array([o[2] for o in out], table.schema.field(cost).type)})

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (group, left, right, cost))
    return pairs.select(group, left, right, order, cost).groupBy(group).applyInArrow(claim, schema)


def _numbers(column):
    """Codes of the values in their order, and the values."""
    import pyarrow as pa
    import pyarrow.compute as pc

    d = column.combine_chunks().dictionary_encode()
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    at = pc.array_sort_indices(d.dictionary)
    rank = np.empty(len(at), np.int64)
    rank[at.to_numpy()] = np.arange(len(at))
    return rank[d.indices.to_numpy(zero_copy_only=False)] if len(at) else np.empty(0, np.int64), d.dictionary.take(at)


def _claimed(pairs, rows):
    """Claims of one group. pairs: _l, _r (classes), _cost; rows: _class, and of
    left rows _order and _left, of right rows _right. Returns left values, right
    values and costs."""
    import pyarrow.compute as pc

    of_left = pc.is_valid(rows.column("_left"))
    lefts, rights = rows.filter(of_left), rows.filter(pc.invert(of_left))
    by = np.lexsort((pairs.column("_cost").to_numpy(), pairs.column("_l").to_numpy()))
    pl, pr, cost = (pairs.column(c).to_numpy()[by] for c in ("_l", "_r", "_cost"))
    del by
    kinds, start = np.unique(pl, return_index=True)
    head = dict(zip(kinds.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(pl)])))
    # free right rows of every class, the smallest last
    code, names = _numbers(rights.column("_right"))
    klass = rights.column("_class").to_numpy()
    by = np.lexsort((-code, klass))
    kinds, start = np.unique(klass[by], return_index=True)
    free = {k: list(own) for k, own in zip(kinds.tolist(), np.split(code[by], start[1:]))} if len(by) else {}
    taken = bytearray(len(names))

    def least(k: int) -> int:
        """The smallest free right row of a class, or -1."""
        own = free.get(k, ())
        while own and taken[own[-1]]:
            own.pop()
        return own[-1] if own else -1

    who, owners = _numbers(lefts.column("_left"))
    order, _ = _numbers(lefts.column("_order"))
    by = np.lexsort((who, order))
    turns = zip(order[by].tolist(), who[by].tolist(), lefts.column("_class").to_numpy()[by].tolist())
    done, out = bytearray(len(owners)), ([], [], [])
    for (_, w), own in groupby(turns, lambda t: t[:2]):
        best = None
        for _, _, k in own if not done[w] else ():
            at, end = head.get(k, (0, 0))
            while at < end and least(pr[at]) < 0:  # a class that is empty stays so
                at += 1
            head[k] = at, end
            if at < end and (best is None or cost[at] <= best[0]):
                tied = at
                while tied < end and cost[tied] == cost[at]:
                    if (c := least(pr[tied])) >= 0 and (best is None or (cost[at], c) < best):
                        best = (cost[at], c)
                    tied += 1
        if best:
            done[w] = taken[best[1]] = 1
            for o, x in zip(out, (w, best[1], best[0])):
                o.append(x)
    return owners.take(out[0]) if out[0] else owners.slice(0, 0), names.take(out[1]) if out[1] else names.slice(0, 0), out[2]


def greedy_claims(left: DataFrame, right: DataFrame, candidates: Callable[[DataFrame, DataFrame], DataFrame], left_id: str, right_id: str, order: str, cost: str, group: str, left_shape: Sequence[str], right_shape: Sequence[str]) -> DataFrame:
    """greedy_match of the pairs that ``candidates`` gives, which looks only at
    the shape columns: it gets the shapes of both sides once each (with group)
    and returns a.*, b.* and ``cost``. The one task of a group holds pairs of
    shapes and each row once, not the pairs of rows. Of left rows with equal
    ``order`` the smaller one claims first."""

    def numbered_shapes(df: DataFrame, shape: Sequence[str]) -> DataFrame:
        return keep(df.select(group, *shape).distinct().withColumn("_class", F.monotonically_increasing_id()))

    a, b = numbered_shapes(left, left_shape), numbered_shapes(right, right_shape)
    pairs = candidates(a, b).select(F.col(f"a.{group}").alias(group), F.col("a._class").alias("_l"), F.col("b._class").alias("_r"), F.col(cost).cast("double").alias("_cost"))
    kinds = dict(left.dtypes) | {f"_r.{c}": k for c, k in right.dtypes}
    none = lambda kind: F.lit(None).cast(kind)
    mine = left.join(a, [group, *left_shape]).select(group, "_class", F.col(order).alias("_order"), F.col(left_id).alias("_left"), none(kinds[f"_r.{right_id}"]).alias("_right"))
    theirs = right.join(b, [group, *right_shape]).select(group, "_class", none(kinds[order]).alias("_order"), none(kinds[left_id]).alias("_left"), F.col(right_id).alias("_right"))

    def claim(key, some, rows):
        import pyarrow as pa

        schema = pa.schema([(group, rows.schema.field(group).type), (left_id, rows.schema.field("_left").type), (right_id, rows.schema.field("_right").type), (cost, pa.float64())])
        l, r, c = _claimed(some, rows)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(c), schema.field(0).type), l, r, pa.array(c, pa.float64())], schema=schema)

    schema = f"{group} {kinds[group]}, {left_id} {kinds[left_id]}, {right_id} {kinds[f'_r.{right_id}']}, {cost} double"
    return pairs.groupBy(group).cogroup(mine.unionAll(theirs).groupBy(group)).applyInArrow(claim, schema)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def exact_points(left: DataFrame, right: DataFrame, unit: float = 1e-5, names: tuple[str, str] = ("a", "b"), how: str = "inner") -> DataFrame:
    """Equal coordinates, up to a unit, as an equality join."""
    a, b = names
    on = None
    for c in ("x", "y", "z"):
        e = F.floor(F.col(f"{a}.{c}") / F.lit(unit) + 0.5) == F.floor(F.col(f"{b}.{c}") / F.lit(unit) + 0.5)
        on = e if on is None else on & e
    return left.alias(a).join(right.alias(b), on, how)


def require_all_matched(left: DataFrame, right: DataFrame, unit: float = 1e-5) -> DataFrame:
    """exact_points that fails if a left row has no partner."""
    lost = exact_points(left, right, unit, how="left_anti").count()
    if lost:
        raise ValueError(f"{lost} points are not in the scene")
    return exact_points(left, right, unit)


def semi_edges(edges: DataFrame, nodes: DataFrame, subject: str = "subj", target: str = "obj", key: str = "id") -> DataFrame:
    """Edges whose both ends are among the nodes."""
    ids = nodes.select(F.col(key).alias("_id")).distinct()
    first = edges.join(ids, edges[subject] == ids["_id"], "left_semi")
    return first.join(ids, first[target] == ids["_id"], "left_semi")


def outside_boxes(points: DataFrame, boxes: DataFrame, pad: float = 0.0, size: float = 1.0) -> DataFrame:
    """Points in none of the axis-aligned boxes (x0..z1), which are dealt to
    the cells that they touch."""
    s = F.lit(float(size))
    b = boxes.withColumn("_i", F.explode(F.sequence(F.floor((F.col("x0") - pad) / s), F.floor((F.col("x1") + pad) / s))))
    b = b.withColumn("_j", F.explode(F.sequence(F.floor((F.col("y0") - pad) / s), F.floor((F.col("y1") + pad) / s))))
    p = points.withColumn("_i", F.floor(F.col("x") / s)).withColumn("_j", F.floor(F.col("y") / s)).alias("p")
    on = (F.col("p._i") == F.col("b._i")) & (F.col("p._j") == F.col("b._j"))
    for c in "xyz":
        on = on & F.col(f"p.{c}").between(F.col(f"b.{c}0") - pad, F.col(f"b.{c}1") + pad)
    return p.join(b.alias("b"), on, "left_anti").drop("_i", "_j")


def inside_boxes(points: DataFrame, boxes: DataFrame, pad: float = 0.0, size: float = 1.0) -> DataFrame:
    """Pairs p.*, b.* of points and the axis-aligned boxes (x0..z1) that hold
    them, as a join on the cells that the boxes touch."""
    s = F.lit(float(size))
    b = boxes.withColumn("_i", F.explode(F.sequence(F.floor((F.col("x0") - pad) / s), F.floor((F.col("x1") + pad) / s))))
    b = b.withColumn("_j", F.explode(F.sequence(F.floor((F.col("y0") - pad) / s), F.floor((F.col("y1") + pad) / s))))
    p = points.withColumn("_i", F.floor(F.col("x") / s)).withColumn("_j", F.floor(F.col("y") / s)).alias("p")
    on = (F.col("p._i") == F.col("b._i")) & (F.col("p._j") == F.col("b._j"))
    for c in "xyz":
        on = on & F.col(f"p.{c}").between(F.col(f"b.{c}0") - pad, F.col(f"b.{c}1") + pad)
    return p.join(b.alias("b"), on)


def inside_counts(points: DataFrame, boxes: DataFrame, pad: float = 0.0, size: float = 1.0, into: str = "n") -> DataFrame:
    """Boxes with the number of points that they hold, if any; equal boxes and
    equal points meet once."""
    sides = ["x0", "x1", "y0", "y1", "z0", "z1"]
    p = points.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("_n"))
    hit = inside_boxes(p, boxes.select(*sides).distinct(), pad, size)
    return boxes.join(hit.groupBy(*(F.col(f"b.{c}").alias(c) for c in sides)).agg(F.sum("p._n").alias(into)), sides)


def renamed(rows: DataFrame, table: DataFrame, name: str, into: str) -> DataFrame:
    """``into``: the table's word (name, into) for each row's name; without one
    the name itself."""
    t = table.select(F.col(name), F.col(into).alias("_to")).dropDuplicates([name])
    return rows.join(t, name, "left").withColumn(into, F.coalesce("_to", name)).drop("_to")
