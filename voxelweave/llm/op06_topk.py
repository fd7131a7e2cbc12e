"""Exact top-k inner products by aggregation without random access.

Vectors of integers are kept in blocks; in each block every dimension has a
sorted list of (value, vector). A query reads all lists in step from the end that
gives the largest products, some entries of each list at a time, and adds
what it reads to the partial sums of the vectors that it meets. A vector's
partial sum plus the least product of each list that has not shown it yet bounds
its score from below; with the product read last instead, from above. Reading
stops when so few vectors can still reach the k-th best lower bound that looking
their entries up costs less than reading on: the outsiders cannot qualify, and the
scores of the rest are resolved. Blocks' results merge by (score, vec_id); a
query's k-th best score of earlier blocks is a lower bound for later ones.

Queries meet blocks of candidates, never rows one by one. They are packed and
measured, and broadcast to all tasks in groups of at most ``BROADCAST_BYTES``,
one group after the other; each group reads the candidates once.

Defined results: vectors null, empty, or holding null or non-finite components
take no part, nor do null vec_ids; a query is compared with vectors of its own
length; rows that share a query's vec_id count as its own and are left out, and
each such row is a query; ties go to the smaller vec_id; fewer than k other
rows: all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, arrow_map

QUERIES_A_BLOCK = 256
ROWS_A_BLOCK = 8192
#: Queries that are broadcast at a time, in bytes.
BROADCAST_BYTES = 32 << 20
#: So many vectors are left at most when reading stops; twice as many entries of
#: each list are read between two looks at the bounds.
STEP = 512


class Block:
    """Integer vectors (rows x dims) with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, step: int = STEP):
        n = len(ids)
        self.ids, self.x, self.step = ids, x, min(step, max(1, n // 16))
        columns = x.T.astype(float)
        # lists fall: ``order`` has the vectors, ``sorted`` their entries
        self.order = np.argsort(-columns, axis=1, kind="stable")
        self.sorted = np.take_along_axis(columns, self.order, axis=1)
        # where in its list a vector's entry stands: it is seen when reading has come so far
        self.place = np.empty(x.shape, np.int32 if n > 32_000 else np.int16)
        np.put_along_axis(self.place.T, self.order, np.arange(n, dtype=self.place.dtype)[None, :], axis=1)
        #: Rounds of reading, entries read and scores resolved so far.
        self.rounds = self.read = self.resolved = 0

    def top(self, own: int, q: np.ndarray, k: int, bar: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, vec_id) of this block for the query, of those
        that score ``bar`` or more."""
        n = len(self.ids)
        outside = self.ids != own
        m = min(k, int(outside.sum()))
        if m == 0:
            return []
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        dims = np.concatenate([up, down])
        weight = q[dims].astype(float)[:, None]
        # the least product of each list: no entry that is not seen yet is below
        end = np.concatenate([self.sorted[up, -1], self.sorted[down, 0]]) * weight[:, 0]
        partial = np.zeros(n)
        # more than what rounding of float32 sums can add up to
        slack = 1e-5 * float((np.abs(self.sorted[dims][:, [0, -1]]) * np.abs(weight)).max(1).sum())
        left, upto = np.flatnonzero(outside), 0
        place = np.concatenate([self.place[:, up], n - 1 - self.place[:, down]], axis=1)[left]
        while len(left) > self.step and upto < n:
            to = min(upto + 2 * self.step, n)
            rows = np.concatenate([self.order[up, upto:to], self.order[down, n - to : n - upto][:, ::-1]])
            products = np.concatenate([self.sorted[up, upto:to], self.sorted[down, n - to : n - upto][:, ::-1]]) * weight
            partial += np.bincount(rows.ravel(), weights=products.ravel(), minlength=n)
            front, upto = products[:, -1], to
            self.rounds += 1
            self.read += rows.size
            # what the lists that have not shown a vector yet add at most and at least
            unseen = (place >= upto).astype(np.float32) @ np.stack([front, end], axis=1).astype(np.float32)
            lower = partial[left] + unseen[:, 1]
            if len(left) >= m:
                bar = max(bar, float(np.partition(lower, len(left) - m)[len(left) - m]) - slack)
            stay = partial[left] + unseen[:, 0] >= bar - slack
            left, place = left[stay], place[stay]
        self.resolved += len(left)
        score = self.x[left] @ q
        best = np.lexsort((self.ids[left], -score))[:k]
        return [(int(score[i]), int(self.ids[left[i]])) for i in best]


class _Blocks:
    """Gathers rows into blocks, one kind of block for each length of vectors."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def add(self, batch):
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids, rows = self.held.setdefault(len(v), ([], []))
            ids.append(i)
            rows.append(v)
            if len(ids) == self.most:
                yield self.out(len(v))

    def out(self, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
        ids, rows = self.held.pop(dims)
        return dims, np.array(ids, "<i8"), np.array(rows, "<i8")


def _pack(batches):
    """Rows -> blocks of queries: their length, ids and values as bytes."""
    import pyarrow as pa

    blocks = _Blocks(QUERIES_A_BLOCK)

    def row(dims, ids, x):
        return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["dims", "ids", "x"])

    for batch in batches:
        for block in blocks.add(batch):
            yield row(*block)
    for d in list(blocks.held):
        yield row(*blocks.out(d))


def _meet(queries, k: int):
    """Candidate rows -> for each query the best of each block."""

    def run(batches):
        import pyarrow as pa

        names = ["q_block", "q_row", "query_id", "vec_id", "score"]
        blocks, known = _Blocks(ROWS_A_BLOCK), {}

        def met(dims, ids, x):
            block = Block(ids, x)
            for q_block, q_ids, q_x in queries.value.get(dims, []):
                rows = []
                for n, (own, q) in enumerate(zip(np.frombuffer(q_ids, "<i8").tolist(), np.frombuffer(q_x, "<i8").reshape(-1, dims))):
                    best = known.get((q_block, n), [])
                    found = block.top(own, q, k, best[-1] if len(best) == k else -np.inf)
                    known[q_block, n] = sorted([*best, *(s for s, _ in found)], reverse=True)[:k]
                    rows += [(q_block, n, own, v, s) for s, v in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names)

        for batch in batches:
            for block in blocks.add(batch):
                yield from met(*block)
        for d in list(blocks.held):
            yield from met(*blocks.out(d))

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score for rows
    where ``is_query`` holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "op6")
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    fit = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long"), whole.alias("v"))
    mine = rows.where(is_query).transform(arrow_map, _pack, "dims int, ids binary, x binary")
    mine = scratch.keep(mine.withColumn("q_block", F.monotonically_increasing_id()))
    size = mine.agg(F.sum(F.length("x") + F.length("ids"))).head()[0] or 0
    groups = max(1, -(-int(size) // BROADCAST_BYTES))
    # few and large files would leave cores idle; many are read as they lie
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    found = None
    for g in range(groups):
        some: dict[int, list] = {}
        for r in mine.where(F.pmod(F.xxhash64("q_block"), F.lit(groups)) == g).collect():
            some.setdefault(r["dims"], []).append((r["q_block"], bytes(r["ids"]), bytes(r["x"])))
        known = spark.sparkContext.broadcast(some)
        part = rows.transform(arrow_map, _meet(known, k), "q_block long, q_row int, query_id long, vec_id long, score long")
        if groups > 1:  # one group's queries at a time
            part = scratch.keep(part)
            known.destroy()
        found = part if found is None else found.unionAll(part)
    best = Window.partitionBy("q_block", "q_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
