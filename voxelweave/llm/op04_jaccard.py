"""Exact Jaccard join of word shingles with adaptive multi-match prefixes.

Tokens are 64-bit hashes of shingles, ordered from rare to frequent by a table
of counts over all documents. Two sets with Jaccard similarity >= t share at
least T = ceil(t x size) tokens, so their prefixes of length size - T + m share
at least m. Each document picks its own m: a longer prefix costs more postings,
but fewer candidates reach verification; the cheapest m by the counts of its
prefix tokens wins. Two documents with m1 and m2 are a candidate if they share
min(m1, m2) tokens of that prefix length.

Groups of copies are not expanded into pairs. Equal sets are one node. In each
posting list all nodes point at the list's smallest node (a star, linear in the
list); pairs that do so in two lists or more are verified, links form
components, and only nodes of one list that are still in different components
meet each other, with the multi-match count, length and position filters
applied. Large families of near copies whose members mostly do not link are
described by their difference to the family's hub, from which the overlap of
any two members follows exactly; members that are not in the hub's component yet
meet all others in blocks, and a block returns a spanning forest of its links. Every pair that could join two components is so
examined, and components equal those of the complete join.

Frequent tokens' lists are salted in both rounds. Long texts are hashed
whole. Sketch and prefix lengths are bounded by parameters; postings, links and
components stay distributed.

Defined results: texts without words have size 0, no links and themselves as
component; a null doc_id takes no part and has component null; rows that repeat
a doc_id are one document that has the links of all of them; fewer words than a
shingle: the whole sequence is one token.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import wordhash
from .common import arrow_map, Scratch

SKETCH_BITS = 20
MOST_MATCHES = 4
#: Cost of verifying a candidate, in postings.
VERIFY_COST = 8.0
#: A posting list expected to be longer is salted in the star round.
SALT_FROM = 2000
#: Star lists that must agree before a pair is verified in the star round.
STAR_LEAST = 2
#: From so many members on, a hub's star is a family; members have at least
#: FAMILY_LEAST percent similarity to the hub, and meet in blocks of about
#: FAMILY_BLOCK.
FAMILY, FAMILY_LEAST, FAMILY_BLOCK = 64, 20, 512
#: Sides whose measured size is below are broadcast.
BROADCAST_BYTES = 24 << 20
_CHUNK = 1 << 18


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles."""
    data = (text or "").encode("utf-8", "replace")
    parts, at = [], 0
    while at < len(data):
        cut = len(data)
        if cut - at > _CHUNK:
            cut = max(data.rfind(c, at, at + _CHUNK) for c in (b" ", b"\n", b"\t"))
            if cut <= at:
                later = [x for c in (b" ", b"\n", b"\t") if (x := data.find(c, at + _CHUNK)) >= 0]
                cut = min(later, default=len(data))
        buf = wordhash.lower_ascii(np.frombuffer(data[at:cut], np.uint8))
        parts.append(wordhash.hashes(buf, *wordhash.spans(buf)))
        at = cut
    return of_words(np.concatenate(parts) if parts else np.zeros(0, np.uint64), k)


def of_words(w: np.ndarray, k: int) -> np.ndarray:
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i]
        h ^= h >> np.uint64(29)
    return np.unique(wordhash.mix(h))


def many(texts: list[str | None], k: int):
    """Shingle sets of many texts; short ones are hashed together."""
    i = 0
    while i < len(texts):
        j, size, data = i, 0, []
        while j < len(texts) and (not data or size + len(texts[j] or "") < _CHUNK // 2):
            data.append((texts[j] or "").encode("utf-8", "replace"))
            size += len(data[-1])
            j += 1
        if size > _CHUNK:
            yield from (shingles(t, k) for t in texts[i:j])
        else:
            buf = wordhash.lower_ascii(np.frombuffer(b"".join(x for d in data for x in (d, b"\n")), np.uint8))
            a, b = wordhash.spans(buf)
            h = wordhash.hashes(buf, a, b)
            ends = np.searchsorted(a, np.cumsum([len(d) + 1 for d in data]))
            for x, y in zip([0, *ends[:-1].tolist()], ends.tolist()):
                yield of_words(h[x:y], k)
        i = j


def sketch(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many documents have a token of each hash cell: counts over all
    documents, 2**bits cells."""
    slices = 64

    size = (1 << bits) // slices

    def run(batches):
        import zlib

        import pyarrow as pa

        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            # each shingle of a document counts once
            found = np.concatenate([np.zeros(0, np.uint64), *many(batch.column(0).to_pylist(), k)])
            total += np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        blobs = [zlib.compress(p.tobytes(), 1) for p in np.split(total.astype(np.int32), slices)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "blob"])

    def add(table):
        import zlib

        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for blob in table.column("blob").to_pylist():
            total += np.frombuffer(zlib.decompress(blob), np.int32)
        out = zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "blob": pa.array([out], pa.binary())})

    import zlib

    kind = "slice int, blob binary"
    # in two steps, so that no task gathers the blobs of all tasks
    parts = docs.select("text").transform(arrow_map, run, kind).withColumn("_some", F.pmod(F.spark_partition_id(), F.lit(128)))
    parts = parts.groupBy("slice", "_some").applyInArrow(add, kind).groupBy("slice").applyInArrow(add, kind)
    out = np.zeros(1 << bits, np.int32)
    for s, blob in parts.collect():
        out[s * size : (s + 1) * size] = np.frombuffer(zlib.decompress(bytes(blob)), np.int32)
    return out


def prefix(tokens: np.ndarray, counts: np.ndarray, background: int, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The chosen prefix (rare first), the counts of its tokens and m."""
    n = len(tokens)
    need = -(-percent * n // 100)
    c = counts[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    # one key: the count, then the bits that the cell leaves free; equal keys stay in token order
    low = tokens & np.uint64((1 << (64 - SKETCH_BITS)) - 1)
    order = np.argsort((np.minimum(c, (1 << SKETCH_BITS) - 1).astype(np.uint64) << np.uint64(64 - SKETCH_BITS)) | low, kind="stable")
    most = min(MOST_MATCHES, need)
    longest = order[: n - need + most]
    f = np.maximum(c[longest].astype(float) - background, 1.0)
    upto = np.cumsum(f)
    best, m = None, 1
    for level in range(1, most + 1):
        length = n - need + level
        cost = upto[length - 1] * (1 + VERIFY_COST / level)
        if best is None or cost < best:
            best, m = cost, level
    chosen = longest[: n - need + m]
    return tokens[chosen], np.maximum(c[chosen] - background, 1), m


def _sets(known, k: int, percent: int):
    """doc_id, text -> doc_id, n, fingerprint, m, prefix, salts."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        counts, background = known.value
        names = ["doc_id", "n", "fa", "fb", "m", "tokens", "salts"]
        for batch in batches:
            rows = []
            for d, s in zip(batch.column(0).to_pylist(), many(batch.column(1).to_pylist(), k)):
                if len(s):
                    raw = s.tobytes()
                    f = xxhash.xxh3_128_intdigest(raw)
                    t, c, m = prefix(s, counts, background, percent)
                    salts = np.minimum(np.maximum(1, c // SALT_FROM), 1024)
                    rows.append((d, len(s), (f >> 64) - 2**63, (f & (2**64 - 1)) - 2**63, m, t.view(np.int64), salts.astype(np.int32)))
                else:
                    rows.append((d, 0, 0, 0, 0, [], []))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], names)

    return run


def _verify(k: int, percent: int):
    """a, b, family, texts -> whether they link; for families also what a lacks
    of b and has besides."""

    def run(batches):
        import pyarrow as pa

        last, kept = None, None
        names = ["a", "b", "linked", "na", "nb", "lacks", "extra"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            a, b, family, ta, tb = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for x, y, f, s, t in zip(a, b, family, many(ta, k), tb):
                if last != t:
                    last, kept = t, shingles(t, k)
                both = len(np.intersect1d(s, kept, assume_unique=True))
                union = len(s) + len(kept) - both
                near = f and 100 * both >= FAMILY_LEAST * union
                lacks = np.setdiff1d(kept, s, assume_unique=True).view(np.int64) if near else None
                extra = np.setdiff1d(s, kept, assume_unique=True).view(np.int64) if near else None
                linked = bool(both) and 100 * both >= percent * union
                if linked or near:
                    out.append((x, y, linked, len(s), len(kept), lacks, extra))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return run


def _common(lists: list[list[int]]) -> np.ndarray:
    """How many tokens each two lists share; tokens of one list only are left
    out, the others are counted by matrix products."""
    n = len(lists)
    total = np.zeros((n, n), np.float32)
    rows = np.repeat(np.arange(n), [len(x) for x in lists])
    if not len(rows):
        return total
    _, at, times = np.unique(np.concatenate([np.asarray(x, np.int64) for x in lists]), return_inverse=True, return_counts=True)
    shared = times > 1
    column = (np.cumsum(shared) - 1)[at]
    keep = shared[at]
    rows, column = rows[keep], column[keep]
    for c in range(0, int(shared.sum()), 2048):
        m = (column >= c) & (column < c + 2048)
        x = np.zeros((n, 2048), np.float32)
        x[rows[m], column[m] - c] = 1
        total += x @ x.T
    return total


def _block(percent: int):
    """Members of one or two blocks of a family -> a spanning forest of the
    links between different components. ``side``: one block is of members that
    the hub's component has already."""

    def run(table):
        import pyarrow as pa

        node, comp, block = (table.column(c).to_numpy() for c in ("node", "comp", "block"))
        n, hub = table.column("n").to_numpy(), int(table.column("hub_n")[0].as_py())
        lacks, extra = table.column("lacks").to_pylist(), table.column("extra").to_pylist()
        less = np.array([len(x) for x in lacks])
        both = hub - less[:, None] - less[None, :] + _common(lacks) + _common(extra)
        ok = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0) & (comp[:, None] != comp[None, :])
        if table.column("side")[0].as_py():
            rest = table.column("rest").to_numpy(zero_copy_only=False)
            ok &= rest[:, None] != rest[None, :]
        elif table.column("lo")[0].as_py() != table.column("hi")[0].as_py():
            ok &= block[:, None] != block[None, :]
        parent: dict[int, int] = {}

        def find(c):
            while parent.setdefault(c, c) != c:
                c = parent[c]
            return c

        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(ok, 1)))):
            p, q = find(int(comp[i])), find(int(comp[j]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def family_links(scratch: Scratch, members: DataFrame, percent: int) -> DataFrame:
    """members (node, comp, pivot, hub_comp, n, hub_n, lacks, extra) -> links (a,
    b). Members that are in the hub's component already meet only those that are
    not, so a family whose members all link to its hub costs nothing."""
    m = members.withColumn("rest", F.col("comp") != F.col("hub_comp"))

    def blocks(flag):
        return F.ceil(F.count_if(flag) / FAMILY_BLOCK).cast("int")

    sizes = m.groupBy("pivot").agg(blocks(F.col("rest")).alias("open"), blocks(~F.col("rest")).alias("done")).where("open > 0")
    m = m.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("open")).otherwise(F.col("done"))).cast("int"))

    def upto(n):
        return F.filter(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), lambda i: i < F.col(n))

    def meeting(side, lo, hi):
        return F.struct(F.lit(side).alias("side"), lo.alias("lo"), hi.alias("hi"))

    own = F.col("block")
    met = F.when(F.col("rest"), F.concat(F.transform(upto("open"), lambda o: meeting(False, F.least(own, o), F.greatest(own, o))), F.transform(upto("done"), lambda o: meeting(True, own, o)))).otherwise(F.transform(upto("open"), lambda o: meeting(True, o, own)))
    m = m.withColumn("_met", F.explode(met)).select("*", "_met.*").drop("_met")
    return m.groupBy("pivot", "side", "lo", "hi").applyInArrow(_block(percent), "a long, b long")


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast if its rows, which are counted, take few bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def verify(scratch: Scratch, pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (a, b, family) of ids -> a, b, linked, na, nb, lacks, extra of those
    that link or belong to a family."""
    pairs = scratch.keep(pairs)
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    left = texts.join(broadcast_if_small(pairs, 24), texts["doc_id"] == pairs["a"]).select("a", "b", "family", F.col("text").alias("ta"))
    ends = scratch.keep(pairs.select("b").distinct())
    right = texts.join(broadcast_if_small(ends, 16), texts["doc_id"] == ends["b"]).select("b", F.col("text").alias("tb"))
    both = left.join(right, "b").select("a", "b", "family", "ta", "tb")
    return scratch.keep(both.transform(arrow_map, _verify(k, percent), "a long, b long, linked boolean, na long, nb long, lacks array<long>, extra array<long>"))


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """links (a, b) -> node, comp: the smallest node that links reach.

    Alternating large-star and small-star steps: each halves paths, so the
    number of rounds grows with the logarithm of the longest path. Each round
    is written, so lineage stays short."""
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(low, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = low.where("m <> u").select("u", F.col("m").alias("v"))
        return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())

    now = state(edges)
    while now[0]:
        following = scratch.keep(star(star(edges, True), False))
        then = state(following)
        scratch.drop(edges)
        edges = following
        if then == now:
            break
        now = then
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def similar(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id for each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "op4")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    counts = sketch(docs, k)
    known = spark.sparkContext.broadcast((counts, int(np.median(counts))))  # 2**SKETCH_BITS counts
    sets = scratch.keep(docs.transform(arrow_map, _sets(known, k, percent), "doc_id long, n long, fa long, fb long, m int, tokens array<long>, salts array<int>"))
    slim = sets.select("doc_id", "n", "fa", "fb")
    some = sets.where("n > 0 and doc_id is not null")
    nodes = some.groupBy("fa", "fb").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("m").alias("m"), F.first(F.struct("tokens", "salts")).alias("p"))
    size = F.col("n").cast("int")
    posts = nodes.select("node", size.alias("n"), "m", F.posexplode(F.arrays_zip("p.tokens", "p.salts")).alias("pos", "t"))
    # the least m whose prefix holds the token
    need = F.ceil(F.col("n") * percent / 100)
    posts = posts.select(F.col("t.tokens").alias("token"), "node", "n", "pos", "m", F.greatest(F.lit(1), F.col("pos") - F.col("n") + need + 1).cast("int").alias("level"), F.pmod(F.xxhash64("node"), F.col("t.salts")).cast("int").alias("salt"), (F.col("t.salts") > 1).alias("hot"))
    mine = Window.partitionBy("token", "salt")
    posts = posts.withColumn("hub", F.min("node").over(mine)).withColumn("many", F.count(F.lit(1)).over(mine)).where("many > 1 or hot").drop("salt", "many", "hot")
    posts = scratch.keep(posts)
    stars = posts.where("node <> hub").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= STAR_LEAST)
    stars = scratch.keep(stars)
    # each node's hub, and hubs of many
    pivots = stars.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    large = pivots.groupBy("b").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= FAMILY).select("b")
    # a doc_id that repeats has several texts and stays out of families
    f = F.struct("fa", "fb")
    several = scratch.keep(slim.where("n > 0").groupBy("doc_id").agg(F.min(f).alias("x"), F.max(f).alias("y")).where("x <> y").select(F.col("doc_id").alias("d")))
    chosen = pivots.join(large, "b", "left_semi").join(several, F.col("a") == F.col("d"), "left_anti").join(several, F.col("b") == F.col("d"), "left_anti").select("a", "b", F.lit(True).alias("family"))
    stars = scratch.keep(stars.join(chosen, ["a", "b"], "left").select("a", "b", F.coalesce("family", F.lit(False)).alias("family")))
    first = verify(scratch, stars, docs, k, percent)
    links = first.where("linked").select("a", "b").distinct()
    found = scratch.keep(components(scratch, links))
    comp = F.coalesce(F.col("comp"), F.col("node")).alias("comp")
    members = first.where("lacks is not null").select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.col("na").alias("n"), F.col("nb").alias("hub_n"), "lacks", "extra").dropDuplicates(["node"])
    hubs = found.select(F.col("node").alias("pivot"), F.col("comp").alias("hub_comp"))
    members = members.join(found, "node", "left").join(hubs, "pivot", "left")
    members = scratch.keep(members.select("node", comp, "pivot", F.coalesce("hub_comp", "pivot").alias("hub_comp"), "n", "hub_n", "lacks", "extra"))
    within = scratch.keep(family_links(scratch, members, percent))
    # lists that still hold several components
    posts = posts.join(found, "node", "left").join(members.select("node", "pivot"), "node", "left").select("token", "node", "n", "pos", "m", "level", comp, "pivot")
    # long lists are cut by salts: the one side's rows go to one salt, the other's to all
    salts = F.least(F.ceil(F.count(F.lit(1)) / SALT_FROM), F.lit(1024)).cast("int").alias("salts")
    open_ = posts.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), salts).where("lo <> hi").select("token", "salts")
    posts = scratch.keep(posts.join(open_, "token"))
    x = posts.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).alias("x")
    y = posts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.comp") != F.col("y.comp")) & ~F.coalesce(F.col("x.pivot") == F.col("y.pivot"), F.lit(False))
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    length = F.col("x.n") * 100 >= F.col("y.n") * percent
    level = F.greatest("x.level", "y.level") <= F.least("x.m", "y.m")
    overlap = F.least("x.pos", "y.pos") + 1 + F.least(F.col("x.n") - F.col("x.pos") - 1, F.col("y.n") - F.col("y.pos") - 1)
    position = overlap * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    meet = x.join(y, apart & order & length & level & position)
    cand = meet.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("x.m", "y.m")).alias("m")).where("shared >= m").select("a", "b")
    tested = stars.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    cand = cand.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(tested, ["lo", "hi"], "left_anti").select("a", "b", F.lit(False).alias("family"))
    second = verify(scratch, cand, docs, k, percent).where("linked").select("a", "b").unionAll(within)
    ids = nodes.select("fa", "fb", "node")
    rows = scratch.keep(slim.join(ids, ["fa", "fb"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")))
    # rows that repeat a doc_id tie their sets together
    again = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id")
    ties = rows.join(again, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    final = components(scratch, found.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionAll(second).unionAll(ties))
    out = rows.join(final, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("component_id"))


def op4_adaptive_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4, percent=85)
