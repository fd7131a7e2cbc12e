"""Best-fit packing of token sequences by a configuration linear program.

A configuration says how many pieces of each length class share one sequence.
The covering program over the histogram (as few sequences as cover all pieces)
is solved by multiplicative weights: each round prices the classes by how badly
they are covered so far, finds the best configuration by a knapsack dynamic
program, and adds some of it. Its amounts are rounded down and made of actual
lengths, gaps are filled with the longest piece that fits, and what remains is
packed best-fit decreasing. Where best-fit decreasing alone needs fewer sequences
than the rounded program, its plan is taken. The program sees at most 2048
counts, so the plan's size does not depend on the data; pieces are numbered
within their length and look up their place in it.

Defined results: null and empty texts are one piece with id 0 alone; null and
repeated doc_ids are packed like others; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map, gapless, Scratch
from .tokens import chunks, vocabulary

LIMIT = 2048
#: Classes of the linear program: up to so many lengths are classes of their own,
#: more are grouped, neighbours together, each group as long as its longest.
CLASSES = 96
#: With more lengths than that, those under this share of the limit only fill gaps.
SMALL = 1 / 8
#: Rounds of the multiplicative weights at most, and rounds between two knapsacks.
ROUNDS, PRICE_EVERY = 40_000, 64
#: Shares of the rounded program that are taken before it is solved anew (and
#: but for the last time nothing of what it uses little, which is its error).
STAGES = (0.9, 0.9, 1.0)
#: Plans of more rows (48 bytes each) are joined, not broadcast.
PLAN_ROWS = 200_000


def knapsack(value: np.ndarray, size: np.ndarray, cap: int) -> tuple[list[int], float]:
    """Items (repeats allowed) of the greatest total value whose sizes fit cap:
    a pass over all capacities for 1, 2, 4, ... of each item."""
    best, passes = np.zeros(cap + 1), []
    for k in np.flatnonzero(value > 0).tolist():
        s, v, times = int(size[k]), float(value[k]), 1
        while times * s <= cap:
            w = times * s
            other = best[:-w] + times * v
            better = other > best[w:]
            passes.append((k, times, w, better))
            best[w:] = np.where(better, other, best[w:])
            times *= 2
    c, out = cap, []
    for k, times, w, better in reversed(passes):
        if c >= w and better[c - w]:
            out += [k] * times
            c -= w
    return sorted(out), float(best[cap])


def configurations(demand: np.ndarray, size: np.ndarray, cap: int, rate: float | None = None) -> tuple[dict[tuple[int, ...], float], float]:
    """Multiplicative weights for: least sum of x, so that for every class the
    pieces in x's configurations are at least demand (above 0 for all). The more
    of a class is covered, the less it weighs. Each round adds some of the
    configuration that covers most weight: the knapsack's, which is asked in the
    first rounds and then every PRICE_EVERY, or the best of those met so far.
    Returns x, scaled to cover all, less what is covered twice, and a lower
    bound of the program's value. Programs of few classes take finer steps."""
    n = len(demand)
    rate = rate or (0.02 if n <= 16 else 0.05 if n <= 32 else 0.12)
    met: dict[tuple[int, ...], int] = {}
    columns, x = np.zeros((0, n)), np.zeros(0)
    covered, bound, goal = np.zeros(n), 0.0, math.log(max(n, 2)) / rate
    for t in range(ROUNDS):
        weight = np.exp(covered.min() - covered)
        price = weight / demand
        if t < n or t % PRICE_EVERY == 0:
            config, most = knapsack(price, size, cap)
            bound = max(bound, float(weight.sum()) / most)  # weak duality
            if tuple(config) not in met:
                met[tuple(config)] = len(met)
                columns = np.vstack([columns, np.bincount(config, minlength=n)])
                x = np.append(x, 0.0)
        nth = int((columns @ price).argmax())
        share = columns[nth] / demand
        step = rate / float(share.max())
        covered += step * share
        x[nth] += step
        if covered.min() >= goal:
            break
    for k in np.flatnonzero(covered == 0).tolist():  # classes that no round has met
        met[(k,) * (cap // int(size[k]))] = len(x)
        x = np.append(x, covered.max())
        covered[k] = covered.max() * (cap // int(size[k])) / demand[k]
    x /= covered.min()
    # amounts that only cover what others cover too go, of the emptiest first
    fill = {c: int(size[list(c)].sum()) for c in met}
    slack = np.zeros(n) - demand
    counts = {c: np.bincount(c, minlength=n) for c in met}
    for c, i in met.items():
        slack += counts[c] * x[i]
    for c, i in sorted(met.items(), key=lambda ci: (fill[ci[0]], ci[0])):
        kinds = counts[c] > 0
        spare = min(x[i], max(0.0, float((slack[kinds] / counts[c][kinds]).min())))
        x[i] -= spare
        slack -= counts[c] * spare
    return {c: float(x[i]) for c, i in met.items() if x[i] > 0}, bound


def classes(rest: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """(above, upto) of the classes of lengths: neighbours of about equal number
    of pieces are grouped if there are more lengths than CLASSES."""
    live = np.flatnonzero(rest[: limit + 1])
    if len(live) <= CLASSES:
        return [(int(s) - 1, int(s)) for s in live]
    live = live[live >= SMALL * limit]
    if not len(live):
        return []
    upto = np.cumsum(rest[live][::-1])  # from the longest on
    group = np.minimum((upto - 1) * CLASSES // upto[-1], CLASSES - 1)
    out = []
    for g in np.unique(group):
        members = live[::-1][group == g]
        out.append((int(members[-1]) - 1, int(members[0])))
    return out


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of sequences, [(length, times), ...])]: packs every piece. The
    program's rounded plan, unless plain best-fit decreasing has fewer."""
    rounded, plain = _round(histogram, limit, True), _round(histogram, limit, False)
    return min(rounded, plain, key=lambda p: sum(m for m, _ in p))


def _round(histogram: dict[int, int], limit: int, program: bool) -> list[tuple[int, list[tuple[int, int]]]]:
    rest = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        rest[length] += n
    # begun sequences by the room they have left: (how many alike, {length: times})
    begun: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(limit + 1)]
    rooms = np.zeros(limit + 1, bool)

    def put(m: int, used: dict[int, int], room: int) -> None:
        begun[room].append((m, used))
        rooms[room] = True

    def longest(upto: int, above: int) -> int:
        found = np.flatnonzero(rest[above + 1 : upto + 1])
        return int(found[-1]) + above + 1 if len(found) else 0

    # the program's error is a share of what it packs: most of its plan is taken,
    # then the program is solved again for what is left
    for share in STAGES if program else ():
        kinds = classes(rest, limit)
        if not kinds:
            break
        demand = np.array([rest[a + 1 : b + 1].sum() for a, b in kinds], float)
        x, _ = configurations(demand, np.array([b for _, b in kinds]), limit)
        total = sum(x.values())
        for config, amount in sorted(x.items(), key=lambda c: (-c[1], c[0])):
            left = int(amount * share) if share == 1 or 8 * len(x) * amount > total else 0
            while left > 0:
                used: dict[int, int] = {}
                room = limit
                for nth, k in enumerate(sorted(config, reverse=True), 1):
                    above, upto = kinds[k]
                    # lengths of a class differ: the last piece fits what the others leave
                    p = longest(room if nth == len(config) else upto, above)
                    while p and used.get(p, 0) >= rest[p]:
                        p = longest(p - 1, above)
                    if not p:
                        break
                    used[p] = used.get(p, 0) + 1
                    room -= p
                else:
                    m = int(min(left, *(rest[p] // t for p, t in used.items())))
                    for p, t in used.items():
                        rest[p] -= m * t
                    put(m, used, room)
                    left -= m
                    continue
                break
    # best fit decreasing into what is begun, then into new sequences
    for p in np.flatnonzero(rest)[::-1].tolist():
        n = int(rest[p])
        while n:
            fits = np.flatnonzero(rooms[p:])
            room = int(fits[0]) + p if len(fits) else limit
            m, used = begun[room].pop() if len(fits) else (-(-n // (limit // p)), {})
            rooms[room] = bool(begun[room])
            times = min(room // p, n)
            k = min(m, n // times)
            put(k, {**used, p: used.get(p, 0) + times}, room - p * times)
            if m > k and len(fits):
                put(m - k, used, room)
            n -= k * times
    return [(m, sorted(used.items(), reverse=True)) for some in begun for m, used in some]


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, end, times, sequence, offset): pieces of a length that
    are numbered first..end-1 go ``times`` to a sequence, from ``sequence`` on."""
    rows, met, sequence = [], {}, 0
    for m, content in patterns:
        offset = 0
        for length, times in content:
            first = met.get(length, 0)
            met[length] = first + m * times
            rows.append((length, first, first + m * times, times, sequence, offset))
            offset += length * times
        sequence += m
    return rows


def _cut(file: str, limit: int):
    def run(batches):
        import pyarrow as pa

        vocab = vocabulary(file)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), [[], [], [], [], []]
            state = [0, 0, 0, 0]  # piece, its start, its length, its CRC

            def close(row):
                for column, v in zip(out, (ids[row], state[0], state[1], state[2], state[3])):
                    column.append(v)
                state[:] = state[0] + 1, state[1] + state[2], 0, 0

            def feed(row, part):
                at = 0
                while at < len(part):
                    if state[2] == limit:
                        close(row)
                    take = min(limit - state[2], len(part) - at)
                    state[3] = zlib.crc32(part[at : at + take], state[3])
                    state[2] += take
                    at += take

            for group in chunks(batch.column(1).to_pylist()):
                buf = np.frombuffer(b"".join(x for _, data, _ in group for x in (data, b"\n")), np.uint8)
                ends = np.cumsum([len(data) + 1 for _, data, _ in group])
                flat, counts = vocab.ids(buf, ends)
                flat, at = flat.astype("<u4"), 0
                for (row, _, last), n in zip(group, counts.tolist()):
                    feed(row, flat[at : at + n])
                    at += n
                    if last:
                        feed(row, np.zeros(1, "<u4"))
                        close(row)
                        state[:] = 0, 0, 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, file: str, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").cast("long"), "text").transform(arrow_map, _cut(file, limit), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, file: str, limit: int = LIMIT) -> DataFrame:
    spark = docs.sparkSession
    numbered = gapless(Scratch(spark, "op9"), pieces(docs, file, limit), ["length"], "_rank")
    # at most ``limit`` rows
    histogram = {int(r[0]): int(r[1]) for r in numbered.groupBy("length").count().collect()}
    rows = places(plan(histogram, limit)) or [(0, 0, 0, 1, 0, 0)]
    table = spark.createDataFrame(rows, "_len long, _first long, _end long, _times long, _seq long, _off long")
    nth = F.col("_rank") - F.col("_first")
    # the plan's rows come from the number of lengths, not of documents; checked all the same
    few = len(rows) <= PLAN_ROWS
    hit = numbered.join(F.broadcast(table) if few else table, (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    return hit.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_seq") + F.floor(nth / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_off") + F.pmod(nth, F.col("_times")) * F.col("length")).cast("long").alias("offset"),
    )


def op9_config_lp_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
