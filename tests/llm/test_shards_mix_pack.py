import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from voxelweave.llm import op01_shards as sh, op07_mix as mx, op09_pack as pk
from voxelweave.llm.common import Scratch, bounded_sample, gapless

VOCAB = __import__("public_tokenizers").path("word_bpe_49k.json")


def spark_xx(key, path):
    h = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest() if key is not None else 42
    return xxhash.xxh64(path.encode(), seed=h).intdigest()


def descend(key, node, path=""):
    if node.shard is not None:
        return node.shard
    if len(node.children) == 1:
        best = node.children[0]
    else:
        best = min(node.children, key=lambda c: -math.log(((spark_xx(key, f"{path}/{c.name}") >> 11) + 0.5) * 2.0**-53) / c.weight)
    return descend(key, best, f"{path}/{best.name}")


def test_shards_equal_brute_force_and_only_grow_into_the_new_one(spark):
    tree = sh.uniform_tree(4, 2, 2)
    rows = sh.hash_tree_shards(spark.range(2000).withColumnRenamed("id", "doc_id"), tree)
    rows = sh.hash_tree_shards(rows, sh.grow(tree), into="more").collect()
    for r in rows[:400]:
        assert r["shard"] == descend(r["doc_id"], tree)
        assert r["more"] == descend(r["doc_id"], sh.grow(tree))
    assert all(r["more"] in (r["shard"], 16) for r in rows)
    assert 50 < sum(r["more"] == 16 for r in rows) < 200
    assert min(Counter(r["shard"] for r in rows).values()) > 70


def test_reweighing_a_shard_moves_rows_only_within_its_rack(spark):
    tree = sh.uniform_tree(2, 2, 2)
    leaf = tree.children[0].children[0].children[0]
    rack = tree.children[0].children[0]
    heavier = sh.Node(rack.name, rack.weight, (sh.Node(leaf.name, 3.0, shard=leaf.shard), rack.children[1]))
    region = sh.Node(tree.children[0].name, tree.children[0].weight, (heavier, tree.children[0].children[1]))
    other = sh.Node("root", tree.weight, (region, tree.children[1]))
    d = sh.hash_tree_shards(spark.range(3000).withColumnRenamed("id", "doc_id"), tree)
    rows = sh.hash_tree_shards(d, other, into="b").collect()
    moved = [(r["shard"], r["b"]) for r in rows if r["shard"] != r["b"]]
    assert moved and set(moved) == {(1, 0)}


def test_gapless_numbers_a_hot_key(spark):
    d = spark.createDataFrame([(i % 7 if i % 3 else 0,) for i in range(900)], "k int").repartition(5)
    out = gapless(Scratch(spark, "t"), d, ["k"], "n").collect()
    for k in range(7):
        got = sorted(r["n"] for r in out if r["k"] == k)
        assert got == list(range(len(got)))


def test_bounded_sample(spark):
    d = spark.createDataFrame([("a" if i % 10 else "b", i) for i in range(1000)], "g string, h long").repartition(6)
    got = bounded_sample(d, "g", "h", 5).collect()
    assert sorted(r["h"] for r in got if r["g"] == "b") == [0, 10, 20, 30, 40]
    assert sorted(r["h"] for r in got if r["g"] == "a") == [1, 2, 3, 4, 5]


def brute_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    budget, target, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = budget
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total >= 2 * sizes[i]}
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = 2.0 * sizes[i]
            left -= target[i]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 10, 10, 5], [0, 5, 100, 3], [7]])
def test_targets(spark, sizes):
    d = spark.createDataFrame([(f"0{i:02d}", s) for i, s in enumerate(sizes)], "flow string, source_size long")
    got = [r["target"] for r in mx.targets(d).orderBy("flow").collect()]
    assert np.allclose(got, brute_targets(sizes))


def test_mix_of_odd_rows(make):
    rows = [(i, "w " * (i % 9), "en", ["a", "b", None][i % 3], 1) for i in range(120)]
    rows += [(None, None, None, None, None), (5, "same id", "en", "a", 3), (5, "same id", "en", "a", 3), (200, "", "en", "c", 0), (201, "x " * 4000, "en", "b", 1)]
    out, _ = mx.fair_queue(make(rows).selectExpr("doc_id", "text", "source"))
    got = out.collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = ["a", "b", "c", None]
    assert np.allclose([target[s] for s in order], brute_targets([size[s] for s in order]))
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    for s in ("a", None):
        assert abs(taken[s] - target[s]) <= 10
    again, _ = mx.fair_queue(make(rows).selectExpr("doc_id", "text", "source"))
    key = lambda x: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in x)
    assert key(again.collect()) == key(got)


def test_mix_of_nothing(make):
    assert mx.fair_queue(make([]).select("doc_id", "text", "source"))[0].collect() == []


def test_plan_packs_every_piece_closely():
    rng = np.random.default_rng(3)
    lengths = Counter(np.clip(rng.lognormal(6.3, 0.8, 20_000), 1, 2048).astype(int).tolist())
    lengths[2048] += 500
    patterns = pk.plan(dict(lengths))
    packed = Counter()
    for m, content in patterns:
        assert sum(a * b for a, b in content) <= 2048
        for length, times in content:
            packed[length] += m * times
    assert packed == lengths
    least = -(-sum(a * b for a, b in lengths.items()) // 2048)
    assert sum(m for m, _ in patterns) <= 1.02 * least + 2
    assert pk.plan({}) == []


def test_pack_equals_the_tokenizer(make):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCAB)
    odd = ["It's <|endoftext|> don't", "İstanbul ŉ × ÷ Straße ÀÉ x", "é ͅΣς ΟΔΟΣ", "日本語 テスト 12ab!!'s '' a\x0bb\tc\r\n", "", None, " ", "x" * 5000, "hello world " * 3000, "é" * 900]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(odd)] + [(3, "again", "en", "a", 1), (None, "null id", None, None, None)]
    got = pk.pack(make(rows).select("doc_id", "text", "lang"), VOCAB).collect()
    want = Counter()
    for d, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for n, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[d, n, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 2048
    assert pk.pack(make([]).select("doc_id", "text"), VOCAB).collect() == []


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n, cap = int(rng.integers(1, 6)), int(rng.integers(5, 60))
        size, value = rng.integers(1, cap + 1, n), rng.random(n) * (rng.random(n) > 0.2)
        best = [0.0]
        for c in range(1, cap + 1):
            best.append(max([best[c - 1]] + [best[c - s] + v for s, v in zip(size, value) if s <= c]))
        config, got = pk.knapsack(value, size, cap)
        assert abs(got - best[cap]) < 1e-9 and abs(value[config].sum() - got) < 1e-9 and size[config].sum() <= cap
    assert pk.knapsack(np.array([1.0, 1, 1, 1]), np.array([41, 44, 65, 85]), 128)[0] == [0, 0, 0]
    assert pk.knapsack(np.array([1.0]), np.array([60]), 128)[0] == [0, 0]


def _sequences(patterns):
    return sum(m for m, _ in patterns)


def test_program_beats_plain_packing():
    few = {700: 30_000, 1348: 10_000, 650: 20_000, 1030: 5_000}
    assert _sequences(pk._round(few, 2048, True)) <= 27_500 < _sequences(pk._round(few, 2048, False))
    x, bound = pk.configurations(np.array([20_000.0, 30_000, 5_000, 10_000]), np.array([650, 700, 1030, 1348]), 2048)
    assert 27_000 <= bound <= 27_500 <= sum(x.values()) + 1e-6 <= 1.01 * 27_500
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(500, 900, 50_000), rng.integers(300, 1100, 20_000)):
        histogram = dict(Counter(lengths.tolist()))
        rounded, plain = (pk._round(histogram, 2048, p) for p in (True, False))
        assert _sequences(rounded) < _sequences(plain)
        packed = Counter()
        for m, content in pk.plan(histogram):
            assert m > 0 and sum(a * b for a, b in content) <= 2048
            for length, times in content:
                packed[length] += m * times
        assert packed == histogram


def test_small_programs_against_brute_force():
    """The fewest sequences of up to 7 pieces, by trying all."""

    def fewest(pieces, room=()):
        if not pieces:
            return len(room)
        p, rest = pieces[0], pieces[1:]
        some = [fewest(rest, room[:i] + (r - p,) + room[i + 1 :]) for i, r in enumerate(room) if r >= p]
        return min([*some, fewest(rest, (*room, 10 - p))])

    rng = np.random.default_rng(2)
    for _ in range(40):
        pieces = sorted(rng.integers(1, 11, 7).tolist(), reverse=True)
        assert _sequences(pk.plan(dict(Counter(pieces)), 10)) <= fewest(tuple(pieces)) + 1
