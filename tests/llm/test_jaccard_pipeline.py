import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import op04_jaccard as jc

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    """doc_id -> sizes of its rows' sets, smallest linked id; rows of one id
    are one document."""
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingle_set(t, k)) for d, t in rows]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=str)


def cases(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 60))] for _ in range(25)]
    rows = []
    for i in range(160):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        if rnd.random() < 0.3:
            t += rnd.choice(base)[: rnd.randint(1, 8)]
        rows.append((i * 3 + 1, rnd.choice([" ", "\n", "\t "]).join(t)))
    hot = "one common passage that stands in a great many texts of this table again and again"
    rows += [(1000 + i, hot + f" tail{i % 5}") for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (None, rows[0][1]), (1, rows[40][1]), (1, rows[50][1]), (2003, rows[0][1].upper()), (2004, "é É"), (2005, "x\x0by z\x1cq")]
    return rows


def family(seed):
    """A large family of near copies most of which do not link."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rnd.randint(0, 9)):
            t[rnd.randrange(len(t))] = rnd.choice(["x", f"y{rnd.randrange(30)}", f"u{i}"])
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed, k, percent, salt, size", [(1, 4, 85, 2000, 64), (2, 5, 80, 2000, 4), (3, 2, 60, 3, 4), (4, 4, 85, 2000, 4), (5, 5, 80, 2000, 64)])
def test_components_equal_brute_force(make, monkeypatch, seed, k, percent, salt, size):
    monkeypatch.setattr(jc, "SALT_FROM", salt)
    monkeypatch.setattr(jc, "FAMILY", size)
    monkeypatch.setattr(jc, "FAMILY_BLOCK", 8 * size)
    rows = cases(seed) if seed < 4 else family(seed)
    got = jc.similar(make([(d, t, "en", "s", 1) for d, t in rows]), k, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, k, percent)


def test_nothing(make):
    assert jc.similar(make([])).collect() == []


def test_long_text_equals_its_parts(monkeypatch):
    rnd = random.Random(0)
    text = " ".join(rnd.choice("ab cd efg hijk".split()) + str(rnd.randrange(50)) for _ in range(3000))
    whole = jc.shingles(text, 4)
    monkeypatch.setattr(jc, "_CHUNK", 500)
    assert (jc.shingles(text, 4) == whole).all() and len(whole) == len(shingle_set(text, 4))
    assert [len(s) for s in jc.many([text, None, "a b", "x" * 3000], 4)] == [len(whole), 0, 1, 1]


def test_prefixes_share_m_tokens():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 30, 1 << jc.SKETCH_BITS).astype(np.int32)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for _ in range(200):
        common = rng.choice(pool, rng.integers(20, 90), replace=False)
        extra = rng.choice(pool, 8, replace=False)
        x, y = np.unique(np.concatenate([common, extra[:4]])), np.unique(np.concatenate([common, extra[4:]]))
        if 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)):
            continue
        (a, _, m), (b, _, n) = jc.prefix(x, counts, 0, 80), jc.prefix(y, counts, 0, 80)
        m = min(m, n)
        need = [len(s) - -(-80 * len(s) // 100) + m for s in (x, y)]
        assert len(np.intersect1d(a[: need[0]], b[: need[1]])) >= m


def test_components_of_a_chain(spark):
    from voxelweave.llm.common import Scratch

    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["comp"] for r in jc.components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


def test_pipeline_stages(spark, tmp_path, make):
    import corpus_pipeline as cp

    rnd = random.Random(3)
    words = {"en": "the water house every thing other with from that river stone".split(), "fr": "le maison eau chaque autre dans avec une être rivière pierre".split()}
    rows = []
    for i in range(120):
        lang = ("en", "fr")[i % 2]
        rows.append((i, " ".join(rnd.choice(words[lang]) for _ in range(30)), lang, f"s{i % 3}", 1))
    rows += [(200, rows[0][1], "en", "s0", 1), (201, None, "en", "s0", 0), (202, "123 456", "en", "s0", 1), (203, "mail bob@home.org " + " ".join(sorted(rows[1][1].split())), "fr", None, 1), (None, "the water of no number", "en", "s1", 1)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == cp.COLUMNS
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name == "language":
            assert set(ids) == {r[0] for r in rows} - {201, 202}
        if name == "near_duplicates":
            assert set(ids) == {r[0] for r in rows} - {200, 201, 202} and len(ids) == len(set(ids))
        if name == "private_data":
            text = docs.where("doc_id = 203").head()["text"]
            assert "bob@home.org" not in text and text.endswith(" ".join(sorted(rows[1][1].split())))
    got = cp.run(spark, str(tmp_path)).collect()
    assert got and all(r["length"] <= 2048 for r in got)


@pytest.mark.parametrize("stored", [True, False])
def test_mix_keeps_rows_that_share_an_id_apart(spark, tmp_path, make, stored):
    """Words that the stage gives out are those that the queue takes, row for row."""
    import corpus_pipeline as cp
    from voxelweave.llm import op07_mix

    rows = [(None, f"five words number {i} here", "en", "a", 1) for i in range(300)]
    rows += [(7, f"same id words {i}", "en", "a", 1) for i in range(40)] + [(8, "equal row of six words altogether", "en", "b", 1)] * 30
    rows += [(i, None if i % 9 == 0 else "w " * (i % 5), "en", ["a", "b", None][i % 3], 1) for i in range(100, 200)]
    docs = make(rows)
    if stored:
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    out = cp.mix(spark, docs, str(tmp_path)).collect()
    taken, _ = op07_mix.fair_queue(docs.select("doc_id", "text", "source"))
    want = taken.selectExpr("sum(copies) n", "sum(taken) words").head()
    assert len(out) == want["n"]
    assert sum(len((r["text"] or "").split()) for r in out) == want["words"]
    size = sum(len((r[1] or "").split()) for r in rows)
    assert abs(want["words"] - 1.5 * size) <= 0.1 * size
    got = {}
    for r in out:
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    for r in set(rows):
        assert got.pop(r, 0) <= 2 * rows.count(r)
    assert not got


def test_near_duplicates_keeps_the_smallest_row_of_an_id(spark, tmp_path, make):
    import corpus_pipeline as cp

    rows = [(1, "b words of the second text here", "en", "s", 1), (1, "a words of the first text here", "fr", "s", 1), (1, "a words of the first text here", "en", "s", 1), (2, "quite another text of its own", "en", None, 1), (None, "no id", None, None, None)]
    got = sorted(map(tuple, cp.near_duplicates(spark, make(rows), "").collect()), key=str)
    assert got == sorted([rows[2], rows[3], rows[4]], key=str)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_nothing_odd_columns_and_long_texts(spark, make, stage):
    import corpus_pipeline as cp

    name, run = cp.STAGES[stage]
    assert run(spark, make([]), "").collect() == []
    rows = [(1, "the water " * 60_000, "en", "a", 1), (2, "", "en", None, 0), (None, None, None, None, None), (3, "la maison chaque eau", "fr", "b", 1), (3, "la maison chaque eau", "fr", "b", 1)]
    docs = make(rows)
    for c in ("size", "h", "taken", "copies", "token", "comp", "score", "lang_pred", "n_entities", "kind", "_row", "length", "copy"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = run(spark, docs, "").collect()
    assert out
    if stage < 4:
        assert list(out[0].asDict()) == cp.COLUMNS
        assert any(len(r["text"] or "") == 600_000 for r in out)


def test_pipeline_equals_plain_stages(spark, tmp_path, make):
    """All stages by brute force, SQL and the tokenizer: the pieces of the last."""
    import zlib
    from collections import Counter

    import corpus_pipeline as cp
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer
    from voxelweave.llm import op07_mix, op10_pii

    rnd = random.Random(11)
    words = {"en": "the water house every thing other with from that river stone".split(), "fr": "le maison eau chaque autre dans avec une être rivière pierre".split()}
    rows = [(i, " ".join(rnd.choice(words[l]) for _ in range(rnd.randint(6, 60))), l, ["a", "b", None][i % 3], 1) for i in range(150) for l in [("en", "fr")[i % 2]]]
    rows += [(500 + i, rows[i][1] + (" stone" if i % 2 else ""), rows[i][2], "a", 1) for i in range(30)]
    rows += [(600, None, "en", "a", 0), (601, "77 88", "en", "b", 1), (602, "write to bob@home.org, " + " ".join(rnd.choice(words["fr"]) for _ in range(40)), "fr", "b", 1), (603, "the water " * 3000, "en", "a", 1)]
    make(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    heads = {d for d, _, c in brute([(r[0], r[1]) for r in kept], 5, 80) if d == c}
    kept = [r for r in kept if r[0] in heads]
    make_up, texts = op10_pii.Surrogates(op10_pii.PUBLIC_KEY), {}
    for d, t, *_ in kept:
        at, out = 0, ""
        for a, b, kind, canon in op10_pii.find(t):
            out, at = out + t[at:a] + op10_pii._write(kind, t[a:b], op10_pii._surrogate(make_up, kind, canon, 0)), b
        texts[d] = out + t[at:]
    assert texts[602] != dict((r[0], r[1]) for r in kept)[602]
    make([(d, texts[d], l, s, 1) for d, _, l, s, _ in kept]).write.parquet(f"{tmp_path}/three")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/three/*.parquet'")
    copies = {d: taken // size for d, size, taken in con.sql(f"select doc_id, size, taken from ({op07_mix.ORACLE})").fetchall()}
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for d, n in copies.items():
        ids = tok.encode(texts[d], add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[d, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())] += n
    got = cp.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
