"""Toxicity of deobfuscated text.

Writers hide words behind look-alike signs (1d10t), letters of another script,
spacing (i d i o t) and repetition (idiooot). A noisy channel undoes that: a span
that shows such signs becomes a lattice of the letters each sign may stand for,
of gaps that part words or were put in, and of runs that were drawn out; Viterbi
decoding under a character trigram model picks the likeliest reading. Letters
without such signs have one path only and stay. The restored text is then scored
by a logistic model over words and word beginnings of 4 to 6 letters. The model's
symbols are a to z, digits, and twelve classes that other letters are hashed to.

The character model counts the trigrams of all documents. Labels are learned
from at most ``PER_LABEL`` rows of each label, none of them held out.

Defined results: null text counts as empty; empty texts get the model's base
score; without rows to learn from (or with one label only) the score is 0 or 1
as that label says, 0 without any; a doc_id labelled both ways counts for both;
null labels and null doc_ids are not learned from; of rows
that repeat a labelled doc_id one text is learned from. Whole texts are read.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map, bounded_sample, held_out, Scratch

PER_LABEL = 6000
FEATURES = 600
#: The letters that a sign may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "*": "aeiou",
}
#: Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPH = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ο": "o", "α": "a", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "κ": "k"}
#: Symbols of the character model: 0 no letter, 1-26 a-z, 27 digits, then classes of other letters.
N, OTHER = 40, 28


def symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if c.isdigit():
        return 27
    return OTHER + ord(c) * 2654435761 % 2**32 * (N - OTHER) // 2**32 if c.isalpha() else 0


#: By code point of the basic plane; what lies beyond counts as no letter.
_PLANE = 1 << 16
_LETTER = np.array([chr(i).isalpha() and chr(i).lower() == chr(i) for i in range(_PLANE)])
_DIGIT = np.zeros(_PLANE, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(_PLANE, bool)
_SIGN[[ord(c) for c in LOOKALIKE]] = True
_LATIN = np.zeros(_PLANE, bool)
_LATIN[97:123] = True
_ALIKE = np.zeros(_PLANE, bool)
_ALIKE[[ord(c) for c in HOMOGLYPH]] = True
_SYMBOL = np.zeros(_PLANE, np.int32)
for _c in np.flatnonzero(_LETTER | _DIGIT).tolist():
    _SYMBOL[_c] = symbol(chr(_c))


def _points(low: str) -> np.ndarray:
    return np.minimum(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4"), _PLANE - 1)


_PART = 1 << 18


def _count(batches):
    """Trigram counts of a task."""
    import pyarrow as pa

    total = np.zeros(N**3, np.int64)
    for batch in batches:
        held = []
        size = 0
        texts = batch.column(0).to_pylist()
        for i, text in enumerate(texts):
            for at in range(0, len(text or ""), _PART):
                held.append(text[max(0, at - 2) : at + _PART])
                size += len(held[-1])
                if size > _PART:
                    _add(held, total)
                    held, size = [], 0
        _add(held, total)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])


def _add(texts: list[str], total: np.ndarray) -> None:
    if texts:
        s = _SYMBOL[_points("  ".join(texts).lower())]
        if len(s) > 2:
            total += np.bincount(s[:-2] * (N * N) + s[1:-1] * N + s[2:], minlength=N**3)


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of c after a, b: trigrams of the whole
    corpus, smoothed by bigrams and single letters. N**3 rows at most."""
    rows = docs.select("text").transform(arrow_map, _count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    c = np.zeros(N**3)
    for gram, n in rows:
        c[gram] = n
    c = c.reshape(N, N, N)
    one = (c.sum((0, 1)) + 1) / (c.sum() + N)
    two = (c.sum(0) + 20 * one) / (c.sum(0).sum(1, keepdims=True) + 20)
    three = (c + 20 * two[None]) / (c.sum(2, keepdims=True) + 20)
    return np.log(three)


#: Channel costs: a sign for a letter, a sign for itself, a letter that looks like
#: another and is meant, a run read as one or two letters, a run that is meant, a
#: gap that was put in, a gap that is meant.
_SUBSTITUTE, _SELF, _MEANT_ALIKE, _SHORTER, _MEANT, _JOIN, _KEEP = -0.7, -6.0, -3.0, -0.7, -4.0, -0.3, -2.0


def decode(span: str, model: np.ndarray) -> str:
    """The likeliest reading of a span: Viterbi over pairs of last symbols."""
    runs: list[tuple[str, int]] = []
    for ch in span:
        if runs and runs[-1][0] == ch:
            runs[-1] = (ch, runs[-1][1] + 1)
        else:
            runs.append((ch, 1))

    like = HOMOGLYPH if any("a" <= c <= "z" for c in span) else {}
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for nth, (ch, r) in enumerate(runs):
        options: list[tuple[str, int, float]] = []  # a sign, how often, cost
        if ch.isalpha():
            if r < 3:
                options.append((ch, r, _MEANT_ALIKE if ch in like else 0.0))
                if r == 2:
                    options.append((ch, 1, -3.0))
            else:
                options += [(ch, 1, _SHORTER), (ch, 2, _SHORTER), (ch, r, _MEANT)]
            if ch in like:
                options += [(like[ch], k, _SUBSTITUTE) for k in {1, min(r, 2)}]
        elif ch in LOOKALIKE:
            options.append((ch, r, _SELF))
            for c in LOOKALIKE[ch]:
                options += [(c, 1, _SUBSTITUTE)] if r == 1 else [(c, 1, 2 * _SUBSTITUTE), (c, 2, 2 * _SUBSTITUTE)]
        else:  # a gap; the signs of one gap are kept or go together
            options.append((ch, r, _KEEP if runs[nth - 1][0].isalnum() else 0.0))
            options.append(("", 0, _JOIN))
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, out) in states.items():
            for c, times, cost in options:
                x, y, s = a, b, score + cost
                if times:
                    z = symbol(c)
                    # from the third time on each adds the same
                    s += model[x, y, z] + (model[y, z, z] if times > 1 else 0.0) + (times - 2) * model[z, z, z] * (times > 2)
                    x, y = (y, z) if times == 1 else (z, z)
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, (out, c * times))
        states = after
    parts, best = [], max(((s + model[a, b, 0], out) for (a, b), (s, out) in states.items()), key=lambda x: x[0])[1]
    while best:
        parts.append(best[1])
        best = best[0]
    return "".join(reversed(parts))


def spans(text: str) -> list[tuple[int, int, str]]:
    """(from, to, what to decode) of the spans of a lower-case text that look
    obfuscated, in order."""
    buf = _points(text)
    n = len(buf)
    if n < 4:
        return []
    letter, sign = _LETTER[buf], _SIGN[buf]
    digit = _DIGIT[buf]
    hit = np.zeros(n, bool)
    # a sign between letters, or (unless "*") at a word's start, or a digit or @ after letters
    inner = sign[1:-1] & letter[2:]
    start = ~letter[:-2] & ~sign[:-2] & (buf[1:-1] != 42)
    hit[1:-1] |= inner & (letter[:-2] | start | (sign[:-2] & (buf[:-2] != 42)))
    hit[0] = sign[0] & letter[1] & (buf[0] != 42)
    hit[1:] |= (digit[1:] | (buf[1:] == 64)) & letter[:-1]
    hit[2:] |= letter[2:] & (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2])
    alike, latin = _ALIKE[buf], _LATIN[buf]
    if alike.any():  # letters of two scripts beside each other
        hit[1:] |= alike[1:] & latin[:-1] | latin[1:] & alike[:-1]
    word = letter | sign
    single = letter | digit
    single[1:] &= ~word[:-1] | (buf[:-1] == 42)
    single[:-1] &= ~word[1:] | (buf[1:] == 42)
    # three letters or more that stand alone, with gaps of one to three signs
    alone = np.flatnonzero(single)
    near = np.diff(alone) <= 4
    chain = np.zeros(n, bool)
    if len(near) > 1:
        chain[alone[:-2][near[:-1] & near[1:]]] = True
    out, at = [], 0
    for i in np.flatnonzero(hit | chain).tolist():
        if i < at:
            continue
        if chain[i]:
            k = int(np.searchsorted(alone, i))
            while k < len(near) and near[k]:
                k += 1
            at = int(alone[k]) + 1
            out.append((i, at, text[i:at]))
            continue
        a = b = i
        while a > at and word[a - 1]:
            a -= 1
        while b < n and word[b]:
            b += 1
        while b > a and text[b - 1] in "!*$+|":
            b -= 1
        if b > a:
            out.append((a, b, text[a:b]))
            at = b
    return out


def restore(text: str | None, model: np.ndarray, memo: dict[str, str]) -> str:
    """The text in lower case with its obfuscated spans decoded."""
    low = (text or "").lower()
    found = spans(low)
    if not found:
        return low
    out, at = [], 0
    for a, b, what in found:
        if what not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[what] = decode(what, model) if any(c.isalpha() for c in what) else what
        out += [low[at:a], memo[what]]
        at = b
    return "".join([*out, low[at:]])


def _features(words: list[str]) -> set[str]:
    got = {f"{w}$" for w in words if 3 <= len(w) <= 20}
    for n in (4, 5, 6):
        got.update(w[:n] for w in words if len(w) > n)
    return got


def _train_rows(model):
    def run(batches):
        import pyarrow as pa
        import re

        letters, memo = re.compile(r"[^\W\d_]+"), {}
        for batch in batches:
            rows = [sorted(_features(list(set(letters.findall(restore(t, model.value, memo)))))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], ["toxic", "f"])

    return run


class Scorer:
    """Finds the model's features with one automaton over the restored text."""

    def __init__(self, weights: dict[str, float], base: float):
        import ahocorasick

        self.base, self.auto = base, ahocorasick.Automaton()
        for f, w in weights.items():
            pattern = f.removesuffix("$")
            whole, start = self.auto.get(pattern, (pattern, 0.0, 0.0))[1:] if pattern in self.auto else (0.0, 0.0)
            self.auto.add_word(pattern, (pattern, w, start) if f.endswith("$") else (pattern, whole, w))
        self.some = bool(weights)
        if self.some:
            self.auto.make_automaton()

    def __call__(self, text: str) -> float:
        got = {}
        if self.some:
            n = len(text)
            for end, (pattern, whole, start) in self.auto.iter(text):
                first = end - len(pattern)
                if first >= 0 and text[first].isalpha():
                    continue
                inside = end + 1 < n and text[end + 1].isalpha()
                if inside and start:
                    got[pattern] = start
                elif not inside and whole:
                    got[pattern + "$"] = whole
        return 1 / (1 + np.exp(-np.clip(self.base + sum(got.values()), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (n * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, chars: np.ndarray, per_label: int = PER_LABEL) -> tuple[dict[str, float], float]:
    """Weights of the features that tell the labels apart, and the base."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "op3")
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic").distinct()
    # labels are drawn first: at most 2 x per_label of them, so only their texts move
    drawn = bounded_sample(known.withColumn("_h", F.xxhash64("doc_id")), "toxic", "_h", per_label).drop("_h")
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("toxic", "doc_id").agg(F.min("text").alias("text")).select("toxic", "text")
    seen = scratch.keep(sample.transform(arrow_map, _train_rows(spark.sparkContext.broadcast(chars)), "toxic int, f array<string>"))
    totals = {int(r[0]): int(r[1]) for r in seen.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return {}, 30.0 if 1 in totals else -30.0
    pos, neg = totals[1], totals[0]
    counts = seen.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    lift = F.log((F.col("p") + 0.5) / F.lit(pos + 1.0)) - F.log((F.col("n") + 0.5) / F.lit(neg + 1.0))
    top = counts.where((F.col("p") >= 4) & (lift > 1.0)).orderBy((lift * F.sqrt("p")).desc(), "f").limit(FEATURES)
    names = [r[0] for r in top.select("f").collect()]
    if not names:
        return {}, float(np.log(pos / neg))
    at = {f: i for i, f in enumerate(names)}
    kept = seen.select("toxic", F.array_intersect("f", F.lit(names)).alias("f")).groupBy("toxic", "f").count().collect()
    x, y, n = np.zeros((len(kept), len(names))), np.zeros(len(kept)), np.zeros(len(kept))
    for i, r in enumerate(kept):
        y[i], n[i] = r["toxic"], r["count"]
        for f in r["f"]:
            x[i, at[f]] = 1
    w = _logistic(x, y, n)
    return {f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-4}, float(w[-1])


def _score(model):
    def run(batches):
        import pyarrow as pa

        chars, weights, base = model.value
        scorer, memo = Scorer(weights, base), {}
        for batch in batches:
            out = [float(scorer(restore(t, chars, memo))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, chars: np.ndarray, weights: dict[str, float], base: float) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""
    known = docs.sparkSession.sparkContext.broadcast((chars, weights, base))  # 28**3 and FEATURES numbers
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").transform(arrow_map, _score(known), f"doc_id {kind}, score double")


def op3_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    chars = character_model(docs)
    weights, base = fit(docs, labels, chars)
    out = score(docs, chars, weights, base)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
