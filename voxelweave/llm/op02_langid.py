"""Language identification with string kernels.

Two texts compare by the blended-spectrum presence kernel: the number of
distinct character n-grams (n = 1..4) they share, over the root of the product
of their numbers. A Nyström map on landmark texts turns kernel values into
features, and kernel ridge regression, one language against the rest, is fitted
on them. As the kernel is a product of presence vectors, landmarks, map and
regression fold into one matrix, and a block of texts is scored by one matrix
product. N-grams are hashed into 2**15 cells, so the model's size is fixed for a
number of languages.

The fit takes at most ``PER_LANG`` texts a language (those of the smallest hash)
and ``LANDMARKS`` of them, at most ``TEXTS_IN_ALL`` and ``LANDMARKS_IN_ALL`` over all
languages; their presence bits, 4 KB a text, come to the driver.

Defined results: null text, text without a letter, or no labelled row to learn
from: ``und`` with score 0. Long texts count whole. Repeated and null doc_ids
are rows like others. Input columns named lang_pred or score are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map, bounded_sample, held_out

BITS = 15
ORDERS = 4
PER_LANG = 200
LANDMARKS = 60  # a language
#: Texts and landmarks of all languages together: with many languages each has fewer.
TEXTS_IN_ALL, LANDMARKS_IN_ALL = 24_000, 1_200
RIDGE = 1e-3
_PART = 1 << 18


def presence(text: str, flags: np.ndarray) -> None:
    """Sets the cells of all n-grams of the text."""
    shift = np.uint32(32 - BITS)
    for at in range(0, max(1, len(text)), _PART):
        c = np.frombuffer(text[at : at + _PART + ORDERS - 1].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        h = c * np.uint32(0x9E3779B1)
        for n in range(1, ORDERS + 1):
            if n > 1:
                if len(h) < 2:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[n - 1 :] * np.uint32(0x9E3779B1)
            x = (h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE3D)
            flags[x >> shift] = True


def _bits(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            flags = np.zeros(1 << BITS, bool)
            presence(text, flags)
            out.append(np.packbits(flags).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["lang", "bits"])


def fit(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> tuple[list[str], np.ndarray]:
    """docs (doc_id, text, lang) -> languages and the folded matrix
    (cells x languages). Rows that are held out aren't learned from."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    # hashes are drawn first, at most per_lang a language, so only their texts move
    known = max(1, rows.select("lang").distinct().count())
    per_lang, landmarks = max(2, min(per_lang, TEXTS_IN_ALL // known)), max(1, min(landmarks, LANDMARKS_IN_ALL // known))
    drawn = bounded_sample(rows.select("lang", "_h"), "lang", "_h", per_lang)
    sample = rows.join(F.broadcast(drawn.distinct()) if known * per_lang <= 2 * TEXTS_IN_ALL else drawn.distinct(), ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("text").alias("text"))
    sample = sample.select("lang", "text").transform(arrow_map, _bits, "lang string, bits binary")
    got = sorted((r[0], bytes(r[1])) for r in sample.collect())
    if not got:
        return [], np.zeros((1 << BITS, 0), np.float32)
    names = sorted({lang for lang, _ in got})
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang, _ in got])
    nth = np.zeros(len(got), int)
    for n in names:
        own = [i for i, (lang, _) in enumerate(got) if lang == n]
        nth[own] = np.arange(len(own))

    def rows_of(some) -> np.ndarray:
        x = np.stack([np.unpackbits(np.frombuffer(got[i][1], np.uint8)) for i in some]).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    marks = rows_of(np.flatnonzero(nth < landmarks))
    # a block of texts at a time: the driver holds packed bits and the landmarks
    kernel = np.concatenate([rows_of(range(at, min(at + 256, len(got)))) @ marks.T for at in range(0, len(got), 256)]).astype(float)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = values > 1e-6 * values.max()
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.hstack([kernel @ nystrom, np.ones((len(got), 1))])
    beta = np.linalg.solve(phi.T @ phi + RIDGE * len(got) * np.eye(phi.shape[1]), phi.T @ y)
    folded = np.vstack([marks.T @ (nystrom @ beta[:-1]), beta[-1:]])
    return names, folded.astype(np.float32)


def _predict(model, text_at: int, keep: list[str]):
    def run(batches):
        import pyarrow as pa

        names, folded = model.value
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            for at in range(0, len(texts) if names else 0, 128):
                rows = [i for i in range(at, min(at + 128, len(texts))) if texts[i] and any(map(str.isalpha, texts[i]))]
                flags = np.zeros((len(rows), 1 << BITS), bool)
                for f, i in zip(flags, rows):
                    presence(texts[i], f)
                size = np.sqrt(flags.sum(1, keepdims=True))
                margin = (flags.astype(np.float32) @ folded[:-1]) / size + folded[-1]
                e = np.exp(3 * (margin - margin.max(1, keepdims=True)))
                best = margin.argmax(1)
                for i, b, p in zip(rows, best.tolist(), (e.max(1) / e.sum(1)).tolist()):
                    lang[i], score[i] = names[b], float(p)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score; ``keep``: the columns that stay (all)."""
    docs = docs.drop("lang_pred", "score")
    keep = docs.columns if keep is None else keep
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"])
    columns = list(dict.fromkeys([*keep, "text"]))
    known = docs.sparkSession.sparkContext.broadcast(model)  # cells x languages floats
    return docs.select(*columns).transform(arrow_map, _predict(known, columns.index("text"), keep), schema)


def op2_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
