"""A corpus from raw documents: five stages, each over all that the last kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, which the
runner writes as Parquet and reads again as the next stage's docs. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelweave.llm import op02_langid, op04_jaccard, op07_mix, op09_pack, op10_pii
from voxelweave.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null, or no letter); the others get
    the predicted one. Fitted on the labelled rows of its own input."""
    docs = docs.select(*COLUMNS)
    model = op02_langid.fit(docs.select("doc_id", "text", "lang"))
    found = op02_langid.identify(docs, model)
    rejected = F.col("text").isNull() | ~F.col("text").rlike(r"\p{L}")
    lang = F.when(F.col("lang_pred") == "und", F.col("lang")).otherwise(F.col("lang_pred"))
    return found.where(~rejected).withColumn("lang", lang).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of five-word shingle sets with
    similarity 0.8 or more: the one whose doc_id names the component. Rows that
    repeat a doc_id are one document, of which the row of the smallest (text,
    lang, source, n_chars) stays; null doc_ids and texts without words stay."""
    docs = docs.select(*COLUMNS)
    found = op04_jaccard.similar(docs.select("doc_id", "text"), k=5, percent=80)
    kept = found.where("component_id = doc_id").select("doc_id").distinct()
    stay = docs.join(op04_jaccard.broadcast_if_small(kept, 16), "doc_id", "left_semi")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        rest = [c for c in COLUMNS if c != "doc_id"]
        first = stay.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r"))
        stay = stay.join(again, "doc_id", "left_anti").select(*COLUMNS).unionAll(first.select("doc_id", "r.*").select(*COLUMNS))
    return stay.select(*COLUMNS).unionAll(docs.where("doc_id is null"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets; n_chars follows the new text. Null
    texts stay null with n_chars null; all rows stay, repeated ones too."""
    out = op10_pii.surrogates(docs.select(*COLUMNS), op10_pii.session_key(spark))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each row comes as often as the mix takes it (0 to 2
    times). Rows are told apart by where they stand in their file, so that null
    and repeated doc_ids get copies of their own; texts without words come once
    or twice as their place in the queue says."""
    docs = docs.select(*COLUMNS)
    try:
        keyed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # not a scan of files: it becomes one
        docs = Scratch(spark, "mix").keep(docs)
        keyed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    taken, _ = op07_mix.fair_queue(keyed, key=("_file", "_row"))
    copies = taken.where("copies > 0").select("_file", "_row", "copies")
    out = keyed.join(copies, ["_file", "_row"])
    return out.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens. Null and empty texts are one piece with
    id 0 alone; rows that come twice are packed twice; no rows give no rows."""
    return op09_pack.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("mix", mix),
    ("pack", pack),
]

#: SQL expresses neither the string kernels nor the surrogates nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        following = scratch.keep(stage(spark, docs, sf_dir))
        if hasattr(docs, "_scratch_path"):
            scratch.drop(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
