"""Where trained models plug in: interfaces, and stubs that need none.

Neural networks, renderers and hosted verifiers are no part of this engine.
Each has a protocol here; implementations run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, functions as F


class Segmenter(Protocol):
    def segment(self, points: DataFrame) -> DataFrame:
        """points with a ``label`` column."""


class Classifier(Protocol):
    def classify(self, objects: DataFrame, classes: list[str], k: int) -> DataFrame:
        """file, rank, class, score."""


class Verifier(Protocol):
    def verify(self, requests: DataFrame) -> DataFrame:
        """id, type, confidence, reason for requests (id, request)."""


class Answerer(Protocol):
    def answer(self, questions: DataFrame) -> DataFrame:
        """topic, answer, abstain."""


class GeometricSegmenter:
    """Normals and heights; no training."""

    def __init__(self, radius: float = 0.15):
        self.radius = radius

    def segment(self, points: DataFrame) -> DataFrame:
        from .operators.structure import baseline_segments, estimate_normals

        return baseline_segments(points, estimate_normals(points, self.radius))


class LearnedSegmenter:
    def segment(self, points: DataFrame) -> DataFrame:
        raise NotImplementedError("a trained segmenter must be plugged in")


_SEGMENTERS: dict[str, Callable[..., Segmenter]] = {"geometric": GeometricSegmenter, "learned": LearnedSegmenter}


def build_segmenter(name: str, **options) -> Segmenter:
    return _SEGMENTERS[name](**options)


class EmbeddingClassifier:
    """Open vocabulary by cosine: objects' and classes' vectors come from an
    encoder elsewhere."""

    def __init__(self, class_vectors: DataFrame, temperature: float = 100.0):
        self.vectors, self.temperature = class_vectors, temperature

    def classify(self, objects: DataFrame, classes: list[str], k: int) -> DataFrame:
        from .functions.vectors import cosine, softmax
        from .operators.windows import top_per_group

        c = F.broadcast(self.vectors.where(F.col("class").isin(classes)).select("class", F.col("vector").alias("cv")))
        s = objects.crossJoin(c).select("file", "class", cosine(F.col("vector"), F.col("cv")).alias("s"))
        p = softmax(s, "file", "s", self.temperature, "score")
        return top_per_group(p, ["file"], [F.col("score").desc(), F.col("class")], k, rank="rank").select("file", "rank", "class", "score")


class EchoVerifier:
    """Confirms what the request says: for tests."""

    def verify(self, requests: DataFrame) -> DataFrame:
        return requests.select("id", F.get_json_object("request", "$.type").alias("type"), F.lit(1.0).alias("confidence"), F.lit("echo").alias("reason"))


def call_service(requests: DataFrame, call: Callable[[str], dict], retries: int = 3) -> DataFrame:
    """A hosted verifier: one call a request, in batches, tried again a few
    times; what still fails gives a null type."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.column(1).to_pylist():
                got: dict = {}
                for _ in range(retries):
                    try:
                        got = call(r)
                        break
                    except OSError:
                        continue
                out.append(got)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o.get("type") for o in out], pa.string()), pa.array([o.get("confidence") for o in out], pa.float64()), pa.array([o.get("reason") for o in out], pa.string())], ["id", "type", "confidence", "reason"])

    return requests.select("id", "request").mapInArrow(run, f"id {dict(requests.dtypes)['id']}, type string, confidence double, reason string")
