"""Quality: a naive Bayes support vector machine. Character n-gram indicators are scaled by class log-count ratios, and a linear
hinge-loss model is fitted to them by dual coordinate descent; a sigmoid fitted on margins of rows kept apart gives the score.

Labels are learned from at most ``per_class`` rows of either class (the documented bound of the sample), taken in the order of a
hash of the id; every document's whole text is scored. Defined results: as for toxicity (null and empty texts score the bias,
repeated rows alike, one label or none the smoothed share of label 1, other columns ignored).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _nbsvm, _stage

SIZES = (3, 5, 8)
BITS = 20
PER_CLASS = 2500
HELD_OUT = (4, 2)
THRESHOLD = 0.7


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sizes: tuple[int, ...] = SIZES, bits: int = BITS, per_class: int = PER_CLASS, held_out: tuple[int, int] = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    model = _nbsvm.train(docs, _nbsvm.sampled_labels(labels, label, *held_out, per_class), sizes, bits)
    return _nbsvm.scored(docs, model).select("doc_id", _stage.held_out("doc_id", *held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
