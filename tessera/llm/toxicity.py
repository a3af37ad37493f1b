"""Toxicity: a linear classifier over character n-gram indicators scaled by naive Bayes log-count ratios, trained on labelled text.

Labels are learned from at most ``per_class`` rows of either class (the documented bound of the sample), taken in the order of a
hash of the id; every document's whole text is scored. Defined results: null and empty texts score what no indicator leaves, the
bias; repeated rows score alike; without labels of both classes all texts score the smoothed share of label 1; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _nbsvm, _stage

SIZES = (4, 6, 8)
BITS = 20
PER_CLASS = 2500
HELD_OUT = (5, 0)
THRESHOLD = 0.5


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sizes: tuple[int, ...] = SIZES, bits: int = BITS, per_class: int = PER_CLASS, held_out: tuple[int, int] = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    model = _nbsvm.train(docs, _nbsvm.sampled_labels(labels, label, *held_out, per_class), sizes, bits)
    return _nbsvm.scored(docs, model).select("doc_id", _stage.held_out("doc_id", *held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
