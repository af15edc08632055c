"""Scores from logits, verdicts from scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The guard inside each logarithm, and the strict decision bound.
LOG_GUARD = 1e-10
DECISION_BOUND = 0.5

# Model types whose score sits in the second column, by phase of a run.
TWO_COLUMN_TYPES = {"train": ("codet5", "t5"), "test": ("codet5", "t5"), "evaluate": ("codet5",)}


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c.cast("double")))


def softmax(logits: Column) -> Column:
    """Softmax of an array column, shifted by its largest item."""
    peak = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp((x - peak).cast("double")))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def verdict(score: Column, bound: float = DECISION_BOUND) -> Column:
    """1 when strictly above the bound; an undefined score is not."""
    return ((score > bound) & ~F.isnan(score)).cast("int")


def pick_score(scores: Column, model_type: Column, phase: str = "test") -> Column:
    """The positive-class score: second column for two-column model types, else the first."""
    two = model_type.isin(*TWO_COLUMN_TYPES[phase])
    return F.when(two, F.element_at(scores, 2)).otherwise(F.element_at(scores, 1))


def binary_log_loss(score: Column, label: Column, weights: tuple[float, float] | None = None) -> Column:
    """Negative log likelihood of one row; ``weights`` are those of class 0 and class 1."""
    w0, w1 = weights or (1.0, 1.0)
    y = label.cast("double")
    hit = F.log(score + LOG_GUARD) * y * F.lit(w1)
    miss = F.log((F.lit(1.0) - score) + LOG_GUARD) * (F.lit(1.0) - y) * F.lit(w0)
    return -(hit + miss)


def class_nll(logits: Column, label: Column) -> Column:
    """Cross-entropy of one row: log-sum-exp of the logits minus the labelled one."""
    peak = F.array_max(logits)
    total = F.aggregate(
        F.transform(logits, lambda x: F.exp((x - peak).cast("double"))), F.lit(0.0), lambda a, x: a + x
    )
    return F.log(total) + peak - F.element_at(logits, label.cast("int") + 1)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
