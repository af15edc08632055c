"""Confusion counts and the metrics built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions.answers import simple_verdict
from verdigraph.functions.numeric import py_round, ratio

COUNTS = ("tn", "fp", "fn", "tp")
METRICS = ("acc", "prec", "recall", "f1", "tnr", "fpr", "fnr", "bacc")
NAN = float("nan")


def _count_columns(pred: Column, target: Column) -> dict[str, Column]:
    return {
        "tn": (pred == 0) & (target == 0),
        "fp": (pred == 1) & (target == 0),
        "fn": (pred == 0) & (target == 1),
        "tp": (pred == 1) & (target == 1),
    }


def confusion_aggs(pred: str = "pred", target: str = "target") -> list[Column]:
    """Aggregates for one group; rows without a verdict count nowhere."""
    return [F.count_if(c).alias(n) for n, c in _count_columns(F.col(pred), F.col(target)).items()]


def confusion_flags(pred: Column, target: Column) -> dict[str, Column]:
    """0/1 columns whose sums are the confusion counts."""
    return {n: F.coalesce(c, F.lit(False)).cast("bigint") for n, c in _count_columns(pred, target).items()}


def confusion(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", target: str = "target") -> DataFrame:
    """tn, fp, fn, tp per group, zero when a class never occurs."""
    return df.groupBy(*by).agg(*confusion_aggs(pred, target))


def with_fractions(counts: DataFrame) -> DataFrame:
    """Metrics as fractions next to their counts.

    Precision, recall and F1 are 0 on an empty denominator; the three rates are NaN there.
    """
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    recall = ratio(tp, tp + fn, 0.0)
    tnr = ratio(tn, tn + fp, NAN)
    return counts.withColumns(
        {
            "acc": ratio(tp + tn, tn + fp + fn + tp, NAN),
            "prec": ratio(tp, tp + fp, 0.0),
            "recall": recall,
            "f1": ratio(2 * tp, 2 * tp + fp + fn, 0.0),
            "tnr": tnr,
            "fpr": ratio(fp, fp + tn, NAN),
            "fnr": ratio(fn, tp + fn, NAN),
            "bacc": (recall + tnr) / 2,
        }
    )


def to_percent(df: DataFrame, digits: int = 4) -> DataFrame:
    """Each metric rounded to ``digits`` places, then times 100."""
    return df.withColumns({m: py_round(F.col(m), digits) * 100 for m in METRICS})


def metrics_pct(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", target: str = "target") -> DataFrame:
    """Percent metrics per group."""
    return to_percent(with_fractions(confusion(df, by, pred, target)))


def invalid_ratio(df: DataFrame, by: Sequence[str] = (), verdict: str = "pred", failed: str | None = None) -> DataFrame:
    """Answers that give no verdict over all test rows; failed generations stay in the total only."""
    none = F.col(verdict).isNull()
    if failed:
        none = none & ~F.col(failed)
    return df.groupBy(*by).agg(
        F.count_if(none).alias("n_invalid"), F.count(F.lit(1)).alias("n_total")
    ).withColumn("invalid_ratio", ratio(F.col("n_invalid"), F.col("n_total"), NAN))


def metrics_frac(
    df: DataFrame, by: Sequence[str] = (), pred: str = "pred", target: str = "target", failed: str | None = None
) -> DataFrame:
    """Fraction metrics over valid rows, and the invalid share of all rows, in one aggregation."""
    none = F.col(pred).isNull()
    if failed:
        none = none & ~F.col(failed)
    counts = df.groupBy(*by).agg(
        *confusion_aggs(pred, target), F.count_if(none).alias("n_invalid"), F.count(F.lit(1)).alias("n_total")
    )
    return with_fractions(counts).withColumn("invalid_ratio", ratio(F.col("n_invalid"), F.col("n_total"), NAN))


def metrics_by(df: DataFrame, by: Sequence[str], pred: str = "pred", target: str = "target") -> DataFrame:
    """Fraction metrics for every configuration."""
    return metrics_frac(df, by, pred, target)


def evaluate(corpus: DataFrame, log: DataFrame, configs: Sequence, by: str = "config") -> DataFrame:
    """Metrics of each configuration over all test rows: corpus, answer log, verdicts, counts.

    ``corpus``: idx, target; ``log``: ``by``, idx, response. Every configuration is asked every row, so a row
    without a line in the log counts as invalid there, as does an answer that gives no verdict. Of several
    lines for one row the least text stands. Tables in equal buckets of idx are not moved.
    """
    # One aggregate a row of the corpus holds all configurations: both sides meet on idx alone, before rows multiply.
    each = [F.min(F.when(F.col(by) == c, F.col("response"))).alias(f"_r{i}") for i, c in enumerate(configs)]
    met = corpus.select("idx", "target").join(log.groupBy("idx").agg(*each), "idx", "left")
    answers = [F.struct(F.lit(c).alias(by), F.col(f"_r{i}").alias("response")) for i, c in enumerate(configs)]
    judged = met.select("target", F.explode(F.array(*answers)).alias("_a")).select("target", "_a.*")
    return metrics_frac(judged.withColumn("pred", simple_verdict(F.col("response"))), [by])
