"""Metrics along the steps of a run. A run may hold most of the rows, so no window spans one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions.numeric import py_round
from verdigraph.operators.metrics import confusion_flags, with_fractions
from verdigraph.operators.scale import BLOCK_ROWS, running

# The scalars logged at each step, by the name they are shown under.
LOGGED = {
    "Loss": "loss",
    "Acc": "acc",
    "F1": "f1",
    "Prec": "prec",
    "Recall": "recall",
    "TNR": "tnr",
    "FPR": "fpr",
    "FNR": "fnr",
    "Balanced_Accuracy": "bacc",
}
SPLITS = ("train", "valid")
LOSS_DIGITS = 5


def running_metrics(
    steps: DataFrame, keys: Sequence[str] = ("run", "epoch"), step: str = "step",
    pred: str = "pred", target: str = "target", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Confusion counts from the epoch's start up to each step, and the metrics they give."""
    flags = confusion_flags(F.col(pred), F.col(target))
    counted = running(steps.select(*keys, step, pred, target), keys, step, sums=flags, block_rows=block_rows)
    return with_fractions(counted)


def running_loss(
    steps: DataFrame, keys: Sequence[str] = ("run", "epoch"), step: str = "step", loss: str = "loss",
    digits: int | None = LOSS_DIGITS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean loss from the epoch's start up to each step."""
    summed = running(
        steps.select(*keys, step, loss), keys, step,
        sums={"_sum": F.col(loss), "_n": F.lit(1).cast("bigint")}, block_rows=block_rows,
    )
    mean = F.col("_sum") / F.col("_n")
    return summed.withColumn("avg_loss", mean if digits is None else py_round(mean, digits)).drop("_sum", "_n")


def logged_steps(
    steps: DataFrame, every: int, keys: Sequence[str] = ("run", "epoch"), step: str = "step"
) -> DataFrame:
    """Steps that write a log entry: every ``every``-th one, and one more entry as an epoch ends.

    The closing entry carries the number of the step after the epoch's last.
    """
    regular = steps.where(F.pmod(F.col(step) + 1, F.lit(every)) == 0).select(
        *keys, F.col(step).alias("logged_step"), F.lit("step").alias("kind")
    )
    closing = steps.groupBy(*keys).agg((F.max(step) + 1).alias("logged_step")).withColumn("kind", F.lit("epoch"))
    return regular.unionByName(closing)


def best_checkpoint(
    history: DataFrame, keys: Sequence[str] = ("run",), step: str = "step", value: str = "bacc", start: float = 0.0
) -> DataFrame:
    """Step of the best value per run if it beats ``start``; the earliest wins ties.

    An undefined value (NaN) never beats anything. One aggregation over structs, so partial results shrink before the shuffle.
    """
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(step)).alias("s")))
    return (
        history.where((F.col(value) > start) & ~F.isnan(value))
        .groupBy(*keys)
        .agg(top.alias("_top"))
        .select(*keys, (-F.col("_top.s")).alias(f"best_{step}"), F.col("_top.v").alias(f"best_{value}"))
    )


def improvements(
    history: DataFrame, keys: Sequence[str] = ("run",), step: str = "step", value: str = "bacc",
    start: float = 0.0, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every step whose value is strictly above all earlier ones and above ``start``."""
    known = F.when(~F.isnan(value), F.col(value))
    past = running(history, keys, step, maxima={"_past": known}, include_row=False, block_rows=block_rows)
    return past.where(known > F.greatest(F.col("_past"), F.lit(start))).drop("_past")


def to_history(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Long form of ``{split}_{metric}`` columns: ids, metric, split, value."""
    pairs = [
        F.struct(F.lit(shown).alias("metric"), F.lit(split).alias("split"), F.col(f"{split}_{name}").cast("double").alias("value"))
        for shown, name in LOGGED.items()
        for split in SPLITS
    ]
    return wide.select(*ids, F.explode(F.array(*pairs)).alias("_e")).select(*ids, "_e.*")


def train_vs_valid(history: DataFrame, ids: Sequence[str] = ("run", "epoch", "step", "metric")) -> DataFrame:
    """Train and valid value side by side; needs one row per (ids, split)."""

    def of(split: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col("value"))).alias(split)

    return history.groupBy(*ids).agg(*[of(s) for s in SPLITS])
