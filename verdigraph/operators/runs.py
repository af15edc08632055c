"""Run control: resuming, stopping after failures, shuffling, batching, planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.operators.scale import BLOCK_ROWS, full_runs, rank_rows

# Failures in a row that stop a run, and the automatic warm-up share.
FAILURES_TO_STOP = 10
WARMUP_AUTO, WARMUP_SHARE = -1, 0.1


def pending(corpus: DataFrame, log: DataFrame, on: Sequence[str] = ("idx",)) -> DataFrame:
    """Rows without an answer yet. The log is made distinct first, so repeats cost no shuffle."""
    return corpus.join(log.select(*on).distinct(), list(on), "left_anti")


def cut_after_failures(
    attempts: DataFrame,
    keys: Sequence[str] = ("run",),
    pos: str = "pos",
    failed: str = "failed",
    n: int = FAILURES_TO_STOP,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Successful attempts made before ``n`` failures in a row ended the run.

    ``pos`` numbers the attempts of a run densely from 0. A cut is handed to every block of its run
    (one row a block), so attempts meet it on (run, block) and a huge run stays spread out.
    """
    block = F.floor(F.col(pos) / F.lit(block_rows))
    placed = attempts.withColumn("_run", F.struct(*keys) if keys else F.struct(F.lit(0)))
    cuts = full_runs(placed, ["_run"], pos, F.col(failed), n, block_rows).groupBy("_run").agg(F.min(pos).alias("_cut"))
    ends = placed.groupBy("_run").agg(F.max(block).alias("_last")).join(cuts, "_run")
    per_block = ends.select("_run", "_cut", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("_block"))
    kept = placed.where(~F.col(failed)).withColumn("_block", block).join(per_block, ["_run", "_block"], "left")
    return kept.where(F.col("_cut").isNull() | (F.col(pos) < F.col("_cut"))).select(*attempts.columns)


def shuffle(df: DataFrame, seed: int, key: str = "idx") -> DataFrame:
    """Seeded random order with its position; the same seed always gives the same order."""
    keyed = df.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return rank_rows(keyed, ["_draw", key], name="pos").drop("_draw")


def in_order(df: DataFrame, key: str = "idx") -> DataFrame:
    """Sequential order with its position."""
    return rank_rows(df, [key], name="pos")


def batches(df: DataFrame, size: int, key: str = "idx", pos: str | None = None) -> DataFrame:
    """Batch number of each row, by ``pos`` if the rows already have one, else by ``key`` order."""
    placed = df if pos else in_order(df, key)
    return placed.withColumn("batch", F.floor(F.col(pos or "pos") / F.lit(size)))


def run_plan(df: DataFrame, epochs: int, batch: int, warmup: int = WARMUP_AUTO, by: Sequence[str] = ()) -> DataFrame:
    """Examples, steps per epoch, total steps and warm-up steps."""
    sized = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_examples"))
    planned = sized.withColumn("steps_per_epoch", F.ceil(F.col("n_examples") / F.lit(batch)))
    planned = planned.withColumn("total_steps", F.col("steps_per_epoch") * epochs)
    steps = F.col("total_steps") * F.lit(WARMUP_SHARE) if warmup == WARMUP_AUTO else F.lit(float(warmup))
    return planned.withColumn("warmup_steps", steps)
