"""Running confusion counts per configuration from an append-only answer log."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions.answers import simple_verdict
from verdigraph.operators.metrics import confusion_aggs
from verdigraph.session import scratch_path


def score_stream(
    stream: DataFrame,
    by: Sequence[str] = ("config",),
    key: str = "idx",
    verdict: Callable[[Column], Column] = simple_verdict,
    event_time: str | None = None,
    lateness: str = "1 hour",
) -> DataFrame:
    """Each answer counts once; re-sent lines are dropped by key.

    Without ``event_time`` the state keeps one key per answer ever seen, as a log without times
    demands. With it, keys older than ``lateness`` leave the state and later repeats are not caught.
    Works on a static DataFrame too.
    """
    keys = [*by, key]
    if event_time:
        once = stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)
    else:
        once = stream.dropDuplicates(keys)
    judged = once.withColumn("pred", verdict(F.col("response")))
    return judged.groupBy(*by).agg(
        *confusion_aggs(), F.count_if(F.col("pred").isNull()).alias("n_invalid"), F.count(F.lit(1)).alias("n_total")
    )


def drain_to_table(scored: DataFrame, label: str = "scores") -> DataFrame:
    """Run what is available, and read the last complete result back from the shared folder.

    Each trigger's whole result goes to its own folder; nothing passes through the driver.
    """
    spark = scored.sparkSession
    root = scratch_path(spark, label)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number:012d}")

    query = (
        scored.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{root}-state")
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    kept = spark.read.parquet(root)
    return kept.where(F.col("batch") == kept.select(F.max("batch")).scalar()).drop("batch")
