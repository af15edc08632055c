"""Stops a configuration once its requests failed too often in a row, over an endless stream of attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.operators.runs import FAILURES_TO_STOP, cut_after_failures
from verdigraph.operators.scale import rank_rows
from verdigraph.session import scratch_path

EXPIRY = 1000


class FailureCut:
    """Keeps the successful attempts of every run up to its ``n``-th failure in a row.

    The state is a table in the shared folder, one row a run: failures in a row at its end (below ``n``), whether
    it has stopped, and the trigger that saw it last. A trigger reads the table of the one before it, puts a run's open failures
    in front of its new attempts, cuts them as a batch is cut, spread over tasks however large a run is, and writes the next
    table. All it writes goes below its own number, so a trigger that is run again writes the same. Runs that
    ``expiry`` triggers did not see leave the state and start anew.

    Attempts of a run reach it in the order of ``pos``, trigger by trigger; within one any order will do.
    """

    def __init__(self, root: str, keys: Sequence[str] = ("run",), pos: str = "pos", failed: str = "failed", n: int = FAILURES_TO_STOP, expiry: int = EXPIRY):
        self.root, self.keys, self.pos, self.failed, self.n, self.expiry = root, list(keys), pos, failed, n, expiry

    def state(self, batch: DataFrame, number: int) -> DataFrame:
        """The state before trigger ``number``."""
        schema = ", ".join(f"`{k}` {dict(batch.dtypes)[k]}" for k in self.keys) + ", streak int, stopped boolean, seen bigint"
        if not number:
            return batch.sparkSession.createDataFrame([], schema)
        before = batch.sparkSession.read.schema(schema).parquet(f"{self.root}/state/{number - 1:012d}")
        return before.where(F.col("seen") >= number - self.expiry)

    def __call__(self, batch: DataFrame, number: int) -> None:
        state = self.state(batch, number)
        held = batch.join(state.select(*self.keys, "streak", "stopped"), self.keys, "left")
        live = held.where(~F.coalesce("stopped", F.lit(False))).select(*batch.columns)
        open_ones = state.where(~F.col("stopped")).join(batch.select(*self.keys).distinct(), self.keys, "left_semi")
        earlier = open_ones.where("streak > 0").select(*self.keys, F.explode(F.sequence(F.lit(1), F.col("streak"))).alias("_back"))
        # Open failures stand before all of the batch.
        rows = live.select(*batch.columns, F.lit(1).alias("_new"), F.lit(0).alias("_back")).unionByName(
            earlier.select(*self.keys, F.lit(True).alias(self.failed), F.lit(0).alias("_new"), "_back"), allowMissingColumns=True
        )
        placed = rank_rows(rows, ["_new", self.pos, "_back"], self.keys, name="_at")
        path = f"{self.root}/placed/{number:012d}"
        placed.write.mode("overwrite").parquet(path)
        placed = batch.sparkSession.read.schema(placed.schema).parquet(path)
        kept = cut_after_failures(placed, self.keys, "_at", self.failed, self.n)
        kept.select(*batch.columns).write.mode("overwrite").parquet(f"{self.root}/kept/batch={number:012d}")
        ends = placed.groupBy(*self.keys).agg(F.max("_at").alias("_end"), F.max(F.when(~F.col(self.failed), F.col("_at"))).alias("_good"), F.count_if(~F.col(self.failed)).alias("_successes"))
        went = kept.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_kept"))
        streak = F.col("_end") - F.coalesce("_good", F.lit(-1))
        fresh = ends.join(went, self.keys, "left").select(
            *self.keys, F.least(streak, F.lit(self.n)).cast("int").alias("streak"),
            ((streak >= self.n) | (F.coalesce("_kept", F.lit(0)) < F.col("_successes"))).alias("stopped"), F.lit(number).cast("bigint").alias("seen"),
        )
        old = state.join(fresh.select(*self.keys), self.keys, "left_anti")
        # A stopped run is seen while its attempts still come.
        here = batch.select(*self.keys).distinct().withColumn("_here", F.lit(number).cast("bigint"))
        old = old.join(here, self.keys, "left").select(*self.keys, "streak", "stopped", F.coalesce("_here", "seen").alias("seen"))
        fresh.unionByName(old).write.mode("overwrite").parquet(f"{self.root}/state/{number:012d}")


def cut_stream(stream: DataFrame, keys: Sequence[str] = ("run",), pos: str = "pos", failed: str = "failed", n: int = FAILURES_TO_STOP, expiry: int = EXPIRY) -> DataFrame:
    """Run what is available, trigger by trigger, and read the kept attempts back."""
    spark = stream.sparkSession
    root = scratch_path(spark, "failures")
    cut = FailureCut(root, keys, pos, failed, n, expiry)
    query = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(cut).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/kept").select(*stream.columns)
