"""Sinks. Each one writes in parallel, a file per partition."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.operators.history import to_history
from verdigraph.sources.readers import RESPONSES, read_responses


def prediction_lines(df: DataFrame) -> DataFrame:
    """``value``: one line per prediction."""
    return df.select(
        F.format_string("idx: %s, pred: %d, target: %d", F.col("idx").cast("string"), "pred", "target").alias("value")
    )


def write_predictions(df: DataFrame, path: str) -> None:
    prediction_lines(df).write.text(path)


def stage_runs(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet") -> str:
    """Write the rows below an attempt of their own, which nobody reads until it is committed; its name."""
    attempt = uuid.uuid4().hex
    df.withColumn("attempt", F.lit(attempt)).write.partitionBy("attempt", *keys).mode("append").format(fmt).save(f"{path}/data")
    return attempt


def commit_runs(spark: SparkSession, path: str, attempt: str, keys: Sequence[str], schema: str, fmt: str = "parquet") -> None:
    """From now on the attempt's rows stand for its keys. The marker is one small write after all the data."""
    held = spark.read.schema(schema).format(fmt).load(f"{path}/data").where(F.col("attempt") == attempt).select(*keys, "attempt").distinct()
    held.withColumn("committed", F.lit(time.time_ns())).write.mode("append").parquet(f"{path}/commits")


def _stored_schema(df: DataFrame, keys: Sequence[str]) -> str:
    columns = [c for c in df.columns if c not in keys] + list(keys)
    return ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in columns) + ", attempt string"


def write_runs(df: DataFrame, path: str, keys: Sequence[str] = ("run",), fmt: str = "parquet") -> None:
    """Keyed sink: rows of a key replace those of the key's earlier writes, and a write counts whole or not at all.

    A write that breaks off leaves rows without a marker, which :func:`read_runs` does not see; the same write again
    leaves the same rows. Keys that a write does not hold keep theirs.
    """
    attempt = stage_runs(df, path, keys, fmt)
    commit_runs(df.sparkSession, path, attempt, keys, _stored_schema(df, keys), fmt)


def read_runs(spark: SparkSession, path: str, schema: str, keys: Sequence[str] = ("run",), fmt: str = "parquet") -> DataFrame:
    """The rows of each key's last committed attempt; a sink without a commit is empty."""
    rows = spark.createDataFrame([], schema)
    columns = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c not in keys)
    named = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in keys)
    try:
        commits = spark.read.schema(f"{named}, attempt string, committed bigint").parquet(f"{path}/commits")
        data = spark.read.schema(f"{columns}, {named}, attempt string").format(fmt).load(f"{path}/data")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows
    last = commits.groupBy(*keys).agg(F.max_by("attempt", F.struct("committed", "attempt")).alias("attempt"))
    same = F.col("d.attempt") == F.col("l.attempt")
    for c in keys:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"l.{c}"))
    return data.alias("d").join(last.alias("l"), same, "left_semi").select(*rows.columns)


def write_metrics(df: DataFrame, path: str, keys: Sequence[str] = ("run",)) -> None:
    """One row per key, laid out by key; a repeated run replaces its rows."""
    write_runs(df, path, keys)


def split_generations(df: DataFrame, verdict: str = "pred") -> tuple[DataFrame, DataFrame]:
    """Answers with a verdict, and those without."""
    return df.where(F.col(verdict).isNotNull()), df.where(F.col(verdict).isNull())


def write_generations(df: DataFrame, path: str, verdict: str = "pred") -> None:
    """Both kinds in one pass, below ``invalid=false`` and ``invalid=true``."""
    df.withColumn("invalid", F.col(verdict).isNull()).write.partitionBy("invalid").parquet(path)


def append_responses(df: DataFrame, log_path: str, run_path: str, run: str | None = None) -> None:
    """Keep successful answers per run, and append the same answers to the shared log.

    The log is fed from the run's written copy: the answers may come from a step that must not run
    twice, and a lost executor cannot make the two copies differ. With ``run`` the log is a keyed sink: the
    same run appended again, after a driver was lost, leaves one line an answer; :func:`read_log` reads it.
    """
    kept = df.where(F.col("response").isNotNull()).select("idx", "target", "response")
    kept.write.mode("errorifexists" if run is None else "overwrite").json(run_path)
    copy = read_responses(df.sparkSession, run_path)
    if run is None:
        copy.write.mode("append").json(log_path)
    else:
        write_runs(copy.withColumn("run", F.lit(run)), log_path, fmt="json")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """run, idx, target, response of a log of keyed runs."""
    return read_runs(spark, path, f"run string, {RESPONSES}", fmt="json")


def write_history(wide: DataFrame, path: str, ids: tuple[str, ...] = ("run", "epoch", "step")) -> None:
    """Long scalar history by run; a repeated run replaces its rows."""
    write_runs(to_history(wide, ids), path, (ids[0],))


def log_lines(log: DataFrame, by: str = "config") -> DataFrame:
    """One line a configuration and row, the least text: answers repeated without end are folded before they move."""
    return log.groupBy(by, "idx").agg(F.min("response").alias("response"))


def write_buckets(df: DataFrame, path: str, name: str, buckets: int, key: str = "idx") -> DataFrame:
    """Write the rows in buckets of ``key``, one sorted file each, as table ``name``, and read it.

    Tables with as many buckets join and group by the key without moving again: corpus and answer log are dealt
    once, and every resume and evaluation reads them in place. A key's rows share a bucket, so the key should not
    repeat without end; :func:`log_lines` sees to that for a log.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def open_buckets(spark: SparkSession, path: str, name: str, schema: str, buckets: int, key: str = "idx") -> DataFrame:
    """A bucketed folder that an earlier session wrote, under a name of this one."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
