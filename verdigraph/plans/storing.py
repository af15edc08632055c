"""Readers and sinks: each query writes to the shared folder and reads its own files back."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph import sources as IO
from verdigraph.operators.history import to_history
from verdigraph.operators.metrics import confusion
from verdigraph.plans.fixtures import CORPUS_SQL, RESPONSES_SQL, SHOTS_SQL, corpus, responses, shots
from verdigraph.plans.measuring import COUNTS_SQL, JUDGED_SQL, LONG_SQL, PRED_SQL, judged, predicted, wide
from verdigraph.plans.registry import query
from verdigraph.session import scratch_path


@query("s1_read_corpus", f"SELECT CAST(idx AS VARCHAR) AS idx, func, target FROM ({CORPUS_SQL}) c")
def s1(t):
    path = scratch_path(t.spark, "corpus")
    corpus(t).withColumn("idx", F.col("idx").cast("string")).write.json(path)
    return IO.read_corpus(t.spark, path)


@query(
    "s2_read_shots",
    f"""SELECT "row", func, target, (row_number() OVER (ORDER BY "row") - 1) // 2 AS pair_id,
 CAST((row_number() OVER (ORDER BY "row") - 1) % 2 AS INTEGER) AS pos_in_pair FROM ({SHOTS_SQL}) s""",
)
def s2(t):
    path = scratch_path(t.spark, "shots")
    shots(t).select("row", "func", "target").write.json(path)
    return IO.read_shots(t.spark, path, "row")


@query(
    "s2_shots_by_line",
    f"""SELECT row_number() OVER (ORDER BY "row") - 1 AS "row", func, target, (row_number() OVER (ORDER BY "row") - 1) // 2 AS pair_id,
 CAST((row_number() OVER (ORDER BY "row") - 1) % 2 AS INTEGER) AS pos_in_pair FROM ({SHOTS_SQL}) s""",
)
def s2_lines(t):
    """The examples as they are kept, without a column of their order: several files, read line by line."""
    path = scratch_path(t.spark, "shots")
    shots(t).repartitionByRange(3, "row").sortWithinPartitions("row").select("func", "target").write.json(path)
    return IO.read_shots(t.spark, path)


@query("s3_read_responses", f"SELECT config, CAST(idx AS VARCHAR) AS idx, target, response FROM ({RESPONSES_SQL}) r")
def s3(t):
    """The log of every configuration, and one that does not exist."""
    path = scratch_path(t.spark, "log")
    rows = responses(t).select("config", F.col("idx").cast("string").alias("idx"), "target", "response")
    rows.write.partitionBy("config").json(path)
    logs = [IO.read_responses(t.spark, f"{path}/config={c}").select(F.lit(c).alias("config"), "*") for c in range(4)]
    return reduce(DataFrame.union, logs)


@query("s4_predictions", f"SELECT concat('idx: ', idx, ', pred: ', pred, ', target: ', target) AS value FROM ({PRED_SQL}) p")
def s4(t):
    path = scratch_path(t.spark, "predictions")
    IO.write_predictions(predicted(t), path)
    return t.spark.read.text(path)


@query("s5_metrics", f"SELECT config AS run, {COUNTS_SQL} FROM ({JUDGED_SQL}) j GROUP BY config")
def s5(t):
    """Written twice, and a third time that breaks off before its commit: one row a run stays."""
    path = scratch_path(t.spark, "metrics")
    rows = confusion(judged(t), ["config"]).withColumnRenamed("config", "run")
    IO.write_metrics(rows, path)
    IO.write_metrics(rows, path)
    IO.stage_runs(rows.withColumn("tp", F.col("tp") + 1), path, ["run"])
    return IO.read_runs(t.spark, path, ", ".join(f"{c} {kind}" for c, kind in rows.dtypes))


@query("s6_generations", f"SELECT config, idx, target, pred, CASE WHEN pred IS NULL THEN 'true' ELSE 'false' END AS invalid FROM ({JUDGED_SQL}) j")
def s6(t):
    path = scratch_path(t.spark, "generations")
    IO.write_generations(judged(t), path)
    back = t.spark.read.parquet(path)
    return back.withColumn("invalid", F.col("invalid").cast("string"))


@query(
    "s7_append_responses",
    f"""SELECT 'log' AS kept_in, CAST(idx AS VARCHAR) AS idx, target, response FROM ({RESPONSES_SQL}) r WHERE idx % 7 <> 0
 UNION ALL SELECT concat('run ', config), CAST(idx AS VARCHAR), target, response FROM ({RESPONSES_SQL}) r WHERE idx % 7 <> 0""",
)
def s7(t):
    """Three runs append to one log; each run's own copy is read too. Failed requests are not kept."""
    log = scratch_path(t.spark, "log")
    copies = []
    for config in range(3):
        own = scratch_path(t.spark, "run")
        asked = responses(t).where(F.col("config") == config).select(
            F.col("idx").cast("string").alias("idx"), "target", F.when(F.col("idx") % 7 != 0, F.col("response")).alias("response")
        )
        # The second run is sent again, as after a lost driver.
        for _ in range(1 + (config == 1)):
            IO.append_responses(asked, log, own, run=str(config))
        copies.append(IO.read_responses(t.spark, own).select(F.lit(f"run {config}").alias("kept_in"), "*"))
    return reduce(DataFrame.union, copies, IO.read_log(t.spark, log).select(F.lit("log").alias("kept_in"), "idx", "target", "response"))


@query("s8_history", LONG_SQL)
def s8(t):
    path = scratch_path(t.spark, "history")
    for _ in range(2):
        IO.write_history(wide(t), path)
    back = IO.read_runs(t.spark, path, ", ".join(f"{c} {kind}" for c, kind in to_history(wide(t), ("run", "epoch", "step")).dtypes))
    return back.withColumns({"run": F.col("run").cast("bigint"), "value": F.round("value", 9)})
