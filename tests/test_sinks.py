"""Keyed sinks, lines in order, and the failure cut over a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from verdigraph import sources as IO
from verdigraph.operators.runs import cut_after_failures
from verdigraph.session import scratch_path
from verdigraph.streaming import FailureCut

SCHEMA = "run string, setup int, acc double"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_repeated_write_replaces_its_keys(spark):
    path = scratch_path(spark, "runs")
    assert rows_of(IO.read_runs(spark, path, SCHEMA, ("run", "setup"))) == []
    first = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), (None, 1, 0.1)], SCHEMA)
    for _ in range(2):
        IO.write_metrics(first, path, ("run", "setup"))
    assert rows_of(IO.read_runs(spark, path, SCHEMA, ("run", "setup")).where("run is not null")) == [("a", 1, 0.5), ("a", 2, 0.6)]
    IO.write_metrics(spark.createDataFrame([("a", 2, 0.9), ("b", 1, 0.7)], SCHEMA), path, ("run", "setup"))
    got = IO.read_runs(spark, path, SCHEMA, ("run", "setup"))
    assert rows_of(got.where("run is not null")) == [("a", 1, 0.5), ("a", 2, 0.9), ("b", 1, 0.7)] and got.where("run is null").count() == 1


def test_a_write_without_commit_is_not_seen(spark):
    path = scratch_path(spark, "runs")
    df = spark.createDataFrame([("a", 1, 0.5)], SCHEMA)
    attempt = IO.stage_runs(df, path, ["run"])
    assert rows_of(IO.read_runs(spark, path, SCHEMA)) == []
    IO.write_runs(df.withColumn("acc", F.lit(0.8)), path)
    IO.stage_runs(df.withColumn("acc", F.lit(0.1)), path, ["run"])
    assert rows_of(IO.read_runs(spark, path, SCHEMA)) == [("a", 1, 0.8)]
    IO.commit_runs(spark, path, attempt, ["run"], "setup int, acc double, run string, attempt string")
    assert rows_of(IO.read_runs(spark, path, SCHEMA)) == [("a", 1, 0.5)]


def test_a_log_takes_a_run_once(spark):
    log, own = scratch_path(spark, "log"), scratch_path(spark, "own")
    answers = spark.createDataFrame([("1", 0, "yes"), ("2", 1, None), ("3", 1, "no")], "idx string, target int, response string")
    for run in ("x", "x", "y"):
        IO.append_responses(answers, log, own + run, run=run)
    assert rows_of(IO.read_log(spark, log)) == [(r, i, t, a) for r in "xy" for i, t, a in (("1", 0, "yes"), ("3", 1, "no"))]


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_lines_stay_in_order_whatever_the_splits(spark, tmp_path, split):
    r = random.Random(3)
    want = []
    for name in ("b", "a", "c"):
        rows = [{"func": f"{name}{i} " + "é x" * r.randint(0, 30), "target": i % 2} for i in range(r.randint(20, 60))]
        text = "\n\n".join(json.dumps(x, ensure_ascii=False) for x in rows)
        (tmp_path / f"{name}.jsonl").write_text(text + "\n" * (name == "a"), encoding="utf-8")
        want.append((name, [x["func"] for x in rows]))
    want = [f for _, funcs in sorted(want) for f in funcs]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sorted(IO.read_shots(spark, str(tmp_path)).collect(), key=lambda x: (x["pair_id"], x["pos_in_pair"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [x["func"] for x in got] == want
    assert [(x["pair_id"], x["pos_in_pair"]) for x in got] == [(i // 2, i % 2) for i in range(len(want))]


def test_a_line_that_is_no_example_is_an_error(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"func": "a", "target": 1}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED|parse"):
        IO.read_shots(spark, str(tmp_path)).collect()


def test_failure_cut_over_triggers(spark):
    r = random.Random(6)
    attempts = []
    for run in range(6):
        attempts += [(run, p, r.random() < (0.2, 0.5, 0.7, 0.9, 1.0, 0.0)[run]) for p in range(r.randint(1, 60))]
    schema = "run int, pos bigint, failed boolean"
    want = rows_of(cut_after_failures(spark.createDataFrame(attempts, schema), n=4))
    root = scratch_path(spark, "cut")
    cut = FailureCut(root, n=4)
    for number, start in enumerate(range(0, 60, 13)):
        part = spark.createDataFrame([a for a in attempts if start <= a[1] < start + 13], schema).repartition(3)
        cut(part, number)
        if number == 2:
            cut(part, number)  # a trigger that is run again
    got = spark.read.schema(schema).parquet(f"{root}/kept")
    assert rows_of(got.select("run", "pos", "failed")) == want


def test_failure_state_expires(spark):
    schema = "run int, pos bigint, failed boolean"
    cut = FailureCut(scratch_path(spark, "cut"), n=2, expiry=1)
    cut(spark.createDataFrame([(1, 0, True), (1, 1, True), (2, 0, False)], schema), 0)
    cut(spark.createDataFrame([(1, 2, False)], schema), 1)
    state = cut.state(spark.createDataFrame([], schema), 2)
    assert rows_of(state) == [(1, 2, True, 1), (2, 0, False, 0)] or rows_of(state) == [(1, 2, True, 1)]
    cut(spark.createDataFrame([(3, 0, False)], schema), 2)
    assert {x["run"] for x in cut.state(spark.createDataFrame([], schema), 3).collect()} == {3}
