"""Bucketed tables: resume and evaluation read them in place."""

import re

from verdigraph import sources as IO
from verdigraph.operators.metrics import evaluate
from verdigraph.operators.runs import pending
from verdigraph.session import scratch_path


def stored(spark, name, df):
    path = scratch_path(spark, name)
    return path, IO.write_buckets(df, path, path.rsplit("/", 1)[1].replace("-", "_"), 4)


def exchanges(df):
    """What each exchange of the plan deals by."""
    return re.findall(r"Exchange (\w+)(?:\((.*?), \d+\))?", df._jdf.queryExecution().executedPlan().toString())


def tables(spark):
    corpus = spark.createDataFrame([(i, f"f{i}", i % 2) for i in range(300)], "idx bigint, func string, target int")
    said = [(c, i, ("yes", "no", "unclear")[(i + c) % 3]) for c in range(3) for i in range(300) if (i + c) % 7]
    log = spark.createDataFrame(said + [(0, 5, "a yes")] * 400 + [(9, 4, "no"), (1, 999, "no"), (1, 6, None)], "config int, idx bigint, response string")
    return corpus, log


def test_stored_log_has_one_line_a_row(spark):
    log = tables(spark)[1]
    assert IO.log_lines(log).where("config = 0 and idx = 5").collect()[0]["response"] == "a yes"
    assert IO.log_lines(log).count() == log.select("config", "idx").distinct().count()


def test_resume_and_evaluation_do_not_move_buckets(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        corpus, log = tables(spark)
        _, rows = stored(spark, "corpus", corpus)
        path, lines = stored(spark, "log", IO.log_lines(log))
        left = pending(rows, lines.where("idx % 3 = 0"))
        assert exchanges(left) == []
        plain = pending(corpus, log.where("idx % 3 = 0"))
        assert sorted(left.collect()) == sorted(plain.collect()) and 0 < left.count() < 300
        judged = evaluate(rows, lines, range(3))
        assert [by for _, by in exchanges(judged)] and all(by.startswith("config") for _, by in exchanges(judged))
        assert sorted(judged.collect()) == sorted(evaluate(corpus, log, range(3)).collect())
        again = IO.open_buckets(spark, path, "log_again", "config int, idx bigint, response string", 4)
        assert exchanges(pending(rows, again)) == [] and sorted(again.collect(), key=str) == sorted(lines.collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
