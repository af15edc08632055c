import math
import random

from pyspark.sql import functions as F

from verdigraph.functions import arrays, scores
from verdigraph.functions.numeric import py_round
from verdigraph.operators import metrics as M


def test_py_round(column):
    rng = random.Random(3)
    xs = [rng.random() for _ in range(2000)] + [0.00015, 0.03125, 0.5, 0.12345, 0.00005, 1.0, 0.0, 2 / 3]
    xs += [k / 64 for k in range(64)] + [(2 * k + 1) / 20000 for k in range(3000)]
    assert column(xs, lambda c: py_round(c, 4), "double") == [round(x, 4) for x in xs]
    assert column(xs, lambda c: py_round(c, 5), "double") == [round(x, 5) for x in xs]
    assert math.isnan(column([float("nan")], lambda c: py_round(c, 4), "double")[0])


def test_verdict_is_strict(column):
    assert column([0.5, 0.5000001, 0.49, float("nan")], scores.verdict, "double") == [0, 1, 0, 0]


def test_softmax_survives_large_logits(column):
    assert column([[1000.0, 1000.0]], scores.softmax, "array<double>") == [[0.5, 0.5]]


def test_keep_last_eos(column):
    got = column([[5, 2, 6, 2], [5, 2, 6], [2, 2, 2], []], lambda c: arrays.keep_last_eos(c, width=6), "array<bigint>")
    assert got == [[5, 6, 2, 0, 0, 0], [5, 2, 6], [2, 0, 0, 0, 0, 0], []]


def test_last_token_pos(column):
    assert column([[5, 6, 1, 1], [5, 6], [1, 5]], lambda c: arrays.last_token_pos(c, 1), "array<bigint>") == [1, 1, 1]


def test_metrics_without_one_class(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("b", 1, 1), ("b", None, 1)], "g string, pred int, target int")
    got = {r["g"]: r for r in M.metrics_frac(rows, ["g"]).collect()}
    assert (got["a"]["recall"], got["a"]["prec"], got["a"]["f1"], got["a"]["tnr"]) == (0.0, 0.0, 0.0, 0.5)
    assert math.isnan(got["a"]["fnr"]) and math.isnan(got["b"]["tnr"]) and math.isnan(got["b"]["bacc"])
    assert (got["b"]["tp"], got["b"]["n_invalid"], got["b"]["invalid_ratio"], got["b"]["acc"]) == (1, 1, 0.5, 1.0)


def test_metrics_pct_rounds_then_scales(spark):
    rows = spark.createDataFrame([(1, 1), (0, 1), (0, 1)], "pred int, target int")
    assert M.metrics_pct(rows).first()["recall"] == round(1 / 3, 4) * 100


def test_failed_rows_stay_in_the_total(spark):
    rows = spark.createDataFrame([(1, False), (None, False), (None, True), (0, False)], "pred int, failed boolean")
    got = M.invalid_ratio(rows, failed="failed").first()
    assert (got["n_invalid"], got["n_total"], got["invalid_ratio"]) == (1, 4, 0.25)
