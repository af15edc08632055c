"""Logistic regression by gradient steps against the same steps in numpy."""

import random

import numpy as np
import pytest

from verdigraph.operators.baseline import BIAS, logistic, logistic_weights, word_lists

TEXT = "idx int, func string, target int"


def texts(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(r.random() < 0.25)
        ws = [r.choice("abcdefgh") for _ in range(r.randint(0, 9))] + (["bad"] if y and r.random() < 0.9 else [])
        rows.append((i, None if i == 3 else "  ".join(ws), y))
    return rows


def by_hand(rows, penalty, rounds, rate):
    sets = [sorted(set((t or "").split())) for _, t, _ in rows]
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(set().union(*sets)))}
    x = np.zeros((len(rows), len(vocabulary) + 1))
    x[:, 0] = 1
    for i, s in enumerate(sets):
        for w in s:
            x[i, vocabulary[w]] = 1 / np.sqrt(len(s))
    y = np.array([r[2] for r in rows])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        w = w * (1 - rate * penalty) - rate * x.T @ ((1 / (1 + np.exp(-x @ w)) - y) * share)
    return {BIAS: w[0], **{v: w[i] for v, i in vocabulary.items()}}


def test_weights_equal_plain_steps(spark):
    rows = texts(1, 120)
    got = logistic_weights(word_lists(spark.createDataFrame(rows, TEXT)), [0.0, 0.05], 4, 3.0).collect()
    for i, p in enumerate([0.0, 0.05]):
        want = by_hand(rows, p, 4, 3.0)
        assert {r["token"] for r in got} == set(want)
        assert all(abs(r[f"w{i}"] - want[r["token"]]) < 1e-9 for r in got)


def test_a_telling_word_is_learned(spark):
    train, valid, test = (spark.createDataFrame(texts(s, n), TEXT) for s, n in ((1, 200), (2, 60), (3, 80)))
    got = logistic(train, valid, test).collect()
    assert len(got) == 80 and sum(r["pred"] == r["target"] for r in got) > 66 and got[0]["valid_bacc"] > 0.8


def test_one_class_and_no_rounds(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], TEXT)
    got = logistic(rows, rows, spark.createDataFrame([(7, "c", 0)], TEXT), rounds=2).collect()
    assert [(r["idx"], r["pred"]) for r in got] == [(7, 1)]
    with pytest.raises(ValueError):
        logistic_weights(word_lists(rows), [0.0], 0, 1.0)
