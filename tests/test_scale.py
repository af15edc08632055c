"""Order-dependent helpers on skewed keys and tiny blocks, against plain loops."""

import random

from pyspark.sql import functions as F

from verdigraph.operators import runs as R
from verdigraph.operators import scale as S
from verdigraph.operators.history import best_checkpoint, improvements, logged_steps


def skewed(n=3000, seed=5):
    rng = random.Random(seed)
    keys = ["hot" if rng.random() < 0.6 else rng.choice("abcdef") for _ in range(n)]
    rows, seen = [], {}
    for i, k in enumerate(keys):
        rows.append((k, seen.get(k, 0), round(rng.random(), 3), rng.random() < 0.5, rng.randint(0, 10**9), i))
        seen[k] = seen.get(k, 0) + 1
    return rows


SCHEMA = "k string, pos bigint, v double, failed boolean, draw bigint, id bigint"


def test_rank_rows(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, SCHEMA).drop("pos")
    ranked = S.rank_rows(df, ["draw", "id"], ["k"]).collect()
    for key in {r[0] for r in rows}:
        mine = sorted((r["pos"], r["id"]) for r in ranked if r["k"] == key)
        wanted = [r[5] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[4], r[5]))]
        assert [i for _, i in mine] == wanted and [p for p, _ in mine] == list(range(len(wanted)))
    overall = S.rank_rows(df, ["draw", "id"]).orderBy("pos").collect()
    assert [r["id"] for r in overall] == [r[5] for r in sorted(rows, key=lambda r: (r[4], r[5]))]


def test_running_crosses_blocks(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, SCHEMA)
    for include in (True, False):
        got = S.running(df, ["k"], "pos", sums={"s": F.lit(1)}, maxima={"m": F.col("v")}, include_row=include, block_rows=7).collect()
        for r in got:
            past = [x for x in rows if x[0] == r["k"] and (x[1] <= r["pos"] if include else x[1] < r["pos"])]
            assert r["s"] == (len(past) or None) and r["m"] == (max(x[2] for x in past) if past else None)


def test_cut_after_failures(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 3, 6, 40):
        wanted = set()
        for key in {r[0] for r in rows}:
            streak = 0
            for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
                if streak == n:
                    break
                streak = streak + 1 if r[3] else 0
                if not r[3]:
                    wanted.add(r[5])
        got = R.cut_after_failures(df, ["k"], "pos", "failed", n, block_rows=5).collect()
        assert {r["id"] for r in got} == wanted and len(got) == len(wanted)


def test_checkpoint_values(spark):
    rows = [("r", 1, 0.0), ("r", 2, 70.0), ("r", 3, 70.0), ("r", 4, 72.0), ("r", 5, 71.0), ("r", 6, 72.0), ("z", 1, 0.0)]
    df = spark.createDataFrame(rows, "run string, step bigint, bacc double")
    assert [tuple(r) for r in best_checkpoint(df).collect()] == [("r", 4, 72.0)]
    assert sorted(r["step"] for r in improvements(df, block_rows=2).collect()) == [2, 4]
    assert [r["step"] for r in improvements(df, start=71.7, block_rows=2).collect()] == [4]
    undefined = df.union(spark.createDataFrame([("r", 0, float("nan")), ("r", 9, float("nan"))], df.schema))
    assert [tuple(r) for r in best_checkpoint(undefined).collect()] == [("r", 4, 72.0)]
    assert sorted(r["step"] for r in improvements(undefined, block_rows=2).collect()) == [2, 4]


def test_logged_steps(spark):
    df = spark.createDataFrame([("r", 0, s) for s in range(5)], "run string, epoch bigint, step bigint")
    got = sorted((r["logged_step"], r["kind"]) for r in logged_steps(df, 2).collect())
    assert got == [(1, "step"), (3, "step"), (5, "epoch")]


def test_pending_batches_and_plan(spark):
    corpus = spark.range(10).withColumnRenamed("id", "idx")
    log = spark.createDataFrame([(1,), (1,), (3,)], "idx bigint")
    assert sorted(r[0] for r in R.pending(corpus, log).collect()) == [0, 2, 4, 5, 6, 7, 8, 9]
    assert [r["batch"] for r in R.batches(corpus, 4).orderBy("idx").collect()] == [0] * 4 + [1] * 4 + [2] * 2
    plan = R.run_plan(corpus, 3, 4).first()
    assert (plan["steps_per_epoch"], plan["total_steps"], round(plan["warmup_steps"], 6)) == (3, 9, 0.9)


def test_shuffle_is_seeded(spark):
    corpus = spark.range(50).withColumnRenamed("id", "idx")
    one = [r["idx"] for r in R.shuffle(corpus, 1).orderBy("pos").collect()]
    again = [r["idx"] for r in R.shuffle(corpus, 1).orderBy("pos").collect()]
    other = [r["idx"] for r in R.shuffle(corpus, 2).orderBy("pos").collect()]
    assert one == again and one != other and sorted(one) == list(range(50))


def test_rank_keeps_other_columns_and_null_keys(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), (5, 1, None)], "k bigint, o bigint, t string")
    got = sorted((r["t"] or "", r["pos"]) for r in S.rank_rows(df, ["o"], ["k"]).collect())
    assert got == [("", 0), ("a", 0), ("b", 1)]


def test_partitions_follow_the_text_and_stay(spark):
    rows = spark.createDataFrame([(i % 50 or None, "x" * 100) for i in range(400)] + [(7, None)], "idx bigint, func string")
    dealt = S.spread(rows, "idx", "func", part_bytes=1000)
    parts = dealt.select("idx", F.spark_partition_id().alias("p"))
    assert dealt.rdd.getNumPartitions() == 40 and dealt.count() == 401
    assert parts.groupBy("idx").agg(F.count_distinct("p").alias("n")).agg(F.max("n")).first()[0] == 1
    assert S.spread(rows.limit(0), "idx", "func").count() == 0
