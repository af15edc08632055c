"""Run control, the answer stream and the baseline classifier."""

from pyspark.sql import functions as F

from verdigraph import sources as IO
from verdigraph.operators import runs as R
from verdigraph.operators.baseline import bayes, fit_baseline, logistic, score_baseline
from verdigraph.operators.metrics import metrics_pct
from verdigraph.plans import sqltext as S
from verdigraph.plans.budgets import SPLIT_EXPR
from verdigraph.plans.fixtures import CORPUS_SQL, RESPONSES_SQL, STEPS_SQL, corpus, in_buckets, responses, steps
from verdigraph.plans.measuring import COUNTS_SQL, JUDGED_SQL
from verdigraph.plans.registry import query
from verdigraph.session import scratch_path
from verdigraph.streaming.failures import cut_stream
from verdigraph.streaming.scoring import drain_to_table, score_stream


@query(
    "c1_bucketed",
    f"SELECT c.idx, c.func, c.target FROM ({CORPUS_SQL}) c WHERE c.idx NOT IN (SELECT idx FROM ({RESPONSES_SQL}) r WHERE idx % 3 = 0)",
)
def c1_bucketed(t):
    """Corpus and log lie in the same buckets, so resuming moves neither."""
    log = IO.log_lines(responses(t).where(F.col("idx") % 3 == 0).select("config", "idx", "response"))
    return R.pending(in_buckets(t, "corpus", corpus(t)), in_buckets(t, "log", log))


@query(
    "c1_pending",
    f"SELECT c.idx, c.func, c.target FROM ({CORPUS_SQL}) c WHERE c.idx NOT IN (SELECT idx FROM ({RESPONSES_SQL}) r WHERE idx % 3 = 0)",
)
def c1(t):
    return R.pending(corpus(t), responses(t).where(F.col("idx") % 3 == 0))


C2_SQL = f"""WITH s AS ({STEPS_SQL}), f AS (SELECT run, step, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM s),
 cut AS (SELECT run, min(step) AS at FROM f WHERE n = 3 GROUP BY run)
 SELECT s.run, s.step, s.loss FROM s LEFT JOIN cut ON s.run = cut.run WHERE NOT s.failed AND (cut.at IS NULL OR s.step < cut.at)"""


@query("c2_cut_after_failures", C2_SQL)
def c2(t):
    return R.cut_after_failures(steps(t), pos="step", n=3).select("run", "step", "loss")


STEPS_SLICES = 4


@query("c2_stream", C2_SQL)
def c2_stream(t):
    """The attempts arrive in parts, later steps later; each part is a trigger."""
    folder = scratch_path(t.spark, "attempts")
    rows = steps(t).select("run", "step", "loss", "failed")
    width = rows.agg(F.ceil((F.max("step") + 1) / STEPS_SLICES).alias("w")).first()["w"] or 1
    for part in range(STEPS_SLICES):
        rows.where(F.floor(F.col("step") / width) == part).repartition(2).write.mode("append").parquet(folder)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "2").parquet(folder)
    return cut_stream(stream, pos="step", n=3).select("run", "step", "loss")


@query(
    "c3_shuffle",
    "SELECT doc_id AS idx, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) - 1 AS pos FROM documents",
)
def c3(t):
    return R.shuffle(t.documents.select(F.col("doc_id").alias("idx")), 42)


@query("c3_in_order", "SELECT event_id AS idx, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events")
def c3_in_order(t):
    return R.in_order(t.events.select(F.col("event_id").alias("idx")))


@query(
    "c4_batches",
    "SELECT doc_id AS idx, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents",
)
def c4(t):
    return R.batches(t.documents.select(F.col("doc_id").alias("idx")), 32).select("idx", "batch")


@query(
    "c5_run_plan",
    f"""SELECT split, n_examples, CAST(ceil(n_examples / 64) AS BIGINT) AS steps_per_epoch, CAST(ceil(n_examples / 64) AS BIGINT) * 10 AS total_steps,
 round(CAST(ceil(n_examples / 64) AS BIGINT) * 10 * 0.1::DOUBLE, 9) AS warmup_steps
 FROM (SELECT {SPLIT_EXPR} AS split, count(*) AS n_examples FROM ({CORPUS_SQL}) c GROUP BY 1) s""",
)
def c5(t):
    plan = R.run_plan(corpus(t).withColumn("split", F.expr(SPLIT_EXPR)), 10, 64, by=["split"])
    return plan.withColumn("warmup_steps", F.round("warmup_steps", 9))


@query(
    "c6_stream_scores",
    f"""SELECT config, {COUNTS_SQL}, count(CASE WHEN pred IS NULL THEN 1 END) AS n_invalid, count(*) AS n_total
 FROM (SELECT CAST(config AS VARCHAR) AS config, pred, target FROM ({JUDGED_SQL}) j) s GROUP BY config""",
)
def c6(t):
    """The log arrives as several files; one third of it is sent twice."""
    spark = t.spark
    folder = scratch_path(spark, "answer-log")
    log = responses(t).withColumn("config", F.col("config").cast("string"))
    log.write.mode("append").json(folder)
    log.where(F.col("idx") % 3 == 0).write.mode("append").json(folder)
    schema = "config string, idx bigint, target int, response string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "64").json(folder)
    return drain_to_table(score_stream(stream))


ALPHAS = (0.1, 1.0)


def _score_sql(alpha: float, split: str) -> str:
    odds = f"ln((c1 + {alpha}::DOUBLE) / (t1 + {alpha}::DOUBLE * v)) - ln((c0 + {alpha}::DOUBLE) / (t0 + {alpha}::DOUBLE * v))"
    return f"""SELECT e.idx, e.target, round(coalesce(sum({odds}), 0.0) + any_value(p), 6) AS score FROM (SELECT idx, target, unnest(l) AS token FROM toks WHERE split = '{split}') e
 LEFT JOIN counts USING (token), totals, prior GROUP BY 1, 2"""


def _bacc_sql(source: str) -> str:
    rate = "CAST(count(CASE WHEN target = {0} AND (score > 0) = {1} THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN target = {0} THEN 1 END), 0)"
    return f"SELECT round(coalesce((coalesce({rate.format(1, 'true')}, 0.0) + {rate.format(0, 'false')}) / 2, 0.0), 9) AS bacc FROM ({source}) s"


BAYES_SQL = f"""WITH toks AS (SELECT idx, target, {SPLIT_EXPR} AS split, {S.words('func')} AS l FROM ({CORPUS_SQL}) c),
 counts AS (SELECT token, count(CASE WHEN target = 0 THEN 1 END) AS c0, count(CASE WHEN target = 1 THEN 1 END) AS c1
  FROM (SELECT target, unnest(l) AS token FROM toks WHERE split = 'train') e GROUP BY token),
 totals AS (SELECT sum(c0) AS t0, sum(c1) AS t1, count(*) AS v FROM counts),
 prior AS (SELECT ln(count(CASE WHEN target = 1 THEN 1 END)) - ln(count(CASE WHEN target = 0 THEN 1 END)) AS p FROM toks WHERE split = 'train'),
 tried AS ({' UNION ALL '.join(f"SELECT {i} AS i, {a}::DOUBLE AS alpha, b.bacc FROM ({_bacc_sql(_score_sql(a, 'valid'))}) b" for i, a in enumerate(ALPHAS))}),
 best AS (SELECT alpha, bacc FROM tried ORDER BY bacc DESC, i LIMIT 1),
 tested AS ({' UNION ALL '.join(f"SELECT {a}::DOUBLE AS alpha, x.* FROM ({_score_sql(a, 'test')}) x" for a in ALPHAS)})
 SELECT idx, target, CASE WHEN score > 0 THEN 1 ELSE 0 END AS pred, alpha, bacc AS valid_bacc FROM tested JOIN best USING (alpha)"""


@query("c7_baseline", BAYES_SQL)
def c7(t):
    return bayes(*_splits(t), ALPHAS).select("idx", "target", "pred", "alpha", "valid_bacc")


PENALTIES, ROUNDS, RATE = (0.0, 0.01), 6, 4.0


def _logistic_sql() -> str:
    """The steps one after the other: margins of the texts, slopes of the words, weights."""
    n = range(len(PENALTIES))
    value = "CASE WHEN f.token = '' THEN 1.0::DOUBLE ELSE f.x END"
    margins = ", ".join(f"coalesce(sum(w.w{i} * {value}), 0.0) AS m{i}" for i in n)
    parts = [
        f"lists AS (SELECT idx, target, {SPLIT_EXPR} AS split, list_distinct({S.words('func')}) AS l FROM ({CORPUS_SQL}) c)",
        "feats AS MATERIALIZED (SELECT idx, target, split, 1.0::DOUBLE / sqrt(greatest(len(l), 1)) AS x, unnest(list_prepend('', l)) AS token FROM lists)",
        "sizes AS (SELECT target, 0.5::DOUBLE / count(*) AS share FROM lists WHERE split = 'train' GROUP BY target)",
    ]
    for k in range(ROUNDS):
        if k == 0:
            held = "SELECT idx, " + ", ".join(f"0.0::DOUBLE AS m{i}" for i in n) + " FROM lists WHERE split = 'train'"
        else:
            held = f"SELECT f.idx, {margins} FROM feats f JOIN w{k} w ON w.token = f.token WHERE f.split = 'train' GROUP BY f.idx"
        slopes = ", ".join(f"sum((1.0::DOUBLE / (exp(-h.m{i}) + 1) - f.target) * s.share * ({value})) AS g{i}" for i in n)
        parts.append(f"g{k} AS MATERIALIZED (SELECT f.token, {slopes} FROM feats f JOIN ({held}) h ON h.idx = f.idx JOIN sizes s ON s.target = f.target GROUP BY f.token)")
        old = [f"w.w{i} * {1.0 - RATE * p}::DOUBLE" if k else "0.0::DOUBLE" for i, p in enumerate(PENALTIES)]
        stepped = ", ".join(f"{old[i]} - g.g{i} * {RATE}::DOUBLE AS w{i}" for i in n)
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT g.token, {stepped} FROM g{k} g{f' JOIN w{k} w ON w.token = g.token' if k else ''})")
    scored = "SELECT f.idx, any_value(f.target) AS target, round(coalesce(sum(w.w{0} * ({1})), 0.0), 6) AS score FROM feats f LEFT JOIN w{2} w ON w.token = f.token WHERE f.split = '{3}' GROUP BY f.idx"
    tried = [f"SELECT {i} AS i, {p}::DOUBLE AS penalty, b.bacc FROM ({_bacc_sql(scored.format(i, value, ROUNDS, 'valid'))}) b" for i, p in enumerate(PENALTIES)]
    tested = [f"SELECT {p}::DOUBLE AS penalty, x.* FROM ({scored.format(i, value, ROUNDS, 'test')}) x" for i, p in enumerate(PENALTIES)]
    parts += [
        f"tried AS ({' UNION ALL '.join(tried)})", "best AS (SELECT penalty, bacc FROM tried ORDER BY bacc DESC, i LIMIT 1)",
        f"tested AS ({' UNION ALL '.join(tested)})",
    ]
    return f"WITH {', '.join(parts)} SELECT idx, target, score, CASE WHEN score > 0 THEN 1 ELSE 0 END AS pred, penalty, bacc AS valid_bacc FROM tested JOIN best USING (penalty)"


def _splits(t):
    rows = corpus(t).withColumn("split", F.expr(SPLIT_EXPR))
    return [rows.where(F.col("split") == s) for s in ("train", "valid", "test")]


@query("c7_logistic", _logistic_sql())
def c7_logistic(t):
    return logistic(*_splits(t), PENALTIES, ROUNDS, RATE).select("idx", "target", "score", "pred", "penalty", "valid_bacc")


@query("c7_hashed")
def c7_hashed(t):
    """Hashed words and a numeric solver, whose steps SQL cannot follow."""
    train, valid, test = _splits(t)
    fitted = fit_baseline(train, valid)
    return metrics_pct(score_baseline(fitted, test)).withColumns({"reg": F.lit(fitted.reg), "valid_bacc": F.lit(fitted.valid_bacc)})
