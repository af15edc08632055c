"""Confusion counts, metrics and their course along a run."""

from pyspark.sql import functions as F

from verdigraph.functions.answers import simple_verdict
from verdigraph.functions.scores import verdict
from verdigraph.operators import history as H
from verdigraph.operators import metrics as M
from verdigraph.plans.fixtures import CORPUS_SQL, HISTORY_SQL, RESPONSES_SQL, SCORED_SQL, STEPS_SQL, corpus, history, in_buckets, responses, scored, steps
from verdigraph.plans.registry import query
from verdigraph.sources import log_lines

SIMPLE_SQL = """CASE WHEN contains(lower(response), 'yes') OR contains(lower(response), 'is vulnerable') OR contains(lower(response), 'true') THEN 1
 WHEN contains(lower(response), 'no') OR contains(lower(response), 'is not vulnerable') OR contains(lower(response), 'false') THEN 0 END"""
JUDGED_SQL = f"SELECT config, idx, target, {SIMPLE_SQL} AS pred FROM ({RESPONSES_SQL}) r"
PRED_SQL = f"SELECT idx, target, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM ({SCORED_SQL}) s"
COUNTS_SQL = """count(CASE WHEN pred = 0 AND target = 0 THEN 1 END) AS tn, count(CASE WHEN pred = 1 AND target = 0 THEN 1 END) AS fp,
 count(CASE WHEN pred = 0 AND target = 1 THEN 1 END) AS fn, count(CASE WHEN pred = 1 AND target = 1 THEN 1 END) AS tp"""


def fractions_sql(source: str, keep: str) -> str:
    """Metrics over a relation with tn, fp, fn, tp."""

    def ratio(top, bottom, empty):
        return f"CASE WHEN {bottom} = 0 THEN {empty} ELSE CAST({top} AS DOUBLE) / ({bottom}) END"

    nan = "'NaN'::DOUBLE"
    recall, tnr = ratio("tp", "tp + fn", "0.0"), ratio("tn", "tn + fp", nan)
    return f"""SELECT {keep}, tn, fp, fn, tp, {ratio('tp + tn', 'tn + fp + fn + tp', nan)} AS acc, {ratio('tp', 'tp + fp', '0.0')} AS prec,
 {recall} AS recall, {ratio('2 * tp', '2 * tp + fp + fn', '0.0')} AS f1, {tnr} AS tnr, {ratio('fp', 'fp + tn', nan)} AS fpr,
 {ratio('fn', 'tp + fn', nan)} AS fnr, (({recall}) + ({tnr})) / 2 AS bacc FROM ({source}) counted"""


def judged(t):
    return responses(t).select("config", "idx", "target", simple_verdict(F.col("response")).alias("pred"))


def predicted(t):
    return scored(t).select("idx", "target", verdict(F.col("score")).alias("pred"))


def rounded(df, digits=9):
    """Metrics to nine places; an undefined one as null."""
    return df.withColumns({m: F.round(F.nanvl(F.col(m), F.lit(None)), digits) for m in M.METRICS})


def rounded_sql(source: str, keep: str, scale: str = "") -> str:
    cols = ", ".join(f"round(CASE WHEN isnan({m}) THEN NULL ELSE {m}{scale} END, 9) AS {m}" for m in M.METRICS)
    return f"SELECT {keep}, {cols} FROM ({source}) metrics"


@query("m1_confusion", f"SELECT config, {COUNTS_SQL} FROM ({JUDGED_SQL}) j GROUP BY config")
def m1(t):
    return M.confusion(judged(t), ["config"])


@query(
    "m2_metrics_pct",
    "SELECT g, tn, fp, fn, tp, "
    + ", ".join(f"round(CASE WHEN isnan({m}) THEN NULL ELSE round_even({m}, 4) * 100 END, 6) AS {m}" for m in M.METRICS)
    + f" FROM ({fractions_sql(f'SELECT idx % 5 AS g, {COUNTS_SQL} FROM ({PRED_SQL}) p GROUP BY 1', 'g')}) f",
)
def m2(t):
    return rounded(M.metrics_pct(predicted(t).withColumn("g", F.col("idx") % 5), ["g"]), 6)


FRAC_SQL = f"""SELECT config, {COUNTS_SQL}, count(CASE WHEN pred IS NULL THEN 1 END) AS n_invalid, count(*) AS n_total FROM ({JUDGED_SQL}) j GROUP BY config"""


@query(
    "m3_metrics_frac",
    rounded_sql(
        fractions_sql(FRAC_SQL, "config, n_invalid, n_total"),
        "config, tn, fp, fn, tp, n_invalid, n_total, CAST(n_invalid AS DOUBLE) / n_total AS invalid_ratio",
    ),
)
def m3(t):
    return rounded(M.metrics_frac(judged(t), ["config"]))


MODEL_EXPR = "CASE idx % 4 WHEN 0 THEN 'gpt-3.5' WHEN 1 THEN 'CodeLlama' WHEN 2 THEN 'Mistral' ELSE 'WizardCoder' END"
SETUP_EXPR = "CASE config WHEN 0 THEN 'None' WHEN 1 THEN 'data_flow' ELSE 'api_call' END"
BY = ["model", "graph_type"]


@query(
    "m4_metrics_by_setup",
    rounded_sql(
        fractions_sql(
            f"""SELECT {MODEL_EXPR} AS model, {SETUP_EXPR} AS graph_type, {COUNTS_SQL}, count(CASE WHEN pred IS NULL THEN 1 END) AS n_invalid, count(*) AS n_total
 FROM ({JUDGED_SQL}) j GROUP BY 1, 2""",
            "model, graph_type, n_invalid, n_total",
        ),
        "model, graph_type, tn, fp, fn, tp, n_invalid, n_total, CAST(n_invalid AS DOUBLE) / n_total AS invalid_ratio",
    ),
)
def m4(t):
    named = judged(t).withColumns({"model": F.expr(MODEL_EXPR), "graph_type": F.expr(SETUP_EXPR)})
    return rounded(M.metrics_by(named, BY))


ASKED_SQL = f"""SELECT a.config, a.idx, a.target, {SIMPLE_SQL} AS pred FROM (SELECT idx, target, unnest([0, 1, 2]) AS config FROM ({CORPUS_SQL}) c) a
 LEFT JOIN (SELECT config, idx, response FROM ({RESPONSES_SQL}) r WHERE (idx + config) % 7 <> 0) l ON l.config = a.config AND l.idx = a.idx"""


R8_SQL = rounded_sql(
    fractions_sql(
        f"SELECT config, {COUNTS_SQL}, count(CASE WHEN pred IS NULL THEN 1 END) AS n_invalid, count(*) AS n_total FROM ({ASKED_SQL}) j GROUP BY config",
        "config, n_invalid, n_total",
    ),
    "config, tn, fp, fn, tp, n_invalid, n_total, CAST(n_invalid AS DOUBLE) / n_total AS invalid_ratio",
)


@query("r8_evaluate", R8_SQL)
def r8(t):
    """Some rows have no line in the log at all."""
    return rounded(M.evaluate(corpus(t), partial_log(t), range(3)))


def partial_log(t):
    return responses(t).where((F.col("idx") + F.col("config")) % 7 != 0).select("config", "idx", "response")


@query("r8_bucketed", R8_SQL)
def r8_bucketed(t):
    """Corpus and log written in the same buckets: only counts move."""
    rows = in_buckets(t, "corpus", corpus(t).select("idx", "target"))
    return rounded(M.evaluate(rows, in_buckets(t, "log", log_lines(partial_log(t))), range(3)))


def _cumulative(name: str, cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER (PARTITION BY run, epoch ORDER BY step) AS BIGINT) AS {name}"


RUNNING_SQL = "SELECT run, epoch, step, " + ", ".join(
    _cumulative(n, f"pred = {p} AND target = {y}") for n, p, y in (("tn", 0, 0), ("fp", 1, 0), ("fn", 0, 1), ("tp", 1, 1))
) + f" FROM ({STEPS_SQL}) s"


@query(
    "m5_running_metrics",
    rounded_sql(fractions_sql(RUNNING_SQL, "run, epoch, step"), "run, epoch, step, tn, fp, fn, tp"),
)
def m5(t):
    return rounded(H.running_metrics(steps(t))).drop("pred", "target")


@query(
    "m6_running_loss",
    f"""SELECT run, epoch, step, loss, round(avg(loss) OVER (PARTITION BY run, epoch ORDER BY step), 9) AS avg_loss FROM ({STEPS_SQL}) s""",
)
def m6(t):
    return H.running_loss(steps(t), digits=None).withColumn("avg_loss", F.round("avg_loss", 9))


@query(
    "m7_logged_steps",
    f"""SELECT run, epoch, step AS logged_step, 'step' AS kind FROM ({STEPS_SQL}) s WHERE (step + 1) % 7 = 0
 UNION ALL SELECT run, epoch, max(step) + 1, 'epoch' FROM ({STEPS_SQL}) s GROUP BY run, epoch""",
)
def m7(t):
    return H.logged_steps(steps(t).select("run", "epoch", "step"), 7)


@query(
    "m8_best_checkpoint",
    f"""SELECT run, step AS best_step, bacc AS best_bacc FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY bacc DESC, step) AS rn
 FROM ({HISTORY_SQL}) h WHERE bacc > 71.7) r WHERE rn = 1""",
)
def m8(t):
    return H.best_checkpoint(history(t), start=71.7)


@query(
    "m8_improvements",
    f"""SELECT run, step, bacc FROM (SELECT *, max(bacc) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past
 FROM ({HISTORY_SQL}) h) r WHERE bacc > greatest(coalesce(past, 0), 0)""",
)
def m8_log(t):
    return H.improvements(history(t), block_rows=256)


# Wide scalars per run and epoch, as a log writer would receive them.
EPOCH_EXPR = "CAST(floor(event_id / 500) AS BIGINT)"


def wide(t):
    """run, epoch, step and train_/valid_ columns of every logged scalar."""
    rows = t.events.select(
        (F.col("user_id") % 20).alias("run"), F.expr(EPOCH_EXPR).alias("epoch"),
        F.when(F.col("event_id") % 5 < 4, "train").otherwise("valid").alias("split"),
        (F.col("event_id") % 3 == 0).cast("int").alias("pred"), (F.col("event_id") % 2).alias("target"), "value",
    )
    parts = []
    for split in H.SPLITS:
        here = F.col("split") == split
        parts += [F.avg(F.when(here, F.col("value"))).alias(f"{split}_loss")]
        parts += [
            F.count_if(here & (F.col("pred") == p) & (F.col("target") == y)).alias(f"{split}_{n}")
            for n, p, y in (("tn", 0, 0), ("fp", 1, 0), ("fn", 0, 1), ("tp", 1, 1))
        ]
    out = rows.groupBy("run", "epoch").agg(*parts)
    for split in H.SPLITS:
        out = out.withColumnsRenamed({f"{split}_{n}": n for n in M.COUNTS})
        out = rounded(M.with_fractions(out))
        out = out.withColumnsRenamed({c: f"{split}_{c}" for c in (*M.METRICS, *M.COUNTS)})
    return out.withColumn("step", F.col("epoch") * 500)


def _wide_sql() -> str:
    longs = []
    for split, cond in (("train", "event_id % 5 < 4"), ("valid", "event_id % 5 >= 4")):
        source = f"""SELECT user_id % 20 AS run, {EPOCH_EXPR} AS epoch, avg(CASE WHEN {cond} THEN value END) AS loss,
 count(CASE WHEN {cond} AND NOT (event_id % 3 = 0) AND event_id % 2 = 0 THEN 1 END) AS tn, count(CASE WHEN {cond} AND event_id % 3 = 0 AND event_id % 2 = 0 THEN 1 END) AS fp,
 count(CASE WHEN {cond} AND NOT (event_id % 3 = 0) AND event_id % 2 = 1 THEN 1 END) AS fn, count(CASE WHEN {cond} AND event_id % 3 = 0 AND event_id % 2 = 1 THEN 1 END) AS tp
 FROM events GROUP BY 1, 2"""
        base = rounded_sql(fractions_sql(source, "run, epoch, loss"), "run, epoch, round(loss, 9) AS loss")
        for shown, name in H.LOGGED.items():
            longs.append(f"SELECT run, epoch, epoch * 500 AS step, '{shown}' AS metric, '{split}' AS split, {name} AS value FROM ({base}) b")
    return " UNION ALL ".join(longs)


LONG_SQL = _wide_sql()


def long_history(t):
    long = H.to_history(wide(t), ["run", "epoch", "step"])
    return long.withColumn("value", F.round("value", 9))


@query("s8_history_long", LONG_SQL)
def s8(t):
    return long_history(t)


@query(
    "m9_train_vs_valid",
    f"""SELECT run, epoch, step, metric, max(CASE WHEN split = 'train' THEN value END) AS train,
 max(CASE WHEN split = 'valid' THEN value END) AS valid FROM ({LONG_SQL}) l GROUP BY run, epoch, step, metric""",
)
def m9(t):
    return H.train_vs_valid(long_history(t))


@query(
    "r7_invalid_ratio",
    f"""SELECT config, count(CASE WHEN pred IS NULL AND NOT failed THEN 1 END) AS n_invalid, count(*) AS n_total,
 CAST(count(CASE WHEN pred IS NULL AND NOT failed THEN 1 END) AS DOUBLE) / count(*) AS invalid_ratio
 FROM (SELECT config, idx % 9 = 0 AS failed, CASE WHEN idx % 9 = 0 THEN NULL ELSE pred END AS pred FROM ({JUDGED_SQL}) j) f GROUP BY config""",
)
def r7(t):
    failed = F.col("idx") % 9 == 0
    rows = judged(t).select("config", failed.alias("failed"), F.when(~failed, F.col("pred")).alias("pred"))
    return M.invalid_ratio(rows, ["config"], failed="failed")
