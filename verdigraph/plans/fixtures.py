"""Inputs of the registered queries, derived from the given tables.

Expressions written as text read the same in Spark SQL and in the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.operators.scale import rank_rows
from verdigraph.plans.registry import Tables
from verdigraph.session import scratch_path
from verdigraph.sources import write_buckets

CORPUS_SQL = "SELECT d.doc_id AS idx, d.text AS func, l.toxic AS target FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def corpus(t: Tables) -> DataFrame:
    labels = t.labels.select("doc_id", F.col("toxic").alias("target"))
    return t.documents.select("doc_id", "text").join(labels, "doc_id").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("func"), "target"
    )


# Every document, its label where it has one.
ALL_SQL = "SELECT d.doc_id AS idx, d.text AS func, l.toxic AS target FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def all_texts(t: Tables) -> DataFrame:
    labels = t.labels.select("doc_id", F.col("toxic").alias("target"))
    return t.documents.select("doc_id", "text").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("func"), "target"
    )


# C source built from parts: straight-line code, members and a loop, a lone call, branches and loops in each other.
CODE_EXPR = """CASE p_partkey % 4
 WHEN 0 THEN concat('int f', p_partkey, '(int a, char *s) { /* ', p_name, ' */ int b = a; b = g', p_size % 5,
   '(b, "x // y"); if (b > ', p_size, ') { h(s); b++; } // ', p_brand, chr(10), ' return b; }')
 WHEN 1 THEN concat('static int f', p_partkey, '(struct buf *p, int n) {', chr(10), ' int len = n + ', p_size,
   ', k; char *q = p->data; // ', p_name, chr(10), '  ', chr(10), ' memcpy(p->data, q, len); p->size = len; k = len; p->n++; q[k]--; ++p->t[n].m; k = n = len + 1;',
   ' while (len > 0) { --len; logger->write_', p_size % 4, '("/* no */", len); } total += len * k;',
   ' return p->ops.run(p, len); }')
 WHEN 2 THEN concat('int f', p_partkey, '(int a, int n, char *s) { int r = ', p_size, ', t = 0; if (a > n) r = a; else if (a < 0) { r = n; t = r; } else t = a; use', p_size % 5,
   '(r, t); while (n > 0) { if (r > t) { n = r - 1; continue; } else for (int i = 0; i < n; i++) t = t + r * i; while (t > a) if (s[t]) --t; else { a = t; r = a + n; } n = next(n, r); }',
   ' if (r) if (t) a = 1; else a = 2; do { r = r - a; } while (r > t); switch (a) { case 1: t = 3; break; default: a++; } /* ', p_name, ' */ if (t) { } else if (a) t = r; return r + t + n; }')
 ELSE concat('static void f', p_partkey, '(const struct tab *tabs, my_t k) { unsigned long x = ', p_size, '; for (int i = 0; i < 9; i++) { x = x * i; y = x;',
   ' } /* ', p_brand, ' */ static const my_t w = x; tabs[x].run_', p_size % 3, '(w, k);
   tabs->ops[x + k]->go[', p_size % 4, '](y); (*handler)(w); if (x) tabs[pick(x)].close(k); done(x, ', chr(39), '/', chr(39), ', f', p_partkey, ', y); }')
 END"""
CODE_SQL = f"SELECT p_partkey AS idx, {CODE_EXPR} AS func, p_size % 2 AS target FROM part"


def code_corpus(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("idx"), F.expr(CODE_EXPR).alias("func"), (F.col("p_size") % 2).alias("target")
    )


SCORE_EXPR = "CAST((idx * 37) % 101 AS DOUBLE) / 100"
SCORED_SQL = f"SELECT idx, target, {SCORE_EXPR} AS score FROM ({CORPUS_SQL}) c"


def scored(t: Tables) -> DataFrame:
    return corpus(t).select("idx", "target", F.expr(SCORE_EXPR).alias("score"))


RESPONSE_EXPR = """CASE (idx + config) % 6
 WHEN 0 THEN 'Yes, the function is vulnerable.</s>'
 WHEN 1 THEN 'No, the function is not vulnerable.</s>'
 WHEN 2 THEN 'I do not know.'
 WHEN 3 THEN 'The code contains a buffer overflow.'
 WHEN 4 THEN 'TRUE'
 ELSE 'Unclear.' END"""
RESPONSES_SQL = (
    f"SELECT config, idx, target, {RESPONSE_EXPR} AS response "
    f"FROM (SELECT idx, target, unnest([0, 1, 2]) AS config FROM ({CORPUS_SQL}) c) x"
)


def responses(t: Tables) -> DataFrame:
    each = corpus(t).select("idx", "target", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("config"))
    return each.select("config", "idx", "target", F.expr(RESPONSE_EXPR).alias("response"))


def in_buckets(t: Tables, name: str, df: DataFrame) -> DataFrame:
    """The rows as a bucketed table of their own."""
    path = scratch_path(t.spark, name)
    return write_buckets(df, path, path.rsplit("/", 1)[1].replace("-", "_"), 8)


# Free-text answers ending in a whole document.
ANSWER_EXPR = """CASE doc_id % 14
 WHEN 0 THEN concat('Yes, the function is vulnerable.</s>', text)
 WHEN 1 THEN concat('No, it is fine.', chr(10), chr(10), text)
 WHEN 2 THEN concat('The code contains a buffer overflow. ', text)
 WHEN 3 THEN concat('The function does not contain any vulnerability. ', text)
 WHEN 4 THEN concat('The snippet is safe. ', text)
 WHEN 5 THEN concat('It appears to be a potentially buggy function. ', text)
 WHEN 6 THEN concat('The memory will not be cleaned up; ', text)
 WHEN 7 THEN concat('My view', chr(10), '```c', chr(10), 'int x = 0; // yes.', chr(10), '```', chr(10), 'it can be exploited. ', text)
 WHEN 8 THEN concat('reasoning: it may leak', chr(10), 'Answer: no', chr(10), text)
 WHEN 9 THEN concat('CWE-787', chr(10), text)
 WHEN 10 THEN concat('It is hard to say.', chr(10), chr(10), 'Question: is it? ', text, ' yes.')
 WHEN 11 THEN concat('The code has no memory leak and it is impossible to rule out a crash. ', text)
 WHEN 12 THEN concat('This can be improved.', chr(10), '```', chr(10), text, ' the code will fail', chr(10))
 ELSE text END"""
MODEL_EXPR = """CASE doc_id % 5 WHEN 0 THEN 'CodeLlama-7b' WHEN 1 THEN 'deepseek-coder-6.7b' WHEN 2 THEN 'Mistral-7B'
 WHEN 3 THEN 'WizardCoder-15B' ELSE 'starcoder-ta' END"""
PROMPT_EXPR = "CASE WHEN doc_id % 3 = 0 THEN 'few_shots' ELSE 'zero_shot' END"
ANSWERS_SQL = (
    f"SELECT doc_id AS idx, {MODEL_EXPR} AS model, {PROMPT_EXPR} AS prompt_type, {ANSWER_EXPR} AS response FROM documents"
)


def answers(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("idx"), F.expr(MODEL_EXPR).alias("model"), F.expr(PROMPT_EXPR).alias("prompt_type"),
        F.expr(ANSWER_EXPR).alias("response"),
    )


# Steps of runs: a user's events in time order, twenty to an epoch.
EPOCH_STEPS = 20
STEPS_SQL = """SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step,
 (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS epoch, value AS loss,
 CAST(event_id % 2 AS INTEGER) AS target, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS pred, event_type = 'error' AS failed
 FROM events"""


def steps(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("loss"),
        (F.col("event_id") % 2).cast("int").alias("target"),
        (F.col("event_id") % 3 == 0).cast("int").alias("pred"),
        (F.col("event_type") == "error").alias("failed"),
    )
    placed = rank_rows(rows, ["ts", "event_id"], ["run"], name="step")
    return placed.select(
        "run", "step", F.floor(F.col("step") / EPOCH_STEPS).alias("epoch"), "loss", "target", "pred", "failed"
    )


# Logged values per run and step, each step a day of orders of one customer group.
HISTORY_SQL = """SELECT o_custkey % 7 AS run, CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS step,
 round(avg(o_totalprice) / 1000, 1) AS bacc FROM orders GROUP BY 1, 2"""


def history(t: Tables) -> DataFrame:
    """run, step, bacc with ties."""
    return t.orders.groupBy(
        (F.col("o_custkey") % 7).alias("run"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint").alias("step"),
    ).agg(F.round(F.avg("o_totalprice") / 1000, 1).alias("bacc"))


SHOTS_SQL = """SELECT item_id AS "row", text AS func, CAST(item_id % 2 AS INTEGER) AS target, item_id // 2 * 7 + 3 AS pair_id,
 CAST(item_id % 2 AS INTEGER) AS pos_in_pair FROM benchmark"""


def shots(t: Tables) -> DataFrame:
    item = F.col("item_id")
    return t.benchmark.select(
        item.alias("row"), F.col("text").alias("func"), (item % 2).cast("int").alias("target"),
        (F.floor(item / 2) * 7 + 3).alias("pair_id"), (item % 2).cast("int").alias("pos_in_pair"),
    )


def text_list(col: str) -> Column:
    """An array shown as text, so both engines compare it alike."""
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")
