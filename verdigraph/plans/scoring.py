"""Scores, verdicts, losses and pooled vectors."""

from pyspark.sql import functions as F

from verdigraph.functions import scores
from verdigraph.operators import groups as G
from verdigraph.operators import losses as L
from verdigraph.operators.runs import batches
from verdigraph.plans.budgets import LENGTHS_SQL, lengths
from verdigraph.plans.fixtures import SCORED_SQL, scored
from verdigraph.plans.registry import query

LOGIT = "(o_totalprice / 100000 - 2.5)"
Y = "CAST(o_orderkey % 2 AS INTEGER)"


def logits(t):
    """Two logits and a label per order."""
    x = F.col("o_totalprice") / 100000 - 2.5
    return t.orders.select(
        F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("g"), (F.col("o_orderkey") % 2).cast("int").alias("target"),
        F.array(-x, x * 0.5).alias("logits"), x.alias("x"),
    )


@query(
    "l1_sigmoid_softmax",
    f"""SELECT o_orderkey AS idx, round(1 / (1 + exp(-{LOGIT})), 9) AS sig, round(exp(-{LOGIT}) / (exp(-{LOGIT}) + exp({LOGIT} * 0.5)), 9) AS p0,
 round(exp({LOGIT} * 0.5) / (exp(-{LOGIT}) + exp({LOGIT} * 0.5)), 9) AS p1 FROM orders""",
)
def l1(t):
    soft = logits(t).select("idx", scores.sigmoid(F.col("x")).alias("sig"), scores.softmax(F.col("logits")).alias("p"))
    return soft.select("idx", F.round("sig", 9).alias("sig"), F.round(F.col("p")[0], 9).alias("p0"), F.round(F.col("p")[1], 9).alias("p1"))


TYPE_EXPR = "CASE idx % 3 WHEN 0 THEN 'codet5' WHEN 1 THEN 't5' ELSE 'roberta' END"


@query(
    "l2_verdict",
    f"""SELECT idx, target, model_type, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS one_column,
 CASE WHEN (CASE WHEN model_type IN ('codet5', 't5') THEN 1 - score ELSE score END) > 0.5 THEN 1 ELSE 0 END AS at_test,
 CASE WHEN (CASE WHEN model_type = 'codet5' THEN 1 - score ELSE score END) > 0.5 THEN 1 ELSE 0 END AS at_evaluate
 FROM (SELECT *, {TYPE_EXPR} AS model_type FROM ({SCORED_SQL}) s) m""",
)
def l2(t):
    rows = scored(t).withColumn("model_type", F.expr(TYPE_EXPR))
    both = F.array(F.col("score"), F.lit(1) - F.col("score"))

    def at(phase):
        return scores.verdict(scores.pick_score(both, F.col("model_type"), phase))

    return rows.select(
        "idx", "target", "model_type", scores.verdict(F.col("score")).alias("one_column"),
        at("test").alias("at_test"), at("evaluate").alias("at_evaluate"),
    )


def _log_loss(w0, w1):
    return f"-(ln(score + 1e-10) * target * {w1} + ln(1 - score + 1e-10) * (1 - target) * {w0})"


@query(
    "l3_log_loss",
    f"""SELECT 'plain' AS kind, round(avg({_log_loss(1, 1)}), 9) AS loss FROM ({SCORED_SQL}) s
 UNION ALL SELECT 'weighted', round(avg({_log_loss(0.3, 1.7)}), 9) FROM ({SCORED_SQL}) s""",
)
def l3(t):
    rows = scored(t)
    plain, weighted = L.log_loss(rows), L.log_loss(rows, weights=(0.3, 1.7))
    kinds = plain.select(F.lit("plain").alias("kind"), "loss").union(weighted.select(F.lit("weighted"), "loss"))
    return kinds.withColumn("loss", F.round("loss", 9))


NLL_SQL = f"ln(exp(-{LOGIT}) + exp({LOGIT} * 0.5)) - CASE WHEN {Y} = 0 THEN -{LOGIT} ELSE {LOGIT} * 0.5 END"


@query(
    "l4_cross_entropy",
    f"""SELECT o_orderstatus AS g, round(avg({NLL_SQL}), 9) AS plain, round(sum(({NLL_SQL}) * w) / sum(w), 9) AS weighted
 FROM (SELECT *, CASE WHEN {Y} = 0 THEN 0.25 ELSE 2.0 END AS w FROM orders) o GROUP BY 1""",
)
def l4(t):
    both = L.cross_entropies(logits(t), {"plain": None, "weighted": (0.25, 2.0)}, by=["g"])
    return both.withColumns({n: F.round(n, 9) for n in ("plain", "weighted")})


@query(
    "l5_batch_mean_loss",
    """SELECT round(avg(m), 9) AS loss, count(*) AS n_batches FROM (SELECT (rn - 1) // 64 AS batch, avg(o_totalprice) AS m
 FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) r GROUP BY 1) b""",
)
def l5(t):
    rows = t.orders.select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("loss"))
    return L.batch_mean_loss(batches(rows, 64)).withColumn("loss", F.round("loss", 9))


GROUP = 4
SIMS_SQL = f"""WITH v AS (SELECT vec_id // {GROUP} AS grp, vec_id % {GROUP} AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a,
  list_reverse(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS b FROM embeddings),
 s AS (SELECT l.grp, l.pos AS i, r.pos AS j, list_inner_product(l.a, r.b) / sqrt(list_inner_product(l.a, l.a) * list_inner_product(r.b, r.b)) / 0.5 AS sim
  FROM v l JOIN v r ON l.grp = r.grp)"""


def sims(t):
    rows = t.embeddings.select(
        F.floor(F.col("vec_id") / GROUP).alias("group"), (F.col("vec_id") % GROUP).cast("int").alias("pos"),
        F.col("embedding").alias("view1"), F.reverse("embedding").alias("view2"),
    )
    return L.group_cosine(L.to_groups(rows, GROUP, short=True), temperature=0.5)


@query("l6_group_cosine", SIMS_SQL + ' SELECT grp AS "group", CAST(i AS INTEGER) AS "row", CAST(j AS INTEGER) AS col, round(sim, 6) AS sim FROM s')
def l6(t):
    each = sims(t).select("group", "row", F.explode(F.arrays_zip(F.col("slots").alias("col"), F.col("sims").alias("sim"))).alias("_s"))
    return each.select("group", "row", "_s.col", F.round("_s.sim", 6).alias("sim"))


def _contrast_sql(where: str) -> str:
    return f"""{SIMS_SQL}, r AS (SELECT grp, i, ln(sum(exp(sim))) - max(CASE WHEN i = j THEN sim END) AS nll FROM s {where} GROUP BY grp, i)
 SELECT round(avg(nll), 7) AS loss, count(*) AS n_rows FROM r"""


@query("l7_contrastive", _contrast_sql(""))
def l7(t):
    return L.contrastive_loss(sims(t)).withColumn("loss", F.round("loss", 7))


@query("l7_contrastive_masked", _contrast_sql("WHERE i = j OR i = 0 OR j = 0"))
def l7_masked(t):
    return L.contrastive_loss(sims(t), mask=True).withColumn("loss", F.round("loss", 7))


UNEQUAL_TILE = 16
# Groups of 1, 3, 5, ... members, many of several tiles.
UNEQUAL_SQL = """WITH g AS (SELECT CAST(floor(sqrt(vec_id)) AS BIGINT) AS grp, * FROM embeddings),
 v AS (SELECT grp, vec_id - grp * grp AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a,
  list_reverse(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS b FROM g),
 s AS (SELECT l.grp, l.pos AS i, r.pos AS j, list_inner_product(l.a, r.b) / sqrt(list_inner_product(l.a, l.a) * list_inner_product(r.b, r.b)) / 0.5 AS sim
  FROM v l JOIN v r ON l.grp = r.grp)"""


def unequal(t):
    grouped = t.embeddings.withColumn("group", F.floor(F.sqrt("vec_id")))
    return G.to_tiles(
        grouped.select("group", (F.col("vec_id") - F.col("group") * F.col("group")).alias("pos"), F.col("embedding").alias("view1"), F.reverse("embedding").alias("view2")),
        UNEQUAL_TILE,
    )


@query("l6_unequal_groups", UNEQUAL_SQL + ' SELECT grp AS "group", i AS "row", j AS col, round(sim, 6) AS sim FROM s')
def l6_unequal(t):
    tiles = G.tile_cosine(G.tile_pairs(unequal(t)), 0.5)
    return tiles.select("group", "row", "start", F.posexplode("sims").alias("_k", "sim")).select(
        "group", "row", (F.col("start") + F.col("_k")).alias("col"), F.round("sim", 6).alias("sim")
    )


def _unequal_contrast_sql(where: str) -> str:
    return f"""{UNEQUAL_SQL}, r AS (SELECT grp, i, ln(sum(exp(sim))) - max(CASE WHEN i = j THEN sim END) AS nll FROM s {where} GROUP BY grp, i)
 SELECT round(avg(nll), 7) AS loss, count(*) AS n_rows FROM r"""


@query("l7_unequal_groups", _unequal_contrast_sql(""))
def l7_unequal(t):
    return G.tiled_loss(unequal(t), 0.5).withColumn("loss", F.round("loss", 7))


@query("l7_unequal_groups_masked", _unequal_contrast_sql("WHERE i = j OR i = 0 OR j = 0"))
def l7_unequal_masked(t):
    return G.tiled_loss(unequal(t), 0.5, mask=True).withColumn("loss", F.round("loss", 7))


@query(
    "l8_check_eos",
    f"""SELECT min(n) AS fewest, max(n) AS most, min(n) = max(n) AS uniform FROM (SELECT CAST(len(list_filter(ids, lambda x: x = 2)) AS INTEGER) AS n
 FROM ({LENGTHS_SQL}) d) c""",
)
def l8(t):
    return L.check_eos(lengths(t), 2, "ids")


@query(
    "g14_pool_vectors",
    """SELECT idx, node, n_tokens, CAST(d - 1 AS INTEGER) AS dim, round(total / (n_tokens + 1e-10), 6) AS value FROM (
 SELECT label AS idx, vec_id % 50 AS node, u.d AS d, count(*) AS n_tokens, sum(CAST(u.x AS DOUBLE)) AS total
 FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, d) GROUP BY 1, 2, 3) g""",
)
def g14(t):
    vectors = t.embeddings.select(F.col("label").alias("idx"), F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    links = vectors.select("idx", (F.col("token") % 50).alias("node"), "token")
    pooled = L.pool_vectors(links, vectors)
    return pooled.select("idx", "node", "n_tokens", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 6))
