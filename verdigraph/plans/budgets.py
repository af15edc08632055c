"""Cleaning, encoding and length budgets over whole documents."""

from pyspark.sql import functions as F

from verdigraph.functions import arrays, text
from verdigraph.operators import corpus as C
from verdigraph.operators.scale import spread
from verdigraph.plans import sqltext as S
from verdigraph.plans.fixtures import CODE_SQL, CORPUS_SQL, code_corpus, corpus, text_list
from verdigraph.plans.registry import query

BLOCK, FLOW = 128, 32


@query("p1_collapse_ws", f"SELECT doc_id, {S.collapse('text')} AS text FROM documents")
def p1(t):
    return t.documents.select("doc_id", text.collapse_ws("text").alias("text"))


@query(
    "p1_collapse_ws_pages",
    f"SELECT page_id, {S.collapse('html')} AS html, length({S.collapse('html')}) AS n FROM pages",
)
def p1_pages(t):
    flat = t.pages.select("page_id", text.collapse_ws("html").alias("html"))
    return flat.withColumn("n", F.length("html").cast("bigint"))


@query("p2_collapse_runs", r"SELECT doc_id, regexp_replace(text, ' +|\t+', ' ', 'g') AS text FROM documents")
def p2(t):
    return t.documents.select("doc_id", text.collapse_runs("text").alias("text"))


@query(
    "p3_strip_comments",
    f"""SELECT 'code' AS kind, idx, {S.strip_comments('func')} AS func FROM ({CODE_SQL}) c
 UNION ALL SELECT 'text', doc_id, {S.strip_comments('text')} FROM documents
 UNION ALL SELECT 'page', page_id, {S.strip_comments('html')} FROM pages""",
)
def p3(t):
    rows = (
        code_corpus(t).select(F.lit("code").alias("kind"), "idx", "func")
        .union(t.documents.select(F.lit("text"), "doc_id", "text"))
        .union(t.pages.select(F.lit("page"), "page_id", "html"))
    )
    return rows.withColumn("func", text.strip_comments("func"))


NAMED = "CASE doc_id % 4 WHEN 0 THEN 'PDBERT-run' WHEN 1 THEN 'GraphCodeBERT-run' WHEN 2 THEN 'CodeBERT-run' ELSE source END"


@query(
    "p4_clean_by_run",
    f"""SELECT doc_id, project, CASE WHEN contains(project, 'PDBERT') THEN regexp_replace(func, ' +|\\t+', ' ', 'g')
 WHEN contains(project, 'GraphCodeBERT') THEN func ELSE {S.collapse('func')} END AS func
 FROM (SELECT doc_id, {NAMED} AS project, text AS func FROM documents) d""",
)
def p4(t):
    named = t.documents.select("doc_id", F.expr(NAMED).alias("project"), F.col("text").alias("func"))
    return C.clean(named, "project")


# Vocabulary: the words of the benchmark texts, numbered by their first place.
VOCAB_SQL = f"""SELECT token, 10 + min(item_id * 100000 + i - 1) AS id
 FROM (SELECT item_id, {S.words('text')} AS l FROM benchmark) b, unnest(b.l) WITH ORDINALITY AS u(token, i) GROUP BY token"""


def vocabulary(t):
    placed = t.benchmark.select("item_id", F.posexplode(text.words("text")).alias("i", "token"))
    return placed.groupBy("token").agg((F.min(F.col("item_id") * 100000 + F.col("i")) + 10).alias("id"))


def _encode_sql(room: int, head: str) -> str:
    return f"""WITH vocab AS ({VOCAB_SQL}),
 d AS (SELECT doc_id AS idx, list_slice({S.words('text')}, 1, {room}) AS l FROM documents),
 w AS (SELECT idx, u.i AS i, coalesce(v.id, 3) AS id FROM d, unnest(d.l) WITH ORDINALITY AS u(token, i) LEFT JOIN vocab v ON v.token = u.token),
 g AS (SELECT idx, list(id ORDER BY i) AS ids FROM w GROUP BY idx)
 SELECT d.idx, array_to_string(list_resize({head} || coalesce(g.ids, []) || [2], {BLOCK}, 1), ' ') AS input_ids
 FROM d LEFT JOIN g ON d.idx = g.idx"""


def _encoded(t, layout):
    docs = t.documents.select(F.col("doc_id").alias("idx"), F.col("text").alias("func"))
    return C.encode(docs, vocabulary(t), BLOCK, layout).select("idx", text_list("input_ids").alias("input_ids"))


@query("p5_encode", _encode_sql(BLOCK - 2, "[0]"))
def p5(t):
    return _encoded(t, "plain")


@query("p6_encode_encoder_only", _encode_sql(BLOCK - 4, "[0, 6, 2]"))
def p6(t):
    return _encoded(t, "encoder_only")


# Word lengths stand in for ids where an operator takes ids as given.
LENGTHS_SQL = f"SELECT doc_id AS idx, list_transform({S.words('text')}, lambda w: CAST(length(w) AS BIGINT)) AS ids FROM documents"


def lengths(t):
    ids = F.transform(text.words("text"), lambda w: F.length(w).cast("bigint"))
    return t.documents.select(F.col("doc_id").alias("idx"), ids.alias("ids"))


@query(
    "p7_keep_last_eos",
    f"""WITH d AS ({LENGTHS_SQL}), c AS (SELECT idx, ids, len(list_filter(ids, lambda x: x = 2)) AS n,
  len(ids) - list_position(list_reverse(ids), 2) + 1 AS last FROM d),
 k AS (SELECT idx, CASE WHEN n > 1 THEN list_filter(ids, lambda x, i: x <> 2 OR i = last) ELSE ids END AS ids, n FROM c)
 SELECT idx, {S.join_list("CASE WHEN n > 1 AND len(ids) < 512 THEN list_resize(ids, 512, 0) ELSE ids END")} AS ids FROM k""",
)
def p7(t):
    return lengths(t).withColumn("ids", arrays.keep_last_eos(F.col("ids"))).withColumn("ids", text_list("ids"))


@query(
    "p8_attention_mask",
    f"""SELECT idx, {S.join_list('list_transform(ids, lambda x: CASE WHEN x <> 1 THEN 1 ELSE 0 END)')} AS mask,
 {S.join_list('list_resize(list_transform(ids[1:64], lambda x: 1), 64, 0)')} AS by_length FROM ({LENGTHS_SQL}) d""",
)
def p8(t):
    ids = F.col("ids")
    masks = lengths(t).select(
        "idx", arrays.attention_mask(ids, 1).alias("mask"), arrays.length_mask(F.size(ids), 64).alias("by_length")
    )
    return masks.select("idx", text_list("mask").alias("mask"), text_list("by_length").alias("by_length"))


@query(
    "p9_graph_budget",
    f"""WITH d AS (SELECT idx, ids AS code, len(list_filter(ids, lambda x: x > 5)) AS n_nodes FROM ({LENGTHS_SQL}) l),
 s AS (SELECT idx, n_nodes, [0] || list_slice(code, 1, least({BLOCK + FLOW - 3} - least(n_nodes, {FLOW}), {BLOCK - 3})) || [2] AS src FROM d),
 k AS (SELECT *, least(n_nodes, {BLOCK + FLOW} - len(src)) AS kept FROM s)
 SELECT idx, CAST(n_nodes AS INTEGER) AS n_nodes, CAST(kept AS INTEGER) AS kept_nodes,
 array_to_string(list_resize(src || {S.repeat('3', 'kept')}, {BLOCK + FLOW}, 1), ' ') AS input_ids,
 array_to_string(list_resize(range(2, len(src) + 2) || {S.repeat('0', 'kept')}, {BLOCK + FLOW}, 1), ' ') AS position_idx FROM k""",
)
def p9(t):
    sized = lengths(t).select(
        "idx", F.col("ids").alias("code_ids"), F.size(F.filter("ids", lambda x: x > 5)).alias("n_nodes")
    )
    out = C.graph_budget(sized, BLOCK, FLOW)
    return out.select(
        "idx", "n_nodes", "kept_nodes", text_list("input_ids").alias("input_ids"), text_list("position_idx").alias("position_idx")
    )


@query(
    "p10_subtoken_spans",
    f"""SELECT idx, CAST(i - 1 AS INTEGER) AS pos, CAST(e - n AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM (
 SELECT idx, i, n, 1 + sum(n) OVER (PARTITION BY idx ORDER BY i) AS e FROM (
  SELECT idx, u.i AS i, (length(u.w) + 3) // 4 AS n FROM (SELECT doc_id AS idx, {S.words('text')} AS l FROM documents) d,
  unnest(d.l) WITH ORDINALITY AS u(w, i)) a) b""",
)
def p10(t):
    dealt = spread(t.documents.select(F.col("doc_id").alias("idx"), "text"), "idx", "text", 1 << 22)
    toks = dealt.select("idx", F.posexplode(text.words("text")).alias("pos", "w"))
    return C.subtoken_spans(toks.select("idx", "pos", F.ceil(F.length("w") / 4).alias("n")))


MAX_LEN = 320
SYSTEM_EXPR = "concat('You judge ', lang, ' text from ', source, '.')"
FIT_SQL = f"""SELECT idx, target, cot, p, greatest({MAX_LEN} - len({S.spaced('system')}) - CASE WHEN cot THEN 205 ELSE 20 END, 0) AS room
 FROM (SELECT d.doc_id AS idx, l.toxic AS target, d.doc_id % 2 = 0 AS cot, {SYSTEM_EXPR} AS system, {S.spaced('text')} AS p
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x"""


def fitted(t):
    labels = t.labels.select("doc_id", F.col("toxic").alias("target"))
    docs = t.documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("idx"), "target", (F.col("doc_id") % 2 == 0).alias("cot"),
        F.expr(SYSTEM_EXPR).alias("system"), F.col("text").alias("user"),
    )
    return C.fit_budget(docs, F.lit(MAX_LEN), F.col("cot"))


@query(
    "p11_fit_budget",
    f"""SELECT idx, cot, array_to_string(CASE WHEN len(p) > room THEN p[1:room] ELSE p END, '') AS "user", len(p) >= room AS truncated
 FROM ({FIT_SQL}) f""",
)
def p11(t):
    return fitted(t).select("idx", "cot", "user", "truncated")


@query(
    "p12_over_length",
    f"SELECT doc_id, CAST(len({S.spaced('text')}) AS INTEGER) AS n_tokens, len({S.spaced('text')}) > 300 AS too_long FROM documents",
)
def p12(t):
    return C.over_length(t.documents, F.lit(300), "text").select("doc_id", "n_tokens", "too_long")


MODEL_EXPR = """CASE doc_id % 3 WHEN 0 THEN 'gpt-3.5-turbo-0125' WHEN 1 THEN 'gpt-4-0125-preview' ELSE concat('local-', source) END"""


@query(
    "p13_model_limits",
    f"""WITH lim AS (SELECT concat('local-', source) AS model, CAST(max(n_chars) AS BIGINT) AS max_length FROM documents GROUP BY 1)
 SELECT doc_id, d.model, CAST(CASE d.model WHEN 'gpt-3.5-turbo-0125' THEN 16385 WHEN 'gpt-4-0125-preview' THEN 128000 ELSE lim.max_length END AS BIGINT) AS max_length
 FROM (SELECT doc_id, {MODEL_EXPR} AS model FROM documents) d LEFT JOIN lim ON lim.model = d.model""",
)
def p13(t):
    limits = t.documents.groupBy(F.concat(F.lit("local-"), "source").alias("model")).agg(F.max("n_chars").alias("max_length"))
    named = t.documents.select("doc_id", F.expr(MODEL_EXPR).alias("model"))
    return C.with_model_limits(named, limits).select("doc_id", "model", "max_length")


@query(
    "p14_last_token",
    f"SELECT idx, CASE WHEN len(ids) = 0 THEN NULL ELSE ((greatest(coalesce(list_position(ids, 1), 0) - 1, 0) - 1) + len(ids)) % len(ids) END AS last FROM ({LENGTHS_SQL}) d",
)
def p14(t):
    rows = lengths(t)
    last = F.when(F.size("ids") > 0, arrays.last_token_pos(F.col("ids"), 1)).cast("bigint")
    return rows.select("idx", last.alias("last"))


@query(
    "m10_truncation_profile",
    f"""SELECT target, count(*) AS n, count(CASE WHEN len(p) >= room THEN 1 END) AS n_truncated, round(avg(CASE WHEN len(p) >= room THEN 1.0 ELSE 0.0 END), 9) AS truncated_share
 FROM ({FIT_SQL}) f GROUP BY target""",
)
def m10(t):
    profile = C.truncation_profile(fitted(t))
    return profile.withColumn("truncated_share", F.round("truncated_share", 9))


SPLIT_EXPR = "CASE WHEN idx % 10 < 8 THEN 'train' WHEN idx % 10 = 8 THEN 'valid' ELSE 'test' END"


@query(
    "m11_split_sizes",
    f"SELECT {SPLIT_EXPR} AS split, count(*) AS n_examples FROM ({CORPUS_SQL}) c GROUP BY 1",
)
def m11(t):
    return C.split_sizes(corpus(t).withColumn("split", F.expr(SPLIT_EXPR)))
