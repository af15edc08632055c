"""Prompt tables over a corpus."""

from pyspark.sql import functions as F

from verdigraph.functions import prompt_text as fixed
from verdigraph.functions.text import collapse_ws
from verdigraph.operators import code as C
from verdigraph.operators import flow as G
from verdigraph.operators import prompts as P
from verdigraph.plans import sqltext as S
from verdigraph.plans.fixtures import ALL_SQL, CODE_SQL, SHOTS_SQL, all_texts, code_corpus, shots
from verdigraph.plans.registry import query
from verdigraph.plans.structure import G4_SQL, G12_SQL

N, SEED = 2, 7

# A context sentence for some texts, of one kind each.
CONTEXT_EXPR = """CASE idx % 4 WHEN 0 THEN concat('The program first calls f', idx, ', ') WHEN 1 THEN concat('The 1st a comes from the 1st b', idx, '. ') ELSE '' END"""
KIND_EXPR = "CASE idx % 3 WHEN 0 THEN 'data_flow' WHEN 1 THEN 'api_call' ELSE 'None' END"


def zero_sql(code: str, context: str, kind: str) -> str:
    return f"""concat('{fixed.QUESTION}', chr(10), chr(10), '```', chr(10), {code}, chr(10), CASE WHEN {context} = '' THEN '' ELSE
 concat(chr(10), '/* ', CASE {kind} WHEN 'data_flow' THEN 'Data flow' WHEN 'api_call' THEN 'API call' ELSE '' END, ': ', {context}, '*/', chr(10)) END, '```')"""


def ask_sql(code: str) -> str:
    return f"concat('{fixed.QUESTION}', chr(10), '```', chr(10), {code}, chr(10), '```')"


@query(
    "q1_zero_shot",
    f"""SELECT idx, '{fixed.SYSTEM}' AS system, {zero_sql(S.collapse('func'), 'context', 'kind')} AS "user"
 FROM (SELECT *, {CONTEXT_EXPR} AS context, {KIND_EXPR} AS kind FROM ({ALL_SQL}) c) d""",
)
def q1(t):
    rows = all_texts(t).withColumns({"context": F.expr(CONTEXT_EXPR), "kind": F.expr(KIND_EXPR)})
    return P.zero_shot(rows, F.col("kind")).select("idx", "system", "user")


ANSWER_SQL = f"CASE target WHEN 0 THEN '{fixed.ANSWERS[0]}' ELSE '{fixed.ANSWERS[1]}' END"
BLOCK_SQL = f"concat({ask_sql(S.collapse('func'))}, chr(10), chr(10), {ANSWER_SQL}, chr(10), chr(10))"
POOL_SQL = f"""pool AS (SELECT pair_id, concat(coalesce(max(CASE WHEN pos_in_pair = 0 THEN b END), ''), coalesce(max(CASE WHEN pos_in_pair = 1 THEN b END), '')) AS b
 FROM (SELECT pair_id, pos_in_pair, {BLOCK_SQL} AS b FROM ({SHOTS_SQL}) s) x GROUP BY pair_id)"""


def _hash(tag: str) -> str:
    return f"md5(concat('{SEED}:', idx, ':', {tag}))"


def _below(tag: str, top: str) -> str:
    return f"CAST(('0x' || substr({_hash(tag)}, 1, 12)) AS BIGINT) % ({top})"


def picks_sql(n: int, source: str = ALL_SQL) -> str:
    """picked(idx, func, picks): ``n`` numbers of p pairs, each draw falling back to its range's last number."""
    steps = f"r0 AS (SELECT idx, func, p, CAST([] AS BIGINT[]) AS l FROM ({source}) c, size)"
    for k in range(n):
        top = f"p - {n - k - 1}"
        number = _below(f"'{k}'", top)
        steps += f""", r{k + 1} AS (SELECT idx, func, p, list_append(l, CASE WHEN list_contains(l, {number}) THEN {top} - 1 ELSE {number} END) AS l FROM r{k})"""
    tag = "'o' || x"
    order = f"list_transform(list_sort(list_transform(l, lambda x: {{'h': {_hash(tag)}, 'p': x}})), lambda y: y.p)"
    return f"""{POOL_SQL}, numbered AS (SELECT pair_id, b, row_number() OVER (ORDER BY pair_id) - 1 AS num FROM pool),
 size AS (SELECT count(*) AS p FROM pool), {steps}, picked AS (SELECT idx, func, {order} AS picks FROM r{n})"""


def few_sql(n: int, source: str = ALL_SQL) -> str:
    blocks = " JOIN ".join(f"numbered b{k} ON b{k}.num = q.picks[{k + 1}]" for k in range(n))
    return f"""WITH {picks_sql(n, source)} SELECT q.idx, concat({', '.join(f'b{k}.b' for k in range(n))}, {ask_sql(S.collapse('q.func'))}) AS "user"
 FROM picked q JOIN {blocks}"""


@query("q2_few_shot_random", few_sql(N))
def q2(t):
    return P.few_shot(all_texts(t), shots(t), N, seed=SEED).select("idx", "user")


@query("q2_few_shot_three", few_sql(3))
def q2_three(t):
    return P.few_shot(all_texts(t), shots(t), 3, seed=SEED).select("idx", "user")


@query(
    "q2_few_shot_fixed",
    f"""WITH f AS (SELECT string_agg(b, '' ORDER BY pair_id, pos_in_pair) AS b FROM (SELECT pair_id, pos_in_pair, {BLOCK_SQL} AS b FROM ({SHOTS_SQL}) s ORDER BY pair_id, pos_in_pair LIMIT {N}) x)
 SELECT idx, concat(f.b, {ask_sql(S.collapse('c.func'))}) AS "user" FROM ({ALL_SQL}) c, f""",
)
def q2_fixed(t):
    return P.few_shot(all_texts(t), shots(t), N).select("idx", "user")


@query(
    "q3_sample_pairs",
    f"""WITH {picks_sql(N)} SELECT q.idx, x.pair_id AS first, y.pair_id AS second FROM picked q
 JOIN numbered x ON x.num = q.picks[1] JOIN numbered y ON y.num = q.picks[2]""",
)
def q3(t):
    drawn = P.draw_pairs(all_texts(t), shots(t), N, SEED)

    def at(slot):
        return F.max(F.when(F.col("slot") == slot, F.col("pair_id")))

    return drawn.groupBy("idx").agg(at(0).alias("first"), at(1).alias("second"))


@query("q4_first_shots", f"""SELECT "row", pair_id, pos_in_pair, target, func FROM ({SHOTS_SQL}) s ORDER BY pair_id, pos_in_pair LIMIT 3""")
def q4(t):
    return P.first_shots(shots(t), 3).select("row", "pair_id", "pos_in_pair", "target", "func")


@query("q5_answer_text", f"SELECT idx, target, {ANSWER_SQL} AS answer FROM ({ALL_SQL}) c")
def q5(t):
    return all_texts(t).select("idx", "target", P.answer_text(F.col("target")).alias("answer"))


@query(
    "q6_merge_turns",
    "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS merged FROM conversations GROUP BY 1",
)
def q6(t):
    return P.merge_dialogs(t.conversations)


MODEL_EXPR = """CASE idx % 6 WHEN 0 THEN 'gpt-3.5-turbo-0125' WHEN 1 THEN 'CodeLlama-7b' WHEN 2 THEN 'deepseek-coder-6.7b'
 WHEN 3 THEN 'Mistral-7B' WHEN 4 THEN 'starchat-beta' ELSE 'WizardCoder-15B' END"""
FAMILY_EXPR = "CASE idx % 6 WHEN 0 THEN 'gpt' WHEN 1 THEN 'llama' WHEN 2 THEN 'deepseek' WHEN 3 THEN 'mistral' WHEN 4 THEN 'starchat' ELSE 'wizardcoder' END"
COT_EXPR = "CAST(floor(idx / 6) AS BIGINT) % 2 = 0"
CAP = 400


def _lit(text: str) -> str:
    return " || ".join(["''"] + [("chr(10)" if i else "") or S.quoted(p) for line in [text] for k, p in enumerate(line.split("\n")) for i in ([1, 0] if k else [0])])


def _pick(part: str, at: int | None = None) -> str:
    whens = " ".join(
        f"WHEN '{name}' THEN {_lit(lay[part] if at is None else lay[part][at])}" for name, lay in fixed.LAYOUTS.items()
    )
    return f"CASE family {whens} END"


BASE_SQL = f"""SELECT idx, kind, cot, family, '{fixed.SYSTEM}' AS system, {zero_sql(S.collapse('func'), 'context', 'kind')} AS usr
  FROM (SELECT *, {CONTEXT_EXPR} AS context, {KIND_EXPR} AS kind, {COT_EXPR} AS cot, {FAMILY_EXPR} AS family FROM ({ALL_SQL}) c) d"""


def render_sql(base: str, keep: str = "idx") -> str:
    """Rendered prompts of a relation with kind, cot, family, system and usr; ``keep`` names its key columns."""
    return f"""WITH base AS ({base}),
 turned AS (SELECT *, {_pick('system', 0)} || system || {_pick('system', 1)} AS st, {S.spaced(f"{_pick('user', 0)} || usr || {_pick('user', 1)}")} AS p FROM base),
 roomed AS (SELECT *, {CAP} - len({S.spaced("CASE WHEN family = 'mistral' THEN system ELSE st END")}) - CASE WHEN cot THEN 205 WHEN family = 'gpt' THEN 30 ELSE 20 END AS room FROM turned),
 fit AS (SELECT *, array_to_string(p[1:room], '') AS ut, len(p) >= room AS truncated,
  CASE WHEN kind IN ('data_flow', 'api_call') THEN '*/' ELSE '' END AS ce FROM roomed),
 closed AS (SELECT *, CASE WHEN NOT truncated THEN '' WHEN family = 'starchat' THEN CASE WHEN cot THEN ce ELSE {_pick('cut')} END ELSE ce || {_pick('cut')} END AS closer,
  CASE WHEN NOT cot THEN '' WHEN family = 'starchat' AND truncated THEN {_lit(chr(10) + "'''" + chr(10) + fixed.COT)} ELSE {_pick('cot')} END AS step_line FROM fit),
 done AS (SELECT {keep}, family, truncated, closer, step_line, st, CASE WHEN family = 'starchat'
   THEN CASE WHEN truncated THEN ut ELSE {_pick('user', 0)} || usr END || closer || step_line || {_lit('<|end|>' + chr(10))}
  ELSE ut || closer || step_line END AS user_turn FROM closed)
 SELECT {keep}, family, truncated, closer, step_line, user_turn, {_pick('whole', 0)} || st || user_turn || {_pick('whole', 1)} AS prompt FROM done"""


RENDER_SQL = render_sql(BASE_SQL)


def rendered(t):
    rows = all_texts(t).withColumns(
        {"context": F.expr(CONTEXT_EXPR), "kind": F.expr(KIND_EXPR), "cot": F.expr(COT_EXPR), "model": F.expr(MODEL_EXPR)}
    )
    asked = P.zero_shot(rows, F.col("kind"))
    return P.render_chat(asked, P.route(F.col("model")), F.lit(CAP), F.col("cot"), F.col("kind"))


@query("q7_render_chat", f"SELECT idx, family, truncated, user_turn, prompt FROM ({RENDER_SQL}) r")
def q7(t):
    return rendered(t).select("idx", "family", "truncated", "user_turn", "prompt")


@query("q8_closers", f"SELECT idx, family, truncated, closer, step_line FROM ({RENDER_SQL}) r")
def q8(t):
    return rendered(t).select("idx", "family", "truncated", "closer", "step_line")


@query("q9_route", f"SELECT idx, {MODEL_EXPR} AS model, {FAMILY_EXPR} AS family FROM ({ALL_SQL}) c")
def q9(t):
    rows = all_texts(t).select("idx", F.expr(MODEL_EXPR).alias("model"))
    return rows.withColumn("family", P.route(F.col("model")))


CONFIGS = [
    {"model": m, "prompt_type": p, "graph_type": g}
    for m in ("gpt-3.5-turbo-0125", "CodeLlama-7b")
    for p in ("zero_shot", "few_shots")
    for g in ("None", "data_flow", "api_call")
]
CONFIG_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{c['model']}', '{c['prompt_type']}', '{c['graph_type']}')" for c in CONFIGS
) + ") v(model, prompt_type, graph_type)"


@query("q10_sweep", f"SELECT c.idx, c.target, v.* FROM ({ALL_SQL}) c, ({CONFIG_SQL}) v")
def q10(t):
    return P.expand_sweep(all_texts(t).select("idx", "target"), CONFIGS)


@query(
    "q11_with_context",
    f"""SELECT idx, model, graph_type, {zero_sql('code', 'context', 'graph_type')} AS "user" FROM (
 SELECT c.idx, v.model, v.graph_type, {S.collapse('c.func')} AS code, CASE WHEN (v.graph_type = 'api_call' AND idx % 4 = 0) OR (v.graph_type = 'data_flow' AND idx % 4 = 1)
  THEN {CONTEXT_EXPR} ELSE '' END AS context FROM ({ALL_SQL}) c, ({CONFIG_SQL}) v WHERE v.prompt_type = 'zero_shot') x""",
)
def q11(t):
    """Prompts of the zero-shot part of the sweep, each with the context its configuration asks for."""
    rows = all_texts(t).withColumn("func", collapse_ws("func"))
    kind = F.when(F.col("idx") % 4 == 0, "api_call").when(F.col("idx") % 4 == 1, "data_flow")
    contexts = rows.select("idx", kind.alias("kind"), F.expr(CONTEXT_EXPR).alias("text")).where("kind IS NOT NULL")
    zero = [c for c in CONFIGS if c["prompt_type"] == "zero_shot"]
    swept = P.expand_sweep(P.attach_contexts(rows, contexts), zero)
    asked = P.zero_shot(swept.withColumn("context", P.context_of(F.col("graph_type"))), F.col("graph_type"))
    return asked.select("idx", "model", "graph_type", "user")


CODE_FAMILY = "CASE v.model WHEN 'gpt-3.5-turbo-0125' THEN 'gpt' ELSE 'llama' END"
KEYS = "idx, model, prompt_type, graph_type"
TOLD_SQL = "coalesce(CASE v.graph_type WHEN 'api_call' THEN a.text WHEN 'data_flow' THEN d.text END, '')"
TABLE_BASE = f"""SELECT c.idx, v.model, v.prompt_type, v.graph_type, v.graph_type AS kind, c.idx % 2 = 0 AS cot, {CODE_FAMILY} AS family, '{fixed.SYSTEM}' AS system,
 CASE v.prompt_type WHEN 'few_shots' THEN f."user" ELSE {zero_sql(S.collapse('c.func'), TOLD_SQL, 'v.graph_type')} END AS usr
 FROM ({CODE_SQL}) c CROSS JOIN ({CONFIG_SQL}) v LEFT JOIN ({G4_SQL}) a ON a.idx = c.idx LEFT JOIN ({G12_SQL}) d ON d.idx = c.idx
 JOIN ({few_sql(N, CODE_SQL)}) f ON f.idx = c.idx"""


@query("q12_prompt_table", f"SELECT {KEYS}, truncated, prompt FROM ({render_sql(TABLE_BASE, KEYS)}) r")
def q12(t):
    """Source to prompt: call and flow sentences, both prompt types, chat layout and budget, for the whole sweep."""
    rows = code_corpus(t)
    calls = C.call_sentence(C.call_sites(rows)).withColumn("kind", F.lit("api_call"))
    edges = G.align_deps(G.reindex_edges(G.prune_edges(G.function_flow(rows, placed=False))))
    flow = G.flow_sentences(edges).withColumn("kind", F.lit("data_flow"))
    asked = P.few_shot(rows, shots(t), N, seed=SEED).withColumnRenamed("user", "_few")
    told = P.attach_contexts(asked, calls.unionByName(flow))
    swept = P.expand_sweep(told, CONFIGS).withColumn("context", P.context_of(F.col("graph_type")))
    turned = P.zero_shot(swept, F.col("graph_type"))
    turned = turned.withColumn("user", F.when(F.col("prompt_type") == "few_shots", F.col("_few")).otherwise(F.col("user")))
    ready = P.render_chat(turned, P.route(F.col("model")), F.lit(CAP), F.col("idx") % 2 == 0, F.col("graph_type"))
    return ready.select("idx", "model", "prompt_type", "graph_type", "truncated", "prompt")
