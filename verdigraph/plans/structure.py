"""Token, call and data-flow tables of the code corpus."""

from pyspark.sql import functions as F

from verdigraph.functions import c_words
from verdigraph.functions.text import SPACE
from verdigraph.operators import code as C
from verdigraph.operators import flow as G
from verdigraph.operators.corpus import subtoken_spans
from verdigraph.operators.intervals import overlaps
from verdigraph.plans import sqltext as S
from verdigraph.plans.fixtures import CODE_SQL, code_corpus, text_list
from verdigraph.plans.registry import query
from verdigraph.session import stored

TOKS = S.tokens_cte(CODE_SQL)
MEMBER = S.in_list(c_words.MEMBER)


def toks(t):
    return C.tokens(code_corpus(t))


@query("g1_tokens", f"WITH {TOKS} SELECT idx, pos, text, kind FROM toks")
def g1(t):
    return toks(t).select("idx", "pos", "text", "kind")


def calls(t):
    return C.call_sites(code_corpus(t))


TAGGED = S.in_list(c_words.TAGGED_TYPES)
IDS = f"""ids AS (SELECT DISTINCT idx, text FROM (SELECT *, coalesce(lag(text) OVER w, '') AS before, coalesce(lead(kind) OVER w, 'op') AS after_kind
  FROM toks WINDOW w AS (PARTITION BY idx ORDER BY pos)) x WHERE kind = 'ident' AND before NOT IN {MEMBER} AND before NOT IN {TAGGED} AND after_kind <> 'ident')"""


@query("g2_identifiers", f"WITH {TOKS}, {IDS} SELECT idx, text FROM ids")
def g2(t):
    return C.identifiers(toks(t))


# Calls read off the text itself: a chain of members and subscripts before an opening bracket, not after a
# name or type; or a bracketed pointer before one.
CHAIN = f"{c_words.NAME}(?:{SPACE}*(?:->|\\.){SPACE}*{c_words.NAME}|{SPACE}*\\[[^\\[\\]()]*\\])*"
CALLS = f"""clisted AS (SELECT idx, regexp_extract_all({S.uncommented('func')}, {S.quoted(S.TOKEN.replace(f"|{c_words.NAME}|", f"|{CHAIN}|", 1))}) AS l FROM code),
 ccut AS (SELECT idx, u.i AS pos, CASE WHEN regexp_matches(u.w, '^[A-Za-z_]') THEN regexp_replace(u.w, '{SPACE}', '', 'g') ELSE u.w END AS text FROM clisted, unnest(clisted.l) WITH ORDINALITY AS u(w, i)),
 ckind AS (SELECT *, {S.KIND} AS kind FROM ccut),
 near AS (SELECT *, lead(text) OVER w AS nxt, coalesce(lag(kind) OVER w, 'op') AS before_kind, lead(kind, 2) OVER w AS kind2, lead(text, 3) OVER w AS text3, lead(text, 4) OVER w AS text4,
  sum(CASE text WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS depth FROM ckind WINDOW w AS (PARTITION BY idx ORDER BY pos)),
 calls AS (SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY pos) AS ord, CASE WHEN kind = 'ident' THEN text ELSE '' END AS callee
  FROM near WHERE depth > 0 AND ((kind = 'ident' AND nxt = '(' AND before_kind NOT IN ('ident', 'type'))
   OR (text = '(' AND nxt = '*' AND kind2 = 'ident' AND text3 = ')' AND text4 = '(' AND before_kind NOT IN ('ident', 'type', 'keyword'))))"""


@query("g3_call_sites", f"WITH {TOKS}, {CALLS} SELECT idx, CAST(ord AS INTEGER) AS ord, callee FROM calls")
def g3(t):
    return calls(t)


@query("g3_distinct_calls", f"WITH {TOKS}, {CALLS} SELECT DISTINCT idx, callee FROM calls")
def g3_distinct(t):
    return C.distinct_calls(calls(t))


G4_SQL = f"""WITH {TOKS}, {CALLS} SELECT idx, string_agg(CASE WHEN ord = 1 THEN concat('The program first calls ', callee, ', ')
 WHEN ord = n THEN concat('and finally calls ', callee, '.') ELSE concat('then calls ', callee, ', ') END, '' ORDER BY ord) AS text
 FROM (SELECT *, count(*) OVER (PARTITION BY idx) AS n FROM calls) c GROUP BY idx"""


@query("g4_call_sentence", G4_SQL)
def g4(t):
    return C.call_sentence(calls(t))


VARS = """vars AS (SELECT i.idx, i.text FROM ids i WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.idx = i.idx AND (
 (regexp_matches(c.callee, '\\b' || i.text) AND ends_with(c.callee, i.text) AND NOT contains(c.callee, '->' || i.text) AND NOT contains(c.callee, '.' || i.text))
 OR contains(c.callee, i.text || '<'))))"""


@query("g5_variables", f"WITH {TOKS}, {IDS}, {CALLS}, {VARS} SELECT idx, text FROM vars")
def g5(t):
    return C.function_variables(code_corpus(t))


@query("g5_variables_of_tables", f"WITH {TOKS}, {IDS}, {CALLS}, {VARS} SELECT idx, text FROM vars")
def g5_tables(t):
    return C.variables(C.identifiers(toks(t)), calls(t))


VALUE_KINDS = S.in_list(G.VALUE_KINDS)
ASSIGNING = S.in_list(c_words.ASSIGNING)
STEPPING = S.in_list(c_words.STEPPING)
CHAIN_TOKEN = S.TOKEN.replace(f"|{c_words.NAME}|", f"|{CHAIN}|", 1)
# A walk over the tokens of each function with its open statements as a stack. A frame: kind, place, arm, what it waits for
# (header, pending body, single or braced body, else, tail of a do), since where, and the brackets open before it.
FRAME = "STRUCT(k VARCHAR, id INTEGER, arm INTEGER, w VARCHAR, since INTEGER, p INTEGER)"


def frame(k, at, arm, w, since, p="0"):
    return f"{{'k': {k}, 'id': {at}, 'arm': {arm}, 'w': {w}, 'since': {since}, 'p': {p}}}::{FRAME}"


def like(f, w, since, arm=None):
    return frame(f"{f}.k", f"{f}.id", arm or f"{f}.arm", w, since, f"{f}.p")


def last_not(st, holds):
    """Number of the last frame that does not hold."""
    return f"coalesce(list_max(list_transform(range(1, len({st}) + 1), lambda j: CASE WHEN {holds.format(f=f'{st}[j]')} THEN 0 ELSE j END)), 0)"


def topped(st, top):
    return f"list_append({st}[:len({st}) - 1], {top})"


GOES_ON = "(({f}.k = 'if' AND {f}.arm = 0) OR {f}.k = 'do')"


def end_of(st, at):
    kept = f"{st}[:{last_not(st, "{f}.w = 'single' AND NOT " + GOES_ON)}]"
    return f"(SELECT CASE WHEN y[-1].w = 'single' THEN {topped('y', like('y[-1]', "CASE y[-1].k WHEN 'if' THEN 'else' ELSE 'tail' END", at))} ELSE y END FROM (SELECT {kept} AS y) z)"


NO_ELSE = f"(SELECT CASE WHEN y[-1].k = 'do' AND y[-1].w = 'single' THEN {topped('y', like('y[-1]', "'tail'", 'pos'))} ELSE y END FROM (SELECT st[:{last_not('st', "{f}.w IN ('single', 'else') AND {f}.k <> 'do'")}] AS y) z)"
WALK = f"""walk AS (SELECT DISTINCT idx, -1 AS pos, CAST([] AS {FRAME}[]) AS st, 0 AS p, 0 AS stmt, false AS fresh, CAST([] AS {FRAME}[]) AS path FROM toks
 UNION ALL SELECT idx, pos,
  CASE WHEN control THEN list_append(st, {frame('x', 'pos', '0', "'header'", 'pos')}) WHEN x = 'do' AND p = 0 THEN list_append(st, {frame("'do'", 'pos', '0', "'pending'", 'pos')})
   WHEN tail THEN st[:len(st) - 1] WHEN other THEN {topped('st', like('st[-1]', "'pending'", 'pos', '1'))} WHEN closes THEN {topped('st', like('st[-1]', "'pending'", 'pos'))}
   WHEN x = ';' AND p = 0 THEN {end_of('st', 'pos')} WHEN x = '{{' AND NOT took THEN list_append(st, {frame("'block'", 'pos', '0', "'braced'", 'pos', 'p')})
   WHEN x = '}}' AND b > 0 THEN CASE WHEN st[b].k = 'block' AND st[b].p > 0 THEN base WHEN {GOES_ON.format(f='st[b]')}
     THEN list_append(base, {like('st[b]', "CASE st[b].k WHEN 'if' THEN 'else' ELSE 'tail' END", 'pos')}) ELSE {end_of('base', 'pos')} END ELSE st END,
  CASE x WHEN '(' THEN p + 1 WHEN ')' THEN greatest(p - 1, 0) WHEN '{{' THEN 0 WHEN '}}' THEN CASE WHEN b > 0 AND st[b].k = 'block' THEN st[b].p ELSE 0 END ELSE p END,
  stmt + CASE WHEN fresh OR control THEN 1 ELSE 0 END, closes OR other OR (x = 'do' AND p = 0) OR x IN (';', '{{', '}}'),
  list_filter(st, lambda f: (f.k = 'if' AND f.w IN ('single', 'braced')) OR f.k IN ('while', 'for'))
 FROM (SELECT *, x IN ('if', 'while', 'for', 'switch') AND p = 0 AND NOT tail AS control, st[:b - 1] AS base FROM (SELECT *, coalesce(st[-1].w = 'tail' AND x = 'while', false) AS tail, coalesce(x = '{{' AND st[-1].w = 'braced' AND st[-1].since = pos - 1 AND st[-1].k <> 'block', false) AS took,
   coalesce(x = ')' AND p = 1 AND st[-1].w = 'header', false) AS closes, coalesce(x = 'else' AND st[-1].w = 'else', false) AS other, {last_not('st', "{f}.w <> 'braced'")} AS b
  FROM (SELECT idx, pos, x, p, stmt, fresh, CASE WHEN st[-1].w = 'else' AND x <> 'else' THEN {NO_ELSE} WHEN st[-1].w = 'pending' THEN {topped('st', like('st[-1]', "CASE WHEN x = '{' THEN 'braced' ELSE 'single' END", 'st[-1].since'))} ELSE st END AS st
   FROM (SELECT w.idx, t.pos, t.text AS x, w.st, w.p, w.stmt, w.fresh FROM walk w JOIN toks t ON t.idx = w.idx AND t.pos = w.pos + 1) q1) q2) q3) q4)"""

ROLES = f"""sk AS (SELECT idx, u.i AS k, u.w AS w FROM (SELECT idx, regexp_extract_all({S.uncommented('func')}, {S.quoted(CHAIN_TOKEN)}) AS l FROM code) c, unnest(c.l) WITH ORDINALITY AS u(w, i)),
 sl AS (SELECT *, regexp_extract_all(w, {S.quoted(S.TOKEN)}) AS parts, coalesce(lag(w) OVER o, '') IN {STEPPING} OR coalesce(lead(w) OVER o, '') IN {STEPPING} AS near FROM sk WINDOW o AS (PARTITION BY idx ORDER BY k)),
 so AS (SELECT idx, k, parts, near AND regexp_matches(w, '^[A-Za-z_]') AS stepped, coalesce(sum(len(parts)) OVER (PARTITION BY idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM sl),
 steps AS (SELECT idx, k AS chain, stepped, CAST(first + v.j - 1 AS INTEGER) AS pos FROM so, unnest(range(1, len(parts) + 1)) AS v(j)),
 {WALK},
 a1 AS (SELECT toks.*, chain, stepped, w.stmt, w.path, coalesce(lag(text) OVER o, '') AS bf, coalesce(lead(text) OVER o, '') AS nx, coalesce(lead(kind) OVER o, 'op') AS nk,
  coalesce(sum(CASE text WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER pw, 0) AS braces,
  sum(CASE WHEN text IN ('(', '[') THEN 1 WHEN text IN (')', ']') THEN -1 ELSE 0 END) OVER o AS lvl
  FROM toks JOIN steps USING (idx, pos) JOIN walk w USING (idx, pos) WINDOW o AS (PARTITION BY idx ORDER BY pos), pw AS (PARTITION BY idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 a2 AS (SELECT * REPLACE (CASE WHEN kind = 'ident' AND bf IN {MEMBER} THEN 'field' ELSE kind END AS kind),
  row_number() OVER o AS rn, first_value(text) OVER o AS firstt, arg_max(text, pos) OVER s AS lastt, min(CASE WHEN text IN {ASSIGNING} THEN pos END) OVER s AS eq
  FROM a1 WINDOW s AS (PARTITION BY idx, stmt), o AS (PARTITION BY idx, stmt ORDER BY pos)),
 a3 AS (SELECT *, rn = CASE WHEN firstt = 'for' THEN 3 WHEN firstt IN ('else', 'do') THEN 2 ELSE 1 END AS is_head FROM a2),
 a4 AS (SELECT *, max(CASE WHEN is_head THEN pos END) OVER s AS hpos, max(CASE WHEN is_head THEN kind END) OVER s AS hkind, max(CASE WHEN is_head THEN nk END) OVER s AS hnk,
  max(CASE WHEN is_head THEN lvl END) OVER s AS hlvl, max(CASE WHEN pos = eq THEN lvl END) OVER s AS eqlvl, braces = 0 AND lastt = '{{' AS header
  FROM a3 WINDOW s AS (PARTITION BY idx, stmt)),
 a5 AS (SELECT *, coalesce(NOT header AND (hkind = 'type' OR (hkind = 'ident' AND hnk = 'ident')), false) AS decl,
  coalesce(max(CASE WHEN pos < eq AND (text IN ('(', ')', ',', '&&', '||', '?', ':') OR kind = 'keyword') THEN pos END) OVER s, -1) AS tfrom,
  min(CASE WHEN pos > eq AND (lvl < eqlvl OR (text = ',' AND lvl = eqlvl)) THEN pos END) OVER s AS vto,
  min(CASE WHEN text = ',' AND pos > hpos AND lvl = hlvl THEN pos END) OVER s AS comma FROM a4 WINDOW s AS (PARTITION BY idx, stmt)),
 a5m AS (SELECT *, coalesce(text IN {ASSIGNING} AND pos > eq AND lvl = eqlvl AND (vto IS NULL OR pos < vto), false) AS more FROM a5),
 a5n AS (SELECT *, coalesce(max(CASE WHEN more THEN pos END) OVER (PARTITION BY idx, stmt), -1) AS lastop,
  count(CASE WHEN more THEN 1 END) OVER (PARTITION BY idx, stmt ORDER BY pos) + CASE WHEN pos > eq THEN 1 ELSE 0 END AS seg FROM a5m),
 a6 AS (SELECT *, CASE WHEN kind NOT IN {VALUE_KINDS} OR bf IN {TAGGED} OR (kind = 'ident' AND nk = 'ident') OR (kind = 'type' AND text NOT IN {S.in_list(c_words.PRIMITIVE_TYPES)}) OR (decl AND pos >= hpos AND comma IS NOT NULL AND pos > comma) THEN NULL
  WHEN decl AND pos >= hpos AND NOT coalesce(pos > eq, false) THEN
   CASE WHEN kind = 'type' OR (pos = hpos AND kind = 'ident') THEN NULL ELSE 'name' END
  WHEN decl AND pos >= hpos THEN CASE WHEN pos < lastop THEN 'target' ELSE 'value' END WHEN header THEN 'use'
  WHEN stepped THEN 'step'
  WHEN eq IS NOT NULL AND pos > eq AND (vto IS NULL OR pos < vto) THEN CASE WHEN pos < lastop THEN 'target' ELSE 'value' END
  WHEN eq IS NOT NULL AND pos < eq AND pos > tfrom THEN 'target' ELSE 'use' END AS part, eq IS NOT NULL AND (comma IS NULL OR eq < comma) AS assigned FROM a5n),
 a7 AS (SELECT *, CASE WHEN part IN ('target', 'name') THEN 1 ELSE 0 END AS late, part IN ('target', 'name', 'step') AS kills, len(list_filter(path, lambda f: f.k <> 'if')) > 0 AS looped FROM a6 WHERE part IS NOT NULL),
 ev AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY stmt, late, pos) AS n FROM a7)"""

# Which definitions reach which pieces: a graph of pieces, walked until nothing new is reached. A piece leads to the next one that is in
# no else part of an if whose then part it is in; a header to both arms or past them; what leaves a while also goes back to its first piece.
REACH = """pc AS (SELECT idx, stmt, arg_max(path, pos) AS path FROM walk WHERE pos >= 0 GROUP BY 1, 2),
 arms AS (SELECT idx, f.id AS id, f.k AS k, f.arm AS arm, min(stmt) AS lo, max(stmt) AS hi FROM (SELECT idx, stmt, unnest(path) AS f FROM pc) x GROUP BY 1, 2, 3, 4),
 ifs AS (SELECT t.idx, t.lo, t.hi, e.lo - 1 AS els, e.hi AS els_hi FROM arms t LEFT JOIN arms e ON e.idx = t.idx AND e.id = t.id AND e.k = 'if' AND e.arm = 1 WHERE t.k = 'if' AND t.arm = 0),
 jumps AS (SELECT idx, stmt AS a, stmt AS b FROM pc UNION ALL SELECT idx, lo - 1, coalesce(els - 1, hi) FROM ifs),
 flows AS (SELECT j.idx, j.a, min(q.stmt) AS b FROM jumps j JOIN pc q ON q.idx = j.idx AND q.stmt > j.b
   WHERE NOT EXISTS (SELECT 1 FROM ifs i WHERE i.idx = j.idx AND i.els IS NOT NULL AND j.a BETWEEN i.lo AND i.hi AND q.stmt BETWEEN i.els AND i.els_hi) GROUP BY j.idx, j.a, j.b),
 outs AS (SELECT idx, a, coalesce(b, 1000000000) AS b FROM (SELECT j.idx, j.a, f.b FROM jumps j LEFT JOIN flows f USING (idx, a)) x),
 goes AS (SELECT DISTINCT idx, a, b FROM flows UNION SELECT o.idx, o.a, l.lo FROM outs o JOIN arms l ON l.idx = o.idx AND l.k = 'while' AND o.a BETWEEN l.lo AND l.hi AND o.b > l.hi),
 gen AS (SELECT e.*, e.kind = 'ident' AND NOT e.kills AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.idx = e.idx AND o.text = e.text AND o.n < e.n AND (o.kills OR o.kind = 'ident')
   AND len(list_filter(o.path, lambda f: f.k = 'if' AND len(list_filter(e.path, lambda g: g.id = f.id AND g.arm <> f.arm)) > 0)) = 0) AS sight FROM ev e),
 reach AS (SELECT d.idx, d.text, d.pos, g.b AS stmt FROM gen d JOIN goes g ON g.idx = d.idx AND g.a = d.stmt
   WHERE (d.kills OR d.sight) AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.idx = d.idx AND o.stmt = d.stmt AND o.text = d.text AND o.kills AND o.n > d.n)
  UNION SELECT r.idx, r.text, r.pos, g.b FROM reach r JOIN goes g ON g.idx = r.idx AND g.a = r.stmt WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.idx = r.idx AND o.stmt = r.stmt AND o.text = r.text AND o.kills)),
 come AS (SELECT u.idx, u.pos, r.pos AS d FROM gen u JOIN reach r ON r.idx = u.idx AND r.stmt = u.stmt AND r.text = u.text WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.idx = u.idx AND o.stmt = u.stmt AND o.text = u.text AND o.kills AND o.n < u.n)
  UNION SELECT u.idx, u.pos, d.pos FROM gen u JOIN gen d ON d.idx = u.idx AND d.stmt = u.stmt AND d.text = u.text AND d.n < u.n AND (d.kills OR d.sight)
   WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.idx = u.idx AND o.stmt = u.stmt AND o.text = u.text AND o.kills AND o.n < u.n AND o.n > d.n)),
 fed AS (SELECT l.idx, l.pos, l.text AS var, CASE l.part WHEN 'name' THEN 'comesFrom' ELSE 'computedFrom' END AS rel, r.text AS dep, r.pos AS dep_pos, l.looped FROM ev l JOIN ev r ON l.idx = r.idx AND l.stmt = r.stmt
   AND ((l.part = 'step' AND r.part = 'step' AND l.chain = r.chain) OR (l.part IN ('target', 'name') AND (l.part = 'target' OR l.assigned) AND (r.part = 'value' OR (r.part = 'target' AND r.seg > l.seg))))),
 edges AS (SELECT u.idx, u.pos, u.text AS var, 'comesFrom' AS rel, CASE WHEN count(c.d) > 0 THEN [u.text] ELSE [] END AS deps, coalesce(list_sort(list(c.d) FILTER (WHERE c.d IS NOT NULL)), []) AS dps
   FROM ev u LEFT JOIN come c ON c.idx = u.idx AND c.pos = u.pos WHERE u.part IN ('use', 'value') GROUP BY u.idx, u.pos, u.text
  UNION ALL SELECT idx, pos, text, 'comesFrom', [], [] FROM ev WHERE part = 'name' AND NOT assigned
  UNION ALL SELECT idx, pos, var, rel, [dep], [dep_pos] FROM fed WHERE NOT looped
  UNION ALL SELECT idx, pos, var, rel, list_sort(list(DISTINCT dep)), list_sort(list(DISTINCT dep_pos)) FROM fed WHERE looped GROUP BY 1, 2, 3, 4)"""
EDGES = f"{ROLES},\n {REACH}"
SHOWN = "array_to_string(deps, ' ') AS deps, array_to_string(dps, ' ') AS dep_pos"


def edges_sql(corpus_sql):
    return f"WITH RECURSIVE {S.tokens_cte(corpus_sql)}, {EDGES} SELECT idx, pos, var, rel, {SHOWN} FROM edges"


def edges(t):
    return G.def_use(code_corpus(t))


def listed(df):
    return df.withColumns({"deps": F.array_join("deps", " "), "dep_pos": text_list("dep_pos")})


@query("g6_def_use", edges_sql(CODE_SQL))
def g6(t):
    return listed(edges(t))


# Declarations of every form, one function per customer.
DECLARED_EXPR = """concat('void d', c_custkey, '(void) { int n', c_nationkey, ' = ', c_nationkey, ' + base, spare = 1; struct seg *s = find("',
 c_mktsegment, '", n', c_nationkey, '); unsigned long total; amount_t a = total; for (int i = 0; i < n', c_nationkey, '; i++) { total += a * i; } const char *c; }')"""
DECLARED_SQL = f"SELECT c_custkey AS idx, {DECLARED_EXPR} AS func FROM customer"


@query("g6b_declarations", edges_sql(DECLARED_SQL))
def g6b(t):
    return listed(G.def_use(t.customer.select(F.col("c_custkey").alias("idx"), F.expr(DECLARED_EXPR).alias("func"))))


@query(
    "g7_merge_edges",
    f"""WITH RECURSIVE {TOKS}, {EDGES} SELECT idx, pos, var, rel, array_to_string(list_sort(list_distinct(flatten(list(deps)))), ' ') AS deps,
 array_to_string(list_sort(list_distinct(flatten(list(dps)))), ' ') AS dep_pos FROM edges GROUP BY 1, 2, 3, 4""",
)
def g7(t):
    return listed(G.merge_edges(edges(t))).select("idx", "pos", "var", "rel", "deps", "dep_pos")


@query(
    "g7_merge_edges_lineitem",
    """SELECT l_orderkey AS idx, l_linenumber AS pos, l_returnflag AS var, CASE l_linestatus WHEN 'O' THEN 'comesFrom' ELSE 'computedFrom' END AS rel,
 string_agg(DISTINCT concat('s', l_suppkey % 10), ' ' ORDER BY concat('s', l_suppkey % 10)) AS deps,
 array_to_string(list_sort(list(DISTINCT l_partkey)), ' ') AS dep_pos FROM lineitem GROUP BY 1, 2, 3, 4""",
)
def g7_lines(t):
    """Edges of another shape and many repeats: an order's lines as tokens, suppliers and parts as sources."""
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("var"),
        F.when(F.col("l_linestatus") == "O", "comesFrom").otherwise("computedFrom").alias("rel"),
        F.array(F.concat(F.lit("s"), F.col("l_suppkey") % 10)).alias("deps"), F.array("l_partkey").alias("dep_pos"),
    )
    return listed(G.merge_edges(rows)).select("idx", "pos", "var", "rel", "deps", "dep_pos")


@query(
    "g8_merge_states",
    """WITH b AS (SELECT l_orderkey AS idx, l_linestatus AS branch, l_returnflag AS var, max(l_linenumber) AS def_pos FROM lineitem GROUP BY 1, 2, 3),
 e AS (SELECT DISTINCT l_orderkey AS idx, l_returnflag AS var, 0 AS def_pos FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F'))
 SELECT idx, var, array_to_string(list_sort(list(DISTINCT def_pos)), ' ') AS def_pos FROM (SELECT idx, var, def_pos FROM b UNION ALL SELECT * FROM e) u GROUP BY idx, var""",
)
def g8(t):
    """Branches are the line states of an order; state F stands for the else branch."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("idx"), "l_linestatus", F.col("l_returnflag").alias("var"), "l_linenumber")
    branches = lines.groupBy("idx", "l_linestatus", "var").agg(F.max("l_linenumber").alias("def_pos"))
    entry = lines.select("idx", "var").distinct().withColumn("def_pos", F.lit(0))
    merged = G.merge_states(branches, entry, lines.where("l_linestatus = 'F'").select("idx"))
    return merged.withColumn("def_pos", text_list("def_pos"))


PRUNED = """pruned AS (SELECT * FROM edges e WHERE EXISTS (SELECT 1 FROM (SELECT idx, pos FROM edges WHERE len(dps) > 0
 UNION SELECT idx, unnest(dps) FROM edges) k WHERE k.idx = e.idx AND k.pos = e.pos))"""


@query("g9_prune_edges", f"WITH RECURSIVE {TOKS}, {EDGES}, {PRUNED} SELECT idx, pos, var, rel, {SHOWN} FROM pruned")
def g9(t):
    return listed(G.prune_edges(edges(t))).select("idx", "pos", "var", "rel", "deps", "dep_pos")


NODES = """numbered AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY pos, rel, var, dps, deps) - 1 AS node FROM pruned),
 last_at AS (SELECT idx, pos, max(node) AS node, arg_max(var, node) AS var FROM numbered GROUP BY 1, 2),
 met AS (SELECT n.idx, n.node, u.i, m.node AS dep_node, m.var AS dep_var FROM numbered n, unnest(n.dps) WITH ORDINALITY AS u(p, i) JOIN last_at m ON m.idx = n.idx AND m.pos = u.p),
 nodes AS (SELECT n.*, coalesce(k.dn, []) AS dn, coalesce(k.dv, []) AS dv FROM numbered n LEFT JOIN (SELECT idx, node, list(dep_node ORDER BY i) AS dn, list(dep_var ORDER BY i) AS dv FROM met GROUP BY 1, 2) k ON k.idx = n.idx AND k.node = n.node)"""


def nodes(t):
    return G.reindex_edges(G.prune_edges(edges(t)))


@query(
    "g10_reindex_edges",
    f"""WITH RECURSIVE {TOKS}, {EDGES}, {PRUNED}, {NODES} SELECT idx, pos, var, rel, CAST(node AS INTEGER) AS node,
 array_to_string(dn, ' ') AS dep_nodes, array_to_string(dv, ' ') AS dep_vars FROM nodes""",
)
def g10(t):
    return nodes(t).select(
        "idx", "pos", "var", "rel", "node", text_list("dep_nodes").alias("dep_nodes"), F.array_join("dep_vars", " ").alias("dep_vars")
    )


# Merged edges carry several deps, which is where alignment matters.
MERGED_NODES = """merged AS (SELECT idx, pos, var, rel, list_sort(list_distinct(flatten(list(deps)))) AS deps, list_sort(list_distinct(flatten(list(dps)))) AS dps
  FROM edges GROUP BY 1, 2, 3, 4),
 mkept AS (SELECT * FROM merged e WHERE EXISTS (SELECT 1 FROM (SELECT idx, pos FROM merged WHERE len(dps) > 0 UNION SELECT idx, unnest(dps) FROM edges) k WHERE k.idx = e.idx AND k.pos = e.pos)),
 mnum AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY pos, rel, var) - 1 AS node FROM mkept),
 mlast AS (SELECT idx, pos, max(node) AS node, arg_max(var, node) AS var FROM mnum GROUP BY 1, 2),
 mlinks AS (SELECT n.idx, n.node, l.node AS dep_node, l.var AS dep_var, u.i FROM mnum n, unnest(n.dps) WITH ORDINALITY AS u(p, i) JOIN mlast l ON l.idx = n.idx AND l.pos = u.p),
 maligned AS (SELECT n.idx, n.node, n.var, n.rel, u.i, u.d AS dep, arg_min(k.dep_node, k.i) AS dep_node FROM mnum n, unnest(n.deps) WITH ORDINALITY AS u(d, i)
  LEFT JOIN mlinks k ON k.idx = n.idx AND k.node = n.node AND k.dep_var = u.d WHERE len(n.deps) > 1 GROUP BY ALL)"""


@query(
    "g11_align_deps",
    f"""WITH RECURSIVE {TOKS}, {EDGES}, {MERGED_NODES} SELECT idx, CAST(node AS INTEGER) AS node, var, string_agg(dep, ' ' ORDER BY i) AS deps,
 string_agg(CAST(dep_node AS VARCHAR), ' ' ORDER BY i) AS dep_nodes FROM maligned GROUP BY 1, 2, 3""",
)
def g11(t):
    merged = G.reindex_edges(G.prune_edges(G.merge_edges(edges(t))))
    many = G.align_deps(merged).where(F.size("deps") > 1)
    return many.select("idx", "node", "var", F.array_join("deps", " ").alias("deps"), text_list("dep_nodes").alias("dep_nodes"))


def _nth(c: str) -> str:
    return f"concat({c}, CASE {c} WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END)"


# Deps as aligned; where their number differs from the nodes', the names repeat along the nodes.
ALIGNED = """lined AS (SELECT idx, node, var, rel, deps, CASE WHEN len(deps) > 1 AND len(dn) > 1 THEN list_transform(deps, lambda x: CASE WHEN list_position(dv, x) > 0 THEN dn[list_position(dv, x)] END) ELSE dn END AS dn, pos FROM nodes),
 occ AS (SELECT *, row_number() OVER (PARTITION BY idx, var ORDER BY node) AS n FROM lined),
 items AS (SELECT o.idx, o.node, u.i, concat('the ', {nth}, ' ', o.deps[(u.i - 1) % len(o.deps) + 1]) AS item FROM occ o, unnest(o.dn) WITH ORDINALITY AS u(d, i) JOIN occ d ON d.idx = o.idx AND d.node = u.d WHERE len(o.deps) > 0),
 said AS (SELECT idx, node, list(item ORDER BY i) AS l FROM items GROUP BY 1, 2)""".replace("{nth}", _nth("d.n"))
G12_SQL = f"""WITH RECURSIVE {TOKS}, {IDS}, {CALLS}, {VARS}, {EDGES}, {PRUNED}, {NODES}, {ALIGNED}
 SELECT o.idx, string_agg(concat('The ', {_nth('o.n')}, ' ', o.var, CASE o.rel WHEN 'computedFrom' THEN ' is computed from ' ELSE ' comes from ' END,
  CASE len(s.l) WHEN 1 THEN s.l[1] WHEN 2 THEN concat(s.l[1], ' and ', s.l[2]) ELSE concat(array_to_string(s.l[:len(s.l) - 1], ', '), ', and ', s.l[-1]) END, '. '), '' ORDER BY o.node) AS text
 FROM occ o JOIN vars v ON v.idx = o.idx AND v.text = o.var JOIN said s ON s.idx = o.idx AND s.node = o.node GROUP BY o.idx"""


@query("g12_flow_sentences", G12_SQL)
def g12(t):
    return G.flow_sentences(G.align_deps(G.reindex_edges(G.prune_edges(G.function_flow(code_corpus(t), placed=False)))))


# Four characters of a token make a subtoken; nodes follow the code and its two markers.
@query(
    "g13_attention_links",
    f"""WITH RECURSIVE {TOKS}, {EDGES}, {PRUNED}, {NODES},
 spans AS (SELECT idx, pos, CAST(e - (length(text) + 3) // 4 AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (SELECT idx, pos, text, 1 + sum((length(text) + 3) // 4) OVER (PARTITION BY idx ORDER BY pos) AS e FROM toks) x),
 sizes AS (SELECT idx, max(e) + 1 AS ni, max(e) + 1 + 12 AS total FROM spans GROUP BY idx),
 laid AS (SELECT n.idx, n.node, n.dn, s.s, s.e, z.ni, z.total FROM nodes n JOIN spans s ON s.idx = n.idx AND s.pos = n.pos JOIN sizes z ON z.idx = n.idx),
 hit AS (SELECT idx, node + ni AS node, u.c FROM laid, unnest(range(s, e)) AS u(c) WHERE s < ni AND e < ni)
 SELECT DISTINCT idx, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col FROM (SELECT idx, node AS "row", c AS col FROM hit UNION ALL SELECT idx, c, node FROM hit
  UNION ALL SELECT idx, node + ni, u.d + ni FROM laid, unnest(dn) AS u(d) WHERE u.d + ni < total) l""",
)
def g13(t):
    nodes = G.reindex_edges(G.prune_edges(G.function_flow(code_corpus(t), names=False)))
    placed = nodes.withColumn("node_index", F.col("length")).withColumn("length", F.col("length") + 12)
    return G.attention_links(placed)


# The same links where the sequence has holes: two places are skipped after every third token, and every fifth place is masked.
@query(
    "g13_span_links",
    f"""WITH RECURSIVE {TOKS}, {EDGES}, {PRUNED}, {NODES},
 spans AS (SELECT idx, pos, CAST(e - (length(text) + 3) // 4 + 2 * (pos // 3) AS BIGINT) AS s, CAST(e + 2 * (pos // 3) AS BIGINT) AS e FROM (SELECT idx, pos, text, 1 + sum((length(text) + 3) // 4) OVER (PARTITION BY idx ORDER BY pos) AS e FROM toks) x),
 places AS (SELECT idx, u.c FROM spans, unnest(range(s, e)) AS u(c) WHERE u.c % 5 <> 0),
 sizes AS (SELECT idx, max(e) + 1 AS ni, max(e) + 1 + 12 AS total FROM spans GROUP BY idx),
 laid AS (SELECT n.idx, n.node, n.dn, s.s, s.e, z.ni, z.total FROM nodes n JOIN spans s ON s.idx = n.idx AND s.pos = n.pos JOIN sizes z ON z.idx = n.idx),
 hit AS (SELECT l.idx, l.node + l.ni AS node, p.c FROM laid l JOIN places p ON p.idx = l.idx AND p.c >= l.s AND p.c < l.e WHERE l.s < l.ni AND l.e < l.ni)
 SELECT DISTINCT idx, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col FROM (SELECT idx, node AS "row", c AS col FROM hit UNION ALL SELECT idx, c, node FROM hit
  UNION ALL SELECT idx, node + ni, u.d + ni FROM laid, unnest(dn) AS u(d) WHERE u.d + ni < total) l""",
)
def g13_spans(t):
    sized = toks(t).select("idx", "pos", F.floor((F.length("text") + 3) / 4).alias("n"))
    gap = 2 * F.floor(F.col("pos") / 3)
    spans = stored(subtoken_spans(sized).select("idx", "pos", (F.col("start") + gap).alias("start"), (F.col("end") + gap).alias("end")), "spans")
    places = spans.select("idx", F.explode(F.sequence("start", F.col("end") - 1)).alias("col")).where(F.col("col") % 5 != 0)
    return G.span_links(G.place_nodes(nodes(t), spans, 12), places)


# Spans of 1 to 1,000 days that are neither dense nor ordered: a line ships on a day and lasts by its quantity.
LASTS_EXPR = "CAST(l_quantity AS BIGINT) * CASE WHEN l_linenumber % 3 = 0 THEN 20 ELSE 1 END"


@query(
    "g13_overlaps",
    f"""WITH lines AS (SELECT l_partkey AS part, l_linenumber AS n, CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS s, {LASTS_EXPR} AS days FROM lineitem),
 pairs AS (SELECT a.part, least(a.s + a.days, b.s + b.days) - greatest(a.s, b.s) AS days FROM lines a JOIN lines b ON b.part = a.part AND a.s < b.s + b.days AND b.s < a.s + a.days
  WHERE a.n % 2 = 0 AND b.n % 2 = 1)
 SELECT part, count(*) AS n_pairs, CAST(sum(days) AS BIGINT) AS days FROM pairs GROUP BY part""",
)
def g13_overlaps(t):
    """How long lines of a part with an even number and with an odd one overlap, as an interval join."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")
    lines = t.lineitem.select(F.col("l_partkey").alias("part"), "l_linenumber", day.alias("start"), (day + F.expr(LASTS_EXPR)).alias("end"))
    even, odd = [lines.where(F.col("l_linenumber") % 2 == k).select("part", "start", "end") for k in (0, 1)]
    met = overlaps(even, odd, ["part"])
    days = F.least("left.end", "right.end") - F.greatest("left.start", "right.start")
    return met.groupBy("part").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(days).alias("days"))


# Definitions at the end of both arms of every branch, and before it where there is no else.
@query(
    "g8_branch_states",
    f"""WITH RECURSIVE {TOKS}, {EDGES},
 ends AS (SELECT a.idx, a.id, a.arm, l.text, l.n FROM arms a JOIN (SELECT idx, text, stmt, n FROM ev WHERE true) l ON l.idx = a.idx AND l.stmt BETWEEN a.lo AND a.hi WHERE a.k = 'if'),
 touched AS (SELECT DISTINCT idx, id, arm, text FROM ends),
 exits AS (SELECT a.idx, a.id, a.arm, p.stmt FROM arms a JOIN pc p ON p.idx = a.idx AND p.stmt BETWEEN a.lo AND a.hi JOIN goes g ON g.idx = a.idx AND g.a = p.stmt AND (g.b > a.hi OR g.b < a.lo) WHERE a.k = 'if'
  UNION SELECT a.idx, a.id, a.arm, a.hi FROM arms a WHERE a.k = 'if' AND NOT EXISTS (SELECT 1 FROM goes g WHERE g.idx = a.idx AND g.a = a.hi)),
 held AS (SELECT x.idx, x.id, x.arm, r.text, r.pos FROM exits x JOIN reach r ON r.idx = x.idx AND r.stmt = x.stmt WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.idx = x.idx AND o.stmt = x.stmt AND o.text = r.text AND o.kills)
  UNION SELECT x.idx, x.id, x.arm, d.text, d.pos FROM exits x JOIN gen d ON d.idx = x.idx AND d.stmt = x.stmt AND (d.kills OR d.sight)
   WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.idx = d.idx AND o.stmt = d.stmt AND o.text = d.text AND o.kills AND o.n > d.n))
 SELECT h.idx, h.id AS branch, h.text AS var, array_to_string(list_sort(list(DISTINCT h.pos)), ' ') AS def_pos FROM held h JOIN touched t USING (idx, id, arm, text) GROUP BY 1, 2, 3""",
)
def g8_branches(t):
    """The states that the arms of each ``if`` of the code leave, merged branch by branch."""
    arms = G.branch_states(code_corpus(t)).withColumn("idx", F.struct("idx", "branch"))
    merged = G.merge_states(arms)
    return merged.select("idx.idx", "idx.branch", "var", text_list("def_pos").alias("def_pos"))
