"""SQL that gives the rows of those queries whose results SQL can express."""

from __future__ import annotations

from verdigraph.llm import licenses

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

# Shingles as texts; links by shared shingles; least reachable id by growing labels.
OP4 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS l FROM documents WHERE doc_id IS NOT NULL),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(l) < 5 THEN array_to_string(l, ' ') ELSE array_to_string(l[i : i + 4], ' ') END AS g
  FROM d, unnest(range(1, greatest(len(l) - 3, 2))) AS u(i) WHERE len(l) > 0),
 n AS (SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
 two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r AS (SELECT doc_id AS node, doc_id AS label FROM n UNION SELECT two.b, r.label FROM r JOIN two ON two.a = r.node WHERE r.label < two.b)
 SELECT n.doc_id, n.n AS n_shingles, min(r.label) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2"""

OP6 = f"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS l FROM documents WHERE doc_id IS NOT NULL),
 w AS (SELECT doc_id, i, array_to_string(l[i : i + 19], ' ') AS k FROM d, unnest(range(1, len(l) - 18)) AS u(i)),
 f AS (SELECT k, min({{'doc': doc_id, 'at': i}}) AS first FROM w GROUP BY 1),
 later AS (SELECT w.doc_id, w.i FROM w JOIN f ON f.k = w.k WHERE f.first.doc < w.doc_id OR (f.first.doc = w.doc_id AND f.first.at < w.i)),
 gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, unnest(range(0, 20)) AS v(j)),
 each AS (SELECT d.doc_id, u.p, u.word FROM d, unnest(d.l) WITH ORDINALITY AS u(word, p)),
 kept AS (SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY 1)
 SELECT d.doc_id, len(d.l) AS n_words, len(d.l) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def license_sql(threshold: float = 0.8) -> str:
    """Every line against every template, without filters."""
    sets = licenses.template_sets(licenses.TEMPLATES)
    words = [(i, label, w.decode(), len(s)) for i, (label, s) in enumerate(sets) for w in sorted(s)]
    phrases = [(p, label, len(p.split())) for p, label in licenses.PHRASES.items()]
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
 l AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS l FROM d),
 tw(item, label, word, size) AS (VALUES {_values(words)}), ph(phrase, label, size) AS (VALUES {_values(phrases)}),
 places AS (SELECT l.r, u.i - 1 AS start, ph.label FROM l, ph, unnest(range(1, len(l.l) + 1)) AS u(i) WHERE array_to_string(l.l[u.i : u.i + ph.size - 1], ' ') = ph.phrase),
 base AS (SELECT r, count(*) AS n, min(start) AS first, max(start) AS last FROM places GROUP BY 1),
 lines AS (SELECT r, i, unnest(list_distinct(regexp_extract_all(line, '{word}'))) AS word FROM (SELECT d.r, u.i, u.line FROM d, unnest(string_split(d.t, chr(10))) WITH ORDINALITY AS u(line, i)) x),
 hits AS (SELECT r, i, item, label, count(*) / any_value(size)::DOUBLE AS share FROM lines JOIN tw ON tw.word = lines.word GROUP BY 1, 2, 3, 4 HAVING count(*) >= {threshold} * any_value(size) - 1e-9),
 named AS (SELECT r, label, 1.0::DOUBLE AS share, true AS own FROM places UNION ALL SELECT r, label, share, false FROM hits),
 shown AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE own) AS own, max(share) AS score FROM named GROUP BY 1)
 SELECT l.doc_id, len(l.l) AS n_words, coalesce(base.n, 0) AS n_base, base.first AS first_word, base.last AS last_word, coalesce(shown.own, '') AS base_labels,
 coalesce(shown.labels, '') AS labels, coalesce(shown.score, 0.0) AS score FROM l LEFT JOIN base ON base.r = l.r LEFT JOIN shown ON shown.r = l.r"""


# As OP4 at 85 percent, with the document that stays.
OP11 = f"SELECT *, doc_id = component_id AS kept FROM ({OP4.replace('>= 75 *', '>= 85 *')}) linked"

FINITE = "embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
# floor(s / n) of integers.
FLOORED = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every part against every entry of its codebook."""
    steps = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings WHERE {FINITE}),
 f AS (SELECT r, (u.i - 1) // (len(p) // {parts}) AS q, (u.i - 1) % (len(p) // {parts}) AS d, u.x FROM v, unnest(p) WITH ORDINALITY AS u(x, i)),
 s0 AS (SELECT r, row_number() OVER (ORDER BY vec_id, p) - 1 AS e FROM v QUALIFY e < {entries}),
 b0 AS (SELECT q, e, d, x FROM f JOIN s0 USING (r))"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT f.r, f.q, b.e, sum((f.x - b.x) * (f.x - b.x)) AS dist FROM f JOIN b{i} b ON b.q = f.q AND b.d = f.d GROUP BY 1, 2, 3),
 a{i} AS (SELECT r, q, min({{'dist': dist, 'e': e}}) AS m FROM d{i} GROUP BY 1, 2)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS (SELECT q, e, d, {FLOORED} AS x FROM (SELECT f.q, a.m.e AS e, f.d, sum(f.x) AS s, count(*) AS n FROM f JOIN a{i} a ON a.r = f.r AND a.q = f.q GROUP BY 1, 2, 3) t
 UNION ALL SELECT q, e, d, x FROM b{i} WHERE (q, e) NOT IN (SELECT (q, m.e) FROM a{i}))""")
    steps.append(f"""rowed AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY q) AS code, CAST(sum(m.dist) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
 named AS (SELECT v.vec_id, v.label, rowed.code, rowed.error FROM v JOIN rowed USING (r)),
 same AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM named GROUP BY 1)""")
    return "WITH " + ",\n ".join(steps) + f""" SELECT n.vec_id, n.code, n.error, s.label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY q, e, d)) FROM b{rounds}) AS codebooks_sha256
 FROM named n JOIN same s ON s.label IS NOT DISTINCT FROM n.label"""


def clusters_sql(k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64) -> str:
    """Every vector against every centroid."""
    steps = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings WHERE {FINITE} AND len(embedding) = {width}),
 f AS (SELECT r, u.i AS d, u.x FROM v, unnest(p) WITH ORDINALITY AS u(x, i)),
 s0 AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), p) - 1 AS c FROM v QUALIFY c < {k}),
 c0 AS (SELECT c, d, x FROM f JOIN s0 USING (r))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, min({{'dist': dist, 'c': c}}) AS m FROM (SELECT f.r, c.c, sum((f.x - c.x) * (f.x - c.x)) AS dist FROM f JOIN c{i} c ON c.d = f.d GROUP BY 1, 2) t GROUP BY 1)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS (SELECT c, d, {FLOORED} AS x FROM (SELECT a.m.c AS c, f.d, sum(f.x) AS s, count(*) AS n FROM f JOIN a{i} a USING (r) GROUP BY 1, 2) t
 UNION ALL SELECT c, d, x FROM c{i} WHERE c NOT IN (SELECT m.c FROM a{i}))""")
    steps.append(f"shas AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY 1)")
    return "WITH " + ",\n ".join(steps) + f""" SELECT v.vec_id, CAST(a.m.c AS INTEGER) AS cluster, CAST(a.m.dist AS BIGINT) AS distance, CAST(sum(a.m.dist) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(a.m.dist) OVER () AS BIGINT) AS inertia, shas.sha AS centroid_sha256 FROM v JOIN a{rounds} a USING (r) JOIN shas ON shas.c = a.m.c"""


SQL = {
    "op4_ngram_jaccard": OP4, "op6_phrase_automata": OP6, "op8_license_join": license_sql(), "op11_minhash_bayes": OP11,
    "op12_dual_tree_codes": codes_sql(), "op13_threshold_clusters": clusters_sql(),
}
