"""Verdicts out of free-text answers."""

from pyspark.sql import functions as F

from verdigraph.functions import answer_rules as fixed
from verdigraph.functions import answers as A
from verdigraph.functions.text import strip_ws
from verdigraph.operators import answers as OA
from verdigraph.plans import sqltext as S
from verdigraph.plans.fixtures import ANSWERS_SQL, RESPONSES_SQL, answers, responses
from verdigraph.plans.measuring import SIMPLE_SQL
from verdigraph.plans.registry import query


@query(
    "r1_simple_verdict",
    f"""SELECT 'short' AS kind, config, idx, {SIMPLE_SQL} AS verdict FROM ({RESPONSES_SQL}) r
 UNION ALL SELECT 'long', 0, idx, {SIMPLE_SQL} FROM ({ANSWERS_SQL}) a""",
)
def r1(t):
    short = responses(t).select(F.lit("short").alias("kind"), "config", "idx", "response")
    long = answers(t).select(F.lit("long"), F.lit(0), "idx", "response")
    return short.union(long).select("kind", "config", "idx", A.simple_verdict(F.col("response")).alias("verdict"))


FENCE = "concat(chr(10), '```')"
TRIM_SQL = f"""q AS (SELECT idx, model, prompt_type, CASE WHEN prompt_type = 'zero_shot' AND contains(response, 'Question') AND NOT starts_with(response, 'Question:')
  THEN substr(response, 1, strpos(response, 'Question') - 1) ELSE response END AS r FROM ({ANSWERS_SQL}) a),
 p AS (SELECT *, strpos(r, {FENCE}) AS f1, substr(r, strpos(r, {FENCE}) + 4) AS after FROM q),
 b AS (SELECT idx, model, prompt_type, CASE WHEN f1 = 0 THEN r WHEN strpos(after, {FENCE}) > 0
  THEN concat(substr(r, 1, f1 - 1), substr(after, strpos(after, {FENCE}) + 4)) ELSE concat(substr(r, 1, f1 - 1), substr(r, 4)) END AS r FROM p),
 trimmed AS (SELECT idx, model, prompt_type, list_reduce(list_filter(regexp_split_to_array(r, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
  lambda l: starts_with(lower(l), 'answer:')), lambda acc, l: CASE WHEN contains(acc, 'reasoning:') THEN l ELSE acc END, r) AS r FROM b)"""


@query("r2_pre_trim", f"WITH {TRIM_SQL} SELECT idx, prompt_type, r AS response FROM trimmed")
def r2(t):
    rows = answers(t)
    return OA.pre_trim(rows, F.col("prompt_type")).select("idx", "prompt_type", "response")


def _before(text: str, mark: str) -> str:
    return f"CASE WHEN strpos({text}, {mark}) > 0 THEN substr({text}, 1, strpos({text}, {mark}) - 1) ELSE {text} END"


ENDED_SQL = f"""ended1 AS (SELECT *, CASE WHEN contains(model, 'starcoder') THEN {_before('r', "'Human:'")} WHEN contains(model, 'WizardCoder') THEN {_before('r', "'<|endoftext|>'")}
  ELSE {_before('r', "'</s>'")} END AS r1 FROM trimmed),
 ended2 AS (SELECT *, CASE WHEN contains(model, 'starcoder') THEN {_before('r1', "concat(chr(10), chr(10))")}
  WHEN contains(model, 'WizardCoder') THEN {_before('r1', "'### Instruction:'")} ELSE r1 END AS r2 FROM ended1),
 ended AS (SELECT idx, model, CASE WHEN contains(model, 'starcoder') THEN {_before('r2', "'-----'")} ELSE r2 END AS r FROM ended2)"""


@query("r3_trim_answer", f"WITH {TRIM_SQL}, {ENDED_SQL} SELECT idx, model, r AS response FROM ended")
def r3(t):
    trimmed = OA.pre_trim(answers(t), F.col("prompt_type")).withColumn("family", A.answer_family(F.col("model")))
    return trimmed.select("idx", "model", A.trim_answer(F.col("response"), F.col("family")).alias("response"))


# The checking engine has no look-around and ASCII word boundaries: letters beyond ASCII become x, and
# what a look-ahead forbids is filtered out match by match.
PLAIN = "[^\\x00-\\x7F\\p{Z}\\p{P}\\p{S}\\p{C}]"
REACH = r"[^.;,\n]*"


def _exists(text: str, pattern: str, voids=()) -> str:
    matches = f"regexp_extract_all({text}, {S.quoted(pattern)})"
    kept = " AND ".join(f"NOT regexp_matches(m, {S.quoted(v)})" for v in voids) or "true"
    return f"len(list_filter({matches}, lambda m: {kept})) > 0"


HAS_WEAKNESS = (
    REACH + r"\b(contains|\b(could|can)\b[^.;\n]+(cause|lead to|result in)|will result in|point out|has|does have|which is a"
    r"|there is|there are)\b[^.;,\n]+" + fixed.WEAKNESS
)
IS_WEAK = REACH + r"\b(appears to be|(function|code|snippet|`) is)\b[^.;\n,]+" + fixed.WEAK_ADJECTIVE
LACKS = (
    r"\b(does not|do not|don't|doesn't|has no|is not|isn't|there are no|contains none of|contains no|cannot detect)\b[^.;,\n]+"
    + fixed.WEAKNESS
)


def rule_sql(c: str) -> str:
    weak = [_exists(c, r"\byes(, |\.|\n|$)")]
    weak += [_exists(c, HAS_WEAKNESS, (fixed.DENIES_WEAKNESS, fixed.CANNOT_TELL, r"contains (no|none|the function)|there (is|are) (no|none)|(could|can) not|which is a good practice"))]
    weak += [_exists(c, IS_WEAK, (fixed.LOOKS_SOUND, fixed.DENIES_STATE, fixed.CANNOT_TELL, r" is (not|also not|no|none)"))]
    weak += [f"regexp_matches({c}, {S.quoted(p)})" for n, p, *_ in fixed.VULNERABLE_RULES if n not in ("yes", "has_weakness", "is_weak")]
    sound = [_exists(c, REACH + r"\bno(, |\.|\n|$)", (fixed.ECHOED_QUESTION,))]
    sound += [_exists(c, fixed.SOUND_RULES[1][1]), _exists(c, LACKS, (r"(is not|isn't) possible to determine",)), _exists(c, "answer: no")]
    late = [f"regexp_matches({c}, {S.quoted(p)})" for _, p, *_ in fixed.LATE_VULNERABLE_RULES]
    return f"CASE WHEN {' OR '.join(weak)} THEN 1 WHEN {' OR '.join(sound)} THEN 0 WHEN {' OR '.join(late)} THEN 1 ELSE 2 END"


def _lowered(c: str) -> str:
    return f"regexp_replace(lower({S.strip(c)}), '{PLAIN}', 'x', 'g')"


@query("r4_rule_verdict", f"SELECT idx, {rule_sql('r')} AS verdict FROM (SELECT idx, {_lowered('response')} AS r FROM ({ANSWERS_SQL}) a) l")
def r4(t):
    low = answers(t).select("idx", F.lower("response").alias("r"))
    return low.select("idx", A.rule_verdict(F.col("r")).alias("verdict"))


def answer_sql(source: str) -> str:
    """Verdict of ``r``: first paragraph, then the whole when that is undecided or improvable."""
    chunk = "string_split(regexp_replace(r, '\\n```[a-z]+\\n', chr(10) || chr(10), 'g'), chr(10) || chr(10))[1]"
    return f"""SELECT idx, CASE WHEN v = 2 OR contains(chunk, 'can be improved') THEN {rule_sql('r')} ELSE v END AS verdict
 FROM (SELECT *, {rule_sql('chunk')} AS v FROM (SELECT *, {chunk} AS chunk FROM ({source}) s) c) d"""


@query("r5_answer_verdict", answer_sql(f"SELECT idx, {_lowered('response')} AS r FROM ({ANSWERS_SQL}) a"))
def r5(t):
    low = answers(t).select("idx", F.lower(strip_ws("response")).alias("r"))
    return OA.answer_verdict(low, "r").select("idx", "verdict")


@query("r6_parse_answers", f"WITH {TRIM_SQL}, {ENDED_SQL} " + answer_sql(f"SELECT idx, {_lowered('r')} AS r FROM ended"))
def r6(t):
    return OA.parse_answers(answers(t)).select("idx", "verdict")
