import pytest
from pyspark.sql import functions as F

from verdigraph.functions import prompt_text as fixed
from verdigraph.operators import corpus as C
from verdigraph.operators import prompts as P

Q = "Is the following function vulnerable? Please answer Yes or No."


def one(df, column):
    return df.first()[column]


def test_zero_shot(spark):
    rows = spark.createDataFrame([(1, " int  x; ", "f calls g. ", "api_call"), (2, "y", "", "data_flow"), (3, "z", "c", "other")], "idx bigint, func string, context string, kind string")
    got = [r["user"] for r in P.zero_shot(rows, F.col("kind")).orderBy("idx").collect()]
    assert got[0] == Q + "\n\n```\nint x;\n\n/* API call: f calls g. */\n```"
    assert got[1] == Q + "\n\n```\ny\n```"
    assert got[2] == Q + "\n\n```\nz\n\n/* : c*/\n```"


SHOTS = [(0, 0, "v  0", 1), (0, 1, "n0", 0), (1, 0, "v1", 1), (1, 1, "n1", 0), (2, 0, "v2", 1), (2, 1, "n2", 0)]


def block(func, target):
    return f"{Q}\n```\n{func}\n```\n\n{fixed.ANSWERS[target]}\n\n"


def test_few_shot_takes_first_rows(spark):
    shots = spark.createDataFrame(SHOTS, "pair_id bigint, pos_in_pair int, func string, target int")
    rows = spark.createDataFrame([(1, "a\nb")], "idx bigint, func string")
    want = block("v 0", 1) + block("n0", 0) + block("v1", 1) + f"{Q}\n```\na b\n```"
    assert one(P.few_shot(rows, shots, 3), "user") == want


def test_few_shot_random(spark):
    shots = spark.createDataFrame(SHOTS, "pair_id bigint, pos_in_pair int, func string, target int")
    rows = spark.range(40).select(F.col("id").alias("idx"), F.lit("q").alias("func"))
    pairs = [block(f"v {i}" if i == 0 else f"v{i}", 1) + block(f"n{i}", 0) for i in range(3)]
    allowed = {a + b + f"{Q}\n```\nq\n```" for a in pairs for b in pairs if a != b}
    got = [r["user"] for r in P.few_shot(rows, shots, 2, seed=1).collect()]
    assert len(got) == 40 and set(got) == allowed


def test_few_shot_draws_stored_pair_numbers(spark):
    shots = spark.createDataFrame([(10 * p + 10, i, f, t) for p, i, f, t in SHOTS], "pair_id bigint, pos_in_pair int, func string, target int")
    rows = spark.range(30).select(F.col("id").alias("idx"), F.lit("q").alias("func"))
    assert P.few_shot(rows, shots, 2, seed=1).where("user is null").count() == 0
    drawn = P.draw_pairs(rows, shots, 3, 1)
    assert {r["pair_id"] for r in drawn.collect()} == {10, 20, 30} and drawn.count() == 90


def test_merge_dialogs(spark):
    turns = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 1, "b"), (2, 5, "z")], "conv_id bigint, turn int, text string")
    assert {r["conv_id"]: r["merged"] for r in P.merge_dialogs(turns).collect()} == {1: "a\n\nb\n\nb", 2: "z"}


def test_sample_pairs_is_even(spark):
    rows = spark.range(6000).withColumnRenamed("id", "idx")
    drawn = P.sample_pairs(rows, 4, 2, 9)
    counts = {tuple(r["picks"]): r["count"] for r in drawn.groupBy("picks").count().collect()}
    assert len(counts) == 12 and all(a != b and 380 < n < 620 for (a, b), n in counts.items())
    assert sorted(one(P.sample_pairs(rows, 4, 4, 9), "picks")) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        P.sample_pairs(rows, 2, 3, 9)


def test_fit_budget_flag_at_exact_length(spark):
    rows = spark.createDataFrame([(4,), (5,), (6,)], "n int").select("n", F.lit("one two").alias("system"), F.repeat(F.lit(" w"), F.col("n")).alias("user"))
    got = C.fit_budget(rows, F.lit(27), F.lit(False)).orderBy("n").collect()
    assert [(r["user"], r["truncated"]) for r in got] == [(" w" * 4, False), (" w" * 5, True), (" w" * 5, True)]
    slow = C.fit_budget(rows, F.lit(2 + 5 + 200 + 5), F.lit(True)).orderBy("n").collect()
    assert [r["truncated"] for r in slow] == [False, True, True]


def render(spark, family, user, cap, cot, kind):
    rows = spark.createDataFrame([("S y", user)], "system string, user string")
    return P.render_chat(rows, F.lit(family), F.lit(cap), F.lit(cot), F.lit(kind)).first()


def test_render_whole(spark):
    cot = "Let's think step by step."
    assert render(spark, "llama", "u v", 999, True, "None")["prompt"] == f"[INST] <<SYS>>\nS y\n<</SYS>>\n\nu v\n{cot} [/INST]"
    assert render(spark, "mistral", "u v", 999, False, "None")["prompt"] == "<s>[INST] S y\n\nu v [/INST]"
    assert render(spark, "deepseek", "u v", 999, True, "None")["prompt"] == f"S y\n### Instruction:\nu v\n{cot}\n### Response:\n"
    assert render(spark, "wizardcoder", "u v", 999, True, "None")["prompt"] == f"S y\n\n### Instruction:\nu v\n{cot}\n\n### Response:\n"
    assert render(spark, "starchat", "u v", 999, True, "None")["prompt"] == f"<|system|>\nS y<|end|>\n<|user|>\nu v\n{cot}<|end|>\n<|assistant|>"
    gpt = render(spark, "gpt", "u v", 999, True, "None")
    assert (gpt["system_turn"], gpt["user_turn"]) == ("S y", f"u v{cot}\n\n")


def test_render_truncated(spark):
    assert render(spark, "gpt", "a b c d", 34, False, "data_flow")["user_turn"] == "a b*/\n'''\n"
    assert render(spark, "gpt", "a b c d", 34, False, "None")["user_turn"] == "a b\n'''\n"
    assert render(spark, "llama", "a b c d", 5 + 20 + 2, False, "api_call")["user_turn"] == "a b*/\n'''"
    assert render(spark, "mistral", "a b c d", 24, False, "api_call")["user_turn"] == "a b*/\n'''"
    slow = render(spark, "starchat", "a b c d", 4 + 205 + 3, True, "data_flow")["user_turn"]
    assert slow == "<|user|>\na b*/\n'''\nLet's think step by step.<|end|>\n"
    quick = render(spark, "starchat", "a b c d", 4 + 20 + 3, False, "data_flow")["user_turn"]
    assert quick == "<|user|>\na b\n'''<|end|>\n"


def test_route(spark):
    names = {"CodeLlama-34b-gpt": "llama", "deepseek-coder": "deepseek", "Mistral": "mistral", "starchat-beta": "starchat", "WizardCoder": "wizardcoder", "gpt-4": "gpt"}
    rows = spark.createDataFrame([(n,) for n in names], "m string")
    assert [r[0] for r in rows.select(P.route(F.col("m"))).collect()] == list(names.values())
    with pytest.raises(Exception, match="no chat family"):
        spark.createDataFrame([("bert",)], "m string").select(P.route(F.col("m"))).collect()


def test_encode_layouts(spark):
    vocab = spark.createDataFrame([("a", 10), ("b", 11)], "token string, id bigint")
    rows = spark.createDataFrame([(1, "a b zz a b a b"), (2, "")], "idx bigint, func string")
    plain = {r["idx"]: r["input_ids"] for r in C.encode(rows, vocab, 6).collect()}
    assert plain == {1: [0, 10, 11, 3, 10, 2], 2: [0, 2, 1, 1, 1, 1]}
    only = {r["idx"]: r["input_ids"] for r in C.encode(rows, vocab, 6, "encoder_only").collect()}
    assert only == {1: [0, 6, 2, 10, 11, 2], 2: [0, 6, 2, 2, 1, 1]}


def test_graph_budget(spark):
    rows = spark.createDataFrame([(1, [7] * 20, 3), (2, [7] * 2, 9), (3, [7] * 20, 50)], "idx bigint, code_ids array<bigint>, n_nodes int")
    for r in C.graph_budget(rows, 8, 4).collect():
        code, nodes = r["code_ids"], r["n_nodes"]
        kept = code[: 8 + 4 - 3 - min(nodes, 4)][: 8 - 3]
        source = [0] + kept + [2]
        left = min(nodes, 8 + 4 - len(source))
        fill = 12 - len(source) - left
        assert r["input_ids"] == source + [3] * left + [1] * fill
        assert r["position_idx"] == [i + 2 for i in range(len(source))] + [0] * left + [1] * fill


def test_merge_turns(spark):
    rows = spark.createDataFrame([([("user", "a"), ("assistant", "b"), ("user", "c")],)], "t array<struct<role string, content string>>")
    assert rows.select(P.merge_turns(F.col("t"))).first()[0] == "a\n\nb\n\nc"


def test_with_context(spark):
    rows = spark.createDataFrame([(1, "api_call"), (1, "data_flow"), (2, "api_call"), (3, "None")], "idx bigint, kind string")
    contexts = spark.createDataFrame([(1, "api_call", "A"), (1, "data_flow", "D"), (3, "api_call", "B")], "idx bigint, kind string, text string")
    got = P.with_context(rows, contexts, F.col("kind")).collect()
    assert sorted((r["idx"], r["kind"], r["context"]) for r in got) == [(1, "api_call", "A"), (1, "data_flow", "D"), (2, "api_call", ""), (3, "None", "")]


def test_texts_of_the_corpus_are_not_sent_to_all_tasks(spark):
    """Draws, worked examples and contexts have a row a function, or several, whatever the packed source weighs."""
    rows = spark.range(6).selectExpr("id AS idx", "concat('f', id) AS func")
    shots = spark.range(8).selectExpr("concat('s', id) AS func", "CAST(id % 2 AS INT) AS target", "id DIV 2 AS pair_id", "CAST(id % 2 AS INT) AS pos_in_pair")
    contexts = spark.range(6).selectExpr("id AS idx", "'api_call' AS kind", "concat('c', id) AS text")
    ready = P.attach_contexts(P.few_shot(rows, shots, 2, seed=1), contexts)
    plan = ready._jdf.queryExecution().executedPlan().toString()
    # Drawn numbers meet the pool, then its blocks; the corpus meets its examples and its contexts. The pool's ranks alone meet a row a block.
    assert plan.count("SortMergeJoin") >= 4 and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "[_key#" not in x]
    assert ready.where("user IS NULL OR contexts.api_call IS NULL").count() == 0 and ready.count() == 6
