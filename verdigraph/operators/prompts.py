"""Prompt tables: dialogs from a corpus, chat layouts, sweeps over configurations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions import prompt_text as fixed
from verdigraph.functions.text import collapse_ws
from verdigraph.operators.corpus import RESERVE_HOSTED, RESERVE_LOCAL, fit_budget
from verdigraph.operators.scale import rank_rows
from verdigraph.session import by_merge


def answer_text(target: Column) -> Column:
    """Answer sentence of a 0/1 label."""
    return F.element_at(F.array(*[F.lit(a) for a in fixed.ANSWERS]), target.cast("int") + 1)


def question_with_code(code: Column) -> Column:
    return F.concat(F.lit(fixed.QUESTION + "\n```\n"), code, F.lit("\n```"))


def zero_shot_text(code: Column, context: Column, graph_type: Column) -> Column:
    """User turn: question, fenced code, and a comment with the context unless that is empty."""
    label = F.lit("")
    for kind, shown in fixed.CONTEXT_LABELS.items():
        label = F.when(graph_type == kind, F.lit(shown)).otherwise(label)
    block = F.when(context == "", F.lit("")).otherwise(
        F.concat(F.lit("\n/* "), label, F.lit(": "), context, F.lit("*/\n"))
    )
    return F.concat(F.lit(fixed.QUESTION + "\n\n```\n"), code, F.lit("\n"), block, F.lit("```"))


def zero_shot(df: DataFrame, graph_type: Column | None = None, code: str = "func", context: str = "context") -> DataFrame:
    """Add system and user turns."""
    kind = F.coalesce(graph_type if graph_type is not None else F.lit(None).cast("string"), F.lit(""))
    return df.withColumn("system", F.lit(fixed.SYSTEM)).withColumn(
        "user", zero_shot_text(collapse_ws(code), F.col(context), kind)
    )


def merge_turns(turns: Column) -> Column:
    """Contents of an array of turns in order, a blank line between them."""
    return F.array_join(F.transform(turns, lambda t: t["content"]), "\n\n")


def merge_dialogs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", content: str = "text") -> DataFrame:
    """conv, merged: all contents of each dialog in turn order, equal turns by content, a blank line between them."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(turn), F.col(content).alias("content"))))
    return turns.groupBy(conv).agg(merge_turns(listed).alias("merged"))


def shot_block(func: Column, target: Column) -> Column:
    """One worked example, question turn then answer turn, each closed by a blank line."""
    turns = F.array(
        F.struct(F.lit("user").alias("role"), question_with_code(collapse_ws(func)).alias("content")),
        F.struct(F.lit("assistant").alias("role"), answer_text(target).alias("content")),
    )
    return F.concat(merge_turns(turns), F.lit("\n\n"))


def pair_blocks(shots: DataFrame) -> DataFrame:
    """pair_id, block: both members of each pair as text, in stored order."""
    text = shot_block(F.col("func"), F.col("target"))

    def member(i: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("pos_in_pair") == i, text)), F.lit(""))

    return shots.groupBy("pair_id").agg(F.concat(member(0), member(1)).alias("block"))


def first_shots(shots: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows (not pairs) of the example file."""
    return shots.orderBy("pair_id", "pos_in_pair").limit(n)


def sample_pairs(df: DataFrame, n_pairs: int, n: int, seed: int, key: str = "idx") -> DataFrame:
    """``picks``: ``n`` distinct pair numbers below ``n_pairs`` for each row, drawn per row.

    Floyd's method: the k-th draw is uniform below ``n_pairs - n + k + 1`` and a repeat is replaced by
    that range's last number, which gives every n-subset the same chance without touching the pool.
    A second hash then puts the picks in random order.
    """
    if not 1 <= n <= n_pairs:
        raise ValueError(f"cannot draw {n} of {n_pairs} pairs without replacement")

    def hashed(tag: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), tag))

    def draw(picked: Column, k: Column) -> Column:
        top = F.lit(n_pairs - n).cast("bigint") + k
        number = F.conv(F.substring(hashed(k.cast("string")), 1, 12), 16, 10).cast("bigint")
        pick = F.pmod(number, top + 1)
        return F.concat(picked, F.array(F.when(F.array_contains(picked, pick), top).otherwise(pick)))

    empty = F.array().cast("array<bigint>")
    picks = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), empty, draw)
    mixed = F.array_sort(
        F.transform(picks, lambda p: F.struct(hashed(F.concat(F.lit("o"), p.cast("string"))).alias("h"), p.alias("p")))
    )
    return df.withColumn("picks", F.transform(mixed, lambda x: x["p"]))


def draw_pairs(df: DataFrame, shots: DataFrame, n: int, seed: int, key: str = "idx") -> DataFrame:
    """key, slot, pair_id: ``n`` distinct stored pairs for each row, drawn by their rank in the pool."""
    ranked = rank_rows(shots.select("pair_id").distinct(), ["pair_id"], name="_pick")
    drawn = sample_pairs(df.select(key), ranked.count(), n, seed, key)
    return drawn.select(key, F.posexplode("picks").alias("slot", "_pick")).join(by_merge(ranked), "_pick").select(key, "slot", "pair_id")


def few_shot(df: DataFrame, shots: DataFrame, n: int, seed: int | None = None, code: str = "func") -> DataFrame:
    """Add system and user turns, worked examples ahead of the question in one user turn.

    Without a seed the first ``n`` example rows serve everyone; with one, ``n`` stored pairs are drawn per
    row. Draws meet their blocks as (idx, slot) rows and become one text a row before the corpus joins, once.
    """
    question = question_with_code(collapse_ws(code))
    out = df.withColumn("system", F.lit(fixed.SYSTEM))
    if seed is None:
        ordered = F.array_sort(F.collect_list(F.struct("pair_id", "pos_in_pair", shot_block(F.col("func"), F.col("target")).alias("block"))))
        examples = first_shots(shots, n).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "").alias("block"))
        return out.withColumn("user", F.concat(examples.scalar(), question))
    drawn = draw_pairs(df, shots, n, seed).join(by_merge(pair_blocks(shots)), "pair_id")
    listed = F.array_sort(F.collect_list(F.struct("slot", "block")))
    told = drawn.groupBy("idx").agg(F.array_join(F.transform(listed, lambda x: x["block"]), "").alias("_blocks"), F.count(F.lit(1)).alias("_n"))
    held = F.when(F.col("_n") == n, F.col("_blocks")).otherwise(F.raise_error(F.lit("an example block is missing")))
    return out.join(by_merge(told), "idx", "left").withColumn("user", F.concat(held, question)).drop("_blocks", "_n")


def route(model: Column) -> Column:
    """Chat family by part of the model's name; an unknown name is an error."""
    (part, family), *rest = fixed.CHAT_FAMILIES
    out = F.when(model.contains(part), F.lit(family))
    for part, family in rest:
        out = out.when(model.contains(part), F.lit(family))
    return out.otherwise(F.raise_error(F.concat(F.lit("no chat family for model "), model)))


def render_chat(df: DataFrame, family: Column, max_len: Column, cot: Column, graph_type: Column) -> DataFrame:
    """Lay each dialog out as its family's prompt: fit the user turn, close what was cut, frame it.

    Adds ``family``, ``system_turn``, ``user_turn``, ``prompt``, ``truncated``, ``closer`` (what ends a cut turn)
    and ``step_line`` to rows with system
    and user columns. All families share one pass: their texts are picked per row.
    """
    fam = F.col("family")

    def pick(part: str, at: int | None = None) -> Column:
        out = F.when(fam.isNull(), F.lit(None).cast("string"))
        for name, layout in fixed.LAYOUTS.items():
            out = out.when(fam == name, F.lit(layout[part] if at is None else layout[part][at]))
        return out

    turned = df.withColumn("family", family)
    turned = turned.withColumns(
        {
            "system_turn": F.concat(pick("system", 0), F.col("system"), pick("system", 1)),
            "user_turn": F.concat(pick("user", 0), F.col("user"), pick("user", 1)),
        }
    )
    # Mistral's budget counts the bare system text: its blank line is added after the fit.
    counted = F.when(fam == "mistral", F.col("system")).otherwise(F.col("system_turn"))
    reserve = F.when(fam == "gpt", F.lit(RESERVE_HOSTED)).otherwise(F.lit(RESERVE_LOCAL))
    fit = fit_budget(turned.withColumn("_counted", counted), max_len, cot, reserve, system="_counted", user="user_turn")

    none = F.lit("")
    comment_end = F.when(graph_type.isin(*fixed.CONTEXT_LABELS), F.lit(fixed.COMMENT_END)).otherwise(none)
    cot_line = F.when(cot, pick("cot")).otherwise(none)
    # Starchat closes the turn itself: the comment end only shows together with the step-by-step line,
    # and a turn that fits is rebuilt from the dialog.
    end = F.lit(fixed.LAYOUTS["starchat"]["user"][1])
    own_step = F.lit("\n" + fixed.QUOTES + "\n" + fixed.COT)
    star, cut = fam == "starchat", F.col("truncated")
    closer = F.when(~cut, none).when(star, F.when(cot, comment_end).otherwise(pick("cut"))).otherwise(F.concat(comment_end, pick("cut")))
    step_line = F.when(star & cut, F.when(cot, own_step).otherwise(none)).otherwise(cot_line)
    fit = fit.withColumns({"closer": closer, "step_line": step_line})
    start = F.when(cut, F.col("user_turn")).otherwise(F.concat(pick("user", 0), F.col("user")))
    own = F.concat(start, F.col("closer"), F.col("step_line"), end)
    usual = F.concat(F.col("user_turn"), F.col("closer"), F.col("step_line"))
    done = fit.withColumn("user_turn", F.when(star, own).otherwise(usual)).drop("_counted")
    return done.withColumn("prompt", F.concat(pick("whole", 0), F.col("system_turn"), F.col("user_turn"), pick("whole", 1)))


def expand_sweep(df: DataFrame, configs: Iterable[Mapping[str, str | None]]) -> DataFrame:
    """Every row under every configuration: the configurations are literals, exploded in place."""
    items = [
        F.struct(*[F.lit(c.get(k)).cast("string").alias(k) for k in ("model", "prompt_type", "graph_type")])
        for c in configs
    ]
    return df.select("*", F.explode(F.array(*items)).alias("_config")).select(*df.columns, "_config.*")


def attach_contexts(df: DataFrame, contexts: DataFrame) -> DataFrame:
    """``contexts``: a struct with each kind's sentence. ``contexts`` rows are idx, kind, text.

    Done once per function, ahead of a sweep, so that the sweep's copies of the text are not shuffled.
    """
    texts = [F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k) for k in fixed.CONTEXT_LABELS]
    per_text = contexts.groupBy("idx").agg(*texts).select("idx", F.struct(*fixed.CONTEXT_LABELS).alias("contexts"))
    return df.join(by_merge(per_text), "idx", "left")


def context_of(kind: Column) -> Column:
    """The attached sentence of a row's kind, empty when there is none."""
    out = F.lit(None).cast("string")
    for name in fixed.CONTEXT_LABELS:
        out = F.when(kind == name, F.col(f"contexts.{name}")).otherwise(out)
    return F.coalesce(out, F.lit(""))


def with_context(df: DataFrame, contexts: DataFrame, kind: Column) -> DataFrame:
    """``context`` of the row's kind, empty when there is none."""
    return attach_contexts(df, contexts).withColumn("context", context_of(kind)).select(*df.columns, "context")
