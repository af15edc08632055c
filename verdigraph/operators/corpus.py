"""Encoding, length budgets and corpus profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.functions.arrays import LAYOUT_MARKERS, SpecialIds, _ids, lay_out
from verdigraph.functions.text import clean_for, spaced_words, words

# Places kept for the answer, with and without the step-by-step line.
RESERVE_COT, RESERVE_LOCAL, RESERVE_HOSTED = 200, 20, 30
COT_LINE = "Let's think step by step."

# Context limits of the hosted models.
HOSTED_LIMITS = {"gpt-3.5-turbo-0125": 16385, "gpt-4-0125-preview": 128000}


def clean(df: DataFrame, run_name: str, text: str = "func") -> DataFrame:
    """Replace the text by its cleaned form; the run's name picks the cleaner."""
    return df.withColumn(text, clean_for(F.col(run_name), F.col(text)))


def encode(
    df: DataFrame,
    vocab: DataFrame,
    block: int,
    layout: str = "plain",
    text: str = "func",
    special: SpecialIds = SpecialIds(),
) -> DataFrame:
    """idx, input_ids: the first words of each text as vocabulary ids within ``block`` places.

    Only words that can enter the block are exploded. ``vocab`` has token and id, one row a token. Words meet
    it by a plain join: adaptive execution sends it to all tasks if it measures small, and splits hot words.
    """
    room = block - LAYOUT_MARKERS[layout]
    placed = df.select("idx", F.posexplode_outer(F.slice(words(text), 1, room)).alias("_at", "token"))
    known = placed.join(vocab.select("token", "id"), "token", "left")
    item = F.when(
        F.col("_at").isNotNull(),
        F.struct("_at", F.coalesce(F.col("id"), F.lit(special.unk)).cast("bigint").alias("id")),
    )
    per_text = known.groupBy("idx").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return per_text.select("idx", lay_out(F.col("_items.id"), block, layout, special).alias("input_ids"))


def graph_budget(
    df: DataFrame, block: int, flow: int, code: str = "code_ids", nodes: str = "n_nodes",
    special: SpecialIds = SpecialIds(),
) -> DataFrame:
    """Share ``block + flow`` places between code tokens and graph nodes: input_ids, position_idx."""
    total = block + flow
    keep = F.least(F.lit(total - 3) - F.least(F.col(nodes), F.lit(flow)), F.lit(block - 3))
    source = F.concat(_ids(special.cls), F.slice(F.col(code), F.lit(1), keep), _ids(special.sep))
    sized = df.withColumn("_source", source).withColumn("_n", F.size("_source"))
    sized = sized.withColumn("kept_nodes", F.least(F.col(nodes), F.lit(total) - F.col("_n")).cast("int"))
    rest = F.lit(total) - F.col("_n") - F.col("kept_nodes")

    def repeat(value: int, times: Column) -> Column:
        return F.array_repeat(F.lit(value).cast("bigint"), times)

    first = F.lit(special.pad + 1).cast("bigint")
    return sized.select(
        *df.columns,
        "kept_nodes",
        F.concat("_source", repeat(special.unk, F.col("kept_nodes")), repeat(special.pad, rest)).alias("input_ids"),
        F.concat(
            F.sequence(first, first + F.col("_n") - 1), repeat(0, F.col("kept_nodes")), repeat(special.pad, rest)
        ).alias("position_idx"),
    )


def subtoken_spans(tokens: DataFrame, count: str = "n", offset: int = 1) -> DataFrame:
    """idx, pos, start, end of each token in the subtoken sequence, one marker ahead of it.

    A window runs over the tokens of one text, which came out of one row.
    """
    so_far = Window.partitionBy("idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(count).over(so_far) + F.lit(offset)
    return tokens.select("idx", "pos", (end - F.col(count)).alias("start"), end.alias("end"))


def prompt_space(system: Column, cot: Column, reserve: Column | int = RESERVE_LOCAL) -> Column:
    """Places taken by the system text, the step-by-step line and the answer to come."""
    own = F.size(spaced_words(system))
    cot_line = F.size(spaced_words(F.lit(COT_LINE)))
    return own + F.when(cot, cot_line + F.lit(RESERVE_COT)).otherwise(reserve)


def fit_budget(
    df: DataFrame,
    max_len: Column,
    cot: Column,
    reserve: Column | int = RESERVE_LOCAL,
    system: str = "system",
    user: str = "user",
    tokens: str | None = None,
) -> DataFrame:
    """Cut the user text to its budget; ``truncated`` also holds when it fills the budget exactly.

    ``tokens`` may name an array column whose joined items give the text (any tokeniser's pieces).
    """
    pieces = F.col(tokens) if tokens else spaced_words(user)
    sized = df.withColumn("_pieces", pieces).withColumn(
        "_room", F.greatest(max_len - prompt_space(F.col(system), cot, reserve), F.lit(0))
    )
    kept = F.array_join(F.slice("_pieces", F.lit(1), F.col("_room")), "")
    return (
        sized.withColumn(user, F.when(F.size("_pieces") > F.col("_room"), kept).otherwise(F.array_join("_pieces", "")))
        .withColumn("truncated", F.size("_pieces") >= F.col("_room"))
        .drop("_pieces", "_room")
    )


def over_length(df: DataFrame, max_len: Column, text: str = "prompt") -> DataFrame:
    """Flag prompts longer than the model takes; nothing is cut."""
    return df.withColumn("n_tokens", F.size(spaced_words(text))).withColumn("too_long", F.col("n_tokens") > max_len)


def with_model_limits(df: DataFrame, limits: DataFrame, model: str = "model") -> DataFrame:
    """max_length per row: the hosted models' fixed limit, else the model's own from ``limits``."""
    hosted = F.create_map(*[F.lit(x) for pair in HOSTED_LIMITS.items() for x in pair])
    own = limits.select(model, F.col("max_length").alias("_own"))
    joined = df.join(own, model, "left")
    return joined.withColumn("max_length", F.coalesce(F.try_element_at(hosted, F.col(model)), F.col("_own"))).drop("_own")


def truncation_profile(df: DataFrame, label: str = "target") -> DataFrame:
    """Rows, truncated rows and their share, per label."""
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("truncated").alias("n_truncated"),
        F.avg(F.col("truncated").cast("double")).alias("truncated_share"),
    )


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    """Number of examples per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_examples"))
