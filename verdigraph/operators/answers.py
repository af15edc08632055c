"""Verdicts for whole answer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions import answers as A
from verdigraph.functions.answer_rules import IMPROVABLE
from verdigraph.functions.text import strip_ws


def pre_trim(df: DataFrame, prompt_type: Column, response: str = "response") -> DataFrame:
    """Replace the answer by its trimmed form; one stage a step, so no step is evaluated twice."""
    asked = df.withColumn(response, A.cut_at_question(F.col(response), prompt_type))
    unfenced = asked.withColumn(response, A.drop_fenced_block(F.col(response)))
    return unfenced.withColumn(response, A.one_answer_line(F.col(response)))


def answer_verdict(df: DataFrame, text: str) -> DataFrame:
    """``verdict`` (1, 0, or 2 undecided) of stripped, lower-cased text: first paragraph, then all of it."""
    first = df.withColumn("_chunk", A.first_paragraph(F.col(text)))
    judged = first.withColumn("_first", A.rule_verdict(F.col("_chunk")))
    again = (F.col("_first") == 2) | F.contains("_chunk", F.lit(IMPROVABLE))
    whole = F.when(again, A.rule_verdict(F.col(text))).otherwise(F.col("_first"))
    return judged.withColumn("verdict", whole).drop("_chunk", "_first")


def parse_answers(df: DataFrame, model: str = "model", prompt_type: str = "prompt_type", response: str = "response") -> DataFrame:
    """Add ``verdict`` read from each model's free-text answer."""
    staged = pre_trim(df.withColumn("_answer", F.col(response)), F.col(prompt_type), "_answer")
    staged = staged.withColumn("_family", A.answer_family(F.col(model)))
    staged = staged.withColumn("_answer", A.trim_answer(F.col("_answer"), F.col("_family")))
    staged = staged.withColumn("_answer", F.lower(strip_ws("_answer")))
    return answer_verdict(staged, "_answer").drop("_answer", "_family")
