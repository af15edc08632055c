"""Readers with fixed schemas: nothing is inferred, a malformed line is an error."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.operators.scale import rank_rows
from verdigraph.session import cut_lineage

CORPUS = "idx string, func string, target int"
RESPONSES = "idx string, target int, response string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _present(name: str) -> Column:
    """The column; a row that lacks it is an error."""
    return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"a corpus row has no {name}"))).alias(name)


def read_corpus(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """idx, func, target from JSON lines or parquet; a row must have all three."""
    rows = _json(spark, path, CORPUS) if fmt == "json" else spark.read.format(fmt).load(path)
    typed = rows.select(F.col("idx").cast("string").alias("idx"), "func", F.col("target").cast("int").alias("target"))
    return typed.select(*[_present(c) for c in ("idx", "func", "target")])


def to_shots(rows: DataFrame, order_col: str) -> DataFrame:
    """Example rows with pair_id and pos_in_pair: rows 2k and 2k+1 in ``order_col`` order form a pair."""
    placed = rank_rows(rows, [order_col], name="_at")
    return placed.select(
        *rows.columns,
        F.floor(F.col("_at") / 2).alias("pair_id"),
        F.pmod(F.col("_at"), F.lit(2)).cast("int").alias("pos_in_pair"),
    )


def lines_in_order(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """value and ``name``, the number of each line of text from 0: files by path, lines as they stand in their file.

    A split is read by one task, front to back, so file, split offset and the order within the task place every line,
    whatever the size of the splits. The rows are pinned before they are numbered; no task sees more than its splits.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_turn")]
    rows = cut_lineage(spark.read.text(path).select("value", *place))
    return rank_rows(rows, ["_file", "_split", "_turn"], name=name).select("value", name)


def read_shots(spark: SparkSession, path: str, order_col: str | None = None) -> DataFrame:
    """Few-shot examples with pair_id and pos_in_pair, in the order of their lines or of a column that numbers them.

    Blank lines do not count; a line that is no JSON object is an error.
    """
    if order_col:
        return to_shots(_json(spark, path, f"{order_col} bigint, func string, target int"), order_col)
    lines = lines_in_order(spark, path, "row").where(F.trim("value") != "")
    parsed = F.from_json("value", "func string, target int", {"mode": "FAILFAST"})
    return to_shots(lines.select("row", parsed.alias("_shot")).select("row", "_shot.*"), "row")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Answer log; a log that does not exist yet is empty."""
    try:
        return _json(spark, path, RESPONSES)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESPONSES)
