"""Order-dependent work on keys of any size.

A window over a hot key runs in one task. The helpers here cut a key's rows into blocks, work
inside a block, and carry one summary row per block across; only those summaries are ever
ordered under the bare key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.session import cut_lineage

BLOCK_ROWS = 1 << 16
SPREAD_BYTES = 1 << 19
MOST_PARTS = 1 << 14


def spread(df: DataFrame, key: str, text: str, part_bytes: int = SPREAD_BYTES) -> DataFrame:
    """The rows spread by ``key`` over partitions of about ``part_bytes`` of ``text``, or larger ones beyond ``MOST_PARTS``.

    Rows that are unrolled after the exchange grow a hundredfold. Adaptive execution sizes partitions by the compact
    text and would give a few tasks all of it, so the number follows the text's length, measured beforehand.
    """
    measured = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(min(max(-(-measured // part_bytes), 2), MOST_PARTS), key)


def _keyed(df: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """Add ``_key``, one struct of the keys and a part: grouping, windows and joins on it share a
    partitioning, and unlike bare columns a null key meets itself."""
    return df.withColumn("_key", F.struct(*keys, part))


def rank_rows(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Exact 0-based position of each row within ``keys``, ordered by ``order`` (a total order).

    Only the ordering columns are range-partitioned on (keys, order), so a hot key spreads over many
    partitions; the checkpoint pins them to their partitions, and counts per (key, partition) give the
    offsets. Other columns stay out of it: the position comes back to the rows by a join on (keys, order).
    """
    by = [*keys, *order]
    rest = [c for c in df.columns if c not in by]
    placed = cut_lineage(
        df.select(*by).repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
    )
    placed = _keyed(placed, keys, "_part")
    counts = placed.groupBy("_key").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*[F.col(f"_key.{k}") for k in keys]).orderBy("_key._part").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = counts.select("_key", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    at = placed.join(shifts, "_key").select(*by, (F.col("_row") + F.col("_shift")).alias(name))
    if not rest:
        return at.select(*df.columns, name)
    # Equal structs meet even where a field is null.
    return df.withColumn("_by", F.struct(*by)).join(at.select(F.struct(*by).alias("_by"), name), "_by").select(*df.columns, name)


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    include_row: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running sums and maxima within ``keys`` along the integer position ``pos``.

    ``include_row=False`` gives the value just before the row (null at the start). The rows are shuffled
    once, by (key, block); the carries, one row a block, come to them.
    """
    folds = {n: (F.sum, e) for n, e in (sums or {}).items()}
    folds.update({n: (F.max, e) for n, e in (maxima or {}).items()})
    blocked = df.withColumns(
        {"_block": F.floor(F.col(pos) / F.lit(block_rows)), **{f"_v_{n}": e for n, (_, e) in folds.items()}}
    )
    blocked = _keyed(blocked, keys, "_block")
    totals = blocked.groupBy("_key").agg(*[fold(f"_v_{n}").alias(f"_t_{n}") for n, (fold, _) in folds.items()])
    before = (
        Window.partitionBy(*[F.col(f"_key.{k}") for k in keys]).orderBy("_key._block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select("_key", *[fold(f"_t_{n}").over(before).alias(f"_c_{n}") for n, (fold, _) in folds.items()])
    inside = (
        Window.partitionBy("_key")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if include_row else -1)
    )
    local = blocked.select("*", *[fold(f"_v_{n}").over(inside).alias(f"_w_{n}") for n, (fold, _) in folds.items()])
    out = [F.col(c) for c in df.columns]
    for name, (fold, _) in folds.items():
        here, past = F.col(f"_w_{name}"), F.col(f"_c_{name}")
        if fold is F.max:
            both = F.greatest(here, past)  # greatest skips nulls
        else:
            both = F.when(here.isNull() & past.isNull(), F.lit(None)).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
            )
        out.append(both.alias(name))
    return local.join(carry, "_key").select(*out)


def full_runs(df: DataFrame, keys: Sequence[str], pos: str, flag: Column, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows at which ``flag`` has held for the last ``n`` dense positions of the key.

    Each block also receives the last ``n - 1`` rows of the block before it, so a run that crosses
    a block's edge is seen whole.
    """
    block = F.floor(F.col(pos) / F.lit(block_rows))
    reach = F.floor((F.col(pos) + F.lit(n - 1)) / F.lit(block_rows))
    spread = df.select(
        *keys, F.col(pos).alias("_at"), flag.cast("int").alias("_flag"), block.alias("_home"),
        F.explode(F.sequence(block, reach)).alias("_block"),
    )
    last_n = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(-(n - 1), Window.currentRow)
    return (
        spread.withColumn("_hits", F.sum("_flag").over(last_n))
        .where((F.col("_block") == F.col("_home")) & (F.col("_hits") == n))
        .select(*keys, F.col("_at").alias(pos))
    )
