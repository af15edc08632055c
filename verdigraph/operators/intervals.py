"""Interval joins: spans of any length and order, with gaps or overlaps, met by bins.

A span is half-open, ``start`` to ``end``. Its level is the least k with 16**k >= its length, so it touches at
most two bins of 16**k places there. Two spans that overlap meet in the bins of the longer one's level: a span is
sent, besides its own level, to the higher levels that the other side has spans of. So one very long span does
not multiply the short ones, and a key holding a third of all rows is spread over its bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.session import by_merge

LEVEL_BITS = 4
TOP_LEVEL = 15  # a longer span is listed in every bin of this level
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _level(start: Column, end: Column) -> Column:
    """Binary digits of length - 1, four to a level; a length beyond a long is of the top level."""
    last = F.try_subtract(end, start + 1)
    digits = F.when(last > 0, F.length(F.bin(last))).when(last == 0, 0).otherwise(64)
    return F.least(F.ceil(digits / LEVEL_BITS).cast("int"), F.lit(TOP_LEVEL))


def _bin(place: Column, level: Column) -> Column:
    return F.call_function("shiftright", place, level * LEVEL_BITS)


def _levels(df: DataFrame) -> Column:
    """The levels that occur, at most sixteen numbers, as a value of the plan."""
    return df.agg(F.collect_set("_level").alias("l")).scalar()


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, left, right: each pair of rows of equal keys whose spans share a place, the rows' other columns as structs.

    Empty spans and rows with a null key or bound meet nothing; repeated rows meet repeatedly. Both sides are
    read once more for their levels. Bounds travel once: those of whole numbers come back out of the bins' own.
    """

    def others(df: DataFrame) -> list[tuple[str, str, str]]:
        """Name, type and place in the bins' rows of each column that is no key."""
        bounds = {start: "_s", end: "_e"}
        return [(c, t, bounds[c] if c in bounds and t in INTEGERS else f"_c{i}") for i, (c, t) in enumerate(df.dtypes) if c not in keys]

    def carried(df: DataFrame) -> list[str]:
        return [at for _, _, at in others(df) if at.startswith("_c")]

    def row(side: str, df: DataFrame) -> Column:
        return F.struct(*[F.col(f"{side}.{at}").cast(t).alias(c) if at in ("_s", "_e") else F.col(f"{side}.{at}").alias(c) for c, t, at in others(df)])

    def sized(df: DataFrame) -> DataFrame:
        begin, stop = F.col(start).cast("bigint"), F.col(end).cast("bigint")
        rest = [F.col(c).alias(at) for c, _, at in others(df) if at.startswith("_c")]
        spans = df.select(*keys, begin.alias("_s"), stop.alias("_e"), *rest).where(F.col("_s") < F.col("_e"))
        return spans.withColumn("_level", _level(F.col("_s"), F.col("_e")))

    def dealt(spans: DataFrame, against: DataFrame, rest: list[str], own_role: int, equal: bool) -> DataFrame:
        """One row a bin: at home in role ``own_role``, a guest in the other one."""
        above = F.filter("_others", lambda k: (k >= F.col("_level")) if equal else (k > F.col("_level")))
        home = F.array(F.struct(F.lit(own_role).alias("role"), F.col("_level").alias("level")))
        guest = F.transform(above, lambda k: F.struct(F.lit(1 - own_role).alias("role"), k.alias("level")))
        at = spans.withColumn("_others", _levels(against)).withColumn("_at", F.explode(F.concat(home, guest)))
        bins = F.sequence(_bin(F.col("_s"), F.col("_at.level")), _bin(F.col("_e") - 1, F.col("_at.level")))
        return at.select(*keys, "_at.role", "_at.level", F.explode(bins).alias("_bin"), "_s", "_e", *rest)

    # Role 0: the left span is at home, the right one no longer than its level; role 1: the right span is
    # at home and the left one of a lower level. Guests never meet guests.
    ours, theirs = sized(left), sized(right)
    a, b = dealt(ours, theirs, carried(left), 0, False).alias("a"), dealt(theirs, ours, carried(right), 1, True).alias("b")
    by = [*keys, "role", "level", "_bin"]
    same = F.lit(True)
    for c in by:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    later = F.greatest("a._s", "b._s")
    # The bin of the later start is one that both touch, so a pair counts there and nowhere else.
    meet = (later < F.least("a._e", "b._e")) & (_bin(later, F.col("a.level")) == F.col("a._bin"))
    return a.join(by_merge(b), same & meet).select(
        *[F.col(f"a.{k}").alias(k) for k in keys], row("a", left).alias("left"), row("b", right).alias("right")
    )
