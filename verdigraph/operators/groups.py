"""Cosines and contrastive losses inside groups of any, and of unequal, size.

A group is cut into tiles of successive positions and tiles are paired, so no row and no task holds a whole
group: a group with a third of all members is so many tile pairs, spread like any others. The loss adds up
over tile pairs without a common shift, as each member measures its row against its own position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions.scores import dot
from verdigraph.operators.losses import NORM_FLOOR

TILE = 256

# Differences of two cosines reach 2 / temperature; their exponential must fit a double.
LEAST_TEMPERATURE = 1 / 350


def cosine(ab: Column, aa: Column, bb: Column) -> Column:
    return ab / F.greatest(F.sqrt(aa * bb), F.lit(NORM_FLOOR))


def to_tiles(
    df: DataFrame, tile: int = TILE, group: str = "group", pos: str = "pos", first: str = "view1", second: str = "view2"
) -> DataFrame:
    """group, tile, n_tiles, members: ``tile`` successive members of a group, in order of position.

    A member is (pos, a, aa, b, bb, own): both views, their squared lengths and the cosine of the two. The
    positions of a group run from 0 without gaps; a missing, repeated or negative one is an error, as is a
    view that is null or holds a null. Rows whose group is null take no part.
    """
    at, a, b = F.col(pos).cast("bigint"), F.col(first), F.col(second)
    placed = df.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), at.alias("pos"), a.alias("a"), b.alias("b"))
    sizes = placed.groupBy("group").agg(F.min("pos").alias("_least"), (F.max("pos") + 1).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    measured = placed.withColumns({"aa": dot(F.col("a"), F.col("a")), "bb": dot(F.col("b"), F.col("b")), "_ab": dot(F.col("a"), F.col("b"))})
    member = F.struct("pos", "a", "aa", "b", "bb", cosine(F.col("_ab"), F.col("aa"), F.col("bb")).alias("own"))
    listed = measured.groupBy("group", F.floor(F.col("pos") / tile).alias("tile")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    base = F.col("tile") * tile
    dense = F.aggregate(
        F.transform("members", lambda m, i: (m["pos"] == base + i) & m["own"].isNotNull()), F.lit(True), lambda x, y: x & F.coalesce(y, F.lit(False))
    )
    whole = (F.col("_least") == 0) & (F.col("_n") == F.col("_rows")) & (F.size("members") == F.least(F.lit(tile), F.col("_n") - base)) & dense
    wrong = F.raise_error(F.lit("a group needs each position from 0 once, with two views"))
    return listed.join(sizes, "group").select(
        "group", "tile", F.ceil(F.col("_n") / tile).alias("n_tiles"), F.when(F.coalesce(whole, F.lit(False)), F.col("members")).otherwise(wrong).alias("members")
    )


def tile_pairs(tiles: DataFrame, mask: bool = False) -> DataFrame:
    """Every tile of rows with every tile of columns of its group.

    The masked form pairs only tiles on the diagonal, in the first row and in the first column: their number
    grows with the group, not with its square.
    """
    every = F.sequence(F.lit(0).cast("bigint"), F.col("n_tiles") - 1)
    if mask:
        every = F.when(F.col("tile") == 0, every).otherwise(F.array(F.lit(0).cast("bigint"), F.col("tile")))
    left = F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), m["a"].alias("a"), m["aa"].alias("aa"), m["own"].alias("own")))
    right = F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), m["b"].alias("b"), m["bb"].alias("bb")))
    rows = tiles.select("group", F.col("tile").alias("_i"), F.explode(every).alias("_j"), left.alias("_rows"))
    cols = tiles.select("group", F.col("tile").alias("_j"), F.explode(every).alias("_i"), right.alias("_cols"))
    return rows.join(cols, ["group", "_i", "_j"])


def tile_cosine(pairs: DataFrame, temperature: float = 1.0) -> DataFrame:
    """group, row, start, own, sims: a member's cosines with the second views at ``start`` and on, over the temperature."""
    scale = F.lit(float(temperature))

    def against(m: Column) -> Column:
        return F.transform("_cols", lambda c: cosine(dot(m["a"], c["b"]), m["aa"], c["bb"]) / scale)

    rows = F.transform("_rows", lambda m: F.struct(m["pos"].alias("row"), (m["own"] / scale).alias("own"), against(m).alias("sims")))
    opened = pairs.select("group", F.col("_cols")[0]["pos"].alias("start"), F.explode(rows).alias("_r"))
    return opened.select("group", "_r.row", "start", "_r.own", "_r.sims")


def tiled_loss(tiles: DataFrame, temperature: float = 1.0, mask: bool = False) -> DataFrame:
    """loss, n_rows: mean cross-entropy of each member against its own position in its group.

    With its own cosine taken off, a row's loss is the logarithm of a sum over all columns, so tiles add up.
    The masked form keeps the diagonal, the first row and the first column.
    """
    if temperature < LEAST_TEMPERATURE:
        raise ValueError(f"the temperature must be {LEAST_TEMPERATURE:.4f} or more")
    row, own = F.col("row"), F.col("own")

    def term(s: Column, j: Column) -> Column:
        # The member's own column adds exactly 1.
        power = F.when(row == F.col("start") + j, F.lit(1.0)).otherwise(F.exp(s - own))
        if not mask:
            return power
        at = F.col("start") + j
        return F.when((row == 0) | (at == 0) | (row == at), power).otherwise(F.lit(0.0))

    part = F.aggregate(F.transform("sims", term), F.lit(0.0), lambda x, y: x + y)
    sums = tile_cosine(tile_pairs(tiles, mask), temperature).groupBy("group", "row").agg(F.sum(part).alias("_sum"))
    return sums.agg(F.avg(F.log("_sum")).alias("loss"), F.count(F.lit(1)).alias("n_rows"))
