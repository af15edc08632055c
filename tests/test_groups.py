import math
import random

import pytest
from pyspark.sql import functions as F

from verdigraph.operators import groups as G
from verdigraph.operators import losses as L

SCHEMA = "`group` string, pos int, view1 array<float>, view2 array<float>"


def members(sizes, seed=1):
    rng = random.Random(seed)
    rows = [(g, i, [rng.uniform(-1, 1) for _ in range(4)], [rng.uniform(-1, 1) for _ in range(4)]) for g, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    return rows


def cos(a, b):
    return sum(x * y for x, y in zip(a, b)) / max(math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 1e-8)


def plain_loss(rows, t, mask):
    groups, losses = {}, []
    for g, i, a, b in rows:
        groups.setdefault(g, {})[i] = (a, b)
    for views in groups.values():
        for i, (a, _) in views.items():
            row = {j: cos(a, b) / t for j, (_, b) in views.items() if not mask or i == j or i == 0 or j == 0}
            losses.append(math.log(sum(math.exp(s - row[i]) for s in row.values())))
    return sum(losses) / len(losses), len(losses)


@pytest.mark.parametrize("mask", [False, True])
@pytest.mark.parametrize("temperature", [1.0, 0.05, 0.004])
def test_unequal_groups(spark, mask, temperature):
    rows = members({"hot": 41, "one": 1, "full": 8, "next": 9})
    tiles = G.to_tiles(spark.createDataFrame(rows, SCHEMA), 8)
    assert {r["n"] for r in tiles.select(F.size("members").alias("n")).collect()} == {1, 8}
    loss, n = G.tiled_loss(tiles, temperature, mask).first()
    want, count = plain_loss(rows, temperature, mask)
    assert n == count and loss == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_no_array_is_longer_than_a_tile(spark):
    tiles = G.to_tiles(spark.createDataFrame(members({"hot": 50, "b": 3}), SCHEMA), 8)
    sims = G.tile_cosine(G.tile_pairs(tiles))
    assert sims.agg(F.max(F.size("sims"))).first()[0] == 8
    assert sims.agg(F.sum(F.size("sims"))).first()[0] == 50 * 50 + 9
    assert G.tile_pairs(tiles, mask=True).count() == 3 * 7 - 2 + 1


def test_equals_the_fixed_size_form(spark):
    df = spark.createDataFrame(members({str(g): 4 for g in range(6)}), SCHEMA)
    fixed = L.contrastive_loss(L.group_cosine(L.to_groups(df, 4), 0.5)).first()
    tiled = G.tiled_loss(G.to_tiles(df, 3), 0.5).first()
    assert tiled["n_rows"] == fixed["n_rows"] and tiled["loss"] == pytest.approx(fixed["loss"])


@pytest.mark.parametrize("mask", [False, True])
def test_fixed_groups_may_lack_members(spark, mask):
    rows = [r for r in members({"whole": 4, "end": 2, "gap": 4, "headless": 3}) if r[:2] not in {("gap", 1), ("headless", 0)}]
    sims = L.group_cosine(L.to_groups(spark.createDataFrame(rows, SCHEMA), 4, short=True), 0.5)
    assert {(r["group"], r["row"], tuple(r["slots"])) for r in sims.collect() if r["group"] == "gap"} == {("gap", i, (0, 2, 3)) for i in (0, 2, 3)}
    loss, n = L.contrastive_loss(sims, mask).first()
    want, count = plain_loss(rows, 0.5, mask)
    assert n == count == 11 and loss == pytest.approx(want)


@pytest.mark.parametrize("positions", [[0, 0], [0, 4], [-1, 0], [None, 0]])
def test_short_groups_repeat_no_position(spark, positions):
    df = spark.createDataFrame([("a", p, [1.0], [2.0]) for p in positions], SCHEMA)
    with pytest.raises(Exception, match="at most once"):
        L.group_cosine(L.to_groups(df, 4, short=True)).collect()


@pytest.mark.parametrize("positions", [[0, 2], [1, 2], [0, 0, 1], [-1, 0, 1], [0, 1, None], [0, 1, 2, 3, 3, 5], [0, 1, 2, 3, 8]])
def test_wrong_positions_are_an_error(spark, positions):
    df = spark.createDataFrame([("a", p, [1.0], [2.0]) for p in positions], SCHEMA)
    with pytest.raises(Exception, match="each position from 0"):
        G.tiled_loss(G.to_tiles(df, 4)).collect()


@pytest.mark.parametrize("view", [None, [1.0, None]])
def test_a_null_view_is_an_error(spark, view):
    df = spark.createDataFrame([("a", 0, [1.0, 2.0], [1.0, 2.0]), ("a", 1, view, [1.0, 2.0])], SCHEMA)
    with pytest.raises(Exception, match="with two views"):
        G.tiled_loss(G.to_tiles(df)).collect()


def test_zero_views_empty_tables_and_null_groups(spark):
    zero = spark.createDataFrame([("a", 0, [0.0], [0.0]), ("a", 1, [0.0], [1.0]), (None, 7, [1.0], [1.0])], SCHEMA)
    assert G.tiled_loss(G.to_tiles(zero)).first()["loss"] == pytest.approx(math.log(2))
    none = G.tiled_loss(G.to_tiles(spark.createDataFrame([], SCHEMA))).first()
    assert none["loss"] is None and none["n_rows"] == 0


def test_a_temperature_too_small_is_refused(spark):
    with pytest.raises(ValueError):
        G.tiled_loss(G.to_tiles(spark.createDataFrame([], SCHEMA)), 0.001)
