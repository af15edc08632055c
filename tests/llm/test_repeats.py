import random

import brute
import numpy as np
import pytest
from brute import rows_of

from verdigraph.llm import jaccard, phrases, repeats
from verdigraph.llm.components import components


def test_byte_repeats(documents, messy, nothing):
    assert rows_of(repeats.remove_repeats(documents), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(messy)
    assert repeats.remove_repeats(nothing).count() == 0


def test_phrase_repeats(documents, messy, nothing):
    assert rows_of(phrases.remove_repeats(documents), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.phrases(messy)
    assert phrases.remove_repeats(nothing).count() == 0


def test_near_copies(documents, messy, nothing):
    assert rows_of(jaccard.link(documents), "doc_id", "n_shingles", "component_id") == brute.components(messy)
    assert jaccard.link(nothing).count() == 0


def test_links_near_the_threshold(spark):
    """Families whose members differ in a few words, so that many pairs lie on either side of 75 percent."""
    r = random.Random(8)
    rows = []
    for family in range(6):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([30, 60, 120]))]
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, max(2, len(w) // 15))):
                w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    got = rows_of(jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == brute.components(rows)
    assert 6 < len({c for _, _, c in got}) < len(rows)


def test_one_of_each_keeps_columns(documents, messy):
    kept = jaccard.one_of_each(documents)
    assert kept.columns == documents.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert set(ids) == {None} | {d for d, _, c in brute.components(messy) if d == c}
    assert 13 not in ids and ids.count(900) <= 1


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_product_counts_exactly(percent):
    r = np.random.default_rng(percent)
    sets = [[np.sort(r.choice(60, 40, replace=False)).astype(np.uint64) for _ in range(12)] for _ in range(2)]
    tiles = [jaccard.Tile.of(np.full(12, 40), np.arange(12) + 100 * k, [x.tobytes() for x in side]) for k, side in enumerate(sets)]
    found = jaccard.product_links(jaccard.Tile.load(tiles[0].dump()), tiles[1], percent)
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in found:
        parent[root(a)] = root(b)
    for i, x in enumerate(sets[0]):
        for j, y in enumerate(sets[1]):
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (80 - both):
                assert root(i) == root(100 + j)


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40) if i != 20] + [(7, 7), (50, 60), (60, 50)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 50: 50, 60: 50}


def test_interval_groups_are_maximal_repeats():
    """Against all maximal repeats of a small set of segments, found by trying every string."""
    r = random.Random(1)
    window = 4
    segments = list({b"\xff" + bytes(r.choice(b"ab") for _ in range(r.randint(4, 9))) for _ in range(12)})
    least = np.arange(len(segments))
    order, groups = repeats.suffix_groups(segments, least, window)
    got = {(segments[order[a, 0]][1 + order[a, 1] :][:size], frozenset(map(tuple, order[a : b + 1].tolist()))) for a, b, size, _ in groups}
    want = set()
    starts = [(s, o) for s, x in enumerate(segments) for o in range(len(x) - window)]
    for s, o in starts:
        for size in range(window, len(segments[s]) - o):
            string = segments[s][1 + o :][:size]
            where = [(t, p) for t, p in starts if segments[t][1 + p :][:size] == string]
            before = {segments[t][p] if p else (t,) for t, p in where}
            after = {segments[t][1 + p + size : 2 + p + size] or (t,) for t, p in where}
            if len(where) > 1 and len(after) > 1 and (len(before) > 1 or any(p == 0 for _, p in where)):
                want.add((string, frozenset(where)))
    assert got == want
