"""Near copies by signatures, vector codes and centroid clusters against plain versions."""

import hashlib
import random

import brute
import numpy as np
import pytest
from brute import rows_of

from verdigraph.llm import centroids, codes, minhash


def floors(scale, vector):
    return np.floor(scale * np.array(vector, dtype=np.float64)).astype(np.int64)


def plain_codes(rows):
    x = np.stack([floors(4096, v) for _, v, _ in rows])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].tolist()))
    cut = x.reshape(len(x), 8, -1)
    books = cut[order[:16]].transpose(1, 0, 2).copy()
    for turn in range(7):
        gaps = ((cut[:, :, None, :] - books[None]) ** 2).sum(-1)
        near = gaps.argmin(-1)
        if turn < 6:
            for p in range(8):
                for e in set(near[:, p].tolist()):
                    books[p, e] = cut[near[:, p] == e, p].sum(0) // (near[:, p] == e).sum()
    error = gaps.min(-1).sum(-1)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    labels = {}
    for (_, _, label), e in zip(rows, error.tolist()):
        labels[label] = labels.get(label, 0) + e
    return [(r[0], "".join(f"{c:02x}" for c in n), e, labels[r[2]], sha) for r, n, e in zip(rows, near.tolist(), error.tolist())]


def plain_clusters(rows):
    x = np.stack([floors(64, v) for _, v, _ in rows])
    names = [(1, "") if r[0] is None else (0, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()) for r in rows]
    start = sorted(range(len(rows)), key=lambda i: (names[i], x[i].tolist()))[:16]
    c = x[start].copy()
    for turn in range(4):
        gaps = ((x[:, None] - c[None]) ** 2).sum(-1)
        near = gaps.argmin(1)
        if turn < 3:
            for k in set(near.tolist()):
                c[k] = x[near == k].sum(0) // (near == k).sum()
    best = gaps.min(1)
    shas = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    return [(r[0], k, d, int(best[near == k].sum()), int(best.sum()), shas[k]) for r, k, d in zip(rows, near.tolist(), best.tolist())]


def vectors(n, seed, values):
    r = random.Random(seed)
    rows = [(i, [r.choice(values) if values else r.gauss(0, 0.3) for _ in range(64)], r.choice([None, 1, 2])) for i in range(n)]
    hot = rows[3][1]
    rows += [(1000 + i, hot, 7) for i in range(n // 2)]  # one vector in a third of all rows
    return rows + [(5, hot, None), (5, rows[n - 1][1], 2), (None, rows[n - 2][1], 1)]


def table(spark, rows):
    odd = [(9000, None, 1), (9001, [0.5] * 63 + [None], 1), (9002, [0.5] * 63 + [float("nan")], 1), (9003, [float("inf")] * 64, 1), (9004, [1e30] * 64, 1), (9005, [], 2), (9006, [0.25] * 8, 2)]
    full = [(*r, "x", 1.5, [1]) for r in rows + odd]
    return spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, code string, distance double, point array<int>").repartition(6)


@pytest.mark.parametrize("n, values", [(400, None), (300, (-0.5, 0.0, 0.25)), (4, None)])
def test_codes_and_clusters(spark, n, values):
    rows = vectors(n, 3, values)
    df = table(spark, rows)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert rows_of(codes.encode(df), "vec_id", "code", "error", "label_error", "codebooks_sha256") == sorted(plain_codes(rows), key=key)
    got = rows_of(centroids.cluster(df), "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert got == sorted(plain_clusters(rows), key=key)


def test_no_vectors(spark):
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codes.encode(nothing).count() == 0 and centroids.cluster(nothing).count() == 0
    alone = spark.createDataFrame([(1, [0.5] * 64, None)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r)[:4] for r in codes.encode(alone).collect()] == [(1, "00" * 8, 0, 0)]
    assert [tuple(r)[:5] for r in centroids.cluster(alone).collect()] == [(1, 0, 0, 0, 0)]


def test_dual_trees_prune_and_stay_exact():
    r = np.random.default_rng(1)
    near_points = np.concatenate([r.integers(-20, 20, (900, 8)) + 1000 * c for c in range(5)])
    entries = np.concatenate([near_points[[0, 0, 950, 1900, 2800, 3700]], r.integers(-100, 100, (7, 8))])
    tree = codes.Tree(near_points, codes.tree_order(near_points), codes.LEAF)
    chosen, sums, counts = codes.descend(tree, entries)
    want = ((near_points[:, None] - entries[None]) ** 2).sum(-1).argmin(1)
    assert (chosen == want[tree.order]).all()
    assert counts.tolist() == np.bincount(want, minlength=len(entries)).tolist()
    assert all((sums[e] == near_points[want == e].sum(0)).all() for e in range(len(entries)))


def test_threshold_walk_meets_ties():
    c = np.array([[0, 0], [4, 4], [4, 4], [0, 8], [100, 100]])
    x = np.array([[2, 2], [4, 4], [0, 4], [50, 51], [-10**8, 10**8]])
    cluster, distance = centroids.SortedLists(c).nearest(x)
    want = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert cluster.tolist() == want.argmin(1).tolist() and distance.tolist() == want.min(1).tolist()


def with_kept(rows):
    return [(*r, r[0] == r[2]) for r in rows]


def near_copies(seed):
    """Two large groups of near copies of one text each, chains of copies, and borderline pairs."""
    r = random.Random(seed)
    out, number = [], 0
    for size, changes in ((400, 3), (150, 5)):
        base = [f"w{r.randrange(10**6)}" for _ in range(150)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, changes)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            out.append((number := number + 1, " ".join(w)))
    w = [f"c{r.randrange(10**6)}" for _ in range(120)]
    for _ in range(40):
        w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        out.append((number := number + 1, " ".join(w)))
    return out


def test_minhash_rows(spark, documents, messy, nothing):
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows_of(minhash.link(documents), *columns) == with_kept(brute.components(messy, 85))
    assert minhash.link(nothing).count() == 0
    r = random.Random(8)
    rows = near_copies(5)
    r.shuffle(rows)
    rows += [(5000 + i, rows[0][1]) for i in range(300)]
    got = minhash.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert rows_of(got, *columns) == with_kept(brute.components(rows, 85))


def test_posterior_bound():
    """The fewest agreements kept leave a pair at the threshold to chance ``MISS``, by integration of the posterior."""
    grid = np.linspace(0, 1, 200_001)
    for n, m in zip(range(minhash.STEP, minhash.SIGNATURE + 1, minhash.STEP), minhash.least_agreements(85).tolist()):
        for agree, kept in ((m - 1, False), (m, True)):
            mass = grid**agree * (1 - grid) ** (n - agree)
            assert (mass[grid >= 0.85].sum() / mass.sum() >= minhash.MISS) == kept, (n, agree)
