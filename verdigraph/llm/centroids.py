"""Centroid clustering: integer Lloyd rounds whose nearest centroid is found by the threshold algorithm.

Every dimension keeps its centroids in a list sorted by their value there. A vector enters each list at its own
value and walks outward, one centroid a list and step, nearest first. A centroid met for the first time gets
its exact squared distance. The squared gaps at the frontier, summed over the dimensions, bound from below
the distance of every centroid not yet met; the walk of a vector ends once that sum strictly exceeds its best
distance (so ties are still met), or when it has met all. The vectors of a slice walk together in numpy.

Assignments run where the vectors lie; each task sums its vectors by cluster and dimension, and Spark adds
these rows. The driver holds the centroids alone: ``k`` times ``width`` integers.

Cases: vectors that are null, of another length, or that hold a null or non-finite number take no part, nor do
those with a component beyond ``LIMIT`` after scaling, whose distances would leave a long. A row without
vec_id is clustered, but starts a centroid only when rows with ids do not suffice. Rows that repeat a vec_id
are vectors of their own; among equal hashes the smaller vector starts first. With fewer vectors than ``k``
there are fewer centroids. Ties go to the smaller cluster. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from verdigraph.llm.common import arrow_map, stored

CLUSTERS = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64
LIMIT = 1 << 27
SLICE_ROWS = 2048
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def scaled(vectors: DataFrame, scale: int, width: int | None = None, column: str = "embedding") -> DataFrame:
    """The input's columns and ``point`` array<long>, floor(scale * x): the rows that take part."""
    v = vectors.withColumn("_v", F.col(column).cast("array<double>"))
    product = F.transform("_v", lambda x: F.floor(x * F.lit(float(scale)).cast(DoubleType())))
    small = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= float(LIMIT // scale)))
    kept = v.where(F.col("_v").isNotNull() & (F.size("_v") == width if width else F.size("_v") > 0) & F.coalesce(small, F.lit(False)))
    return kept.withColumn("point", product).drop("_v")


def points(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


class SortedLists:
    """One list of (value, centroid) a dimension, ascending."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.k, self.width = centroids.shape
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()
        self.values = np.sort(centroids, axis=0).T.copy()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row of ``x``."""
        n, dims = len(x), np.arange(self.width)
        right = np.stack([np.searchsorted(self.values[d], x[:, d], side="left") for d in range(self.width)], axis=1) if n else np.zeros((0, self.width), dtype=np.int64)
        left = right - 1
        best = np.full(n, np.iinfo(np.int64).max)
        cluster = np.zeros(n, dtype=np.int64)
        met = np.zeros((n, self.k), dtype=bool)
        live = np.arange(n)
        far = np.int64(2) * LIMIT + 1
        while len(live):
            at, l, r = x[live], left[live], right[live]
            below = np.where(l >= 0, at - self.values[dims, np.maximum(l, 0)], far)
            above = np.where(r < self.k, self.values[dims, np.minimum(r, self.k - 1)] - at, far)
            down = below <= above
            gap = np.where(down, below, above)
            frontier = (gap * gap).sum(1)
            found = self.order[dims, np.where(down, np.maximum(l, 0), np.minimum(r, self.k - 1))]
            new = np.zeros((len(live), self.k), dtype=bool)
            np.put_along_axis(new, found, True, axis=1)
            new &= ~met[live]
            met[live] |= new
            row, c = np.nonzero(new)
            for start in range(0, len(row), SLICE_ROWS):
                i, j = row[start : start + SLICE_ROWS], c[start : start + SLICE_ROWS]
                gaps = at[i] - self.centroids[j]
                distance, own = (gaps * gaps).sum(1), live[i]
                # Smallest distance a row, then smallest cluster: the first of each row in this order.
                first = np.lexsort((j, distance, own))
                first = first[np.concatenate([[True], own[first][1:] != own[first][:-1]])]
                own, distance, j = own[first], distance[first], j[first]
                better = (distance < best[own]) | ((distance == best[own]) & (j < cluster[own]))
                best[own[better]], cluster[own[better]] = distance[better], j[better]
            left[live], right[live] = l - down, r + ~down
            live = live[(frontier <= best[live]) & ~met[live].all(1)]
        return cluster, best


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of ``1:<vec_id>``, in that order."""
    named = rows.withColumn("_h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["point"] for r in named.orderBy(F.asc_nulls_last("_h"), "point").limit(k).select("point").collect()], dtype=np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; sums come back as one row a cluster and dimension."""
    k, width = centroids.shape

    def run(batches):
        lists = SortedLists(centroids)
        sums, counts = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            x = points(b.column(0), width)
            for start in range(0, len(x), SLICE_ROWS):
                part = x[start : start + SLICE_ROWS]
                cluster, _ = lists.nearest(part)
                np.add.at(sums, cluster, part)
                counts += np.bincount(cluster, minlength=k)
        c, d = (a.ravel() for a in np.indices((k, width)))
        held = counts[c] > 0
        yield {"cluster": c[held], "dim": d[held], "total": sums[c, d][held], "n": counts[c][held]}

    parts = arrow_map(rows, run, "cluster int, dim int, total long, n long", ["point"])
    exact = F.sum(F.col("total").cast("decimal(38,0)"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(exact.alias("total"), F.sum("n").alias("n")).collect():  # k * width rows
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = scaled(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), scale, width)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], SCHEMA)
    for _ in range(rounds):
        centroids = moved(rows, centroids)

    def run(batches):
        lists = SortedLists(centroids)
        for b in batches:
            x = points(b.column(1), width)
            found = [lists.nearest(x[s : s + SLICE_ROWS]) for s in range(0, len(x), SLICE_ROWS)]
            for s, (near, distance) in zip(range(0, len(x), SLICE_ROWS), found):
                yield {"vec_id": b.column(0).slice(s, len(near)), "cluster": near.astype(np.int32), "distance": distance}

    assigned = stored(arrow_map(rows, run, "vec_id long, cluster int, distance long", ["vec_id", "point"]), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of_cluster(values):
        return F.get(F.array(*values), F.col("cluster"))

    return assigned.select(
        "vec_id", "cluster", "distance",
        of_cluster([F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))]).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of_cluster([F.lit(s) for s in shas]).alias("centroid_sha256"),
    )
