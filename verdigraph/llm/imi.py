"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own k-means codebook; a cell is a pair of
centroids. A query walks the cells by the summed distance of its halves to both centroids, with a heap
over the two sorted distance lists, until the cells hold the wanted share of all vectors. Everything in
those cells is reranked by the exact cosine in double precision.

The codebooks are fitted on the driver on a sample of at most ``FIT_ROWS`` vectors (chosen by a hash of
the id); every vector is indexed. Cell sizes are a table of at most ``centroids ** 2`` numbers. A cell
larger than ``BLOCK`` is cut into numbered blocks, so a hot cell is spread over tasks, and queries come to
a block in groups of ``QUERY_BLOCK``: a task holds one block of vectors and one group of queries. Each
(query, block) keeps its ``k`` best, and the best of those are taken per query.

Cases: vectors that are null, of another length than most, zero, or that hold a null or non-finite number
take no part; rows without an id take no part; a repeated row is a candidate twice; ties go to the
smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.llm.common import arrow_map, hashed_sample

FIT_ROWS = 20_000
CENTROIDS = 24
SHARE = 0.5
BLOCK = 2048
QUERY_BLOCK = 256
SCHEMA = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector array<double>: the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def common_length(rows: DataFrame) -> int | None:
    found = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else None


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squared(x, centres).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def walk(near: np.ndarray, far: np.ndarray, sizes: np.ndarray, want: float) -> list[int]:
    """Cells in order of summed distance, by a heap over both sorted lists, until they hold ``want`` vectors."""
    a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    heap, seen, out, held = [(near[a[0]] + far[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (near[a[x]] + far[b[y]], x, y))
    return out


def search(vectors: DataFrame, query_of, k: int = 5, centroids: int = CENTROIDS, share: float = SHARE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The ``k`` nearest rows found for every row where ``query_of`` (a Column on vec_id) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    width = common_length(rows)
    if width is None:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.where(F.size("vector") == width)
    half = width // 2
    sample = hashed_sample(rows, "vec_id", fit_rows).select("vector").toArrow()
    x = unit(matrix(sample.column(0).combine_chunks(), width))
    first, second = kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)
    n_cells = len(first) * len(second)

    def cells(batches):
        for b in batches:
            u = unit(matrix(b.column(1), width))
            cell = squared(u[:, :half], first).argmin(1) * len(second) + squared(u[:, half:], second).argmin(1)
            yield {"vec_id": b.column(0), "raw": [r.tobytes() for r in matrix(b.column(1), width)], "cell": cell.astype(np.int32)}

    indexed = arrow_map(rows, cells, "vec_id long, raw binary, cell int")
    counted = indexed.groupBy("cell").count().collect()  # at most centroids ** 2 rows
    sizes = np.zeros(n_cells, dtype=np.int64)
    for r in counted:
        sizes[r["cell"]] = r["count"]
    want = share * sizes.sum()
    blocks = np.maximum(1, -(-sizes // BLOCK))

    def block_of(vec_id, cell_blocks):
        return F.pmod(F.xxhash64(vec_id), cell_blocks).cast("int")

    per_cell = spark.createDataFrame([(c, int(b)) for c, b in enumerate(blocks)], "cell int, blocks int")
    stored = indexed.join(F.broadcast(per_cell), "cell").select("cell", block_of("vec_id", F.col("blocks")).alias("block"), "vec_id", "raw")
    stored = stored.groupBy("cell", "block").agg(F.collect_list(F.struct("vec_id", "raw")).alias("members"))

    def plan(batches):
        for b in batches:
            raw = matrix(b.column(1), width)
            u = unit(raw)
            near, far = squared(u[:, :half], first), squared(u[:, half:], second)
            ids, query, cell, block = b.column(0).to_pylist(), [], [], []
            for i in range(len(ids)):
                for c in walk(near[i], far[i], sizes, want):
                    for p in range(int(blocks[c])):
                        query.append(i)
                        cell.append(c)
                        block.append(p)
            yield {"cell": cell, "block": block, "vec_id": [ids[i] for i in query], "raw": [raw[i].tobytes() for i in query]}

    queries = rows.where(query_of(F.col("vec_id")))
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = arrow_map(queries, plan, "cell int, block int, vec_id long, raw binary")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    asked = asked.groupBy("cell", "block", "part").agg(F.collect_list(F.struct("vec_id", "raw")).alias("queries"))

    def near_ones(batches):
        for b in batches:
            for queries, members in zip(b.column(0), b.column(1)):
                queries, members = queries.values, members.values
                ids = members.field(0).to_numpy(zero_copy_only=False)
                m = unit(np.frombuffer(b"".join(members.field(1).to_pylist()), dtype=np.float64).reshape(-1, width))
                q_ids, raws = queries.field(0).to_pylist(), queries.field(1).to_pylist()
                for start in range(0, len(q_ids), QUERY_BLOCK):
                    q = unit(np.frombuffer(b"".join(raws[start : start + QUERY_BLOCK]), dtype=np.float64).reshape(-1, width))
                    scores = q @ m.T
                    out_q, out_v, out_s, out_r = [], [], [], []
                    for i, own in enumerate(q_ids[start : start + QUERY_BLOCK]):
                        s = np.where(ids == own, -np.inf, scores[i])
                        least = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                        keep = np.flatnonzero((s >= least - 1e-9) & (s > -np.inf))
                        # Ties that rounding hides, and all that may be among the k best, are settled below.
                        keep = keep[np.lexsort((ids[keep], -np.round(s[keep], 12)))][: 4 * k]
                        out_q += [own] * len(keep)
                        out_v += ids[keep].tolist()
                        out_s += [exact(raws[start + i], members.field(1)[int(j)].as_py()) for j in keep]
                    yield {"query_id": out_q, "vec_id": out_v, "score": out_s}

    found = arrow_map(asked.join(stored, ["cell", "block"]), near_ones, "query_id long, vec_id long, score double", ["queries", "members"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(a: bytes, b: bytes) -> float:
    """Cosine of two stored vectors in double precision."""
    x, y = np.frombuffer(a, dtype=np.float64), np.frombuffer(b, dtype=np.float64)
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)))
