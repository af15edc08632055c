"""Vector codes: product quantisation whose codebooks come from integer dual-tree Lloyd rounds.

A vector's integers are cut into ``PARTS`` consecutive parts, each part position with a codebook of its own.
Vectors are dealt by hash into blocks of about ``BLOCK`` rows, written once to the shared folder. For every part
position a block holds its parts as a balanced tree, split at the median of the widest dimension: the
order of the rows, and from it, level by level, the box, count and sum of every node. A round builds a tree
over the entries too and descends both together: a pair of nodes is dropped when its least possible
distance strictly exceeds the largest possible one of another pair with the same parts. Where one entry is left, the
node's cached sum and count go to it whole; a leaf with several left is settled by exact integer distances,
ties to the lower index. Each task adds up its blocks, Spark adds the tasks' rows, and the driver holds the
codebooks alone: parts times entries times width integers.

Cases: vectors that are null, empty, or that hold a null or non-finite number take no part, nor do those with a
component beyond ``LIMIT`` after scaling, whose errors would leave a long, nor those of another
length than the most common one that ``PARTS`` divides (among equally common ones the smallest). Rows without
vec_id are coded, and start an entry only when rows with ids do not suffice. Rows that repeat a vec_id are vectors
of their own; the smaller vector starts an entry first. With fewer vectors than ``ENTRIES`` there are fewer entries.
Entries without parts stay. Null labels count as one label. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.blocks import grouped
from verdigraph.llm.centroids import LIMIT, points, scaled
from verdigraph.llm.common import arrow_map, pack, runs, stored, unpack

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK = 4096
LEAF = 16
SALTS = 16
SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def tree_order(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Rows of ``x`` in the order of a balanced tree's leaves, padded to leaf * 2**depth by the last row (index len - 1)."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
    order = np.minimum(np.arange(leaf << depth), len(x) - 1)
    for level in range(depth):
        nodes = order.reshape(1 << level, -1)
        held = x[nodes]
        widest = (held.max(1) - held.min(1)).argmax(1)
        along = np.take_along_axis(held, widest[:, None, None], axis=2)[:, :, 0]
        order = np.take_along_axis(nodes, np.argsort(along, axis=1, kind="stable"), axis=1).ravel()
    return order


class Tree:
    """Boxes, counts and sums of the nodes of each level, root first; ``weight`` is 0 for padding."""

    def __init__(self, x: np.ndarray, order: np.ndarray, leaf: int):
        self.order, self.leaf = order, leaf
        padding = np.zeros(len(order), dtype=bool)
        if len(order) > len(x):
            copies = np.flatnonzero(order == len(x) - 1)
            padding[copies[1:]] = True
        self.weight = (~padding).astype(np.int64)
        self.rows = x[order]
        low = self.rows.reshape(-1, leaf, x.shape[1]).min(1)
        high = self.rows.reshape(-1, leaf, x.shape[1]).max(1)
        total = (self.rows * self.weight[:, None]).reshape(-1, leaf, x.shape[1]).sum(1)
        count = self.weight.reshape(-1, leaf).sum(1)
        self.levels = [(low, high, total, count)]
        while len(low) > 1:
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            total, count = total[::2] + total[1::2], count[::2] + count[1::2]
            self.levels.insert(0, (low, high, total, count))


def descend(parts: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each row of the tree's order, sums by entry, counts by entry)."""
    k, width = entries.shape
    book = Tree(entries, tree_order(entries, 1), 1)
    sums, counts = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
    chosen = np.full(len(parts.order), -1, dtype=np.int64)
    node, entry = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    level, deep, bottom, floor = 0, 0, len(parts.levels) - 1, len(book.levels) - 1
    while len(node):
        low, high, total, count = parts.levels[level]
        e_low, e_high = book.levels[deep][0][entry], book.levels[deep][1][entry]
        low, high = low[node], high[node]
        gap = np.maximum(np.maximum(low - e_high, e_low - high), 0)
        reach = np.maximum(np.abs(high - e_low), np.abs(e_high - low))
        least, most = (gap * gap).sum(1), (reach * reach).sum(1)
        bound = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(bound, node, most)
        keep = least <= bound[node]
        node, entry = node[keep], entry[keep]
        if deep == floor:
            # Entries that padding repeats count once.
            real = book.weight[entry] > 0
            node, entry = node[real], entry[real]
            left = np.bincount(node, minlength=int(node.max()) + 1)[node] if len(node) else node
            done = left == 1
            n, e = node[done], book.order[entry[done]]
            np.add.at(sums, e, total[n])
            np.add.at(counts, e, count[n])
            size = len(parts.order) >> level
            chosen[runs(n * size, np.full(len(n), size))] = np.repeat(e, size)
            node, entry = node[~done], entry[~done]
            if level == bottom:
                settle(parts, entries, node, book.order[entry], chosen, sums, counts)
                break
        grow = level < bottom
        dive = deep < floor
        if grow:
            node, entry = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([entry, entry])
        if dive:
            node, entry = np.concatenate([node, node]), np.concatenate([2 * entry, 2 * entry + 1])
        level, deep = level + grow, deep + dive
    return chosen, sums, counts


def settle(parts: Tree, entries: np.ndarray, node: np.ndarray, entry: np.ndarray, chosen: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Exact distances for the rows of leaves with several entries left."""
    if not len(node):
        return
    leaf = parts.leaf
    at = runs(node * leaf, np.full(len(node), leaf))
    e = np.repeat(entry, leaf)
    gap = parts.rows[at] - entries[e]
    order = np.lexsort((e, (gap * gap).sum(1), at))
    at, e = at[order], e[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])
    at, e = at[first], e[first]
    chosen[at] = e
    weight = parts.weight[at]
    np.add.at(sums, e, parts.rows[at] * weight[:, None])
    np.add.at(counts, e, weight)


def blocks_of(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """ids, known, labels, data, orders: packed blocks with the tree order of every part position."""
    number = max(1, -(-rows.count() // BLOCK))
    # Rows that repeat are told apart by their own content and a draw per row of a written table.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "point", F.monotonically_increasing_id()), F.lit(number)))

    def build(table):
        x = points(table["point"].combine_chunks(), width)
        cut = x.reshape(len(x), parts, -1)
        ids, labels = table["vec_id"], table["label"]
        return {
            "n": [len(x)],
            "ids": [pack(ids.fill_null(0).to_numpy())], "id_null": [pack(ids.is_null().to_numpy())],
            "labels": [pack(labels.fill_null(0).to_numpy())], "label_null": [pack(labels.is_null().to_numpy())],
            "data": [pack(x)], "orders": [pack(np.stack([tree_order(cut[:, p]) for p in range(parts)]).astype(np.int32))],
        }

    return stored(grouped(dealt, "block", build, "n long, ids binary, id_null binary, labels binary, label_null binary, data binary, orders binary"), "blocks")


def opened(data: bytes, orders: bytes, width: int, parts: int):
    """(part position, tree) of a block."""
    x = unpack(data, np.int64).reshape(-1, width)
    cut = x.reshape(len(x), parts, -1)
    order = unpack(orders, np.int32).reshape(parts, -1)
    for p in range(parts):
        yield p, Tree(np.ascontiguousarray(cut[:, p]), order[p], LEAF)


def moved(blocks: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """Codebooks after one round; sums come back as one row a part, entry and component."""
    parts, k, step = books.shape

    def run(batches):
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
        for b in batches:
            for data, orders in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p, tree in opened(data, orders, width, parts):
                    _, total, count = descend(tree, books[p])
                    sums[p] += total
                    counts[p] += count
        p, e, d = (a.ravel() for a in np.indices(books.shape))
        held = counts[p, e] > 0
        yield {"part": p[held], "entry": e[held], "dim": d[held], "total": sums[p, e, d][held], "n": counts[p, e][held]}

    rows = arrow_map(blocks, run, "part int, entry int, dim int, total long, n long", ["data", "orders"])
    exact = F.sum(F.col("total").cast("decimal(38,0)"))
    out = books.copy()
    for r in rows.groupBy("part", "entry", "dim").agg(exact.alias("total"), F.sum("n").alias("n")).collect():  # parts * entries * step rows
        out[r["part"], r["entry"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error; a hot label is met in ``SALTS`` places."""
    same = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    salted = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "_label")
    dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, dealt["label"].eqNullSafe(salted["_label"]) & (dealt["_salt"] == salted["salt"]))


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = scaled(named, scale).select("vec_id", "label", "point")
    lengths = rows.where(F.size("point") % parts == 0).groupBy(F.size("point").alias("width")).count()
    common = lengths.orderBy(F.desc("count"), "width").first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    width = common["width"]
    rows = rows.where(F.size("point") == width)
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "point").limit(entries).select("point").collect()
    books = np.array([r["point"] for r in start], dtype=np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    blocks = blocks_of(rows, width, parts)
    for _ in range(rounds):
        books = moved(blocks, books, width)

    def run(batches):
        for b in batches:
            for ids, id_null, labels, label_null, data, orders in zip(*[c.to_pylist() for c in b.columns]):
                code, error = None, None
                for p, tree in opened(data, orders, width, parts):
                    chosen, _, _ = descend(tree, books[p])
                    if code is None:
                        n = len(unpack(ids, np.int64))
                        code, error = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                    gap = tree.rows - books[p][chosen]
                    code[tree.order, p] = chosen
                    real = tree.weight > 0
                    error[tree.order[real]] += (gap * gap).sum(1)[real]

                def nullable(values, missing):
                    return [None if m else v for v, m in zip(unpack(values, np.int64).tolist(), unpack(missing, np.bool_).tolist())]

                yield {"vec_id": nullable(ids, id_null), "label": nullable(labels, label_null), "code": [c.tobytes().hex() for c in code], "error": error}

    columns = ["ids", "id_null", "labels", "label_null", "data", "orders"]
    coded = stored(arrow_map(blocks, run, "vec_id long, label long, code string, error long", columns), "codes")
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
