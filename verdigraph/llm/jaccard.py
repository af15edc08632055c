"""N-gram Jaccard join as a blocked sparse matrix product of document by shingle incidence.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Two documents link when their
sets' Jaccard similarity is at least ``percent``; linked documents get one component id. The product is
never formed as a whole; bounds that follow from the set sizes drop rows, columns and blocks first, none
of which can lose a link:

1. Columns with one row add nothing. A document links only if need = ceil(percent * size) of its shingles
   stand elsewhere too, so documents with fewer shared shingles are done.
2. Equal sets are one row: the class, under its least doc_id.
3. Hub columns: in every column the least class is the hub, and the overlap of each class with the hubs
   of its columns is accumulated over all columns. That sum is a lower bound of the true overlap; where it
   suffices, the two are linked already, which settles most of a large group of near copies by a star.
4. The other pairs: shingles ordered by frequency, rarest first; two sets that link must meet in their
   prefixes of size - need + 1. Classes are laid into tiles of about ``TILE`` similar ones. A pair of
   tiles is multiplied only if classes of different components and near enough sizes meet in a prefix
   column there; the
   product counts overlaps exactly, and pairs below 3/7 (for 75 percent) of the summed sizes are dropped.

Links become components by contraction. No step holds all pairs of a group, and no list of links is
collected: a tile product returns a spanning forest of what it links.

Cases: texts without words have an empty set and link with nothing; texts of fewer than five words are one
shingle; rows without doc_id are left out; rows that repeat a doc_id are nodes of their own, which meet
through their texts alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.blocks import LOWER, Batch, block_count, by_block, counts_of, grouped, pack_documents, recurring, rolling, word_hashes, words
from verdigraph.llm.common import arrow_map, mix, pack, runs, scratch, stored, unpack
from verdigraph.llm.components import components

SIZE = 5
PERCENT = 75
TILE = 256
PACK_HASHES = 200_000
COLUMNS = 4096


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of ``n`` with any set it links to."""
    return -(-(np.asarray(n, dtype=np.int64) * percent) // 100)


def shingle_sets(batch: Batch, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all distinct shingles, ordered by document, then hash."""
    lowered = Batch.__new__(Batch)
    lowered.ids, lowered.sizes, lowered.starts, lowered.raw = batch.ids, batch.sizes, batch.starts, LOWER[batch.raw]
    starts, lengths, doc = words(lowered)
    hashes = word_hashes(lowered.raw, starts, lengths)
    count = np.bincount(doc, minlength=len(batch)).astype(np.int64)
    first = np.cumsum(count) - count
    grams = rolling(hashes, size)
    number = np.maximum(count - size + 1, 0)
    keys = [grams[runs(first, number)]]
    docs = [np.repeat(np.arange(len(batch)), number)]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        with np.errstate(over="ignore"):
            whole = [rolling(hashes[first[i] : first[i] + count[i]], int(count[i]))[0] + np.uint64(count[i]) for i in short]
        keys.append(mix(np.array(whole, dtype=np.uint64)))
        docs.append(short)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], key[new]


def document_sets(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, int]:
    """doc_id, n, digest, hashes: set sizes; digest where a link is possible; the shared hashes once a batch and set."""
    batches = pack_documents(docs, "jaccard")
    blocks = block_count(batches)
    columns = ["ids", "sizes", "data"]

    def keys_of(ids, sizes, data):
        _, key = shingle_sets(Batch(ids, sizes, data), size)
        return np.unique(key, return_counts=True)

    def sift(rows):
        for b in rows:
            for ids, sizes, data, answers in zip(*[c.to_pylist() for c in b.columns]):
                batch = Batch(ids, sizes, data)
                doc, key = shingle_sets(batch, size)
                distinct, where = np.unique(key, return_inverse=True)
                shared = counts_of(distinct, blocks, answers)[where] > 0
                n = np.bincount(doc, minlength=len(batch)).astype(np.int64)
                m = np.bincount(doc, weights=shared, minlength=len(batch)).astype(np.int64)
                ends = np.cumsum(n)
                digests: list[bytes | None] = [None] * len(batch)
                sets: list[bytes | None] = [None] * len(batch)
                seen: set[bytes] = set()
                for i in sorted(np.flatnonzero((n > 0) & (m >= need(n, percent))).tolist(), key=lambda i, x=batch.ids: x[i]):
                    part = slice(ends[i] - n[i], ends[i])
                    digests[i] = hashlib.blake2b(key[part].tobytes(), digest_size=16).digest()
                    if digests[i] not in seen:
                        seen.add(digests[i])
                        sets[i] = key[part][shared[part]].tobytes()
                yield {"doc_id": batch.ids, "n": n, "digest": digests, "hashes": sets}

    known = batches.join(recurring(batches, columns, keys_of, blocks), "tid", "left")
    return stored(arrow_map(known, sift, "doc_id long, n long, digest binary, hashes binary", [*columns, "answers"]), "sets"), blocks


def pack_classes(classes: DataFrame) -> DataFrame:
    """Classes packed for another round of counting."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            rep, n, sets = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            sizes = np.array([len(s) // 8 for s in sets], dtype=np.int64)
            group = (np.cumsum(sizes) - sizes) // PACK_HASHES
            for g in np.unique(group):
                p = np.flatnonzero(group == g)
                yield {
                    "tid": [f"{part}-{number}"], "reps": [pack(rep[p])], "ns": [pack(n[p])], "sizes": [pack(sizes[p])],
                    "hashes": [pack(np.frombuffer(b"".join([sets[i] for i in p]), dtype=np.uint64))],
                }
                number += 1

    return stored(arrow_map(classes, run, "tid string, reps binary, ns binary, sizes binary, hashes binary", ["rep", "n", "hashes"]), "classes")


def ordered_sets(packed: DataFrame, blocks: int, percent: int) -> DataFrame:
    """rep, n, prefix, hashes: shared shingles, rarest first, of the classes that may still link."""

    def keys_of(hashes):
        return np.unique(unpack(hashes, np.uint64), return_counts=True)

    def order(rows):
        for b in rows:
            for reps, ns, sizes, hashes, answers in zip(*[c.to_pylist() for c in b.columns]):
                rep, n, size, key = unpack(reps, np.int64), unpack(ns, np.int64), unpack(sizes, np.int64), unpack(hashes, np.uint64)
                distinct, where = np.unique(key, return_inverse=True)
                df = counts_of(distinct, blocks, answers, exact=True)[where]
                row = np.repeat(np.arange(len(rep)), size)
                at = np.lexsort((key, df, row))
                at = at[df[at] > 1]
                key, row = key[at], row[at]
                m = np.bincount(row, minlength=len(rep))
                prefix = m - need(n, percent) + 1
                ends = np.cumsum(m)
                keep = np.flatnonzero(prefix > 0)
                yield {"rep": rep[keep], "n": n[keep], "prefix": prefix[keep].astype(np.int32), "hashes": [key[ends[i] - m[i] : ends[i]].tobytes() for i in keep]}

    known = packed.join(recurring(packed, ["hashes"], keys_of, blocks, exact=True), "tid", "left")
    return stored(arrow_map(known, order, "rep long, n long, prefix int, hashes binary", ["reps", "ns", "sizes", "hashes", "answers"]), "ordered")


def column_blocks(rows: DataFrame, blocks: int, columns: list[str], prefix_only: bool) -> DataFrame:
    """Incidence dealt by shingle: block, hashes, and for each hash the values of ``columns`` of its class."""

    def run(batches):
        for b in batches:
            prefix, sets = b.column(0).to_numpy(), b.column(1).to_pylist()
            values = np.stack([b.column(i + 2).to_numpy() for i in range(len(columns))])
            keys = [np.frombuffer(s, dtype=np.uint64)[: p if prefix_only else None] for s, p in zip(sets, prefix.tolist())]
            row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
            found = list(by_block(key, blocks))
            yield {
                "block": [x for x, _ in found], "keys": [pack(key[p]) for _, p in found], "values": [pack(values[:, row[p]]) for _, p in found],
            }

    return arrow_map(rows, run, "block int, keys binary, values binary", ["prefix", "hashes", *columns])


def open_block(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) of a block, ordered by key."""
    key = np.concatenate([unpack(k, np.uint64) for k in table["keys"].to_pylist()])
    values = np.concatenate([unpack(v, np.int64).reshape(width, -1) for v in table["values"].to_pylist()], axis=1)
    order = np.lexsort((values[0], key))
    return key[order], values[:, order]


def hub_overlaps(rows: DataFrame, blocks: int) -> DataFrame:
    """a, b, overlap, n_a, n_b: classes, hubs of their columns, and how many columns they share through them."""

    def count(table: pa.Table) -> dict:
        key, (rep, n) = open_block(table, 2)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        hub = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first row of each column has the least class
        own = np.flatnonzero(rep != rep[hub])
        pairs, where, times = np.unique(np.stack([rep[own], rep[hub[own]]], axis=1), axis=0, return_index=True, return_counts=True)
        at = own[where]
        return {"a": pairs[:, 0], "b": pairs[:, 1], "overlap": times.astype(np.int64), "n_a": n[at], "n_b": n[hub[at]]}

    parts = grouped(column_blocks(rows, blocks, ["rep", "n"], False), "block", count, "a long, b long, overlap long, n_a long, n_b long")
    return stored(parts.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")), "hubs")


def tiles_of(rows: DataFrame, hubs: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """rep, comp, tile: tiles hold about ``TILE`` classes of one family and like size; a large component has its own."""
    best = hubs.groupBy("a").agg(F.max_by("b", F.struct("overlap", "b")).alias("hub"))
    comp = linked.select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    size_class = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))).alias("class")
    placed = (
        rows.select("rep", size_class).join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        .join(best.select(F.col("a").alias("rep"), "hub"), "rep", "left").withColumn("hub", F.coalesce("hub", "rep"))
        .join(comp.select(F.col("rep").alias("hub"), F.col("comp").alias("family")), "hub", "left").withColumn("family", F.coalesce("family", "hub"))
    )
    size = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("held"))
    placed = placed.join(size, "comp").withColumn("own", F.when(F.col("held") >= TILE // 4, F.col("comp")).otherwise(F.lit(-1)))
    group = placed.groupBy("family", "own", "class").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    placed = placed.join(group, ["family", "own", "class"])
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    return stored(placed.select("rep", "comp", F.xxhash64("family", "own", "class", part).alias("tile")), "tiles")


def tile_pairs(rows: DataFrame, blocks: int, percent: int) -> DataFrame:
    """i, j: tiles in which classes of different components and near enough sizes meet in a prefix column."""

    def meet(table: pa.Table) -> dict:
        key, (tile, comp, n) = open_block(table, 3)
        found: set[tuple[int, int]] = set()
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a < 2 or (comp[a:b] == comp[a]).all():
                continue
            held: dict[int, set[int]] = {}
            sizes: dict[int, list[int]] = {}
            for t, c, m in zip(tile[a:b].tolist(), comp[a:b].tolist(), n[a:b].tolist()):
                held.setdefault(t, set()).add(c)
                span = sizes.setdefault(t, [m, m])
                span[:] = min(span[0], m), max(span[1], m)
            names = sorted(held, key=lambda t: sizes[t])
            for x, t in enumerate(names):
                if len(held[t]) > 1:
                    found.add((t, t))
                for u in names[x + 1 :]:
                    if 100 * sizes[t][1] < percent * sizes[u][0]:
                        # Every class of u is too large for all of t; later ones start no smaller.
                        break
                    if len(held[t]) > 1 or len(held[u]) > 1 or held[t] != held[u]:
                        found.add((min(t, u), max(t, u)))
        return {"i": [p[0] for p in found], "j": [p[1] for p in found]}

    return grouped(column_blocks(rows, blocks, ["tile", "comp", "n"], True), "block", meet, "i long, j long").distinct()


class Tile:
    """Classes of one tile: sizes, components, and the incidence of its distinct shingles, as one packed value."""

    def __init__(self, n: np.ndarray, comp: np.ndarray, row: np.ndarray, spot: np.ndarray, keys: np.ndarray):
        self.n, self.comp, self.row, self.spot, self.keys = n, comp, row, spot, keys

    @staticmethod
    def of(n: np.ndarray, comp: np.ndarray, sets: list[bytes]) -> Tile:
        keys, spot = np.unique(np.frombuffer(b"".join(sets), dtype=np.uint64), return_inverse=True)
        return Tile(n, comp, np.repeat(np.arange(len(sets)), [len(s) // 8 for s in sets]), spot, keys)

    def dump(self) -> list[bytes]:
        return [pack(self.n), pack(self.comp), pack(self.row.astype(np.uint32)), pack(self.spot.astype(np.uint32)), pack(self.keys)]

    @staticmethod
    def load(parts: list[bytes]) -> Tile:
        return Tile(*[unpack(x, k) for x, k in zip(parts, (np.int64, np.int64, np.uint32, np.uint32, np.uint64))])


def product_links(left: Tile, right: Tile, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the components that linked pairs of two tiles join.

    Overlaps are sums of products of 0/1 blocks of ``COLUMNS`` columns, over the shingles both tiles hold.
    """
    common = np.intersect1d(left.keys, right.keys, assume_unique=True)
    entries = []
    for side in (left, right):
        at = np.full(len(side.keys), -1)
        at[np.searchsorted(side.keys, common)] = np.arange(len(common))
        col = at[side.spot]
        ok = np.flatnonzero(col >= 0)
        ok = ok[np.argsort(col[ok], kind="stable")]
        entries.append((side.row[ok], col[ok]))
    overlap = np.zeros((len(left.n), len(right.n)), dtype=np.float32)
    for start in range(0, len(common), COLUMNS):
        dense = []
        for (row, col), side in zip(entries, (left, right)):
            lo, hi = np.searchsorted(col, [start, start + COLUMNS])
            x = np.zeros((len(side.n), min(COLUMNS, len(common) - start)), dtype=np.float32)
            x[row[lo:hi], col[lo:hi] - start] = 1
            dense.append(x)
        overlap += dense[0] @ dense[1].T
    bound = percent * (left.n[:, None] + right.n[None, :])
    hit = ((100 + percent) * overlap.astype(np.int64) >= bound) & (left.comp[:, None] != right.comp[None, :])
    x, y = np.nonzero(hit)
    parent: dict[int, int] = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for a, b in np.unique(np.stack([left.comp[x], right.comp[y]], axis=1), axis=0).tolist():
        if root(a) != root(b):
            parent[root(a)] = root(b)
            out.append((a, b))
    return out


def tile_links(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """a, b: components that the products of the tile pairs link."""

    def packed(table: pa.Table) -> dict:
        n, comp = table["n"].to_numpy(), table["comp"].to_numpy()
        return {"tile": table["tile"][:1], **{c: [x] for c, x in zip("vwxyz", Tile.of(n, comp, table["hashes"].to_pylist()).dump())}}

    parts = grouped(rows.select("tile", "n", "comp", "hashes"), "tile", packed, "tile long, v binary, w binary, x binary, y binary, z binary")
    held = stored(parts.select("tile", F.array(*"vwxyz").alias("held")), "held")
    # The product of a tile with itself needs it once: its second place is empty.
    asked = pairs.select("i", F.when(F.col("i") != F.col("j"), F.col("j")).alias("j"))
    wanted = asked.join(held.select(F.col("tile").alias("i"), F.col("held").alias("left")), "i").join(
        held.select(F.col("tile").alias("j"), F.col("held").alias("right")), "j", "left"
    )

    def run(batches):
        for b in batches:
            for first, second in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                left = Tile.load(first)
                found = product_links(left, Tile.load(second) if second else left, percent)
                yield {"a": [x for x, _ in found], "b": [y for _, y in found]}

    return arrow_map(wanted, run, "a long, b long", ["left", "right"])


def link(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) of every document."""
    sets, blocks = document_sets(docs, size, percent)
    classes = stored(
        sets.where("hashes is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("hashes").alias("hashes")), "reps"
    )
    rows = ordered_sets(pack_classes(classes), blocks, percent)
    hubs = hub_overlaps(rows, blocks)
    sure = hubs.where((100 + percent) * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b")))
    linked = components(sure)
    tiles = tiles_of(rows, hubs, linked, percent)
    laid = stored(rows.join(tiles, "rep"), "laid")
    more = components(tile_links(laid, stored(tile_pairs(laid, blocks, percent), "pairs"), percent))
    final = (
        classes.select("digest", "rep")
        .join(linked.select(F.col("node").alias("rep"), F.col("root").alias("first")), "rep", "left")
        .withColumn("first", F.coalesce("first", "rep"))
        .join(more.select(F.col("node").alias("first"), F.col("root").alias("last")), "first", "left")
        .select("digest", F.coalesce("last", "first").alias("component"))
    )
    return sets.select("doc_id", "n", "digest").join(final, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, that have the least doc_id of their component; rows without doc_id stay.

    Of rows that repeat both doc_id and text, one stays. The documents meet the ids that go, far fewer than those that stay, so
    that texts move only where even those are too many to send to all tasks.
    """
    with scratch(docs.sparkSession) as keep:
        held = F.sum((F.col("doc_id") == F.col("component_id")).cast("int")).alias("times")
        odd = keep(link(docs, size, percent).groupBy("doc_id").agg(held).where("times != 1"), "odd")
    number = F.col("doc_id").cast("long")
    kept = docs.where(number.isNotNull()).join(odd.where("times = 0").select(F.col("doc_id").alias("_gone")), number == F.col("_gone"), "left_anti")
    if not odd.where("times > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))
