"""MinHash near duplicates with sequential Bayesian verification.

A document's set holds the 64-bit hashes of its distinct five-word shingles; documents with equal sets are one
class. A class has a signature of ``BANDS * ROWS`` minima. Classes that agree on all rows of a band are
candidates: at similarity 0.85, 24 bands of five rows miss a pair once in 1.3 million.

Verification compares two signatures batch by batch. With m agreements in n minima and a uniform prior, the
similarity is distributed as Beta(m + 1, n - m + 1); a pair is pruned as soon as the mass at or above the
threshold is below ``MISS``. Survivors are verified exactly, by the sizes of their full sets and of the intersection.

No bucket is expanded into its pairs:

1. Star: every bucket has a centre, the class whose buckets are largest in sum. A class is compared with the
   centres of its buckets, and the best-agreeing one is verified. That joins most of a large group of near copies.
2. Rest: buckets that still hold several components, once for each distinct set of members, are cut into tiles
   of about ``TILE`` classes. A tile pair is compared as two blocks of signatures if it may join different
   components of compatible sizes. Where pairs survive, the tiles are met again with their full sets, every
   survivor is verified, and a spanning forest of the links leaves the task.

Links become components by contraction.

Cases: texts without words have an empty set and link with nothing; texts of fewer than five words are one
shingle; rows without doc_id are left out; rows that repeat a doc_id are nodes of their own, which meet
through their texts alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.blocks import Batch, grouped
from verdigraph.llm.common import arrow_map, runs, slices, stored, texts
from verdigraph.llm.components import components
from verdigraph.llm.jaccard import shingle_sets

SIZE = 5
PERCENT = 85
BANDS = 24
ROWS = 5
STEP = 20
MISS = 1e-6
TILE = 256
TILE_SHINGLES = 400_000
SLICE = 1 << 20
SIGNATURE = BANDS * ROWS


def families(number: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of the hash functions."""
    rng = np.random.default_rng(seed)
    masks = rng.integers(0, 2**64, number, dtype=np.uint64)
    return masks, rng.integers(0, 2**64, number, dtype=np.uint64) | np.uint64(1)


def opened(rows: list[str]) -> Batch:
    """Texts as one byte array."""
    raw = [t.encode() for t in rows]
    batch = Batch.__new__(Batch)
    batch.ids = np.arange(len(raw))
    batch.sizes = np.array([len(r) for r in raw], dtype=np.int64)
    batch.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
    batch.starts = np.cumsum(batch.sizes) - batch.sizes
    return batch


def text_sets(rows: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles of each text, their hashes one text after the other, ascending)."""
    batch = opened(rows)
    doc, key = shingle_sets(batch, size)
    return np.bincount(doc, minlength=len(rows)).astype(np.int64), key


def digest(part: np.ndarray) -> bytes:
    return hashlib.blake2b(part.tobytes(), digest_size=16).digest()


def signatures(key: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minima under every hash function, one row a set; sets are not empty."""
    masks, factors = families(SIGNATURE)
    starts = np.cumsum(counts) - counts
    out, held = np.empty((len(counts), SIGNATURE), dtype=np.uint32), np.empty_like(key)
    with np.errstate(over="ignore"):
        for i in range(SIGNATURE):
            np.bitwise_xor(key, masks[i], out=held)
            np.multiply(held, factors[i], out=held)
            np.right_shift(held, np.uint64(32), out=held)
            out[:, i] = np.minimum.reduceat(held, starts)
    return out


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, digest (null for empty sets), signature (once a slice and set)."""

    def run(batches):
        for ids, rows in slices(batches, SLICE):
            n, key = text_sets(rows, size)
            ends = np.cumsum(n)
            digests: list[bytes | None] = [None] * len(rows)
            first: dict[bytes, int] = {}
            for i in np.flatnonzero(n).tolist():
                digests[i] = digest(key[ends[i] - n[i] : ends[i]])
                first.setdefault(digests[i], i)
            signature: list[bytes | None] = [None] * len(rows)
            own = np.array(sorted(first.values()), dtype=np.int64)
            if len(own):
                for i, s in zip(own.tolist(), signatures(key[runs(ends[own] - n[own], n[own])], n[own])):
                    signature[i] = s.tobytes()
            yield {"doc_id": ids, "n": n, "digest": digests, "signature": signature}

    return stored(arrow_map(texts(docs, drop_null_ids=True), run, "doc_id long, n long, digest binary, signature binary"), "signed")


def band_keys(classes: DataFrame) -> DataFrame:
    """digest, rep, n, key: a row a class and band; the band's number is part of its key."""

    def run(batches):
        for b in batches:
            table = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint32).reshape(-1, BANDS, ROWS)
            keys = np.empty(table.shape[:2], dtype=np.uint64)
            with np.errstate(over="ignore"):
                for band in range(BANDS):
                    h = np.full(len(table), band + 1, dtype=np.uint64)
                    for r in range(ROWS):
                        h = (h ^ table[:, band, r]) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(29)
                    keys[:, band] = h
            row = np.repeat(np.arange(len(table)), BANDS)
            yield {"digest": b.column(0).take(row), "rep": b.column(1).take(row), "n": b.column(2).take(row), "key": keys.ravel().view(np.int64)}

    return arrow_map(classes, run, "digest binary, rep long, n long, key long", ["digest", "rep", "n", "signature"])


def least_agreements(percent: int, miss: float = MISS) -> np.ndarray:
    """By number of batches compared: the fewest agreements that are not pruned.

    P(similarity >= t | m of n) is the chance that a binomial of n + 1 draws at t is at most m.
    """
    t = percent / 100
    out = []
    for n in range(STEP, SIGNATURE + 1, STEP):
        mass, m = 0.0, 0
        while True:
            mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        out.append(m)
    return np.array(out)


def surviving(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, agreements) of the pairs of signature rows that no batch prunes."""
    agree = np.zeros(len(i), dtype=np.int64)
    for batch, fewest in enumerate(least.tolist()):
        part = slice(batch * STEP, (batch + 1) * STEP)
        agree = agree + (left[i, part] == right[j, part]).sum(1)
        keep = agree >= fewest
        i, j, agree = i[keep], j[keep], agree[keep]
    return i, j, agree


def fits(small, large, percent: int):
    """Whether sets of these sizes may reach the threshold."""
    return 100 * F.least(small, large) >= percent * F.greatest(small, large)


def table_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, SIGNATURE)


def bucketed(classes: DataFrame) -> DataFrame:
    """digest, rep, n, key, held: the rows of buckets with several classes, and how many those are."""
    keyed = band_keys(classes)
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    return stored(keyed.join(many, "key"), "buckets")


def star_pairs(buckets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b, agree: each class b with the centre among its buckets' that agrees with it best."""
    spread = buckets.groupBy("digest").agg(F.sum("held").alias("spread"))
    weighed = buckets.join(spread, "digest")
    centre = weighed.groupBy("key").agg(F.max_by(F.struct("digest", "n"), F.struct("spread", -F.col("rep"), "digest")).alias("c"))
    pairs = buckets.join(centre, "key").where((F.col("digest") != F.col("c.digest")) & fits(F.col("n"), F.col("c.n"), percent))
    pairs = pairs.select(F.col("c.digest").alias("a"), F.col("digest").alias("b")).distinct()
    sides = [classes.select(F.col("digest").alias(s), F.col("signature").alias(f"s{s}")) for s in "ab"]
    met = pairs.join(sides[1], "b").join(sides[0], "a")

    def run(batches):
        least = least_agreements(percent)
        for x in batches:
            at = np.arange(x.num_rows)
            i, _, agree = surviving(table_of(x.column(2)), table_of(x.column(3)), at, at, least)
            yield {"a": x.column(0).take(i), "b": x.column(1).take(i), "agree": agree}

    found = arrow_map(met, run, "a binary, b binary, agree long", ["a", "b", "sa", "sb"])
    best = found.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a"), F.max("agree").alias("agree"))
    return stored(best.select("a", "b", "agree"), "star")


def routed_sets(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """to, digest, set: the full set of every class in ``wanted`` (rep, digest, to), once for each member of its array ``to``.

    The sets are read off the texts of the classes' least documents.
    """
    rows = texts(docs, drop_null_ids=True).join(wanted, F.col("doc_id") == F.col("rep")).select("doc_id", "text", "digest", "to")

    def run(batches):
        sent: set[bytes] = set()
        for x in batches:
            own, to, at = x.column(2).to_pylist(), x.column(3).to_pylist(), 0
            for ids, part in slices([x.select([0, 1])], SLICE):
                n, key = text_sets(part, size)
                ends = np.cumsum(n)
                out: dict[str, list] = {"to": [], "digest": [], "set": []}
                for i in range(len(ids)):
                    held = key[ends[i] - n[i] : ends[i]]
                    # A doc_id may stand for several texts: only the class's own is sent, and once.
                    if own[at + i] not in sent and digest(held) == own[at + i]:
                        sent.add(own[at + i])
                        out["to"] += to[at + i]
                        out["digest"] += [own[at + i]] * len(to[at + i])
                        out["set"] += [held.tobytes()] * len(to[at + i])
                at += len(ids)
                yield out

    return stored(arrow_map(rows, run, "to binary, digest binary, set binary"), "sets")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold; the sets meet at a."""
    both = pairs.select("a", "b").unionByName(pairs.select("a", F.col("a").alias("b")).distinct())
    wanted = both.join(classes.select(F.col("digest").alias("b"), "rep"), "b").groupBy("rep", F.col("b").alias("digest")).agg(F.collect_set("a").alias("to"))
    routed = routed_sets(wanted, docs, size)
    centres = routed.where("to = digest").groupBy("to").agg(F.first("set").alias("other"))
    met = routed.where("to <> digest").join(centres, "to")

    def compare(batches):
        for x in batches:
            keep = []
            for i, (left, right) in enumerate(zip(x.column(2), x.column(3))):
                one, two = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (left, right))
                shared = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * shared >= percent * (len(one) + len(two) - shared):
                    keep.append(i)
            kept = np.array(keep, dtype=np.int64)
            yield {"a": x.column(0).take(kept), "b": x.column(1).take(kept)}

    return stored(arrow_map(met, compare, "a binary, b binary", ["to", "digest", "set", "other"]), "links")


def rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """digest, n, root of every class."""
    if links.isEmpty():
        return classes.select("digest", "n", F.col("digest").alias("root"))
    found = components(links).withColumnRenamed("node", "digest")
    return classes.select("digest", "n").join(found, "digest", "left").withColumn("root", F.coalesce("root", "digest"))


def open_tiles(buckets: DataFrame, roots: DataFrame, tried: DataFrame) -> DataFrame:
    """tile, key, digest, n, root, tried: tiles of the buckets that hold several components, one bucket for each member set.

    ``tried`` is the class this one was verified against before.
    """
    named = stored(buckets.select("key", "digest").join(roots, "digest"), "named")
    mixed = named.groupBy("key").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("held"), F.bit_xor(F.xxhash64("digest")).alias("m1"),
        F.sum(F.xxhash64(F.lit(7), "digest").cast("decimal(38,0)")).alias("m2"),
    ).where("x <> y")
    single = stored(mixed.groupBy("held", "m1", "m2").agg(F.min("key").alias("key")).select("key", "held"), "mixed")
    rows = stored(named.join(single, "key"), "open")
    own = stored(rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("alike")), "alike")
    large = F.col("held") > TILE
    part = F.when(large & (F.col("alike") >= TILE // 4), F.xxhash64("root")).otherwise(0)
    size_class = F.when(large, F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)))).otherwise(0)
    rows = stored(rows.join(own, ["key", "root"]).select("key", "digest", "n", "root", part.alias("part"), size_class.alias("class")), "placed")
    group = ["key", "part", "class"]
    number = rows.groupBy(*group).agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("tiles"))
    rows = rows.join(stored(number, "numbers"), group).join(tried.select(F.col("b").alias("digest"), F.col("a").alias("tried")), "digest", "left")
    tile = F.xxhash64(*group, F.pmod(F.xxhash64("digest"), "tiles"))
    return stored(rows.select(tile.alias("tile"), "key", "digest", "n", "root", F.coalesce("tried", "digest").alias("tried")), "tiles")


def tile_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """tile, tile2: tiles of one bucket that may join components, by their sizes and components."""
    about = stored(tiles.groupBy("key", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("x"), F.max("root").alias("y")), "about")
    other = about.select("key", *[F.col(c).alias(f"{c}2") for c in ("tile", "lo", "hi", "x", "y")])
    near = (100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo"))
    apart = (F.col("x") != F.col("y")) | (F.col("x2") != F.col("y2")) | (F.col("x") != F.col("x2"))
    return about.join(other, "key").where((F.col("tile") <= F.col("tile2")) & near & apart).select("tile", "tile2")


class Tile:
    """Classes of one tile as arrays."""

    def __init__(self, held: dict):
        self.n = np.frombuffer(held["ns"], dtype=np.int64)
        self.digests, self.roots, self.tried = ([held[c][i : i + 16] for i in range(0, 16 * len(self.n), 16)] for c in ("digests", "roots", "tried"))
        self.table = np.frombuffer(held["signatures"], dtype=np.uint32).reshape(-1, SIGNATURE)
        self.keys = np.frombuffer(held["sets"], dtype=np.uint64)
        self.starts = np.cumsum(self.n) - self.n


def candidates(one: Tile, two: Tile, same: bool, percent: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, agreements) of surviving pairs of different components that were not verified before."""
    names: dict[bytes, int] = {}

    def numbers(values):
        return np.array([names.setdefault(v, len(names)) for v in values], dtype=np.int64)

    low, high = np.minimum(one.n[:, None], two.n[None, :]), np.maximum(one.n[:, None], two.n[None, :])
    ok = (100 * low >= percent * high) & (numbers(one.roots)[:, None] != numbers(two.roots)[None, :])
    ok &= (numbers(one.tried)[:, None] != numbers(two.digests)[None, :]) & (numbers(one.digests)[:, None] != numbers(two.tried)[None, :])
    i, j = np.nonzero(np.triu(ok, 1) if same else ok)
    return surviving(one.table, two.table, i, j, least)


def exact_links(one: Tile, two: Tile, i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the components that the pairs join by their full sets."""
    _, code = np.unique(np.concatenate([one.keys, two.keys]), return_inverse=True)
    left, right = code[: len(one.keys)], code[len(one.keys) :]
    mark = np.zeros(len(code), dtype=bool)
    parent: dict[bytes, bytes] = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for a in np.unique(i).tolist():
        own, others = slice(one.starts[a], one.starts[a] + one.n[a]), j[np.searchsorted(i, a) : np.searchsorted(i, a, side="right")]
        mark[left[own]] = True
        shared = np.add.reduceat(mark[right[runs(two.starts[others], two.n[others])]].astype(np.int64), np.cumsum(two.n[others]) - two.n[others])
        mark[left[own]] = False
        for b in others[100 * shared >= percent * (one.n[a] + two.n[others] - shared)].tolist():
            x, y = root(one.roots[a]), root(two.roots[b])
            if x != y:
                parent[x] = y
                out.append((one.roots[a], two.roots[b]))
    return out


def packed_tiles(rows: DataFrame) -> DataFrame:
    """tile and its classes (digest, n, root, tried, signature, set) as one struct of bytes."""

    def packed(table):
        joined = {c: [b"".join(table[f].to_pylist())] for c, f in (("digests", "digest"), ("roots", "root"), ("tried", "tried"), ("signatures", "signature"), ("sets", "set"))}
        return {"tile": table["tile"][:1], "ns": [table["n"].to_numpy().tobytes()], **joined}

    schema = "tile long, ns binary, digests binary, roots binary, tried binary, signatures binary, sets binary"
    held = grouped(rows, "tile", packed, schema)
    return stored(held.select("tile", F.struct(*[f.split(" ")[0] for f in schema.split(", ")[1:]]).alias("held")), "packed")


def joined_tiles(pairs: DataFrame, held: DataFrame) -> DataFrame:
    left, right = held.withColumnRenamed("held", "one"), held.select(F.col("tile").alias("tile2"), F.col("held").alias("two"))
    return pairs.join(left, "tile").join(right, "tile2").select("tile", "tile2", "one", "two")


def rest_links(tiles: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """a, b: links between the components of open buckets, as a spanning forest of each tile pair.

    Signatures alone find the tile pairs with survivors; full sets go to their tiles only.
    """
    marks = tiles.join(classes.select("digest", "signature", "rep"), "digest")
    held = packed_tiles(marks.withColumn("set", F.lit(b"").cast("binary")))

    def sift(batches):
        least = least_agreements(percent)
        for b in batches:
            keep = []
            for x, (one, two) in enumerate(zip(b.column(2), b.column(3))):
                same = b.column(0)[x] == b.column(1)[x]
                if len(candidates(Tile(one.as_py()), Tile(two.as_py()), same, percent, least)[0]):
                    keep.append(x)
            kept = np.array(keep, dtype=np.int64)
            yield {"tile": b.column(0).take(kept), "tile2": b.column(1).take(kept)}

    pairs = stored(arrow_map(joined_tiles(tile_pairs(tiles, percent), held), sift, "tile long, tile2 long"), "pairs")
    if pairs.isEmpty():
        return None
    hot = pairs.select("tile").unionByName(pairs.select(F.col("tile2").alias("tile"))).distinct()
    rows = stored(marks.join(hot, "tile"), "hot")
    wanted = rows.groupBy("rep", "digest").agg(F.array(F.first("digest")).alias("to"))
    sets = routed_sets(wanted, docs, size).groupBy("digest").agg(F.first("set").alias("set"))
    held = packed_tiles(rows.join(sets, "digest"))

    def settle(batches):
        least = least_agreements(percent)
        for b in batches:
            for x in range(b.num_rows):
                one, two = Tile(b.column(2)[x].as_py()), Tile(b.column(3)[x].as_py())
                i, j, _ = candidates(one, two, b.column(0)[x] == b.column(1)[x], percent, least)
                found = exact_links(one, two, i, j, percent) if len(i) else []
                yield {"a": [f[0] for f in found], "b": [f[1] for f in found]}

    return stored(arrow_map(joined_tiles(pairs, held), settle, "a binary, b binary").distinct(), "links")


def link(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept of every document."""
    own = signed(docs, size)
    classes = stored(
        own.where("digest is not null").groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("signature", ignorenulls=True).alias("signature")
        ), "classes",
    )
    buckets = bucketed(classes)
    tried = star_pairs(buckets, classes, percent)
    links = verified(tried, classes, docs, size, percent)
    roots = rooted(classes, links)
    tiles = open_tiles(buckets, roots, tried)
    more = None if tiles.isEmpty() else rest_links(tiles, classes, docs, size, percent)
    if more is not None and not more.isEmpty():
        roots = rooted(classes, links.unionByName(more))
    reps = roots.join(classes.select("digest", "rep"), "digest")
    least = reps.groupBy("root").agg(F.min("rep").alias("component"))
    final = stored(reps.join(least, "root").select("digest", "component"), "final")
    out = own.select("doc_id", "n", "digest").join(final, "digest", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
