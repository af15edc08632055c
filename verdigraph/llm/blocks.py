"""Packed batches of documents, and which keys of a batch recur elsewhere.

Documents are packed into batches (one row each: ids, sizes, text bytes, all zstd), written once to the
shared folder, so that a batch is the same thing whenever it is read. To learn which of billions of keys
(hashes of shingles, anchors) occur more than once, each batch sends its distinct keys, dealt by hash into
blocks, as packed arrays; a block counts them and answers each batch with one number or bit a key. A key
that a third of all documents hold reaches its block once a batch, not once a document. The number of
blocks follows the bytes of text, so a block's size does not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import SLICE_BYTES, arrow_map, give_back, let_go, mix, pack, runs, slices, stored, texts, unpack

BATCH_BYTES = 2 << 20
BLOCK_BYTES = 16 << 20
MIN_BLOCKS = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
# Units worked on at once: few enough to stay in a core's cache.
NEAR = 1 << 15
PACKED = "tid string, n_bytes long, ids binary, sizes binary, data binary"


class Batch:
    """Opened documents of one packed row: ids, sizes in bytes, one byte array."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids = unpack(ids, np.int64)
        self.sizes = unpack(sizes, np.int64)
        self.raw = unpack(data, np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return len(self.ids)


def pack_documents(docs: DataFrame, label: str) -> DataFrame:
    """The documents as stored batches; rows without doc_id are left out."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, (ids, rows) in enumerate(slices(batches, BATCH_BYTES)):
            raw = [t.encode() for t in rows]
            sizes = np.array([len(r) for r in raw], dtype=np.int64)
            yield {
                "tid": [f"{part}-{number}"], "n_bytes": [int(sizes.sum())], "ids": [pack(np.array(ids, dtype=np.int64))],
                "sizes": [pack(sizes)], "data": [pack(np.frombuffer(b"".join(raw), dtype=np.uint8))],
            }

    return stored(arrow_map(texts(docs, drop_null_ids=True), run, PACKED), label)


def block_count(batches: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    total = batches.agg(F.sum("n_bytes")).first()[0] or 0
    return max(MIN_BLOCKS, -(-total // block_bytes))


def grouped(df: DataFrame, key: str, fn: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """``applyInArrow`` for a function that returns one dict of columns a group."""
    from verdigraph.llm.common import ARROW

    fields = [f.strip().split(" ") for f in schema.split(",")]

    def run(table: pa.Table) -> pa.Table:
        let_go()
        out = fn(table)
        if table.nbytes >= SLICE_BYTES:
            give_back()
        return pa.table([pa.array(out[n], ARROW[k]) for n, k in fields], names=[n for n, _ in fields])

    return df.groupBy(key).applyInArrow(run, schema)


def by_block(keys: np.ndarray, blocks: int):
    """(block, positions) for distinct sorted keys."""
    block = ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[order], np.arange(blocks + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def recurring(batches: DataFrame, columns: list[str], keys_of: Callable[..., tuple[np.ndarray, np.ndarray]], blocks: int, exact: bool = False) -> DataFrame:
    """tid, answers: for each batch its answer to every block it wrote to.

    ``keys_of(*columns)`` gives a batch's distinct sorted 64-bit keys and how often each occurs in it. The
    answer holds, for the keys of one block in order, the count over all batches. Unless ``exact``, keys
    travel as 32 bits within their block and the answer is one bit: whether the count over all batches may
    be two or more (two keys in 4 billion may be taken for one another there; callers compare afterwards).
    """

    def ask(rows):
        for b in rows:
            for tid, *values in zip(*[c.to_pylist() for c in b.columns]):
                keys, counts = keys_of(*values)
                found = list(by_block(keys, blocks))
                short = keys if exact else (keys >> np.uint64(32)).astype(np.uint32)
                if exact:
                    sent = [pack(counts[p].astype(np.uint32)) for _, p in found]
                else:
                    sent = [pack(np.packbits(counts[p] > 1)) for _, p in found]
                yield {"block": [x for x, _ in found], "tid": [tid] * len(found), "keys": [pack(short[p]) for _, p in found], "counts": sent}

    kind = np.uint64 if exact else np.uint32

    def answer(table: pa.Table) -> dict:
        arrays = [unpack(k, kind) for k in table["keys"].to_pylist()]
        if exact:
            counts = [unpack(c, np.uint32).astype(np.int64) for c in table["counts"].to_pylist()]
        else:
            counts = [1 + np.unpackbits(unpack(c, np.uint8))[: len(a)].astype(np.int64) for a, c in zip(arrays, table["counts"].to_pylist())]
        values, where = np.unique(np.concatenate(arrays), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts), minlength=len(values)).astype(np.int64)[where]
        parts = np.split(total, np.cumsum([len(a) for a in arrays])[:-1])
        out = [pack(p.astype(np.uint32)) if exact else pack(np.packbits(p > 1)) for p in parts]
        return {"tid": table["tid"], "block": table["block"], "answer": out}

    asked = arrow_map(batches, ask, "block int, tid string, keys binary, counts binary", ["tid", *columns])
    answers = grouped(asked, "block", answer, "tid string, block int, answer binary")
    return answers.groupBy("tid").agg(F.collect_list(F.struct("block", "answer")).alias("answers"))


def counts_of(keys: np.ndarray, blocks: int, answers, exact: bool = False) -> np.ndarray:
    """Counts (or 0/1 bits) for a batch's keys, put together from the blocks' answers."""
    got = {a["block"]: a["answer"] for a in answers or []}
    out = np.zeros(len(keys), dtype=np.int64)
    for b, p in by_block(keys, blocks):
        if b in got:
            out[p] = unpack(got[b], np.uint32) if exact else np.unpackbits(unpack(got[b], np.uint8))[: len(p)]
    return out


WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, length, document) of all words; words never cross documents."""
    inner = ~WHITE[batch.raw]
    first = np.zeros(len(inner) + 1, dtype=bool)
    first[batch.starts[batch.sizes > 0]] = True  # a document's first byte
    edge = first[:-1]
    begins = inner & (edge | np.concatenate([[True], ~inner[:-1]])[: len(inner)])
    starts = np.flatnonzero(begins)
    closes = inner & (np.concatenate([edge[1:], [True]])[: len(inner)] | np.concatenate([~inner[1:], [True]])[: len(inner)])
    lengths = np.flatnonzero(closes) - starts + 1
    doc = np.searchsorted(batch.starts + batch.sizes, starts, side="right")
    return starts, lengths, doc


def word_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), BASE, dtype=np.uint64))
        place = runs(np.zeros(len(starts)), lengths)
        chars = (raw[runs(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers[place]
        return mix(np.add.reduceat(chars, np.cumsum(lengths) - lengths))


def rolling(units: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring units: runs of twice the length from two of the length before."""
    n = max(len(units) - size + 1, 0)
    out = np.empty(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, n, NEAR):
            piece = units[at : min(at + NEAR, n) + size - 1].astype(np.uint64)
            total, length, power = piece, 1, BASE
            for bit in bin(size)[3:]:
                total = total[:-length] * power + total[length:]
                length, power = 2 * length, power * power
                if bit == "1":
                    total = total[:-1] * BASE + piece[length:]
                    length, power = length + 1, power * BASE
            out[at : at + NEAR] = mix(total)
    return out


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least hash in each run of ``width`` neighbours.

    The lowest bits of a hash give way to its place, so one minimum finds both; the order of hashes that agree in all other
    bits is that of their places, in equal runs the same.
    """
    n = max(len(values) - width + 1, 0)
    out = np.empty(n, dtype=np.int64)
    low = np.uint64((1 << (NEAR + width).bit_length()) - 1)
    for start in range(0, n, NEAR):
        piece = values[start : min(start + NEAR, n) + width - 1]
        best = (piece & ~low) | np.arange(len(piece), dtype=np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            best = np.minimum(best[step:], best[:-step])
            span += step
        out[start : start + NEAR] = best & low
        out[start : start + NEAR] += start
    return out


class AnchorRuns:
    """Windows of ``window`` units by their anchor, the leftmost least of the grams inside.

    Equal windows have equal anchors at equal places. ``start`` (unit), ``number`` of windows, ``doc`` and
    ``key`` of every run of neighbouring windows that share an anchor.
    """

    def __init__(self, grams: np.ndarray, gram: int, window: int, starts: np.ndarray, sizes: np.ndarray):
        least = window_least(grams, window - gram + 1)
        n_windows = np.maximum(sizes - window + 1, 0)
        at = runs(starts, n_windows)
        doc = np.repeat(np.arange(len(sizes)), n_windows)
        anchor = least[at] if len(at) else at
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        self.start = at[first]
        self.number = np.diff(np.append(first, len(at)))
        self.doc = doc[first]
        self.key = grams[anchor[first]] if len(first) else np.zeros(0, dtype=np.uint64)

    def keys(self, by_document: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and the documents (or else runs) of the batch each occurs in."""
        if not len(self.key):
            return self.key, np.zeros(0, dtype=np.int64)
        order = np.lexsort((self.doc, self.key))
        key, doc = self.key[order], self.doc[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        counted = (np.concatenate([[True], doc[1:] != doc[:-1]]) | new) if by_document else np.ones(len(key))
        return key[new], np.bincount(np.cumsum(new) - 1, weights=counted).astype(np.int64)

    def recurring(self, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Places of the runs whose key's bit is set."""
        return np.flatnonzero(bits[np.searchsorted(keys, self.key)]) if len(keys) else np.zeros(0, dtype=np.int64)


def shards_of(keys: np.ndarray, shards: int):
    """(shard, positions), dealt by key."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), order[cuts[s] : cuts[s + 1]]
