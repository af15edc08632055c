"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of two neighbouring blocks of ``BLOCK`` words, so every stretch of a block's
length lies whole in one passage. A passage's vector holds TF-IDF weights of the words of the benchmark,
hashed into ``BUCKETS`` features, with document frequencies counted over all passages of all documents.

A randomised singular value decomposition of the passage matrix A (documents, and the items with the same
total weight) gives the latent space: Spark tasks sum their share of S = A'(A R) for a random R, summed by
feature ranges, and the driver takes the leading ``RANK`` right singular vectors from S and R'S, matrices
whose size depends on ``BUCKETS`` and ``RANK`` alone. A passage and an item are candidates when the cosine
of their latent images, over the passage's full norm, reaches ``MIN_COSINE``. A document that holds an item word
for word is a candidate whatever the cosine: ``GRAM`` words of each item are looked up in every text.

Words that stand in more than ``COMMON`` of all passages weigh nothing there. Where they, with words that stand
nowhere, make up ``ANSWERED_SHARE`` of an item or more, the leak itself may be that frequent; such an item meets
every passage that holds this share of its words and its answer's, or ``LCS_SHARE`` of its words (of an item
longer than a block, half of these shares of a block).

Candidates are compared word by word: the longest common subsequence of the item with the passage and an
item's length around it, and whether the item's last sentence, its answer, stands there. A document holds an
item when the subsequence covers ``LCS_SHARE`` of it, or ``ANSWERED_SHARE`` with the answer found. Items of
fewer than ``SHORT`` words must stand there word for word.

The benchmark is worked off in parts of at most ``SPACE_ITEMS`` items and ``MAX_ITEM_BYTES``, each with a latent
space of its own: the items of a larger part would not all lie in ``RANK`` directions. A part travels with the
tasks and takes three passes over the corpus.

Cases: null and empty texts and items without words match nothing; rows without doc_id or item_id are left
out; a repeated document gives one row a (doc_id, item_id); empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.blocks import grouped
from verdigraph.llm.common import arrow_map, give_back, let_go, runs, slices, texts

BLOCK = 48
BUCKETS = 8192
RANK = 256
OVERSAMPLE = 16
COMMON = 0.25
MIN_COSINE = 0.3
LCS_SHARE = 0.5
ANSWERED_SHARE = 0.4
SHORT = 8
MIN_CONTENT = 3
PLAIN_SHARE, ORDER_SHARE = 0.7, 0.4
MAX_ITEM_BYTES = 16 << 20
SPACE_ITEMS = 200
GRAM = 4
RANGES = 64
# Rows summed at once: few enough to stay in a core's cache.
NEAR_BLOCKS, NEAR_TOKENS = 32, 1024
# Passages, and words read for them, that are held side by side, a byte a bucket.
NEAR_PASSAGES, NEAR_WORDS = 256, 1 << 16
SLICE = 1 << 20
SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double, answer boolean"
TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once; they come nearly in order, where sorting takes a fraction of what ``np.unique`` takes."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def lcs(item: list, masks: dict, other: list) -> int:
    """Length of the longest common subsequence, bit-parallel over the item; ``masks`` has each word's places."""
    full = (1 << len(item)) - 1
    state = full
    get = masks.get
    for word in other:
        m = get(word)
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return len(item) - state.bit_count()


class Item:
    """An item's words, their places as bit masks, and its last sentence as the answer."""

    def __init__(self, item_id: int, text: str):
        self.item_id = item_id
        self.words = words_of(text)
        self.masks: dict[bytes, int] = {}
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        sentences = [words_of(s) for s in re.split(r"[.!?\n]+", text)]
        self.answer = next((s for s in reversed(sentences) if s), [])

    def compare(self, other: list[bytes]) -> tuple[float, bool]:
        """Share of the item in the longest common subsequence, and whether the answer stands in ``other``."""
        share = lcs(self.words, self.masks, other) / len(self.words)
        shown = b" %s " % b" ".join(other)
        answer = bool(self.answer) and b" %s " % b" ".join(self.answer) in shown
        if len(self.words) < SHORT and b" %s " % b" ".join(self.words) not in shown:
            return 0.0, False
        return share, answer

    def weigh(self, useful: np.ndarray) -> None:
        """Tell words that are no frequent ones; where few are, the item is ``plain``: frequent words alone must not decide."""
        self.content = [w for w in self.words if useful[bucket(w)]]
        self.plain = len(self.content) <= (1 - ANSWERED_SHARE) * len(self.words)
        self.content_masks: dict[bytes, int] = {}
        for i, w in enumerate(self.content):
            self.content_masks[w] = self.content_masks.get(w, 0) | 1 << i

    def compare_plain(self, other: list[bytes]) -> tuple[float, bool]:
        """As ``compare``, in stretches of about the item's own length, of which the best counts.

        Half of the item's rarer words must stand there in order too. An item with hardly any must stand there word for word,
        or share ``PLAIN_SHARE`` with the stretch and ``ORDER_SHARE`` more than with the stretch read backwards: frequent words meet in any order.
        """
        n = len(self.words)
        width, best = n + n // 2, (0.0, False)
        rare = len(self.content) >= MIN_CONTENT
        if rare and sum(map(self.content_masks.__contains__, other)) < LCS_SHARE * len(self.content):
            return best
        for start in range(0, max(1, len(other) - width + n // 4), max(1, n // 4)):
            part = other[start : start + width]
            if rare and lcs(self.content, self.content_masks, part) < LCS_SHARE * len(self.content):
                continue
            share, answer = self.compare(part)
            if not rare and share < PLAIN_SHARE:
                continue
            if not rare and b" %s " % b" ".join(self.words) not in b" %s " % b" ".join(part):
                if share - self.compare(part[::-1])[0] < ORDER_SHARE:
                    continue
            best = max(best, (share, answer))
        return best


class Blocks:
    """Benchmark words of some texts, by block: buckets of tokens, block of each token, document of each block."""

    def __init__(self, rows: list[str], vocabulary: dict[bytes, int]):
        each = [words_of(t) for t in rows]
        self.words = each
        self.sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        tokens = np.fromiter(map(vocabulary.get, chain.from_iterable(each), repeat(-1)), dtype=np.int32, count=int(self.sizes.sum()))
        number = -(-self.sizes // BLOCK)
        first = np.cumsum(number) - number
        self.all, self.starts, self.first = tokens, np.cumsum(self.sizes) - self.sizes, first
        hit = np.flatnonzero(tokens >= 0)
        doc = np.repeat(np.arange(len(each), dtype=np.int32), self.sizes)[hit]
        self.tokens, self.block = tokens[hit], first[doc] + (hit - self.starts[doc]) // BLOCK
        self.n = int(number.sum())
        self.doc = np.repeat(np.arange(len(each)), number)
        self.index = np.arange(self.n) - np.repeat(first, number)
        # A passage is a block and the next one; a text of one block is one passage.
        self.pairs = np.flatnonzero((self.index == 0) & (np.repeat(number, number) == 1) | (self.index + 1 < np.repeat(number, number)))
        self.single = np.repeat(number, number)[self.pairs] == 1

    def passages(self, values: np.ndarray) -> np.ndarray:
        """Sums over both blocks of each passage."""
        after = np.where(self.single, self.pairs, self.pairs + 1)
        out = values[self.pairs] + values[after]
        out[self.single] = values[self.pairs[self.single]]
        return out


class Sequences:
    """Finds items word for word: by the buckets of up to ``GRAM`` words in a row, from the item's rarest word on."""

    def __init__(self, items: list[Item], counts: np.ndarray):
        self.items = items
        self.owners: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for number, item in enumerate(items):
            size = min(len(item.words), GRAM)
            spots = [bucket(w) for w in item.words]
            at = min(range(len(spots) - size + 1), key=lambda i: counts[spots[i]])
            key = 0
            for x in spots[at : at + size]:
                key = key * BUCKETS + x
            self.owners.setdefault(size, {}).setdefault(key, []).append((number, at))
        self.keys = {size: np.array(sorted(o), dtype=np.int64) for size, o in self.owners.items()}

    def find(self, b: Blocks) -> dict[tuple[int, int], int]:
        """The first word of each (document, item) in which the item's words stand in a row."""
        out: dict[tuple[int, int], int] = {}
        ends = np.cumsum(b.sizes)
        for size, keys in self.keys.items():
            opens = np.zeros(BUCKETS + 1, dtype=bool)  # the last for words of no item
            opens[keys // BUCKETS ** (size - 1)] = True
            at = np.flatnonzero(opens[b.all])
            at = at[at + size <= len(b.all)]
            gram = np.zeros(len(at), dtype=np.int64)
            for i in range(size):
                gram = gram * BUCKETS + b.all[at + i]
            hit = keys[np.minimum(np.searchsorted(keys, gram), len(keys) - 1)] == gram
            docs = np.searchsorted(ends, at[hit], side="right")
            for place, key, doc in zip(at[hit].tolist(), gram[hit].tolist(), docs.tolist()):
                for number, offset in self.owners[size].get(key, ()):
                    words, start = self.items[number].words, place - int(b.starts[doc]) - offset
                    if start >= 0 and (doc, number) not in out and b.words[doc][start : start + len(words)] == words:
                        out[doc, number] = start
        return out


class Shared:
    """Passages that hold half of an item's rarer words, for items that consist largely of frequent words."""

    def __init__(self, items: list[Item], counts: np.ndarray, n_passages: int):
        self.chosen = [k for k, item in enumerate(items) if item.plain]
        # The words that decide: the rarer ones, where there are enough of them.
        held = {k: items[k].content if len(items[k].content) >= MIN_CONTENT else items[k].words for k in self.chosen}
        self.spots = np.full(BUCKETS + 1, -1)  # the last for words of no item
        used = np.unique(np.array([bucket(w) for k in self.chosen for w in held[k]], dtype=np.int64))
        self.spots[used] = np.arange(len(used))
        self.times = np.zeros((len(used), len(self.chosen)), dtype=np.float32)
        for column, k in enumerate(self.chosen):
            np.add.at(self.times[:, column], self.spots[[bucket(w) for w in held[k]]], 1)
        sizes = np.array([len(held[k]) for k in self.chosen])
        self.need = np.where(sizes > BLOCK, BLOCK / 2, sizes) - 1e-6

    def find(self, b: Blocks):
        """(passage, item) where enough of the item's words occur in the passage."""
        if not self.chosen:
            return
        spot = self.spots[b.tokens]
        held = distinct(b.block[spot >= 0] * BUCKETS + spot[spot >= 0])
        block, spot = held // BUCKETS, held % BUCKETS
        # Each block is the first of the passage at its own place and the second of the one before.
        place = np.full(b.n + 1, -1)
        place[b.pairs] = np.arange(len(b.pairs))
        before = np.full(b.n + 1, -1)
        before[b.pairs[~b.single] + 1] = np.flatnonzero(~b.single)
        both = distinct(np.concatenate([(at[block] * BUCKETS + spot)[at[block] >= 0] for at in (place, before)]))
        passage, spot = both // BUCKETS, both % BUCKETS
        new = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else passage
        for start in range(0, len(new), 4096):
            chosen = new[start : start + 4096]
            end = new[start + 4096] if start + 4096 < len(new) else len(passage)
            of, begins = spot[chosen[0] : end], chosen - chosen[0]
            total = np.add.reduceat(self.times[of], begins, axis=0)
            for p, column in zip(*np.nonzero(total >= LCS_SHARE * self.need)):
                yield int(passage[chosen[p]]), self.chosen[column]


def block_sums(blocks: Blocks, table: np.ndarray) -> np.ndarray:
    """Sum of table rows over the tokens of each block."""
    out = np.zeros((blocks.n, table.shape[1]), dtype=np.float32)
    if len(blocks.tokens):
        new = np.flatnonzero(np.concatenate([[True], blocks.block[1:] != blocks.block[:-1]]))
        for start in range(0, len(new), NEAR_BLOCKS):
            chosen = new[start : start + NEAR_BLOCKS]
            end = new[start + NEAR_BLOCKS] if start + NEAR_BLOCKS < len(new) else len(blocks.tokens)
            out[blocks.block[chosen]] = np.add.reduceat(table[blocks.tokens[chosen[0] : end]], chosen - chosen[0], axis=0)
    return out


def passage_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Number of passages of all documents, and in how many each bucket occurs."""

    def run(batches):
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for _, rows in slices(batches, SLICE):
            b = Blocks(rows, vocabulary)
            n += len(b.pairs)
            # A block belongs to up to two passages; a bucket in both blocks of one passage counts once there.
            last = np.zeros(b.n, dtype=bool)
            last[b.n - 1 :] = True
            last[:-1] = b.doc[1:] != b.doc[:-1]
            key = distinct(b.block.astype(np.int64) * BUCKETS + b.tokens)
            block, token = key // BUCKETS, key % BUCKETS
            multiplicity = 1 + ((b.index[block] > 0) & ~last[block])
            total += np.bincount(token, weights=multiplicity, minlength=BUCKETS).astype(np.int64)
            near = np.flatnonzero(~last[block])
            after = np.searchsorted(key, key[near] + BUCKETS)
            following = near[key[np.minimum(after, len(key) - 1)] == key[near] + BUCKETS]
            total -= np.bincount(token[following], minlength=BUCKETS)
        yield {"bucket": np.append(np.arange(BUCKETS), -1), "n": np.append(total, n)}

    rows = arrow_map(texts(docs), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    n = 0
    for r in rows:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            counts[r["bucket"]] = r["n"]
    return n, counts


def latent_basis(docs: DataFrame, items: list[Item], vocabulary: dict[bytes, int], idf: np.ndarray, n_passages: int, rank: int, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors of the passage matrix, BUCKETS x rank."""
    rng = np.random.default_rng(seed)
    used = np.unique(np.array(list(vocabulary.values()), dtype=np.int64))
    used = used[idf[used] > 0]
    width = min(rank + OVERSAMPLE, max(len(used), 1))
    random = np.zeros((BUCKETS, width), dtype=np.float32)
    random[used] = rng.standard_normal((len(used), width)).astype(np.float32)
    weighted = random * idf[:, None]
    spots = np.full(BUCKETS, -1)
    spots[used] = np.arange(len(used))

    def share(rows: list[str], total: np.ndarray) -> None:
        """Add A'(A R) of some texts' passages to ``total``."""
        b = Blocks(rows, vocabulary)
        images = b.passages(block_sums(b, weighted))
        # Each token of a block meets the images of the passages the block is in.
        per_block = np.zeros((b.n, width), dtype=np.float32)
        per_block[b.pairs] = images  # each block begins one passage at most
        both = b.pairs[~b.single]
        per_block[both + 1] += images[~b.single]
        spot = spots[b.tokens]
        keep = np.flatnonzero(spot >= 0)
        keep = keep[np.argsort(spot[keep], kind="stable")]
        rows = b.block[keep]
        for start in range(0, len(keep), NEAR_TOKENS):
            s = spot[keep[start : start + NEAR_TOKENS]]
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            total[s[new]] += np.add.reduceat(per_block[rows[start : start + NEAR_TOKENS]], new, axis=0)

    edges = np.linspace(0, len(used), RANGES + 1).astype(int)

    def run(batches):
        total = np.zeros((len(used), width), dtype=np.float32)
        for _, rows in slices(batches, SLICE):
            share(rows, total)
        yield {"part": np.arange(RANGES), "sums": [total[a:b].tobytes() for a, b in zip(edges, edges[1:])]}

    def add(table: pa.Table) -> dict:
        parts = [np.frombuffer(x.as_py(), dtype=np.float32) for x in table["sums"]]
        return {"part": table["part"][:1], "sums": [np.sum(parts, axis=0, dtype=np.float64).tobytes()]}

    summed = grouped(arrow_map(texts(docs), run, "part int, sums binary"), "part", add, "part int, sums binary").collect()
    sketch = np.zeros((len(used), width))
    for r in summed:
        a, b = edges[r["part"]], edges[r["part"] + 1]
        sketch[a:b] = np.frombuffer(r["sums"]).reshape(b - a, width)
    own = np.zeros((len(used), width), dtype=np.float32)
    share([b" ".join(i.words).decode() for i in items], own)
    sketch += own * (max(n_passages, 1) / max(len(items), 1))
    sketch *= idf[used, None]
    # Nystroem: the matrix A'A is close to S (R'S)^-1 S'.
    core = random[used].T.astype(np.float64) @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0) * 1e-9
    half = sketch @ (vectors[:, keep] / np.sqrt(values[keep]))
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    basis = np.zeros((BUCKETS, min(rank, left.shape[1])), dtype=np.float32)
    basis[used] = left[:, : basis.shape[1]]
    return basis


class Judge:
    """What a task needs to find a part's items in texts: word weights and latent images, items, and their searches."""

    def __init__(self, vocabulary: dict[bytes, int], table: np.ndarray, images: np.ndarray, items: list[Item], counts: np.ndarray, n_passages: int):
        self.vocabulary, self.table, self.images, self.items = vocabulary, table, images, items
        self.sequences, self.shared = Sequences(items, counts), Shared(items, counts, n_passages)
        # An item's words and its answer's, by bucket.
        self.spots = [np.unique(np.array([bucket(w) for w in i.words], dtype=np.int64), return_counts=True) for i in items]
        self.answers = [np.unique(np.array([bucket(w) for w in i.answer], dtype=np.int64)) for i in items]

    def possible(self, b: Blocks, passages: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which (passage, item) share enough words to pass ``compare``: a subsequence holds no word that the stretch compared does not hold.

        Items look at stretches of their own length rounded up to blocks, so a few tables of the words at hand serve all.
        """
        out = np.zeros(len(passages), dtype=bool)
        around = np.array([-(-len(i.words) // BLOCK) * BLOCK for i in self.items], dtype=np.int64)[items]
        for reach in np.unique(around).tolist():
            chosen = np.flatnonzero(around == reach)
            used, row = np.unique(passages[chosen], return_inverse=True)
            block = b.pairs[used]
            doc, at = b.doc[block], b.index[block] * BLOCK
            low = np.maximum(at - reach, 0)
            sizes = np.minimum(at + 2 * BLOCK + reach, b.sizes[doc]) - low
            ends, start = np.cumsum(sizes), 0
            while start < len(used):
                full = int(np.searchsorted(ends, ends[start] - sizes[start] + NEAR_WORDS, side="right"))
                end = max(start + 1, min(start + NEAR_PASSAGES, full))
                held = np.zeros((end - start, BUCKETS + 1), dtype=bool)  # the last for words of no item
                held[np.repeat(np.arange(end - start), sizes[start:end]), b.all[runs((b.starts[doc] + low)[start:end], sizes[start:end])]] = True
                near = np.flatnonzero((row >= start) & (row < end))
                which, place = items[chosen[near]], row[near] - start
                for k in np.unique(which).tolist():
                    own = np.flatnonzero(which == k)
                    spots, times = self.spots[k]
                    share = (held[place[own][:, None], spots] @ times.astype(np.float32)).astype(np.float64) / len(self.items[k].words)
                    told = held[place[own][:, None], self.answers[k]].all(axis=1) & (len(self.answers[k]) > 0)
                    out[chosen[near[own]]] = share >= np.where(told, ANSWERED_SHARE, LCS_SHARE)
                start = end
        return out

    def find(self, rows: list[str]) -> dict[tuple[int, int], list]:
        """Cosine, share and answer of every (text, item) where the text holds the item."""
        b = Blocks(rows, self.vocabulary)
        sums = b.passages(block_sums(b, self.table))
        norm = np.sqrt(np.maximum(sums[:, -1], 1e-12))
        out: dict[tuple[int, int], list] = {}

        def compare(doc: int, k: int, first: int, last: int, cosine: float) -> None:
            """Compare an item with a document's words from ``first`` to ``last`` and an item's length around."""
            item = self.items[k]
            reach = len(item.words)
            share, answer = (item.compare_plain if item.plain else item.compare)(b.words[doc][max(0, first - reach) : last + reach])
            if share >= LCS_SHARE or answer and share >= ANSWERED_SHARE:
                kept = out.setdefault((doc, k), [0.0, 0.0, False])
                kept[:] = max(kept[0], cosine), max(kept[1], share), kept[2] or answer

        for start in range(0, len(sums), 8192):
            cosine = sums[start : start + 8192, :-1] @ self.images.T / norm[start : start + 8192, None]
            near, items = np.nonzero(cosine >= MIN_COSINE)
            passes = self.possible(b, start + near, items)
            for p, k in zip(near[passes], items[passes]):
                block = b.pairs[start + p]
                at = int(b.index[block]) * BLOCK
                compare(int(b.doc[block]), int(k), at, at + 2 * BLOCK, float(cosine[p, k]))
        for p, k in self.shared.find(b):
            at = int(b.index[b.pairs[p]]) * BLOCK
            compare(int(b.doc[b.pairs[p]]), k, at, at + 2 * BLOCK, float(sums[p, :-1] @ self.images[k] / norm[p]))
        for (doc, k), at in self.sequences.find(b).items():
            p = np.searchsorted(b.pairs, b.first[doc] + at // BLOCK, side="right") - 1
            compare(doc, k, at, at + len(self.items[k].words), float(sums[p, :-1] @ self.images[k] / norm[p]))
        return out


def fitted(docs: DataFrame, items: list[Item], rank: int):
    """The broadcast ``Judge`` of a part's items: its size depends on the part alone."""
    vocabulary = {w: bucket(w) for i in items for w in i.words}
    n, counts = passage_counts(docs, vocabulary)
    for item in items:
        item.weigh((counts > 0) & (counts <= COMMON * n))
    idf = np.where(counts > COMMON * n, 0.0, np.log((n + 1) / (counts + 1)) + 1e-6).astype(np.float32)
    # Words that stand in a large share of all passages weigh nothing; ``Sequences`` and ``Shared`` look them up.
    weighted = {w: b for w, b in vocabulary.items() if idf[b] > 0}
    basis = latent_basis(docs, items, weighted, idf, n, rank)
    table = np.concatenate([basis * idf[:, None], (idf**2)[:, None]], axis=1)
    images = np.zeros((len(items), basis.shape[1]), dtype=np.float32)
    for k, item in enumerate(items):
        ids = [vocabulary[w] for w in item.words if w in vocabulary]
        v = table[ids, :-1].sum(0)
        images[k] = v / max(np.linalg.norm(v), 1e-12)
    return docs.sparkSession.sparkContext.broadcast(Judge(vocabulary, table, images, items, counts, n))


def _leaks(docs: DataFrame, items: list[Item], rank: int) -> DataFrame:
    judge = fitted(docs, items, rank)

    def run(batches):
        for ids, rows in slices(batches, SLICE):
            out = judge.value.find(rows)
            if out:
                c, s, a = zip(*out.values())
                yield {"doc_id": [ids[d] for d, _ in out], "item_id": [judge.value.items[k].item_id for _, k in out], "cosine": c, "lcs_share": s, "answer": a}

    found = arrow_map(texts(docs, drop_null_ids=True), run, SCHEMA)
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"), F.max("answer").alias("answer"))


def item_parts(benchmark: DataFrame) -> list[list[Item]]:
    """The items in parts of bounded size, each of which may travel with the tasks and fits one latent space."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("item_id is not null")
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_parts = max(1, math.ceil(total / MAX_ITEM_BYTES))
    out = []
    for p in range(n_parts):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == p).distinct().orderBy("item_id", "text").collect()
        items = [i for i in (Item(r["item_id"], r["text"]) for r in part) if i.words]
        pieces = math.ceil(len(items) / SPACE_ITEMS)
        out += [items[i::pieces] for i in range(pieces)]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer: documents that hold a benchmark item, verbatim or reworded."""
    out = None
    for items in item_parts(benchmark):
        found = _leaks(docs, items, rank)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item; rows without doc_id stay.

    Every row is judged by its own text where it is read, so no text is moved; each part of the items sifts what the one before left.
    """
    kept = docs
    number, column = docs.columns.index("doc_id"), docs.columns.index("text")
    for items in item_parts(benchmark):
        kept = kept.mapInArrow(_sieve(fitted(docs, items, rank), number, column), docs.schema)
    return kept


def _sieve(judge, number: int, column: int):
    def run(batches):
        let_go()
        for batch in batches:
            ids = batch.column(number)
            rows = pa.RecordBatch.from_arrays([pa.array(range(len(ids))), batch.column(column).cast(pa.string()).fill_null("")], ["row", "text"])
            leaking = {part[d] for part, some in slices([rows], SLICE) for d, _ in judge.value.find(some)}
            yield batch.filter(pa.array([i not in leaking or not ids[i].is_valid for i in range(len(ids))], pa.bool_()))
        give_back()

    return run
