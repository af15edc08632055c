"""Repeated phrases by sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of one document. Every window has an anchor, its least hash of
``GRAM`` words, and windows are equal only if their anchors are; anchors that occur once are dropped
(``blocks``). Each document's stretches around recurring anchors are dealt by anchor into shards. A shard
confirms the passages that recur (a stretch whose anchor has no other stretch recurs as a whole; else its
windows are counted), compiles them into automata over word numbers and streams all its stretches through them, which locates every occurrence. The earliest occurrence of a
window is its smallest (doc_id, start); the answer to a batch says where windows occur earlier, and the batch
removes the words they cover.

Identical stretches of a batch travel once, so one passage in a third of all documents reaches its shard
once a batch. A shard's automata are compiled one after the other, each over at most ``AUTOMATON_WINDOWS``
windows (more only if one single anchor has more), cut between anchors.

Cases: null and empty texts have no words; rows without doc_id are left out; rows that repeat a doc_id hold
windows at the same (doc_id, start), of which neither is earlier; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.blocks import (
    AnchorRuns, Batch, block_count, counts_of, grouped, pack_documents, recurring, rolling, shards_of, word_hashes, words,
)
from verdigraph.llm.common import arrow_map, pack, runs, unpack

WINDOW = 20
GRAM = 5
SHARD_BYTES = 8 << 20
AUTOMATON_WINDOWS = 60_000
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Words:
    """A batch's words, one blank after each, and their anchors."""

    def __init__(self, batch: Batch, window: int):
        starts, lengths, doc = words(batch)
        self.sizes = np.bincount(doc, minlength=len(batch)).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.lengths = lengths + 1
        self.at = np.cumsum(self.lengths) - self.lengths  # first byte of each word
        data = np.full(int(self.lengths.sum()), 32, dtype=np.uint8)
        data[runs(self.at, lengths)] = batch.raw[runs(starts, lengths)]
        self.data = data
        hashes = word_hashes(batch.raw, starts, lengths)
        self.anchors = AnchorRuns(rolling(hashes, GRAM), GRAM, window, self.starts, self.sizes)

    def keys(self):
        return self.anchors.keys(by_document=False)

    def stretches(self, flagged: np.ndarray, window: int):
        """Distinct (key, words) around recurring anchors, and the number of each anchor's stretch."""
        a = self.anchors
        first = self.at[a.start[flagged]]
        last = a.start[flagged] + a.number[flagged] + window - 2
        end = self.at[last] + self.lengths[last] - 1 if len(last) else last
        raw = self.data.tobytes()
        numbers: dict[tuple[int, bytes], int] = {}
        which = [numbers.setdefault((k, raw[s:e]), len(numbers)) for k, s, e in zip(a.key[flagged].tolist(), first.tolist(), end.tolist())]
        return numbers, np.array(which, dtype=np.int64)


def opened(batch: Batch, answers, blocks: int, window: int):
    found = Words(batch, window)
    keys, _ = found.keys()
    flagged = found.anchors.recurring(keys, counts_of(keys, blocks, answers))
    return found, flagged, *found.stretches(flagged, window)


def locate(stretches: list[list[int]], where: list[tuple[int, int]], several: list[bool], alone: list[bool], window: int) -> list[list[tuple[int, int, int]]]:
    """For each stretch (offset, doc, start) of its recurring windows' earliest occurrence.

    ``where`` is each stretch's own earliest place, ``several`` whether it stands at more than one, and
    ``alone`` whether no other stretch has its anchor: then it recurs as a whole or not at all.
    """
    import ahocorasick

    seen: set[tuple[int, ...]] = set()
    patterns: dict[tuple[int, ...], int] = {}
    for ids, many, whole in zip(stretches, several, alone):
        if whole:
            if many:
                patterns.setdefault(tuple(ids), len(patterns))
            continue
        for i in range(len(ids) - window + 1):
            key = tuple(ids[i : i + window])
            if many or key in seen:
                patterns.setdefault(key, len(patterns))
            else:
                seen.add(key)
    del seen
    if not patterns:
        return [[] for _ in stretches]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    sizes = []
    for key, number in patterns.items():
        automaton.add_word(key, number)
        sizes.append(len(key))
    automaton.make_automaton()
    earliest: list[tuple[int, int] | None] = [None] * len(patterns)
    hits = []
    for ids, (doc, start), many, whole in zip(stretches, where, several, alone):
        own = [(end - sizes[number] + 1, number) for end, number in automaton.iter(tuple(ids))] if many or not whole else []
        hits.append(own)
        for off, number in own:
            place = (doc, start + off)
            best = earliest[number]
            if best is None or place < best:
                earliest[number] = place
    out = []
    for own in hits:
        rows = []
        for off, number in own:
            doc, at = earliest[number]
            rows += [(off + i, doc, at + i) for i in range(sizes[number] - window + 1)]
        out.append(rows)
    return out


def as_runs(found: list[tuple[int, int, int]], high: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """(offset, windows, doc, start at offset 0) of neighbouring windows with neighbouring earliest places, where earlier than ``high``."""
    out: list[list[int]] = []
    for off, doc, at in found:
        if (doc, at) >= (high[0], high[1] + off):
            continue
        if out and out[-1][0] + out[-1][1] == off and out[-1][2] == doc and out[-1][3] == at - off:
            out[-1][1] += 1
        else:
            out.append([off, 1, doc, at - off])
    return [tuple(r) for r in out]


def phrase_runs(batches: DataFrame, window: int = WINDOW) -> tuple[DataFrame, int]:
    """The batches with ``found``, the shards' answers; and the number of shards."""
    shards = block_count(batches, SHARD_BYTES)
    columns = ["ids", "sizes", "data"]

    def keys_of(ids, sizes, data):
        return Words(Batch(ids, sizes, data), window).keys()

    known = batches.join(recurring(batches, columns, keys_of, shards), "tid", "left")

    def send(rows):
        for b in rows:
            for tid, ids, sizes, data, answers in zip(*[c.to_pylist() for c in b.columns]):
                batch = Batch(ids, sizes, data)
                found, flagged, numbers, which = opened(batch, answers, shards, window)
                if not numbers:
                    continue
                a = found.anchors
                doc = batch.ids[a.doc[flagged]]
                start = a.start[flagged] - found.starts[a.doc[flagged]]
                order = np.lexsort((start, doc, which))
                cuts = np.searchsorted(which[order], np.arange(len(numbers) + 1))
                low, high = order[cuts[:-1]], order[cuts[1:] - 1]
                several = np.diff(cuts) > 1
                keys = np.fromiter((k for k, _ in numbers), dtype=np.uint64, count=len(numbers))
                contents = [c for _, c in numbers]
                for shard, p in shards_of(keys, shards):
                    places = np.stack([doc[low[p]], start[low[p]], doc[high[p]], start[high[p]], several[p]])
                    yield {
                        "shard": [shard], "tid": [tid], "keys": [pack(keys[p])], "places": [pack(places.astype(np.int64))],
                        "content": [pack(np.frombuffer(b"\n".join([contents[i] for i in p]), dtype=np.uint8))],
                    }

    def judge(table: pa.Table) -> dict:
        index: dict[tuple[int, bytes], int] = {}
        parts, highs, low, several = [], [], [], []
        for keys, places, content in zip(*[table[c].to_pylist() for c in ("keys", "places", "content")]):
            which = []
            rows = unpack(places, np.int64).reshape(5, -1)
            for key, words_, doc, at, many in zip(unpack(keys, np.uint64).tolist(), unpack(content, np.uint8).tobytes().split(b"\n"), *rows[[0, 1, 4]].tolist()):
                n = index.setdefault((key, words_), len(index))
                if n == len(low):
                    low.append((doc, at))
                    several.append(bool(many))
                else:
                    several[n] = True
                    low[n] = min(low[n], (doc, at))
                which.append(n)
            parts.append(which)
            highs.append(list(zip(*rows[2:4].tolist())))
        # One automaton after the other, cut between anchors.
        order = sorted(range(len(index)), key=lambda n, keys=[k for k, _ in index]: keys[n])
        contents = list(index)
        found: list[list[tuple[int, int, int]]] = [[] for _ in order]
        anchored = Counter(k for k, _ in contents)
        group: list[int] = []
        held = 0

        def run_group():
            names: dict[bytes, int] = {}
            stretches = [[names.setdefault(w, len(names)) for w in contents[n][1].split(b" ")] for n in group]
            alone = [anchored[contents[n][0]] == 1 for n in group]
            for n, hits in zip(group, locate(stretches, [low[n] for n in group], [several[n] for n in group], alone, window)):
                found[n] = hits

        for i, n in enumerate(order):
            if held >= AUTOMATON_WINDOWS and contents[n][0] != contents[order[i - 1]][0]:
                run_group()
                group, held = [], 0
            group.append(n)
            held += contents[n][1].count(b" ") + 2 - window
        if group:
            run_group()
        out = []
        for which, high in zip(parts, highs):
            rows = [(s, *r) for s, (n, h) in enumerate(zip(which, high)) for r in as_runs(found[n], h)]
            out.append(pack(np.array(rows, dtype=np.int64).reshape(-1, 5)))
        return {"tid": table["tid"], "shard": table["shard"], "runs": out}

    sent = arrow_map(known, send, "shard int, tid string, keys binary, places binary, content binary", ["tid", *columns, "answers"])
    judged = grouped(sent, "shard", judge, "tid string, shard int, runs binary")
    found = judged.groupBy("tid").agg(F.collect_list(F.struct("shard", "runs")).alias("found"))
    return known.join(found, "tid", "left"), shards


def kept_words(batch: Batch, answers, found, shards: int, window: int) -> tuple[Words, np.ndarray]:
    """A batch's words, and which of them stay."""
    if not found:
        w = Words(batch, window)
        return w, np.ones(len(w.lengths), dtype=bool)
    w, flagged, numbers, which = opened(batch, answers, shards, window)
    keys = np.fromiter((k for k, _ in numbers), dtype=np.uint64, count=len(numbers))
    members = dict(shards_of(keys, shards))
    rows = []
    for f in found:
        r = unpack(f["runs"], np.int64).reshape(-1, 5).copy()
        r[:, 0] = members[f["shard"]][r[:, 0]]
        rows.append(r)
    table = np.concatenate(rows)
    table = table[np.argsort(table[:, 0], kind="stable")]
    first = np.searchsorted(table[:, 0], which)
    each = np.searchsorted(table[:, 0], which, side="right") - first
    run = table[runs(first, each)]
    place = np.repeat(flagged, each)
    a = w.anchors
    doc, start = batch.ids[a.doc[place]], a.start[place] - w.starts[a.doc[place]]
    earlier = (run[:, 3] < doc) | ((run[:, 3] == doc) & (run[:, 4] < start))
    run, place = run[earlier], place[earlier]
    delta = np.zeros(len(w.lengths) + 1, dtype=np.int64)
    np.add.at(delta, a.start[place] + run[:, 1], 1)
    np.add.at(delta, a.start[place] + run[:, 1] + run[:, 2] - 1 + window, -1)
    return w, np.cumsum(delta[:-1]) == 0


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words removed, digest of the kept words joined by blanks."""
    joined, shards = phrase_runs(pack_documents(docs, "phrases"), window)

    def settle(rows):
        for b in rows:
            for ids, sizes, data, answers, found in zip(*[c.to_pylist() for c in b.columns]):
                batch = Batch(ids, sizes, data)
                w, kept = kept_words(batch, answers, found, shards, window)
                digest, removed = [], []
                for s, n in zip(w.starts.tolist(), w.sizes.tolist()):
                    keep = kept[s : s + n]
                    removed.append(n - int(keep.sum()))
                    part = w.data[w.at[s] : w.at[s + n - 1] + w.lengths[s + n - 1]] if n else w.data[:0]
                    if removed[-1]:
                        part = part[np.repeat(keep, w.lengths[s : s + n])]
                    digest.append(hashlib.sha256(part[:-1]).hexdigest())
                yield {"doc_id": batch.ids, "n_words": w.sizes, "n_removed": removed, "kept_sha256": digest}

    return arrow_map(joined, settle, SCHEMA, ["ids", "sizes", "data", "answers", "found"])
