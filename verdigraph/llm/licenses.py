"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or a window of as many words in a row as the template has, over line ends too: a
template may be wrapped anywhere. A template is a set of words. They join when the block holds at least
``threshold`` of the template's words. Words of templates are ordered by their frequency in the whole
corpus, rarest first, and three filters keep the comparison exact but short:

- prefix: a template T needs o = ceil(threshold * |T|) of its words in the block, so one of its
  |T| - o + 1 rarest words must be there. Only those words are looked up.
- length: the block must have at least o words.
- position: a hit at place i of the ordered template leaves at most |T| - i words in common.

Two passes over the corpus: the frequencies of the templates' words, then the join. Templates are a
parameter whose words, bounded by ``MAX_TEMPLATE_WORDS``, travel with the tasks.

Base places, where the words of a fixed phrase stand next to each other, are found in the same pass.

Cases: null and empty texts have no words, no places, empty labels and score 0; repeated rows give
repeated results; a null doc_id stays null.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import arrow_map, map_texts, slices, texts

MAX_TEMPLATE_WORDS = 50_000
# Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "apache": ("Licensed under the Apache License, Version 2.0",),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "reserved": ("All rights reserved",),
}
# Bytes of words lower-cased, line feeds kept, all else a blank.
_WORD = [b for b in range(256) if b >= 0x80 or chr(b).isalnum()]
TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b in _WORD or b == 10 else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def template_words(templates: Mapping[str, Sequence[str]]) -> list[tuple[str, list[bytes]]]:
    out = [(label, words_of(t)) for label, each in templates.items() for t in each]
    if sum(len(set(w)) for _, w in out) > MAX_TEMPLATE_WORDS:
        raise ValueError("the templates hold more words than travel with a task")
    return [(label, w) for label, w in out if w]


def template_sets(templates: Mapping[str, Sequence[str]]) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(w)) for label, w in template_words(templates)]


def word_frequencies(docs: DataFrame, words: Sequence[bytes]) -> dict[bytes, int]:
    """How often each of a bounded list of words stands in all texts."""
    number = {w: i for i, w in enumerate(words)}

    def run(batches):
        total = np.zeros(len(number) + 1, dtype=np.int64)
        for _, rows in slices(batches):
            for text in rows:
                found = np.fromiter(map(number.get, words_of(text), repeat(len(number))), dtype=np.int64)
                total += np.bincount(found, minlength=len(number) + 1)
        yield {"word": np.arange(len(number)), "n": total[:-1]}

    counts = arrow_map(texts(docs), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in counts}
    return {w: found.get(i, 0) for w, i in number.items()}


class Index:
    """Templates ordered by word frequency, and the postings of their prefixes."""

    def __init__(self, templates: Mapping[str, Sequence[str]], frequency: Mapping[bytes, int], threshold: float):
        self.items = []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.widths = []
        for label, each in template_words(templates):
            held = frozenset(each)
            order = sorted(held, key=lambda w: (frequency.get(w, 0), w))
            need = math.ceil(threshold * len(order) - 1e-9)
            number = len(self.items)
            self.widths.append(len(each))
            self.items.append((label, order, held, need))
            for place, word in enumerate(order[: len(order) - need + 1]):
                self.postings.setdefault(word, []).append((number, place))

    def match(self, block: set[bytes]) -> dict[str, float]:
        """Best containment by label of the templates the block contains."""
        out: dict[str, float] = {}
        done = set()
        for word in block & self.postings.keys():
            for number, place in self.postings[word]:
                label, order, held, need = self.items[number]
                if number in done or len(block) < need or len(order) - place < need:
                    continue
                done.add(number)
                common = len(held & block)
                if common >= need:
                    out[label] = max(out.get(label, 0.0), common / len(order))
        return out


    def match_windows(self, words: list[bytes], known: Mapping[str, float]) -> dict[str, float]:
        """As ``match``, for every window of a template's number of words; ``known`` are shares found already."""
        out: dict[str, float] = {}
        whole = set(words)
        rare = whole & self.postings.keys()
        places: dict[int, list[int]] = {}
        numbers = {number for word in rare for number, _ in self.postings[word]}
        for number in numbers:
            label, order, held, need = self.items[number]
            if known.get(label, 0.0) < 1 and len(held & whole) >= need:
                places[number] = []
        if not places:
            return out
        for at, word in enumerate(words):
            if word in rare:
                for number, _ in self.postings[word]:
                    if number in places:
                        places[number].append(at)
        for number, each in places.items():
            label, order, held, need = self.items[number]
            width, best, done = self.widths[number], 0, 0
            counts: dict[bytes, int] = {}
            # Windows that hold a rare word: one sweep over the stretches around the rare words' places.
            for at in each:
                first = max(done, at - width + 1)
                if first > done or not done:
                    counts, done = {}, first
                    start = first
                for end in range(done, min(at + width, len(words))):
                    if end - start >= width:
                        gone = words[start]
                        start += 1
                        if gone in held:
                            counts[gone] -= 1
                            if not counts[gone]:
                                del counts[gone]
                    if words[end] in held:
                        counts[words[end]] = counts.get(words[end], 0) + 1
                        best = max(best, len(counts))
                done = max(done, min(at + width, len(words)))
            if best >= need:
                out[label] = max(out.get(label, 0.0), best / len(order))
        return out


def base_places(words: list[bytes], phrases: Mapping[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases.items():
        last = phrase[-1]
        at, reach = -1, len(phrase) - 1
        for _ in range(words.count(last)):
            at = words.index(last, at + 1)
            if at >= reach and tuple(words[at - reach : at + 1]) == phrase:
                out.append((at - reach, label))
    return out


def scan(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """One row a document: words, base places, and labels of phrases and of templates contained in a block."""
    vocabulary = sorted(set().union(*[s for _, s in template_sets(templates)]))
    index = Index(templates, word_frequencies(docs, vocabulary), threshold)
    wanted = {tuple(words_of(p)): label for p, label in phrases.items()}

    def judge(text: str):
        data = text.encode().translate(TABLE)
        words = data.split()
        places = base_places(words, wanted)
        labels: dict[str, float] = {}
        if not index.postings.keys().isdisjoint(words):
            for line in data.split(b"\n"):
                block = set(line.split())
                if not index.postings.keys().isdisjoint(block):
                    for label, share in index.match(block).items():
                        labels[label] = max(labels.get(label, 0.0), share)
            if b"\n" in data:
                for label, share in index.match_windows(words, labels).items():
                    labels[label] = max(labels.get(label, 0.0), share)
        base = {label for _, label in places}
        starts = [s for s, _ in places]
        return (
            len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels.keys())), max([1.0] if base else labels.values(), default=0.0),
        )

    def run(ids, rows):
        columns = list(zip(*map(judge, rows)))
        return dict(zip(("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"), columns), doc_id=ids)

    return map_texts(docs, run, SCHEMA)
