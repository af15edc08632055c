"""Quality classifier: supervised embeddings of hashed words and character n-grams.

Each word, each immediate repeat of a word, and each character n-gram within a word (blanks at its ends
included) is hashed into a table of learned vectors. A document is the mean of the vectors of all its words and n-grams; a linear layer and a
softmax give the probability of label 1. Numpy stochastic gradient descent trains both, on the driver,
from at most ``max_train`` labelled documents chosen by a hash of their doc_id: that bound is the only
sample taken. Features of the training documents are computed by Spark tasks.

The mean and the layer are linear, so after training each table row is folded into one number; every
whole text is then scored by Spark tasks as the mean of those numbers.

Cases: null and empty texts have the score of a document without features; without any usable label the
score is 0.5 for all; a label row without doc_id or quality is ignored, of several rows the least quality
counts; repeated documents give repeated rows; a null doc_id stays null and is held out as the empty text.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import arrow_map, give_back, let_go, map_texts, mix, runs, slices, texts

BUCKETS = 1 << 16
DIM = 16
GRAMS = (3, 4, 5)
MAX_TRAIN = 3000
EPOCHS = 4
RATE = 8.0
BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 18
REPEATED = 0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash bucket, start byte) of all words and n-grams of a byte array whose white space is 32."""
    n = len(data)
    with np.errstate(over="ignore"):
        x = data.astype(np.uint64) + np.uint64(1)
        blank = data == 32
        out, at = [], []
        value = x.copy()
        inner = ~blank
        crossing = np.zeros(n, dtype=bool)  # a blank strictly inside the window
        for size in range(2, max(GRAMS) + 1):
            m = n - size + 1
            if m <= 0:
                break
            value = value[:m] * BASE + x[size - 1 :]
            if size > 2:
                crossing = crossing[:m] | blank[size - 2 : n - 1]
            else:
                crossing = crossing[:m]
            if size in GRAMS:
                keep = np.flatnonzero(~crossing)
                out.append((mix(value[keep] ^ np.uint64(size)) % np.uint64(BUCKETS)).astype(np.int32))
                at.append(keep)
        starts = np.flatnonzero(inner & np.concatenate([[True], blank[:-1]]))
        if len(starts):
            # A word's hash: the sum of its bytes mixed with their place in the word.
            lengths = np.flatnonzero(inner & np.concatenate([blank[1:], [True]])) - starts + 1
            place = runs(np.zeros(len(starts)), lengths).astype(np.uint64)
            chars = mix((place << np.uint64(8)) | x[runs(starts, lengths)])
            word = np.add.reduceat(chars, np.cumsum(lengths) - lengths)
            out.append((mix(word) % np.uint64(BUCKETS)).astype(np.int32))
            at.append(starts)
            # A word that repeats the one before it, one blank between, also counts as a word of its own kind.
            again = np.flatnonzero((word[1:] == word[:-1]) & (starts[1:] - starts[:-1] == lengths[:-1] + 1)) + 1
            out.append(np.full(len(again), REPEATED, dtype=np.int32))
            at.append(starts[again])
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(at)


WHITE = bytes(32 if b in b"\t\n\x0b\x0c\r " else b for b in range(256))


def features(text: str) -> np.ndarray:
    """Hash buckets of all words and n-grams of a whole text."""
    data = np.frombuffer(b" " + text.encode().translate(WHITE) + b" ", dtype=np.uint8)
    return _hashes(data)[0]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def _held_out_column():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> list:
    """At most ``max_train`` rows (label, buckets, counts) of documents outside the held-out fold."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~_held_out_column())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    # Half of the bound for each label, if there are as many.
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    # Never more than max_train rows: bounded, so it may travel to every task.
    # A repeated doc_id gives the text with the least hash, so that each chosen label is one row.
    held = texts(docs).join(F.broadcast(chosen), "doc_id")
    least = held.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"), F.col("quality"))).alias("r"))
    picked = least.select("r.quality", "r.text", "doc_id").limit(max_train)

    def run(batches):
        for quality, rows in slices(batches):
            each = [np.unique(features(t), return_counts=True) for t in rows]
            yield {"quality": quality, "buckets": [u.astype("<u4").tobytes() for u, _ in each], "counts": [c.astype("<u4").tobytes() for _, c in each]}

    found = arrow_map(picked, run, "quality int, buckets binary, counts binary", ["quality", "text"]).collect()
    rows = [(r["quality"], np.frombuffer(r["buckets"], "<u4"), np.frombuffer(r["counts"], "<u4")) for r in found]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return rows


def train(rows: list, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """One number a bucket and a bias: the log-odds of label 1 are their mean over a document, plus the bias."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    if rows:
        per_label = np.bincount([q for q, _, _ in rows], minlength=2)
        weight = len(rows) / (2 * np.maximum(per_label, 1))
        steps, done = epochs * len(rows), 0
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                label, buckets, counts = rows[i]
                step = rate * (1 - done / steps)
                done += 1
                if not len(buckets):
                    continue
                share = (counts / counts.sum()).astype(np.float32)
                mean = share @ table[buckets]
                score = mean @ layer + bias
                p = np.exp(score - score.max())
                p /= p.sum()
                p[label] -= 1
                p *= weight[label]
                back = layer @ p
                layer -= step * 0.05 * np.outer(mean, p)
                bias -= step * 0.01 * p
                table[buckets] -= step * share[:, None] * back
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(rows: list[str], folded: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each text."""
    total, count = np.zeros(len(rows)), np.zeros(len(rows))
    start = 0
    while start < len(rows):
        end, held = start, 0
        while end < len(rows) and (held == 0 or held + len(rows[end]) < PIECE):
            held += len(rows[end])
            end += 1
        parts = [b" " + t.encode().translate(WHITE) + b" " for t in rows[start:end]]
        sizes = np.array([len(p) for p in parts])
        buckets, at = _hashes(np.frombuffer(b"".join(parts), dtype=np.uint8))
        doc = np.repeat(np.arange(start, end), sizes)[at]
        total += np.bincount(doc, weights=folded[buckets], minlength=len(rows))
        count += np.bincount(doc, minlength=len(rows))
        start = end
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def fitted(docs: DataFrame, labels: DataFrame, max_train: int) -> tuple[np.ndarray, float]:
    rows = training_rows(docs, labels, max_train)
    return train(rows) if rows else (np.zeros(BUCKETS, np.float32), 0.0)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents, with all their columns, that are predicted to have label 1."""
    folded, bias = fitted(docs, labels, max_train)
    model = docs.sparkSession.sparkContext.broadcast((folded, bias))  # BUCKETS numbers, whatever the input

    @F.pandas_udf("double")
    def score(column):
        let_go()
        scores = column.__class__(score_texts(column.tolist(), *model.value))
        give_back()
        return scores

    return docs.where(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    folded, bias = fitted(docs, labels, max_train)
    model = docs.sparkSession.sparkContext.broadcast((folded, bias))  # BUCKETS numbers, whatever the input

    def run(ids, texts_):
        score = score_texts(texts_, *model.value)
        return {"doc_id": ids, "held_out": [held_out(i) for i in ids], "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_texts(docs, run, SCHEMA)
