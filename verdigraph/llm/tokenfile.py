"""Token ids of a corpus as one concatenated array with Elias-Fano document boundaries.

The array is cut into shards in ascending doc_id order. A shard is one binary value: a header, the ids
(two bytes each where the vocabulary allows, else four), and two Elias-Fano sequences, the end offset of
every document and its doc_id. An Elias-Fano sequence of n rising values below u keeps the low bits of
each value packed, and the high bits in unary: about 2 + log2(u / n) bits a value, where an offset table
takes 64. Every 64th one-bit's place is kept, so that ``select`` finds a single offset by a short scan.

Spark writes the shards as Parquet rows (bucket, seq, blob) and reads them back, on any store it can use.
Documents come to their bucket by splitting doc_id at quantiles of all ids; a task packs the sorted
documents of a bucket into shards of bounded size, so a bucket may be of any size.

Cases: null and empty texts hold the end id alone; rows without doc_id are left out; rows that repeat a
doc_id each have their place, in the order of their ids; an empty table gives no shards.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigraph.llm.common import arrow_map, hold, map_texts, runs
from verdigraph.session import scratch_path

MAGIC = b"VGTF"
SHARD_IDS = 1 << 20
SELECT_STEP = 64
DOCS_PER_BUCKET = 4000
MAX_BUCKETS = 20_000
# Entries a worker keeps; what comes later, when the frequent words are in, is encoded once a slice.
KEPT_PIECES, KEPT_WORDS = 50_000, 150_000
ENCODE_BYTES = 1 << 20
CONTROL_SPACE = re.compile("[\x1c-\x1f]")
# The tokenizer's own split of a text without white space, for Latin-1 characters, where its
# normalisation is lower-casing alone. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Marks that stand together as one word behind letters; none opens an ending such as 's.
TAIL = ".,;:!?%&$#*)\""
LETTERS = "".join(filter(str.isalpha, map(chr, range(256))))


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, base: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.base, self.low, self.high, self.samples = n, low_bits, base, low, high, samples

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        base = int(values[0]) if n else 0
        v = (values - base).astype(np.uint64)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[places] = 1
        return EliasFano(n, low_bits, base, low, np.packbits(bits, bitorder="little"), places[::SELECT_STEP].astype(np.uint32))

    def _low(self, i: int) -> int:
        bits = range(i * self.low_bits, (i + 1) * self.low_bits)
        return sum(((int(self.low[b >> 3]) >> (b & 7)) & 1) << k for k, b in enumerate(bits))

    def select(self, i: int) -> int:
        """The i-th value: from the nearest kept place on, byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SELECT_STEP]), i % SELECT_STEP
        byte = place >> 3
        current = int(self.high[byte]) & (0xFF << (place & 7))
        while left >= current.bit_count():
            left -= current.bit_count()
            byte += 1
            current = int(self.high[byte])
        for _ in range(left):
            current &= current - 1
        place = byte * 8 + (current & -current).bit_length() - 1
        return self.base + ((place - i) << self.low_bits | self._low(i))

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return self.base + high
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return self.base + (high | (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1))

    def dump(self) -> bytes:
        head = struct.pack("<IBqII", self.n, self.low_bits, self.base, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @staticmethod
    def load(data: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, base, n_low, n_high = struct.unpack_from("<IBqII", data, at)
        at += struct.calcsize("<IBqII")
        n_samples = -(-n // SELECT_STEP)
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        return EliasFano(n, low_bits, base, low, high, samples), at + n_low + n_high + 4 * n_samples


class Shard:
    """Read access to one shard."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token shard")
        width, count = struct.unpack_from("<BI", blob, 4)
        at = 4 + struct.calcsize("<BI")
        self.ids = np.frombuffer(blob, "<u2" if width == 2 else "<u4", count, at)
        self.ends, at = EliasFano.load(blob, at + width * count)
        self.doc_ids, _ = EliasFano.load(blob, at)

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the shard."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    @staticmethod
    def dump(doc_ids: list[int], parts: list[bytes], width: int) -> bytes:
        sizes = np.array([len(p) // width for p in parts], dtype=np.int64)
        head = MAGIC + struct.pack("<BI", width, int(sizes.sum()))
        return head + b"".join(parts) + EliasFano.of(np.cumsum(sizes)).dump() + EliasFano.of(np.array(doc_ids)).dump()


def listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of texts, each distinct word of a slice encoded once by the library.

    Most pieces between white space are letters with marks behind them. Those are lower-cased and cut by columns; any other is split on its own.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.split = regex.compile(SPLIT)
        self.tokenize = self.tokenizer.model.tokenize
        from tokenizers.pre_tokenizers import ByteLevel

        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        # The character that stands for each byte, asked from the library.
        self.shown = {b: shown.pre_tokenize_str(bytes([b]).decode("ascii"))[0][0] for b in range(128)}
        for c in map(chr, range(128, 256)):
            for b, s in zip(c.encode(), shown.pre_tokenize_str(c)[0][0]):
                self.shown[b] = s
        # Tokens beside the model's own, which the library cuts out of a text before anything else.
        self.added = tuple({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {"": b""}

    def _raw(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; the library sees those not held yet, each byte as its character."""
        out = list(map(self.words.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        fresh = [words[k] for k in missing]
        tokenize, ids, ends = self.tokenize, [], []
        # No word holds a line's end, so it parts them.
        for seen in "\n".join(fresh).encode().decode("latin-1").translate(self.shown).split(self.shown[10]) if fresh else ():
            ids += [t.id for t in tokenize(seen)]
            ends.append(self.width * len(ids))
        data = self._raw(ids)
        for k, a, b in zip(missing, [0, *ends], ends):
            out[k] = data[a:b]
        for word, k in zip(fresh[: max(0, KEPT_WORDS - len(self.words))], missing):
            self.words[word] = out[k]
        return out

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            if not piece.isascii() and max(piece) > "ÿ":
                got = self._raw(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            else:
                got = b"".join(self._words(self.split.findall(piece.lower())))
            if len(self.pieces) < KEPT_PIECES:
                self.pieces[piece] = got
        return got

    def _parts(self, pieces: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Distinct runs of ids, and for each piece the two that make it up: of its letters and its tail, or of all of it and none."""
        rest = pc.utf8_ltrim(pieces, characters=LETTERS)
        plain = pc.and_(pc.equal(pc.utf8_rtrim(rest, characters=TAIL), ""), pc.not_equal(rest, pieces))
        words = pc.utf8_lower(pc.utf8_rtrim(pieces.filter(plain), characters=TAIL)).dictionary_encode()
        tails = rest.filter(plain).dictionary_encode()
        odd = listed(pieces.filter(pc.invert(plain)))
        parts = [b"", *self._words(listed(words.dictionary)), *self._words(listed(tails.dictionary)), *map(self._piece, odd)]
        both = np.zeros((len(pieces), 2), dtype=np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        both[plain, 0] = 1 + words.indices.to_numpy()
        both[plain, 1] = 1 + len(words.dictionary) + tails.indices.to_numpy()
        both[~plain, 0] = len(parts) - len(odd) + np.arange(len(odd))
        return parts, both

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids of each text: its pieces are named by number, their distinct words are looked up once, and numbers are turned into ids."""
        out = [b""] * len(rows)
        cut = []
        for i, t in enumerate(rows):
            if CONTROL_SPACE.search(t) or any(a in t for a in self.added):
                out[i] = self._raw(self.tokenizer.encode(t, add_special_tokens=False).ids)
            else:
                cut.append(i)
        split = pc.utf8_split_whitespace(pa.array([rows[i] for i in cut], pa.large_string()))
        named = split.flatten().dictionary_encode()
        parts, both = self._parts(named.dictionary)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // self.width
        at = both[named.indices.to_numpy()]
        each = sizes[at]
        data = np.frombuffer(b"".join(parts), dtype=self.kind)[runs((np.cumsum(sizes) - sizes)[at].ravel(), each.ravel())].tobytes()
        ends = (self.width * np.append(0, np.cumsum(each.sum(axis=1)))[split.offsets.to_numpy()]).tolist()
        for i, a, b in zip(cut, ends, ends[1:]):
            out[i] = data[a:b]
        return out


def encoder(path: str) -> WordEncoder:
    return hold(WordEncoder, path)


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian, two or four bytes each), the end id last."""

    def run(ids, rows):
        coder = encoder(path)
        end = coder._raw([end_id])
        return {"doc_id": ids, "ids": [x + end for x in coder.encode(rows)]}

    return map_texts(docs, run, "doc_id long, ids binary", drop_null_ids=True, holds=True)


def quantile_cuts(docs: DataFrame, rows_per_bucket: int = DOCS_PER_BUCKET) -> list[int]:
    """Inner bounds of buckets of about equally many rows; reads doc_id alone."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    n = ids.count()
    buckets = min(MAX_BUCKETS, -(-n // rows_per_bucket))
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 10 * buckets).alias("q")).first()["q"]
    return sorted(set(found))


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, width: int = 2) -> None:
    """Encode the documents and write their shards to ``path``."""
    cuts = quantile_cuts(docs)
    found = np.array(cuts, dtype=np.int64)

    def encoded(ids, rows):
        coder = encoder(tokenizer_path)
        if coder.width != width:
            raise ValueError(f"this vocabulary needs {coder.width} bytes an id")
        end = coder._raw([end_id])
        return {"doc_id": ids, "ids": [x + end for x in coder.encode(rows)], "bucket": np.searchsorted(found, np.array(ids, dtype=np.int64), side="right").astype(np.int32)}

    placed = (
        map_texts(docs, encoded, "doc_id long, ids binary, bucket int", drop_null_ids=True, max_bytes=ENCODE_BYTES, holds=True)
        .repartition(len(cuts) + 1, "bucket")
        .sortWithinPartitions("bucket", "doc_id", "ids")
    )

    def packed(batches):
        size, ids, parts, bucket, seq = 0, [], [], None, 0

        def shard():
            return {"bucket": [bucket], "seq": [seq], "blob": [Shard.dump(ids, parts, width)]}

        for batch in batches:
            for b, d, data in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if ids and (b != bucket or size + len(data) > SHARD_IDS * width):
                    yield shard()
                    seq = seq + 1 if b == bucket else 0
                    size, ids, parts = 0, [], []
                bucket = b
                ids.append(d)
                parts.append(data)
                size += len(data)
        if ids:
            yield shard()

    arrow_map(placed, packed, "bucket int, seq int, blob binary", ["bucket", "doc_id", "ids"]).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket int, seq int, blob binary").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards alone."""
    shards = read_shards(spark, path)

    def sizes(batches):
        for b in batches:
            blobs = [Shard(x) for x in b.column(2).to_pylist()]
            yield {"bucket": b.column(0), "seq": b.column(1), "n": [len(s.ids) for s in blobs]}

    counted = arrow_map(shards, sizes, "bucket int, seq int, n long")
    # One row a bucket here, of which there are at most MAX_BUCKETS.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("bucket", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("within")).join(offsets, "bucket")
    placed = shards.join(starts.select("bucket", "seq", (F.col("first") + F.col("within")).alias("first")), ["bucket", "seq"])

    def opened(batches):
        for b in batches:
            for first, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard(blob)
                numbers = range(s.ends.n)
                ends = np.array([s.ends.select(i) for i in numbers], dtype=np.int64)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                yield {
                    "doc_id": [s.doc_ids.select(i) for i in numbers],
                    "start": begins + first,
                    "n_tokens": ends - begins,
                    "ids_crc32": [zlib.crc32(s.ids[x:y].astype("<u4")) for x, y in zip(begins.tolist(), ends.tolist())],
                }

    return arrow_map(placed, opened, "doc_id long, start long, n_tokens long, ids_crc32 long", ["first", "blob"])


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the shards below the shared folder and read every document back from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_shards(docs, tokenizer_path, end_id, path)
    return read_documents(spark, path)
