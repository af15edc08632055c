"""What the operators share: input columns, slices of Arrow batches, word tables, scratch tables.

Defined cases, the same for every operator that reads documents: a null text is an empty text; columns
other than those named are neither read nor returned; a row whose ``doc_id`` is null is kept by operators
that judge rows one by one and left out by those that order or link documents; rows that repeat a
``doc_id`` are documents of their own, each with its own result row.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.session import scratch_path

SLICE_BYTES = 4 << 20
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
HEX = "0123456789abcdef"
_HELD: dict[tuple, object] = {}
_OPEN: ContextVar[list[str] | None] = ContextVar("scratch tables of the open scope", default=None)


def texts(docs: DataFrame, drop_null_ids: bool = False) -> DataFrame:
    """doc_id long, text string without nulls."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return out.where("doc_id is not null") if drop_null_ids else out


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int = SLICE_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about ``max_bytes`` of text; one text may be longer than that."""
    for batch in batches:
        ids, rows, held, start = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0, 0
        for i, text in enumerate(rows):
            held += len(text)
            if held >= max_bytes:
                yield ids[start : i + 1], rows[start : i + 1]
                held, start = 0, i + 1
        if start < len(rows):
            yield ids[start:], rows[start:]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, columns: list[str] | None = None, holds: bool = False) -> DataFrame:
    """``mapInArrow`` for a function that yields dicts of equally long columns in the order of ``schema``; ``holds`` if it uses :func:`hold`."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    kinds = {name: kind for name, kind in fields}

    def run(batches):
        if not holds:
            let_go()
        arrow = pa.schema([(name, ARROW[kind]) for name, kind in kinds.items()])
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type, from_pandas=False) for f in arrow], schema=arrow)
        give_back()

    return (df.select(*columns) if columns else df).mapInArrow(run, schema)


def map_texts(docs: DataFrame, fn: Callable[[list, list[str]], dict], schema: str, drop_null_ids: bool = False, max_bytes: int = SLICE_BYTES, holds: bool = False) -> DataFrame:
    """Apply ``fn(ids, texts)`` to slices of the documents."""

    def run(batches):
        for ids, rows in slices(batches, max_bytes):
            yield fn(ids, rows)

    return arrow_map(texts(docs, drop_null_ids), run, schema, holds=holds)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    held = _OPEN.get()
    if held is not None:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end what ``stored`` wrote inside. The function it gives stores a table that outlives it.

    Rows that are not stored by that function must not be read after the end.
    """
    held: list[str] = []
    outer = _OPEN.get()

    def keep(df: DataFrame, label: str) -> DataFrame:
        inner = _OPEN.set(outer)
        try:
            return stored(df, label)
        finally:
            _OPEN.reset(inner)

    opened = _OPEN.set(held)
    try:
        yield keep
    finally:
        _OPEN.reset(opened)
        for path in held:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def hold(make: Callable, *args):
    """``make(*args)``, which a Python worker keeps from task to task until a task of other work comes to it."""
    name = (make, *args)
    if name not in _HELD:
        let_go()
        _HELD[name] = make(*args)
    return _HELD[name]


def let_go() -> None:
    """Other work begins: what the worker holds for the work before goes, as a worker outlives its stage."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Hand memory that is no longer used to the system: a Python worker lives on from stage to stage, and keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim:
        trim(0)


def pack(array: np.ndarray) -> bytes:
    """An integer array as zstd bytes; what a shuffle moves stays near its entropy."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(s, s + n)`` for each start and length."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(np.asarray(starts, dtype=np.int64), lengths)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = np.asarray(h, dtype=np.uint64).copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def word_table(table: bytes) -> Callable[[str], list[bytes]]:
    """A splitter: bytes mapped by ``table``, then cut at spaces."""
    return lambda text: text.encode().translate(table).split()


def hashed_sample(df: DataFrame, by: str, bound: int) -> DataFrame:
    """At most ``bound`` rows: those whose hash of ``by`` falls in the share that leaves about that many.

    Where one value of ``by`` holds so many rows that none are left, the rows with the least hashes: never none of some.
    """
    n = df.count()
    share = max(1, -(-n // bound))
    part = df.where(F.pmod(F.xxhash64(by), F.lit(share)) == 0)
    if share > 1 and part.isEmpty():
        part = df
    return part.orderBy(F.xxhash64(by), by).limit(bound)
