"""Helpers that the operators share: whole texts in Arrow batches, word hashing, durable intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's memo holds before it starts anew; it bounds memory, never results.
MEMO_LIMIT = 200_000

#: Rows of an Arrow batch.
BATCH_ROWS = 1000

#: Longest text or bytes that a memo keeps as a key.
LONG_KEY = 64

MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_bucket(column: str, buckets: int) -> Column:
    """crc32 of the value's decimal text, modulo ``buckets``; a null value counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Where none is set a local master gets a
    temporary one; on a cluster that is an error, as executors could not see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="parley-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of an action go when it ends, as is right where its result is a checkpoint; the session's setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``keyed``, which has one row for each key and in ``n`` how many of the ``total`` rows have it.

    Keys of more than a 1 / ``share`` of all rows, of which there are fewer than ``share``, are broadcast, so that no task gets
    all rows of such a key; the others are joined by key.
    """
    hot = F.col("n") * share > total
    columns = [c for c in keyed.columns if c not in (key, "n")]
    first = rows.join(F.broadcast(keyed.where(hot).drop("n").withColumn("__hot", F.lit(True))), key, "left")
    rest = first.where("__hot is null").drop("__hot", *columns).join(keyed.where(~hot).drop("n"), key, "left")
    return first.where("__hot").drop("__hot").unionByName(rest)


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text at most (one row at least); small ones are joined."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        rows = batch.num_rows
        step = max(1, int(rows * most_bytes / max(1, batch.column(column).nbytes)))
        for at in range(0, rows, step):
            part = batch.slice(at, step)
            own = part.column(column).nbytes
            if held and size + own > most_bytes:
                yield _joined(held)
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def map_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``rows.mapInArrow(run, schema)``, after which a worker gives back the memory that it no longer uses; workers live on and
    serve the next stages.

    Rows hold long texts, so where the session has Spark's default of 10,000 rows to an Arrow batch, it gets BATCH_ROWS; ``slices`` makes of
    them what an operator wants at a time.
    """
    conf = rows.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return rows.mapInArrow(freeing, schema)


def release() -> None:
    """Hand free memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Memo(dict):
    """Results of ``make`` by key; emptied between batches when it has grown beyond the limit. Long keys, which hardly ever come
    again, are not kept, so the limit bounds its bytes too."""

    def __init__(self, make: Callable, limit: int = MEMO_LIMIT):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if not isinstance(key, (bytes, str)) or len(key) <= LONG_KEY:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; both steps touch ASCII only."""
    return raw.lower().split()


def word_memo() -> Memo:
    """64-bit hashes of words. Distinct words share one with a chance of about n*n / 2**65."""
    return Memo(xxhash.xxh3_64_intdigest)


def word_hashes(raw: bytes, memo: Memo) -> np.ndarray:
    words = words_of(raw)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where each text's words begin and the last one's end.

    Words of up to LONG_KEY bytes are hashed for all texts at once, eight bytes a round; no object is made for a word.
    """
    joined = b" ".join(texts).lower() + b" "
    data = np.frombuffer(joined, np.uint8)
    inside = ((data - np.uint8(9)) > 4) & (data != 32)
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    eights = np.ndarray((len(joined),), "<u8", joined + bytes(8), strides=(1,))
    out = mixed(sizes.astype(np.uint64), 8)
    left = np.flatnonzero(sizes <= LONG_KEY)
    for first in range(0, LONG_KEY, 8):
        left = left[sizes[left] > first]
        if not len(left):
            break
        spare = np.maximum(8 - (sizes[left] - first), 0).astype(np.uint64) << np.uint64(3)
        eight = eights[starts[left] + first] & (np.uint64(MASK) >> spare)
        out[left] = mixed(out[left] ^ eight, 9)
    for k in np.flatnonzero(sizes > LONG_KEY).tolist():
        out[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]])
    return out, np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in texts)]))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and order statistics of hashes behave as random."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; a shorter text is one shingle, an empty one has none."""
    if len(words) == 0:
        return words
    size = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            total = mixed(total + words[k : k + len(total)], salt=size)
    return total


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine; PARLEY_TOKENIZERS names another folder."""
    folder = os.environ.get("PARLEY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
