"""Helpers shared by the training-data operators.

Nothing outside this subpackage imports it. Conventions that every operator keeps:

* Input columns are picked by name and renamed to private names at once, so extra
  columns of the caller, whatever they are called, can't clash.
* A null text is the empty text. A null ``doc_id`` is kept as null and hashes as the
  empty string.
* Intermediate tables are Parquet below the shared folder that the cluster names in
  ``spark.checkpoint.dir``; nothing is kept on an executor's own disk.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between the JVM and a Python worker, so that a
#: batch of very long documents stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="shelfscope-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table below the shared folder (a folder for each value of ``by``) and read it
    back: a lineage cut that survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(c: Column) -> Column:
    """An id as text; null as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def fold(c: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``."""
    return F.crc32(id_text(c).cast("binary")) % k


def doc_bytes(docs: DataFrame, *more: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the text as UTF-8 bytes (null: empty); ``more`` are further columns."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"),
                       *more)


def bounded(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones in every run: those with the least hash of
    ``key``. For fitting classifiers only; ``rows`` is a parameter of the operator. Rows
    whose hash is far above the bound go before they are ordered, so the tasks
    together send the driver little more than ``rows``, however many tasks there are."""
    n = df.count()
    h = F.pmod(F.xxhash64(id_text(F.col(key))), F.lit(1 << 40))
    if n > 2 * rows:
        df = df.where(h < (1 << 40) * 2 * rows // n)
    return df.orderBy(h, F.col(key)).limit(rows)


class WordIds(dict):
    """Word -> dense id in order of appearance, with a 64-bit content hash each.

    ``room`` bounds the memory: ``trim()`` empties the map between documents when it
    is full; ids then start again, hashes stay what they were.
    """

    def __init__(self, room: int = 400_000):
        super().__init__()
        self.room = room
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        i = len(self.hashes)
        self[word] = i
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return i

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hash_array(self) -> np.ndarray:
        return np.array(self.hashes, np.uint64)

    def trim(self) -> None:
        if len(self) > self.room:
            self.clear()
            self.hashes.clear()


class WordHashes(dict):
    """Word -> 64-bit content hash, remembered for up to ``room`` words: the frequent ones
    are met again at once, and a larger map costs a worker memory without saving time."""

    def __init__(self, room: int = 50_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.room:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the runs of ``k`` consecutive word hashes, in text order: a sum
    with an odd multiplier for each place, finalised."""
    n = len(h) - k + 1
    out = np.full(max(n, 0), np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
    for j in range(k if n > 0 else 0):
        odd = (int(MIX1) * (2 * j + 1) + (int(MIX2) << (j + 1))) % (1 << 64)
        out += h[j:j + n] * np.uint64(odd)
    return mixed(out)


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker lives on after its task, beside
    those of the next stages. Where the C library has no such call, only Arrow's is made."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What drops that which a worker keeps from task to task for one operator.
KEPT: list[Callable[[], None]] = []


def forget() -> None:
    """Drop what this worker keeps for other operators."""
    for drop in KEPT:
        drop()


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]):
    """A Python operator that drops what its worker kept for others and hands its own memory back
    when it ends: a worker lives on, beside the JVM's next stages, with all that it ever held."""
    def ended(batches):
        forget()
        yield from run(batches)
        give_back()

    return ended


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values."""
    give_back()  # what the worker's last task left
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)],
                                      schema=schema)
