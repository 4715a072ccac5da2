"""Shared scratch space, bounded Arrow batches and packed hash blocks used by the operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from xxhash import xxh3_64_intdigest

#: Upper bound of one Arrow batch handed to a Python worker, whatever the length of its texts.
BATCH_BYTES = 16 << 20
#: Rows of one Arrow batch.
BATCH_ROWS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; an own temporary one where that is unset and driver and tasks are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexipulse-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/lexipulse-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these tables, once no later plan reads them."""
    for df in tables:
        if path := df.__dict__.get("_stored_at"):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of the filter of ``split_by``: at least, and at most (a table of 2**20 rows).
FILTER_BITS = (1 << 16, 1 << 26)


def split_by(rows: DataFrame, keys: DataFrame, on: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows that no row of ``keys`` can match on the columns ``on``; all others), told by a filter on the 64-bit number ``on[0]``.

    The filter has 16 bits a key up to a fixed size, so it may be broadcast. Only the second part, the matches and some
    false ones, needs a join and its shuffle; where the keys are too many for the filter, that part is larger, not wrong.
    """
    from pyspark.sql import functions as F

    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * keys.count()).bit_length()))
    cell = F.pmod(F.col(on[0]), F.lit(bits))
    place, bit = F.shiftright(cell, 6).cast("int"), (cell % 64).cast("int")
    words = keys.select(place.alias("filter_place"), bit.alias("bit")).groupBy("filter_place").agg(F.expr("bit_or(shiftleft(cast(1 as bigint), bit))").alias("filter_bits"))
    marked = rows.withColumn("filter_place", place).join(F.broadcast(words), "filter_place", "left")
    hit = F.coalesce(F.expr(f"(shiftright(filter_bits, cast(pmod({on[0]}, {bits}) % 64 as int)) & 1) = 1"), F.lit(False))
    part = lambda test: marked.where(test).select(rows.columns)
    return part(~hit), part(hit)


def reclaim(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so once their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Bounds rows and bytes of the Arrow batches that later plans of this session send to Python.

    Small shuffles are also merged to the advisory size, so that small tables are few files and tasks.
    """
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def open_shared(path: str):
    """(file system, path) of a URI in the shared folder, for Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


#: What a worker process keeps between tasks, by operator: name -> function that empties it.
CACHES: dict[str, Callable[[], None]] = {}


_HOLDER: list[str | None] = [None]


def only_cache(name: str | None) -> None:
    """Empties what other operators keep in this worker process and gives the memory back, when the operator changes."""
    if _HOLDER[0] == name:
        return
    _HOLDER[0] = name
    for other, empty in CACHES.items():
        if other != name:
            empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


# --- word hashes -------------------------------------------------------------------------------

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, filled on demand; emptied by ``trim`` when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        v = self[word] = xxh3_64_intdigest(word)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def trim(self, most: int = 600_000) -> None:
        if len(self) > most:
            self.clear()


#: Random 64-bit values of the bytes, and an odd base; both made from the finaliser.
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _M1)
_BASE = int(_M3) | 5
_BLANK = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
_POWERS: dict[int, np.ndarray] = {}
CACHES["powers"] = _POWERS.clear


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers of an odd base modulo 2**64, lowest first."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        step = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        step[0] = 1
        _POWERS[base] = np.multiply.accumulate(step)
    return _POWERS[base]


def hashed_words(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, one after the other; number of words of each text), without a loop over words.

    A word is a run of bytes other than ASCII white space. Its hash is a polynomial in the base over random values of
    its bytes, taken as a difference of prefix sums, then mixed with its length.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    joined = b" ".join([*raw, b""])
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.r_[0, edge]
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, len(data) + 1)[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)[start]
    h = mix64(h + (end - start).astype(np.uint64) * _M2)
    edge = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return h, np.diff(np.searchsorted(start, edge))


def byte_runs(texts: list[bytes], inside_of: Callable[[np.ndarray], np.ndarray], least: int = 1) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(all maximal runs of bytes where ``inside_of`` holds, A-Z lower-cased, in order; the text each comes from).

    Runs of fewer than ``least`` code points are left out. A blank must not be inside.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
    turn = np.flatnonzero(np.diff(np.concatenate([[False], inside_of(data)]).astype(np.int8)))
    start, end = turn[::2], turn[1::2]  # the last byte is a blank, so every run ends
    if least > 1:
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        enough = points[end] - points[start] >= least
        start, end = start[enough], end[enough]
    within = np.zeros(len(data) + 1, np.int8)
    within[start] += 1
    within[end] -= 1
    kept = data[np.cumsum(within[:-1]).astype(bool)]
    lower = np.where((kept >= 0x41) & (kept <= 0x5A), kept | 0x20, kept)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(lower.tobytes()))
    return words.dictionary_encode(), np.searchsorted(edge, start, side="right") - 1


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all windows of ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k * int(_M1) % (1 << 64), np.uint64)
    for i in range(k):
        h = mix64(h + words[i : i + n] * _M1 + np.uint64(i + 1))
    return h


# --- packed sorted hashes ----------------------------------------------------------------------

def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted distinct 64-bit numbers as gaps of the fewest whole bytes: count, first, width, gaps."""
    n = len(h)
    if not n:
        return b""
    gaps = np.diff(h)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if n > 1 else 1
    body = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return np.array([n, h[0], width], "<u8").tobytes() + body


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    n, first, width = (int(x) for x in np.frombuffer(b, "<u8", 3))
    out = np.empty(n, np.uint64)
    out[0] = first
    if n > 1:
        full = np.zeros((n - 1, 8), np.uint8)
        full[:, :width] = np.frombuffer(b, np.uint8, (n - 1) * width, 24).reshape(-1, width)
        np.cumsum(full.view("<u8").ravel(), out=out[1:])
        out[1:] += np.uint64(first)
    return out


# --- blocks of documents and buckets of hashes ---------------------------------------------------

def text_blocks(docs: DataFrame, per_part: int = 2) -> DataFrame:
    """block, doc_id, text: documents dealt by hash to a few blocks for each shuffle partition, block i to partition i.

    The block of a row depends on the row alone, and the exchange is the same wherever it is used in a plan, so Spark
    shuffles the texts once and every stage that takes blocks reads that shuffle again. Equal rows lie in one block;
    their texts are one entry of a message, however many they are.
    """
    from pyspark.sql import functions as F

    n = per_part * shuffle_parts(docs.sparkSession)
    text = docs["text"].cast("string")
    block = F.pmod(F.xxhash64(docs["doc_id"], text), F.lit(n)).cast("int")
    return by_number(docs.select(block.alias("block"), "doc_id", text.alias("text")), "block", n)


def by_number(rows: DataFrame, column: str, n: int) -> DataFrame:
    """``rows`` dealt so that number i of ``column`` (0 to n - 1) lies in partition i: even where a hash of few numbers is not."""
    from pyspark.sql import functions as F

    return rows.repartitionById(n, F.col(column))


def buckets(spark: SparkSession) -> int:
    """Ranges that the 64-bit hashes are cut into. Blocks times ranges is the most messages of an exchange."""
    return min(shuffle_parts(spark), 1 << 16)


def bucket_edges(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges begins in sorted hashes, and the end."""
    first = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
    return np.r_[0, np.searchsorted(sorted_hashes, first), len(sorted_hashes)].astype(np.int64)


def first_of_runs(a: np.ndarray) -> np.ndarray:
    """Places where a sorted array takes a new value."""
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
