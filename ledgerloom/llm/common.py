"""Shared helpers: tables, the shared folder, worker caches, word hashing and id bitmaps."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import materialize, scratch  # noqa: F401

#: A word is a maximal run of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_ROWS = 1000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 18


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores, for a Python stage: small inputs come as one file, and would run in one task.

    Batches for Python are kept to BATCH_ROWS, so that a worker's memory follows neither the table nor its longest texts much.
    """
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(conf, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(conf, str(BATCH_ROWS))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df if df.rdd.getNumPartitions() >= min(n, 8) else df.repartition(n)


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across tasks, until one of another name is asked for."""
    module = sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache"))
    kept = module.__dict__.setdefault("kept", {})
    if name not in kept:
        if kept:
            kept.clear()
            _give_back()
        kept[name] = {}
    return kept[name]


def _give_back() -> None:
    """Freed memory goes back to the system: else a worker keeps what the last operator's cache took beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def labelled(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """``text``, ``y`` of at most ``limit`` labelled rows that aren't held out, chosen by a hash of the id.

    The bound makes what is learned from, and the broadcast of the chosen ids, of fixed size.
    Of several labels of a document the largest counts; null labels and ids don't.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(column).cast("int").alias("y"))
    known = materialize(known.orderBy(F.xxhash64("_id"), "_id").limit(limit), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(texts.join(F.broadcast(known), "_id").select("text", "y").repartition(16), "labelled")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


# --- word hashes, vectorised over the bytes of many texts -----------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below n."""
    cache = process_cache("powers")
    if cache.get("n", 0) < n:
        n = max(n, _PIECE + (1 << 16))
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(n, _BASE, dtype=_U), np.full(n, inverse, dtype=_U)
        up[0] = down[0] = 1
        cache.update(n=n, up=np.cumprod(up, dtype=_U), down=np.cumprod(down, dtype=_U))
    return cache["up"], cache["down"]


_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
_MARK = ~_ALNUM & ~_SPACE
_MARK[128:] = _MARK[:32] = _MARK[127] = False


def _without_marks(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the marks that follow their last ASCII letter or digit as words of their own."""
    other = np.maximum.accumulate(np.where(_MARK[a], -1, np.arange(len(a))))[end - 1]
    cut = np.flatnonzero((other >= start) & (other < end - 1) & _ALNUM[a[np.maximum(other, 0)]])
    at = other[cut] + 1
    return np.sort(np.concatenate([start, at])), np.sort(np.concatenate([end, at]))


def _piece_words(buf: bytes, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a piece that ends with a space, and a 64-bit polynomial hash of each word."""
    a = np.frombuffer(buf, dtype=np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return start.astype(np.int64), end.astype(np.int64), np.zeros(0, dtype=_U)
    if marks:
        start, end = _without_marks(a, start, end)
    up, down = _powers(len(a))
    total = np.cumsum((a.astype(_U) + _U(1)) * up[: len(a)], dtype=_U)
    before = np.where(start > 0, total[np.maximum(start, 1) - 1], _U(0))
    value = (total[end - 1] - before) * down[start]
    return start.astype(np.int64), end.astype(np.int64), mix64(value + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def locate_words(texts: list[bytes | None], lower: bool = False, marks: bool = False) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts; starts, ends and hashes of all their words; and each text's first place among these.

    With ``marks`` those after a word's last letter or digit count as a word.

    Works through pieces of about 256 KB cut at spaces, so memory does not follow the longest text.
    """
    buf = b"\n".join(t or b"" for t in texts) + b"\n"
    if lower:
        buf = buf.translate(ASCII_LOWER)
    begins = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    found, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U))], 0
    while at < len(buf):
        cut = len(buf) if len(buf) - at <= _PIECE else max(buf.rfind(b, at, at + _PIECE) for b in (b" ", b"\n")) + 1
        if cut <= at:  # a word longer than a piece
            cut = min(x for x in (buf.find(b, at + _PIECE) for b in (b" ", b"\n")) if x >= 0) + 1
        start, end, h = _piece_words(buf[at:cut], marks)
        found.append((start + at, end + at, h))
        at = cut
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    return buf, starts, ends, hashes, np.searchsorted(starts, begins)


def hash_words(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and each text's first place among them."""
    _, _, _, hashes, at = locate_words(texts, lower)
    return hashes, at


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


# --- a bitmap of ids: a prefilter of fixed size ---------------------------------------------------


class IdBitmap:
    """Which rows may have one of the ids: a bitmap of fixed size, so it may go to every task whatever the number of ids.

    It has no false negatives; where it fills up, the prefilter passes more
    rows and the join after it decides.  The bits are put together by the
    executors, by words of 64, and reach the filter as a scalar subquery.
    """

    def __init__(self, ids: DataFrame, bits: int = 1 << 22):
        self.bits = bits
        spark, place = ids.sparkSession, F.pmod(F.xxhash64(ids.columns[0]), F.lit(bits))
        marked = ids.where(F.col(ids.columns[0]).isNotNull()).select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
        # One row for each word, so that the words in order are the bitmap.
        words = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")).union(marked).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        whole = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.transform("w", lambda x: x["bits"]).alias("bitmap"))
        self.bitmap = materialize(whole, "bitmap")

    def keep(self, df: DataFrame, column: str, others: bool = False) -> DataFrame:
        """Rows that may have one of the ids; with ``others``, exactly the rest (a null id included)."""
        place = F.pmod(F.xxhash64(column), F.lit(self.bits))
        word = F.get(self.bitmap.scalar(), F.shiftright(place, 6).cast("int"))
        found = F.col(column).isNotNull() & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return df.where(~found if others else found)
