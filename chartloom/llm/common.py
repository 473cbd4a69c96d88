"""What the llm operators share: stable intermediate tables, texts as numpy buffers, vectorised hashing.

Texts reach Python in Arrow batches. `chunks` cuts a batch into runs of whole texts of a MB, so a worker's
temporaries stay bounded by the chunk size or by one text, whichever is larger.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode, where driver and executor are one
    process, a folder of our own stands in for it; on a cluster it has to be set."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chartloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends: its rows are in the shared folder then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later plans start from the files, whoever is lost."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chartloom_path = path
    return out


def stored_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """stored(), bucketed by a key: later joins on it leave these rows where they are. The catalog holds the
    table only until it is read back."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    table = f"chartloom_{path.rsplit('/', 1)[1].replace('-', '_')}"
    with shuffles_dropped(spark):
        df.write.bucketBy(partitions(spark), key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved while the catalog has it
    spark.sql(f"DROP TABLE {table}")
    out._chartloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what stored() wrote; for tables that no later plan reads."""
    path = getattr(df, "_chartloom_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- workers

_kept: dict[str, Callable[[], None]] = {}


def worker_of(operator: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called where a task of an operator begins: what other operators' tasks kept in this worker goes. `forget` drops
    what this one keeps between its tasks."""
    others = [name for name in _kept if name != operator]
    for name in others:
        _kept.pop(name)()
    if others:
        gc.collect()
        trim()
    _kept[operator] = forget


def trim() -> None:
    """Gives free memory of this worker back, for the time until its next task."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow after which its worker holds no free memory."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return task


# ---------------------------------------------------------------- buffers

def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.fill_null(column, "").cast(pa.large_string())
    else:
        column = pc.fill_null(column, b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def cuts(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of rows whose texts take at most `limit` bytes, or of one longer text."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES):
    """(rows of the batch, their bytes, their offsets) for each run of rows."""
    buf, off = buffer_of(batch.column(text))
    for lo, hi in cuts(off, limit):
        yield batch.slice(lo, hi - lo), buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


# ---------------------------------------------------------------- words

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: ASCII letters and digits, and every byte of other characters.
ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_a:_b] = True


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of `inside`, which never cross a row's end."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    a, b = offsets[:-1][full], offsets[1:][full] - 1
    first[a], last[b] = inside[a], inside[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


# ---------------------------------------------------------------- hashing

LONG = 128  # longer ranges are digested one by one
_SEED, _FOLD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number; past the end they are zero."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def range_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): equal for equal bytes, wherever they stand.

    Eight bytes at a time are folded in between rounds of a bijective mixer, so ranges of the same length up to
    8 bytes never collide and no arithmetic relation between longer ones carries over; ranges over LONG bytes
    are digested.
    """
    size, view = ends - starts, eights(buf)
    out = mix(size.astype(np.uint64) * _SEED + _FOLD)
    at = np.flatnonzero(size <= LONG) if len(size) and size.max() > LONG else np.arange(len(size))
    for k in range(0, LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        out[at] = mix((out[at] ^ (view[starts[at] + k] & _LOW[np.minimum(size[at] - k, 8)])) * _FOLD + np.uint64(k))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def same_ranges(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from a and from b on are equal, compared byte by byte."""
    view, out = eights(buf), np.ones(len(a), bool)
    at = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        at = at[out[at] & (size[at] > k)]
        if not len(at):
            break
        out[at] = ((view[a[at] + k] ^ view[b[at] + k]) & _LOW[np.minimum(size[at] - k, 8)]) == 0
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = bool((buf[a[i] : a[i] + size[i]] == buf[b[i] : b[i] + size[i]]).all())
    return out


def exact_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each byte range, equal for equal bytes only: hashes group them, bytes confirm the groups."""
    _, first, ids = np.unique(range_hash(buf, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    if (size == size[first][ids]).all() and same_ranges(buf, starts, starts[first][ids], size).all():
        return ids
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(buf[a:b].tobytes(), len(known)) for a, b in zip(starts, ends)], np.int64)


_STEP = np.uint64(0xFF51AFD7ED558CCD)


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * _STEP + words[i : i + m]
    return mix(out)


def shingles(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each n-word shingle that lies within one row."""
    h = ngram_hash(words, n)
    if not len(h):
        return h, np.zeros(0, np.int64)
    ok = row[: len(h)] == row[n - 1 :]
    return h[ok], row[: len(h)][ok]


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of near-duplicate and containment search: runs of letters and digits,
    lower-cased in ASCII; every other ASCII character separates."""
    low = LOWER[buf]
    s, e, row = spans(ALNUM[low], offsets)
    return range_hash(low, s, e), row
