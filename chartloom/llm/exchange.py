"""Counting by hash across blocks of documents, with answers to the blocks that asked.

A block holds a few MB of whole documents and is one row of a stored table, so every later pass sees the same
blocks. A block asks about its distinct keys once each, sorted, in one message for each bucket (a range
of the hash); a bucket merges the messages of all blocks and answers each in the order asked. However
often a key occurs, a bucket gets it once from a block. Buckets are as many as keep one of them small.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import common as c

REQUEST = "bucket int, block long, keys binary, vals binary"
REPLY = "block long, bucket int, reply binary"
BUCKET_BYTES = 4 << 20


def planes(x: np.ndarray) -> bytes:
    """An array as bytes, by significance and then compressed: of sorted hashes and small numbers little is left."""
    if not x.size:
        return b""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unplanes(packed: bytes, dtype, columns: int = 1) -> np.ndarray:
    raw = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True) if packed else b""
    width = np.dtype(dtype).itemsize * columns
    out = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype)
    return out.reshape(-1, columns) if columns > 1 else out.reshape(-1)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def n_buckets(spark, total_bytes: int) -> int:
    return max(c.partitions(spark), math.ceil(total_bytes / BUCKET_BYTES))


def requests(block: int, keys: np.ndarray, vals: np.ndarray, n: int) -> pa.RecordBatch:
    """Messages about sorted distinct keys; vals has a row for each key."""
    b = bucket_of(keys, n)
    edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    ends = np.concatenate([edges[1:], [len(b)]]) if len(b) else edges
    return pa.RecordBatch.from_arrays(
        [
            pa.array(b[edges].astype(np.int32)), pa.array(np.full(len(edges), block, np.int64)),
            pa.array([planes(keys[i:j]) for i, j in zip(edges, ends)], pa.binary()), pa.array([planes(vals[i:j]) for i, j in zip(edges, ends)], pa.binary()),
        ],
        names=["bucket", "block", "keys", "vals"],
    )


def answered(asked: DataFrame, reduce: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], dtype, width: int, name: str, extra: Callable | None = None) -> DataFrame:
    """asked: REQUEST rows. reduce(group of each entry, number of groups, vals) gives an answer an entry.

    extra(uniques, group, vals) may give numbers on the whole bucket, sent under block -1.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        keys = [unplanes(k, "<u8") for k in table.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        flat = np.concatenate(keys)
        vals = np.concatenate([unplanes(v, dtype, width) for v in table.column("vals").to_pylist()])
        unique, group = np.unique(flat, return_inverse=True)
        answer = reduce(group, len(unique), vals)
        at = np.concatenate([[0], np.cumsum(sizes)])
        blocks = table.column("block").to_pylist()
        replies = [planes(answer[a:b]) for a, b in zip(at[:-1], at[1:])]
        if extra is not None:
            blocks, replies = [*blocks, -1], [*replies, planes(extra(unique, group, vals))]
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(blocks), pa.int32()), "reply": pa.array(replies, pa.binary())})

    return c.stored(asked.groupBy("bucket").applyInArrow(run, REPLY), name)


def joined(blocks: DataFrame, **replies: DataFrame) -> DataFrame:
    """blocks with, by name, the answers each got (in the order of its sorted keys)."""
    out = blocks
    for name, r in replies.items():
        own = r.where("block >= 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias(name))
        out = out.join(own.withColumn(name, F.col(f"{name}.reply")).hint("shuffle_hash"), "block", "left")
    return out


def gathered(value: pa.Scalar, dtype) -> np.ndarray:
    parts = value.as_py() or []
    return np.concatenate([unplanes(p, dtype) for p in parts]) if parts else np.zeros(0, dtype)


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}
