"""Benchmark decontamination by size-partitioned MinHash containment search.

Shingles are five consecutive words (runs of letters and digits, ASCII lower-cased). A document is first
reduced to the shingles that occur in some test item; containment of an item in it does not change, and a
long document becomes a set as small as what it may have leaked. Reduced sets and items are partitioned
by size in powers of two. Within a pair of size classes containment t corresponds to a Jaccard similarity
of at least t*q / (u + (1-t)*q), q being the smallest item and u the largest set of the classes, and as
many MinHash values are compared as make missing a pair of that similarity less likely than `miss`. Pairs
that agree in a value are verified by exact counts of shared shingles.

Where a class pair would need over MOST_VALUES values (a few leaked words in a huge set), the items that
share any shingle with the document are verified instead: nothing is dropped.

The items travel to the tasks in blocks of at most BLOCK_SHINGLES shingles (some tens of MB), one pass of
the documents a block, so a large benchmark needs more passes, not more memory.

Edge cases: null and empty texts and documents without five words match nothing; an item of fewer than
five words has no shingles and is never found; rows that repeat are found again each; items with equal
texts are found each; extra columns of either table are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import common as c

N = 5
THRESHOLD = 0.8
BLOCK_SHINGLES = 1 << 21
MOST_VALUES = 2048
SCHEMA = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def _values(hashes: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """The MinHash value number `seed` of each set; set i is hashes[starts[i]:starts[i+1]], none empty."""
    salt = np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return np.minimum.reduceat(c.mix(hashes ^ salt), starts[:-1])


def _size_class(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)


class Items:
    """A block of test items, by size class."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, threshold: float, miss: float):
        self.ids, self.threshold, self.miss = ids, threshold, miss
        self.sizes = np.diff(starts)
        self.universe, self.local = np.unique(hashes, return_inverse=True)
        self.hashes, self.starts = hashes, starts
        owner = np.repeat(np.arange(len(ids)), self.sizes)
        order = np.argsort(self.local, kind="stable")
        self.posting = owner[order]
        self.posting_at = np.searchsorted(self.local[order], np.arange(len(self.universe) + 1))
        self.classes = {int(k): np.flatnonzero(_size_class(self.sizes) == k) for k in np.unique(_size_class(self.sizes))}
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def table(self, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted values, items) of value `seed` over the items of size class k."""
        got = self.tables.get((k, seed))
        if got is None:
            rows = self.classes[k]
            parts = [self.hashes[self.starts[r] : self.starts[r + 1]] for r in rows]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            v = _values(np.concatenate(parts), at, seed)
            order = np.argsort(v)
            got = self.tables[k, seed] = v[order], rows[order]
        return got

    def needed(self, k: int, largest: int) -> int:
        q = int(self.sizes[self.classes[k]].min())
        j = self.threshold * q / (largest + (1 - self.threshold) * q)
        return 1 if j >= 1 else math.ceil(math.log(self.miss) / math.log1p(-j))

    def candidates(self, sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Pairs (set, item) as set * n_items + item: those that agree in a MinHash value."""
        n, out, sizes = len(self.ids), [], np.diff(starts)
        kinds = _size_class(sizes)
        for kind in np.unique(kinds):
            rows = np.flatnonzero(kinds == kind)
            parts = [sets[starts[r] : starts[r + 1]] for r in rows]
            at = np.concatenate([[0], np.cumsum(sizes[rows])])
            flat, largest = np.concatenate(parts), int(sizes[rows].max())
            wanted = {k: self.needed(k, largest) for k in self.classes if math.ceil(self.threshold * int(self.sizes[self.classes[k]].min())) <= largest}
            if wanted and max(wanted.values()) > MOST_VALUES:
                local = np.searchsorted(self.universe, flat)
                many = self.posting_at[local + 1] - self.posting_at[local]
                begin = np.repeat(self.posting_at[local] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                who = np.repeat(np.repeat(rows, sizes[rows]), many)
                out.append(np.unique(who * n + self.posting[begin]))
                continue
            for seed in range(max(wanted.values(), default=0)):
                v = None
                for k, most in wanted.items():
                    if seed < most:
                        v = _values(flat, at, seed) if v is None else v
                        keys, items = self.table(k, seed)
                        lo, hi = np.searchsorted(keys, v, "left"), np.searchsorted(keys, v, "right")
                        hit = np.flatnonzero(hi > lo)
                        if len(hit):
                            many = (hi - lo)[hit]
                            at_item = np.repeat(lo[hit] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                            out.append(np.unique(np.repeat(rows[hit], many) * n + items[at_item]))
            if len(out) > 64:
                out = [np.unique(np.concatenate(out))]
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def verify(self, pairs: np.ndarray, sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Shared shingles of each candidate pair, counted exactly."""
        n, shared = len(self.ids), np.zeros(len(pairs), np.int64)
        who, item = pairs // n, pairs % n
        for i, (w, x) in enumerate(zip(who.tolist(), item.tolist())):
            shared[i] = np.isin(self.hashes[self.starts[x] : self.starts[x + 1]], sets[starts[w] : starts[w + 1]], assume_unique=True).sum()
        return shared


def _reduced(buf: np.ndarray, off: np.ndarray, universe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a hit, starts, shingles): each row's distinct shingles that are in `universe`, row by row."""
    h, row = c.shingles(*c.word_hashes(buf, off), N)
    at = np.minimum(np.searchsorted(universe, h), len(universe) - 1)
    hit = universe[at] == h
    h, row = h[hit], row[hit]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        h, row = h[new], row[new]
    rows, starts = np.unique(row, return_index=True)
    return rows, np.concatenate([starts, [len(h)]]), h


def item_shingles(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in c.chunks(batch):
                h, row = c.shingles(*c.word_hashes(buf, off), N)
                ids, out = part.column("item_id").to_pylist(), [np.unique(h[row == r]).astype("<u8") for r in range(part.num_rows)]
                keep = [i for i, s in enumerate(out) if len(s) and ids[i] is not None]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([out[i].tobytes() for i in keep], pa.binary()), pa.array([len(out[i]) for i in keep], pa.int64())], names=["item_id", "sets", "n"])

    return items.select("item_id", "text").mapInArrow(c.lean(run), "item_id long, sets binary, n long")


def _blocks(items: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The items' shingles in blocks of bounded size: (ids, shingles, starts) of each."""
    sized = c.stored(item_shingles(items), "items")
    total = sized.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, math.ceil(total / (BLOCK_SHINGLES // 2)))
    for b in range(n_blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).select("item_id", "sets").toArrow()  # some BLOCK_SHINGLES numbers
        sets = [np.frombuffer(s, "<u8") for s in rows.column("sets").to_pylist()]
        if sets:
            yield rows.column("item_id").to_numpy(), np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def _verified(index: Items, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, shared shingles) of each leak in a run of texts."""
    rows, starts, h = _reduced(buf, off, index.universe)
    if not len(rows):
        return rows, rows, rows
    pairs = index.candidates(h, starts)
    shared = index.verify(pairs, h, starts)
    who, item = pairs // len(index.ids), pairs % len(index.ids)
    ok = shared >= index.threshold * index.sizes[item] - 1e-9
    return rows[who[ok]], item[ok], shared[ok]


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, miss: float = 1e-6) -> DataFrame:
    """A row (doc_id, item_id, n_shared, n_item, containment) for each document that holds at least
    `threshold` of an item's shingles."""
    spark = docs.sparkSession

    def search(block: tuple) -> DataFrame:
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c.worker_of("contamination")
            index = Items(*shipped.value, threshold, miss)
            for batch in batches:
                for part, buf, off in c.chunks(batch):
                    row, item, shared = _verified(index, buf, off)
                    n = index.sizes[item]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()).take(pa.array(row, pa.int64())), pa.array(index.ids[item], pa.int64()), pa.array(shared, pa.int64()), pa.array(n, pa.int64()), pa.array(shared / n, pa.float64())], names=["doc_id", "item_id", "n_shared", "n_item", "containment"])

        return docs.select("doc_id", "text").mapInArrow(c.lean(run), SCHEMA)

    return reduce(DataFrame.unionByName, map(search, _blocks(items)), spark.createDataFrame([], SCHEMA))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, miss: float = 1e-6) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""

    def clean(docs: DataFrame, block: tuple) -> DataFrame:
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c.worker_of("contamination")
            index = Items(*shipped.value, threshold, miss)
            for batch in batches:
                for part, buf, off in c.chunks(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[_verified(index, buf, off)[0]] = False
                    yield part.filter(pa.array(keep))

        return docs.mapInArrow(c.lean(run), docs.schema)

    return reduce(clean, _blocks(items), docs)
