"""Toxicity from the nearest labelled examples.

Examples: at most `max_examples` labelled documents, those of the lowest hashed id, and of these as many as have
at most `max_postings` terms in sum, so the choice does not depend on order or partitioning. Terms are words of
letters, lower-cased, all that occur in an example. A document is its unit TF-IDF vector over them: (1 + log count) *
idf, idf from all documents, each term weighted by the square root of its chi-squared statistic between the labels of
the examples, without which most of a cosine is words that say nothing about the label. A document's neighbours
are the `k` examples of highest cosine, found exactly with a block-max index: examples lie in blocks of similar
ones, an inverted list holds a term's weight in each block's examples behind its largest weight there, the largest weights bound
the cosine of all a block's examples, and blocks are left out only when that bound is under the k-th best so far.
Lists of terms in over 1/DENSE of the examples are stored in full. Votes weigh by squared cosine, with the
rate of the examples as prior, and a logistic fitted on leave-one-out votes of the examples calibrates them.

Edge cases: null and empty texts, and texts without a known term, get the calibrated prior; null labels
and null ids are not examples; a document labelled twice counts with its larger label; of rows with one id the text of lowest hash is
the example; without examples of both labels every score is their common rate (0.5 without any); equal texts get equal scores; very
long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import common as c

BLOCK = 512
DENSE = 16
PRIOR = 0.05
RANGES = 64
SCHEMA = "doc_id long, score double, evidence array<struct<doc_id:long,label:int,cosine:double>>"
LETTER = c.ALNUM.copy()
LETTER[48:58] = False


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = c.LOWER[buf]
    s, e, row = c.spans(LETTER[low], off)
    return c.range_hash(low, s, e), row


def _terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of each row, by row."""
    h, row = _words(buf, off)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if not len(h):
        return row, h, np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
    return row[edge], h[edge], np.diff(np.concatenate([edge, [len(h)]]))


def _known(buf: np.ndarray, off: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the sorted `terms`, count) of the distinct known terms of each row, by row."""
    h, row = _words(buf, off)
    if not len(terms) or not len(h):
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = terms[at] == h
    key, n = np.unique(row[hit] * len(terms) + at[hit], return_counts=True)
    return key // len(terms), key % len(terms), n


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n of them, for each start."""
    start, n = start.astype(np.int64), n.astype(np.int64)
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Index:
    """Block-max inverted index of the examples' vectors, given by rows (example, term, weight)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, row: np.ndarray, term: np.ndarray, w: np.ndarray, terms: np.ndarray, weight: np.ndarray, prior: float, k: int):
        n = len(ids)
        self.terms, self.weight, self.prior, self.k = terms, weight, prior, k
        self.n_blocks, self.a, self.b = math.ceil(n / BLOCK), 1.0, 0.0
        # similar examples are neighbours: by their heaviest terms
        by = np.lexsort((-w, row))
        place = np.arange(len(by)) - np.searchsorted(row[by], np.arange(n))[row[by]]
        lead = np.full((n, 3), len(terms))
        for i in range(3):
            lead[row[by[place == i]], i] = term[by[place == i]]
        order = np.lexsort((ids, *[lead[:, i] for i in (2, 1, 0)]))
        self.ids, self.labels = ids[order], labels[order].astype(float)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        row = rank[row]
        often = np.bincount(term, minlength=len(terms)) * DENSE > n
        self.column = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        full = often[term]
        self.dense = np.zeros((n, int(often.sum())), np.float32)
        self.dense[row[full], self.column[term[full]]] = w[full]
        self.dense_top = np.stack([self.dense[b * BLOCK : (b + 1) * BLOCK].max(axis=0) for b in range(self.n_blocks)]) if n else np.zeros((0, self.dense.shape[1]), np.float32)
        row, term, w = row[~full], term[~full], w[~full].astype(np.float32)
        order = np.lexsort((row, term))
        self.example, self.w = row[order].astype(np.int32), w[order]
        key = term[order] * max(self.n_blocks, 1) + self.example // BLOCK
        self.first = (np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)).astype(np.int32)
        self.size = np.diff(np.concatenate([self.first, [len(key)]])).astype(np.int32)
        self.block = (key[self.first] % max(self.n_blocks, 1)).astype(np.int32)
        self.top = np.maximum.reduceat(self.w, self.first) if len(key) else np.zeros(0, np.float32)
        self.lists = np.searchsorted(key[self.first] // max(self.n_blocks, 1), np.arange(len(terms) + 1)).astype(np.int32)

    def vectors(self, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of the rows' unit vectors."""
        w = (1 + np.log(count)) * self.weight[term]
        keep = w > 0
        row, term, w = row[keep], term[keep], w[keep]
        norm = np.sqrt(np.bincount(row, weights=w * w)) if len(row) else np.zeros(0)
        return row, term, (w / norm[row] if len(row) else w).astype(np.float32)

    def nearest(self, n: int, row: np.ndarray, term: np.ndarray, w: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k nearest of each of n vectors, exact; ties by the examples' order.
        skip: an example that is left out, for each vector."""
        k, nb = self.k, self.n_blocks
        # one integer a candidate: the cosine in units of 1e-7, then the lower position
        best = np.full((n, k), -1, np.int64)
        full = self.column[term] >= 0
        x = np.zeros((n, self.dense.shape[1]), np.float32)
        x[row[full], self.column[term[full]]] = w[full]
        row, term, w = row[~full], term[~full], w[~full]
        n_lists = self.lists[term + 1] - self.lists[term]
        at, row, w = _spread(self.lists[term], n_lists), np.repeat(row, n_lists), np.repeat(w, n_lists)
        bound = x @ self.dense_top.T + 1e-5
        bound += np.bincount(row * nb + self.block[at], weights=w * self.top[at], minlength=n * nb).reshape(n, nb)
        order = np.argsort(self.block[at], kind="stable")
        at, row, w = at[order], row[order], w[order]
        edge = np.searchsorted(self.block[at], np.arange(nb + 1))
        for b in np.argsort(-bound.sum(axis=0), kind="stable").tolist():
            kth = best.min(axis=1)
            need = np.flatnonzero((bound[:, b] >= np.where(kth >= 0, (kth >> 24) / 1e7, 0.0)) & (bound[:, b] > 2e-5))
            if not len(need):
                continue
            lo, hi = b * BLOCK, min((b + 1) * BLOCK, len(self.ids))
            local = np.full(n, -1)
            local[need] = np.arange(len(need))
            i, j = edge[b], edge[b + 1]
            mine = np.flatnonzero(local[row[i:j]] >= 0) + i
            sizes = self.size[at[mine]]
            posting = _spread(self.first[at[mine]], sizes)
            cos = np.bincount(np.repeat(local[row[mine]], sizes) * (hi - lo) + self.example[posting] - lo, weights=np.repeat(w[mine], sizes) * self.w[posting], minlength=len(need) * (hi - lo)).reshape(len(need), hi - lo)
            cos = cos + x[need] @ self.dense[lo:hi].T  # bincount of nothing is of integers
            key = (np.rint(np.clip(cos, 0, 1) * 1e7).astype(np.int64) << 24) | ((1 << 24) - 1 - np.arange(lo, hi))
            key[cos < 1e-6] = -1
            if skip is not None:
                here = (skip[need] >= lo) & (skip[need] < hi)
                key[np.flatnonzero(here), skip[need][here] - lo] = -1
            some = np.flatnonzero(key.max(axis=1) > kth[need])
            best[need[some]] = np.partition(np.concatenate([best[need[some]], key[some]], axis=1), hi - lo, axis=1)[:, hi - lo :]
        best = -np.sort(-best, axis=1)
        return np.where(best >= 0, (1 << 24) - 1 - (best & ((1 << 24) - 1)), -1), np.where(best >= 0, (best >> 24) / 1e7, 0.0)

    def votes(self, at: np.ndarray, cos: np.ndarray) -> np.ndarray:
        w = cos**2
        label = np.where(at >= 0, self.labels[np.maximum(at, 0)], 0.0) if len(self.labels) else np.zeros_like(w)
        return (np.sum(w * label, axis=1) + PRIOR * self.prior) / (np.sum(w, axis=1) + PRIOR)

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """The logistic a * logit(vote) + b of least log loss, ridge on a - 1, by Newton steps."""
        z = np.log(np.clip(votes, 1e-4, 1 - 1e-4) / (1 - np.clip(votes, 1e-4, 1 - 1e-4)))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([np.sum((p - labels) * z) + (a - 1), np.sum(p - labels) + b * 1e-3])
            h = np.array([[np.sum(w * z * z) + 1, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.a, self.b = max(a, 0.05), b

    def scores(self, votes: np.ndarray) -> np.ndarray:
        v = np.clip(votes, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-np.clip(self.a * np.log(v / (1 - v)) + self.b, -30, 30)))

    def judged(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, nearest examples, cosines) of each text."""
        n = len(off) - 1
        if not len(self.ids):
            return np.full(n, float(self.scores(np.array([self.prior]))[0])), np.full((n, self.k), -1), np.zeros((n, self.k))
        at, cos = self.nearest(n, *self.vectors(*_known(buf, off, self.terms)))
        return self.scores(self.votes(at, cos)), at, cos


def examples(docs: DataFrame, labels: DataFrame, max_examples: int) -> DataFrame:
    """(doc_id, text, label) of the sample of labelled documents, a row for each id."""
    of = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label"))
    chosen = of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_examples rows of 12 bytes
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def document_counts(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """(documents, documents that have each term), summed by ranges of terms."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)  # at most max_postings numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c.worker_of("toxicity")
        df, rows = np.zeros(len(shipped.value), np.int64), 0
        for batch in batches:
            for part, buf, off in c.chunks(batch):
                df += np.bincount(_known(buf, off, shipped.value)[1], minlength=len(df))
                rows += part.num_rows
        parts = [np.array([rows]), *np.array_split(df, RANGES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, RANGES), pa.int32()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], names=["part", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), "<i8") for v in table.column("n"))
        return pa.table({"part": table.column("part").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

    got = {r.part: np.frombuffer(r.n, "<i8") for r in docs.select("text").mapInArrow(c.lean(run), "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect()}  # as many numbers as terms
    if not got:
        return 0, np.zeros(len(terms), np.int64)
    return int(got[-1][0]), np.concatenate([got[i] for i in range(RANGES)])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 6000, max_postings: int = 4_000_000, k: int = 25) -> Index:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c.worker_of("toxicity")
        for batch in batches:
            for part, buf, off in c.chunks(batch):
                row, term, count = _terms(buf, off)
                edge = np.searchsorted(row, np.arange(part.num_rows + 1))
                cut = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int64()), pa.array(np.diff(edge)), cut(term.astype("<u8")), cut(count.astype("<i8"))], names=["doc_id", "label", "n", "terms", "counts"])

    sample = c.stored(examples(docs, labels, max_examples).mapInArrow(c.lean(listed), "doc_id long, label long, n long, terms binary, counts binary"), "examples")
    sizes = sample.select(F.xxhash64("doc_id").alias("h"), "doc_id", "n").orderBy("h", "doc_id").collect()  # at most max_examples rows
    room = int((np.cumsum([r.n for r in sizes]) <= max_postings).sum())
    got = sample.join(F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id,) for r in sizes[:room]], "doc_id long")), "doc_id").toArrow()  # at most max_postings terms
    c.release(sample)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    got = got.take(pa.array(order))
    ids, label = got.column("doc_id").to_numpy(), got.column("label").to_numpy().astype(float)
    n, n1 = len(ids), int(label.sum())
    n0, rate, none = n - n1, n1 / n if n else 0.5, np.zeros(0, np.int64)
    if not n1 or not n0:
        return Index(none, none, none, none, np.zeros(0), none.astype(np.uint64), np.zeros(0), rate, k)
    row = np.repeat(np.arange(n), got.column("n").to_numpy())
    terms, term = np.unique(np.frombuffer(b"".join(got.column("terms").to_pylist()), "<u8"), return_inverse=True)
    count = np.frombuffer(b"".join(got.column("counts").to_pylist()), "<i8")
    m, a = np.bincount(term, minlength=len(terms)).astype(float), np.bincount(term, weights=label[row], minlength=len(terms))
    b = m - a
    chi2 = np.where(m < n, n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(m * (n - m) * n1 * n0, 1), 0.0)
    n_docs, df = document_counts(docs, terms)
    weight = (np.log((1 + n_docs) / (1 + df)) + 1) * np.sqrt(chi2)

    index = Index(ids, label, none, none, np.zeros(0), terms, weight, rate, k)
    own = index.vectors(row, term, count)
    index = Index(ids, label, *own, terms, weight, rate, k)
    place = np.empty(n, np.int64)
    place[np.searchsorted(ids, index.ids)] = np.arange(n)
    row, term, w = own
    votes = np.zeros(n)
    for lo in range(0, n, 256):  # the examples among themselves, each without itself
        i, j = np.searchsorted(row, [lo, lo + 256])
        some = min(256, n - lo)
        votes[lo : lo + some] = index.votes(*index.nearest(some, row[i:j] - lo, term[i:j], w[i:j], place[lo : lo + some]))
    index.calibrate(votes, label)
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score and evidence (the five nearest examples) for each row of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(index)  # bounded by max_postings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c.worker_of("toxicity")
        index = shipped.value
        for batch in batches:
            for part, buf, off in c.chunks(batch):
                own, at, cos = index.judged(buf, off)
                why = [[{"doc_id": int(index.ids[i]), "label": int(index.labels[i]), "cosine": s} for i, s in zip(a, s) if i >= 0] for a, s in zip(at[:, :5].tolist(), cos[:, :5].tolist())]
                kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(own), pa.array(why, kind)], names=["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(c.lean(run), SCHEMA)


def without_toxic(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under `threshold`, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c.worker_of("toxicity")
        for batch in batches:
            for part, buf, off in c.chunks(batch):
                yield part.filter(pa.array(shipped.value.judged(buf, off)[0] < threshold))

    return docs.mapInArrow(c.lean(run), docs.schema)
