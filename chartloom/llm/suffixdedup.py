"""Removal of repeated byte strings by suffix arrays with longest-previous-factor matches.

Every `length`-byte window of a text belongs to one anchor: the start of the GRAM bytes of least hash in it,
the leftmost of equals, which depends on the window's bytes alone. Windows of one anchor that follow each
other form a segment. Equal windows have equal anchors, so repeats are settled anchor by anchor:

1. Blocks of documents ask, by anchor, how often each segment occurs. Segments are told apart by 128-bit digests
   of their bytes (blake2b). An anchor that occurs once has no repeat; a segment that occurs again is all repeats.
2. Where one anchor has several different segments, the bytes of one copy of each go to the anchor's bucket. The
   bucket sorts the suffixes that begin at the anchors and, read backwards, what stands before them; the common
   prefixes of neighbours in these orders tell how far any two segments agree to either side. For each distance
   of a window's start from its anchor that gives the suffix order of the windows with their common prefixes, and
   from the previous and the next smaller position in that order each window's longest previous factor: one that
   reaches the window's length is an earlier copy. With keep="none" the longest next factor counts as well.
3. Blocks mark what the windows found cover.

An anchor with more than `hot` different segments (the edge of a passage that very many documents share) would
make one bucket too large. Its windows are counted one by one by 128-bit digest instead, spread over all buckets,
to the same result.

keep="first" keeps the first copy in the order of blocks and positions, keep="none" removes all copies.

Edge cases: null and empty texts and those shorter than a window lose nothing; a repeated row is a copy;
matches never cross rows; overlapping repeats within a text count; a text is held in memory whole, once a
task; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import common as c
from chartloom.llm import exchange as x

GRAM = 32
BLOCKS = "block long, ids array<long>, offsets binary, data binary, n_bytes long, segments binary, keys binary, pieces binary"
SEGMENTS = "bucket int, block long, keys binary, spans binary, asks binary, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
TEXT_RESULT = RESULT + ", kept binary"
#: Cutting a block into segments takes some 60 bytes of working memory a byte.
BLOCK_BYTES = 1 << 20
PLACE = 31  # bits of a position within a block: no text is longer
REPEATED, SEND, ASK, HOT, FIRST = 1, 2, 4, 8, 16


def _names(text: str) -> list[str]:
    return [f.split()[0] for f in text.split(", ")]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    n = len(v)
    rows = np.concatenate([v, np.full(-n % w + w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)[: n - w + 1]
    np.minimum.accumulate(rows, axis=1, out=rows)
    return np.minimum(back, rows.reshape(-1)[w - 1 : n])


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    n = len(buf) - GRAM + 1
    eight = c.mix(c.eights(buf)[: n + GRAM - 8])
    out = eight[:n].copy()
    for k in range(8, GRAM, 8):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= eight[k : k + n]
    return c.mix(out)


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """Two numbers for each byte range (and its mark): the 128 bits of its digest."""
    view = memoryview(data)
    if marks is None:
        out = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())]
    else:
        salts = {m: m.to_bytes(8, "little") for m in set(marks.tolist())}
        out = [hashlib.blake2b(view[a:b], digest_size=16, salt=salts[m]).digest() for a, b, m in zip(starts.tolist(), ends.tolist(), marks.tolist())]
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)


def segments(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor's hash) of each segment, in order."""
    none = np.zeros(0, np.int64)
    n = len(buf)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    gram = gram_hashes(buf)
    anchor = sliding_min((gram >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(gram), dtype=np.uint64), length - GRAM + 1)
    anchor = (anchor & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    ok = np.zeros(len(anchor) + 1, np.int64)  # windows that lie in one row
    long = np.diff(off) >= length
    np.add.at(ok, off[:-1][long], 1)
    np.add.at(ok, off[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(ok)[:-1] > 0)
    a = anchor[start]
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    # texts that follow each other are apart by at least length - 1 starts, so runs are in one row
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return start[first], start[last], a[first], c.mix(gram[a[first]])  # least hashes: mixed anew they spread over the buckets


def _blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        one = lambda v, kind: pa.array([v], kind)
        for batch in batches:
            for part, buf, off in c.chunks(batch, limit=BLOCK_BYTES):
                lo, hi, a, keys = segments(buf, off, length)
                data = buf.tobytes()
                pieces = digests(data, lo, hi + length, a - lo)
                order = np.lexsort((pieces[:, 1], pieces[:, 0], keys))  # stable: of equal ones the first in the text leads
                ids = part.column("doc_id").cast(pa.int64()).to_pylist()
                table = np.stack([lo, hi, a], axis=1)[order].astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        one(task << 32 | k, pa.int64()), one(ids, pa.list_(pa.int64())), one(off.astype("<i8").tobytes(), pa.binary()), one(data, pa.binary()), one(len(buf), pa.int64()),
                        one(x.planes(table), pa.binary()), one(x.planes(keys[order]), pa.binary()), one(pieces[order].tobytes(), pa.binary()),
                    ],
                    names=_names(BLOCKS),
                )
                k += 1

    return run


class Block:
    def __init__(self, row: dict, length: int):
        self.row, self.block, self.length = row, row["block"].as_py(), length
        self.data = row["data"].as_py()
        self.off = np.frombuffer(row["offsets"].as_py(), "<i8")
        keys = x.unplanes(row["keys"].as_py(), "<u8")
        table = x.unplanes(row["segments"].as_py(), "<i4", 3).astype(np.int64)
        pieces = np.frombuffer(row["pieces"].as_py(), "<u8").reshape(-1, 2)
        self.lo, self.hi, self.anchor = table[:, 0], table[:, 1], table[:, 2]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (pieces[1:] != pieces[:-1]).any(axis=1)
        self.example = np.flatnonzero(new)  # of each distinct segment the first in the block
        self.of = np.cumsum(new) - 1
        self.is_first = new
        self.keys, self.pieces = keys[self.example], pieces[self.example]

    def ask(self, buckets: int) -> pa.RecordBatch:
        times = np.diff(np.concatenate([self.example, [len(self.of)]])).astype(np.uint64)
        return x.requests(self.block, self.keys, np.concatenate([self.pieces, times[:, None]], axis=1), buckets)

    def codes(self) -> np.ndarray:
        return x.gathered(self.row["found"], np.uint8)

    def send(self, buckets: int) -> pa.RecordBatch:
        code = self.codes()
        sent = np.flatnonzero((code & SEND > 0) & (code & HOT == 0))
        b = x.bucket_of(self.keys[sent], buckets)
        edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        ends = np.concatenate([edges[1:], [len(b)]]) if len(b) else edges
        own = self.example[sent]
        where = np.stack([self.lo[own], self.hi[own], self.anchor[own]], axis=1).astype("<i4")
        asks = (code[sent] & ASK > 0).astype(np.uint8)
        parts = [self.data[i:j] for i, j in zip(self.lo[own].tolist(), (self.hi[own] + self.length).tolist())]
        cols = [
            pa.array(b[edges].astype(np.int32)), pa.array(np.full(len(edges), self.block, np.int64)),
            *(pa.array([v[i:j].tobytes() for i, j in zip(edges, ends)], pa.binary()) for v in (self.keys[sent], where, asks)), pa.array([b"".join(parts[i:j]) for i, j in zip(edges, ends)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=_names(SEGMENTS))

    def hot_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, distinct digests, first of each, which is whose) of the windows of segments whose anchor is hot."""
        seg = np.flatnonzero(self.codes()[self.of] & HOT > 0)
        n = (self.hi - self.lo + 1)[seg]
        start = np.sort(np.repeat(self.lo[seg] - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
        found = digests(self.data, start, start + self.length) if len(start) else np.zeros((0, 2), np.uint64)
        order = np.lexsort((found[:, 1], found[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (found[order[1:]] != found[order[:-1]]).any(axis=1)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        return start, found[order[new]], order[new], of

    def ask_hot(self, buckets: int) -> pa.RecordBatch:
        _, found, _, of = self.hot_windows()
        return x.requests(self.block, found[:, 0].copy(), np.stack([found[:, 1], np.zeros(len(found), np.uint64), np.bincount(of, minlength=len(found)).astype(np.uint64)], axis=1), buckets)

    def covered(self, keep_first: bool) -> np.ndarray:
        code, width, n = self.codes(), -(-(self.length - GRAM + 1) // 8), len(self.data)
        every = (code[self.of] & REPEATED > 0) & (code[self.of] & HOT == 0)
        if keep_first:
            every &= ~(self.is_first & (code[self.of] & FIRST > 0))
        edge = np.zeros(n + 2, np.int32)  # windows found, as runs of starts
        np.add.at(edge, self.lo[every], 1)
        np.add.at(edge, self.hi[every] + 1, -1)
        repeat = np.cumsum(edge)[: n + 1] > 0
        masks = b"".join(self.row["masks"].as_py() or [])
        asked = np.flatnonzero((code & SEND > 0) & (code & ASK > 0) & (code & HOT == 0))
        if len(asked):
            bits = np.unpackbits(np.frombuffer(masks, np.uint8).reshape(len(asked), width), axis=1)
            seg, k = np.nonzero(bits)
            repeat[self.lo[self.example[asked[seg]]] + k] = True
        if self.row.get("hot") is not None and (code & HOT > 0).any():
            start, _, first, of = self.hot_windows()
            got = x.gathered(self.row["hot"], np.uint8)
            dup = (got & REPEATED > 0)[of]
            if keep_first:
                here = np.zeros(len(of), bool)
                here[first] = True
                dup &= ~(here & ((got & FIRST) > 0)[of])
            repeat[start[dup]] = True
        at = np.flatnonzero(repeat[:-1])
        edge[:] = 0
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + self.length, len(edge) - 1), -1)
        return np.cumsum(edge)[:n] > 0

    def result(self, keep_first: bool, texts: bool) -> pa.RecordBatch:
        gone, buf = self.covered(keep_first), np.frombuffer(self.data, np.uint8)
        n = len(self.off) - 1
        s, _, row = c.spans(gone, self.off)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[self.off])
        kept = [buf[a:b][~gone[a:b]].tobytes() if r else self.data[a:b] for a, b, r in zip(self.off[:-1].tolist(), self.off[1:].tolist(), removed.tolist())]
        cols = [self.row["ids"].values, pa.array(np.diff(self.off)), pa.array(removed), pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        if texts:
            cols.append(pa.array(kept, pa.binary()))
        return pa.RecordBatch.from_arrays(cols, names=_names(TEXT_RESULT if texts else RESULT))


def _ordered(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by group, then by bytes; common prefix of each with the one before it, -1 across groups)."""
    width = rows.shape[1]
    named = np.concatenate([group.astype(">u4")[:, None].view(np.uint8).reshape(len(group), 4), rows], axis=1)
    order = np.argsort(np.ascontiguousarray(named).view(f"S{width + 4}").reshape(-1), kind="stable")
    common = np.full(len(order), -1, np.int64)
    differ = rows[order[1:]] != rows[order[:-1]]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def previous_factor_reaches(place: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """In a suffix order: whether the longest previous factor of each suffix reaches the window's length.

    place: the positions; joined: whether the common prefix with the suffix before is of that length. The longest previous
    factor is the longer of the common prefixes with the previous and the next smaller position in the order; both
    are found by jumping over greater ones, all suffixes at once, as long as the common prefix reaches.
    """
    n = len(place)
    out = np.zeros(n, bool)
    for values, link in ((place, joined), (place[::-1], np.concatenate([[False], joined[:0:-1]]))):
        to = np.where(link, np.arange(n) - 1, -1)
        open_ = np.flatnonzero(to >= 0)
        while len(open_):
            greater = values[to[open_]] > values[open_]
            open_ = open_[greater]
            to[open_] = to[to[open_]]
            open_ = open_[to[open_] >= 0]
        found = to >= 0
        out |= found if values is place else found[::-1]
    return out


def repeated_windows(left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, place: np.ndarray, length: int, keep_first: bool) -> np.ndarray:
    """bool (segment, distance): whether the window that starts `distance` bytes before the anchor is to go.

    left: what stands before each anchor, read backwards; right: what begins there; both padded with zeros, which no
    window reaches. low, high: the distances of the segment's windows. place: the anchors' positions in the corpus.
    """
    n, far = len(group), left.shape[1]
    out = np.zeros((n, far + 1), bool)
    by_right, right_common = _ordered(right, group)
    by_left, left_common = _ordered(left, group)
    name = np.empty(n, np.int64)
    for k in range(far + 1):
        name[by_left] = np.cumsum(left_common < k)  # equal names: the k bytes before the anchors are equal
        run = np.cumsum(right_common < length - k)  # equal runs: the rest of the windows is equal
        here = np.flatnonzero((low[by_right] <= k) & (k <= high[by_right]))
        here = here[np.argsort(name[by_right[here]], kind="stable")]
        own = by_right[here]
        joined = np.zeros(len(here), bool)
        joined[1:] = (name[own[1:]] == name[own[:-1]]) & (run[here[1:]] == run[here[:-1]])
        if joined.any():
            found = previous_factor_reaches(place[own], joined)
            if not keep_first:
                found |= previous_factor_reaches(-place[own], joined)
            out[own[found], k] = True
    return out


def _settled(hot: int, keep_first: bool):
    def reduce(group: np.ndarray, n: int, vals: np.ndarray) -> np.ndarray:
        times = vals[:, 2].astype(np.int64)
        order = np.lexsort((vals[:, 1], vals[:, 0], group))
        new = np.ones(len(order), bool)
        new[1:] = (group[order[1:]] != group[order[:-1]]) | (vals[order[1:], :2] != vals[order[:-1], :2]).any(axis=1)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        total = np.bincount(which, weights=times).astype(np.int64)
        first = np.zeros(len(order), bool)
        first[order[new]] = True  # the entry of the lowest block
        kinds = np.bincount(group[order[new]], minlength=n)
        several = kinds[group] > 1
        repeated = total[which] > 1
        ask = several & first & (~repeated | keep_first)
        code = REPEATED * repeated + SEND * (several & first) + ASK * ask + HOT * (kinds[group] > hot) + FIRST * first
        return code.astype(np.uint8)

    return reduce


def repeated_strings(docs: DataFrame, length: int = 200, keep: str = "first", texts: bool = False, hot: int = 4_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of each row of docs."""
    if keep not in ("first", "none") or length < GRAM + 8:
        raise ValueError("keep is 'first' or 'none'; length is at least 40")
    keep_first, far = keep == "first", length - GRAM
    width = -(-(far + 1) // 8)
    blocks = c.stored_by(docs.select("doc_id", "text").mapInArrow(_blocks(length), BLOCKS), "block", "text-blocks")
    buckets = x.n_buckets(docs.sparkSession, 2 * (blocks.agg(F.sum("n_bytes")).first()[0] or 0))

    def over(ask, schema: str, **replies) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in x.each_row(batches):
                yield ask(Block(row, length))

        return x.joined(blocks, **replies).mapInArrow(run, schema)

    def hot_entries(unique: np.ndarray, group: np.ndarray, vals: np.ndarray) -> np.ndarray:
        order = np.lexsort((vals[:, 1], vals[:, 0], group))
        new = np.ones(len(order), bool)
        new[1:] = (group[order[1:]] != group[order[:-1]]) | (vals[order[1:], :2] != vals[order[:-1], :2]).any(axis=1)
        return np.array([(np.bincount(group[order[new]]) > hot).sum()], "<i8")

    got = {"found": x.answered(over(lambda b: b.ask(buckets), x.REQUEST), _settled(hot, keep_first), "<u8", 3, "segments", hot_entries)}
    any_hot = any(x.unplanes(r.reply, "<i8")[0] for r in got["found"].where("block < 0").select("reply").toLocalIterator())

    def match(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        column = lambda name: table.column(name).to_pylist()
        keys = np.concatenate([np.frombuffer(v, "<u8") for v in column("keys")])
        lo, hi, anchor = np.concatenate([np.frombuffer(v, "<i4").reshape(-1, 3) for v in column("spans")]).astype(np.int64).T
        asks = [np.frombuffer(v, np.uint8) > 0 for v in column("asks")]
        counts = [len(v) for v in asks]
        buf = np.frombuffer(b"".join([*column("data"), bytes(length)]), np.uint8)
        size = hi - lo + length
        at = np.cumsum(size) - size + anchor - lo  # the anchors in buf
        before = np.arange(1, far + 1)
        left = np.where(before[None, :] <= (anchor - lo)[:, None], buf[np.maximum(at[:, None] - before[None, :], 0)], 0).astype(np.uint8)
        ahead = np.arange(length)
        right = np.where(ahead[None, :] < (hi + length - anchor)[:, None], buf[np.minimum(at[:, None] + ahead[None, :], len(buf) - 1)], 0).astype(np.uint8)
        place = np.argsort(np.lexsort((anchor, np.repeat(np.arange(table.num_rows), counts))))
        gone = repeated_windows(left, right, anchor - hi, anchor - lo, np.unique(keys, return_inverse=True)[1], place, length, keep_first)
        # bit i of a segment speaks of its window i, which starts anchor - lo - i before the anchor
        distance = (anchor - lo)[:, None] - np.arange(far + 1)[None, :]
        bits = np.where(distance >= 0, np.take_along_axis(gone, np.maximum(distance, 0), axis=1), False)
        packed = np.packbits(bits, axis=1)
        edge = np.concatenate([[0], np.cumsum(counts)])
        replies = [packed[a:b][own].tobytes() for a, b, own in zip(edge[:-1], edge[1:], asks)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "reply": pa.array(replies, pa.binary())})

    got["masks"] = c.stored(over(lambda b: b.send(buckets), SEGMENTS, **got).groupBy("bucket").applyInArrow(match, x.REPLY), "masks")
    if any_hot:
        got["hot"] = x.answered(over(lambda b: b.ask_hot(buckets), x.REQUEST, found=got["found"]), _settled(1 << 62, keep_first), "<u8", 3, "hot-windows")
    return over(lambda b: b.result(keep_first, texts), TEXT_RESULT if texts else RESULT, **got)
