"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of preceding words, of no word, one, two and so on to `depth`. A context is a candidate if it
occurs `min_count` times in training texts and the context without its first word is retained; it is retained if
the gain in log likelihood of its next-word distribution over its parent's passes `gain` nats for each
distribution entry and `divergence` nats an occurrence, the parent's probabilities taken with eight binary digits. A state's entries are next words seen at least twice
after it, less `discount` each; what that leaves goes to the parent's distribution, down to the root's
additively smoothed word frequencies, in which all unknown words are one symbol. Each distribution sums to
one. A text's score uses, word by word and for its end, the longest retained suffix of what precedes.

Counts are gathered by hash across blocks of documents: a round for words (exchange.py), then one for contexts of all
lengths. All contexts that end with the same word go to one bucket, which has with them whatever decides on them: it adds up
and tests length after length. So a position moves once, as its `depth` words before and its own, up to the first
word that occurs under `min_count` times, and comes back as its word's log probability. What moves grows with the
tokens, however many contexts are retained; half of the buckets take their turn after the others, when the messages to these
are gone from the disks. A context that occurs over `hot` times (a frequent word) is dealt to as many parts as keep a part at `hot`, by next word;
parts' sums meet in an aggregation, and the at most N / `hot` contexts of a length go to the driver. Positions behind hot
contexts go to the bucket of the first longer context that isn't hot. Contexts stop being tested where none can be
retained: one wins at most what its entries cost below, the sum of count * log(1 / probability), and needs 2 * `gain`.
Nothing is sampled or capped, counts have 64 bits, and the tables grow with the corpus. Words are told apart by
64-bit hashes and have a number from then on; contexts are told apart by 64-bit hashes.

Edge cases: null and empty texts are a single end token; null ids are training rows; repeated rows are
counted and scored each; if no row is for training, N and V are 0, no word is known and every token has
the probability 1; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import common as c
from chartloom.llm import exchange as x

END, BEGIN = np.uint64(0x5DEECE66D1234567), np.uint64(0x1B873593CC9E2D51)
SALT = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = "block long, ids array<long>, held array<boolean>, sizes binary, words binary, tokens binary, counts binary, n_tokens long, n_words long"
COUNTED = "block long, ids array<long>, held array<boolean>, sizes binary, tokens binary, numbers binary, counts binary"
ASKED = "bucket int, block long, packed binary"
#: Answers to the blocks; under block -1 the sums of a bucket's parts of hot contexts.
ANSWERS = "block long, bucket int, reply binary, hot array<struct<context:long,entries:double,occurrences:double,mass:double,won:double,seen:double,most:double>>"
HOT_KIND = pa.list_(pa.struct([("context", pa.int64()), *((f, pa.float64()) for f in ("entries", "occurrences", "mass", "won", "seen", "most"))]))
#: Columns of messages: their kind, and the bytes of it that are sent. Words' numbers stay below 2^48.
WORD, HASH, COUNT, BELOW, LEVEL = ("<u8", 6), ("<u8", 8), ("<u4", 4), ("<f4", 4), ("<u1", 1)
#: The answer to an entry that no context speaks for; logarithms of probabilities are not above 0.
NO_CONTEXT = np.float32(1)
OF_HOT = [HASH, HASH, WORD, COUNT, BELOW]
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ALPHA = 0.1
BLOCK_BYTES = 5 << 20
#: Buckets get their messages in so many turns; only one turn's are on disk at a time.
TURNS = 2


def _names(text: str) -> list[str]:
    return [f.split()[0] for f in text.split(", ") if " " in f]


def gathered_batches(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes: the fewer blocks, the fewer messages."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def token_blocks(docs: DataFrame, modulus: int) -> DataFrame:
    """Blocks of texts as positions in the block's sorted distinct word hashes, each text closed by END; the
    last count is of the training texts that begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in gathered_batches(batches):
            for part, buf, off in c.chunks(batch, limit=BLOCK_BYTES):
                low = c.LOWER[buf]
                s, e, row = c.spans(~c.SPACE[low], off)
                n = part.num_rows
                sizes = np.bincount(row, minlength=n) + 1
                h = np.full(int(sizes.sum()), END, np.uint64)
                ends = np.cumsum(sizes) - 1
                own = np.ones(len(h), bool)
                own[ends] = False
                h[own] = c.range_hash(low, s, e)
                words, tokens = np.unique(h, return_inverse=True)
                ids = part.column("doc_id").cast(pa.int64())
                held = np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == 0 for i in ids.to_pylist()], bool)
                counts = np.append(np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words)), (~held).sum())
                one = lambda v, kind: pa.array([v], kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        one(task << 32 | k, pa.int64()), one(ids.to_pylist(), pa.list_(pa.int64())), one(held.tolist(), pa.list_(pa.bool_())), one(sizes.astype("<i8").tobytes(), pa.binary()),
                        one(x.planes(words), pa.binary()), one(x.planes(tokens.astype("<i4")), pa.binary()), one(x.planes(counts.astype("<i8")), pa.binary()), one(len(h), pa.int64()), one(len(words), pa.int64()),
                    ],
                    names=_names(BLOCKS),
                )
                k += 1

    return c.stored_by(docs.select("doc_id", "text").mapInArrow(run, BLOCKS), "block", "token-blocks")


def _bytes(columns: list[np.ndarray], kinds: list[tuple[str, int]]) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(v.astype(k, copy=False)).view(np.uint8).reshape(len(v), np.dtype(k).itemsize)[:, :w] for v, (k, w) in zip(columns, kinds)], axis=1)


def packed(columns: list[np.ndarray], kinds: list[tuple[str, int]], edges: np.ndarray, ends: np.ndarray, more: np.ndarray | None = None, at: np.ndarray | None = None) -> list[bytes]:
    """A message for each run [edge, end) of entries: its columns by significance, then compressed; behind them what
    `more` has from at[edge] to at[end]."""
    raw, out = _bytes(columns, kinds), []
    for i, j in zip(edges.tolist(), ends.tolist()):
        part = raw[i:j].T.tobytes()
        if more is not None:
            part += np.ascontiguousarray(more[at[i] : at[j]].view(np.uint8).reshape(-1, more.itemsize).T).tobytes()
        out.append(len(part).to_bytes(4, "little") + (j - i).to_bytes(4, "little") + pa.compress(part, codec="zstd", asbytes=True))
    return out


def unpacked(messages: list[bytes], kinds: list[tuple[str, int]], more: str = "<f4") -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(the columns of all messages, one behind the other; the entries of each; what stands behind the columns)"""
    width = sum(w for _, w in kinds)
    parts, behind = [], []
    for m in messages:
        raw, n = np.frombuffer(pa.decompress(m[8:], decompressed_size=int.from_bytes(m[:4], "little"), codec="zstd", asbytes=True), np.uint8), int.from_bytes(m[4:8], "little")
        parts.append(raw[: width * n].reshape(width, n))
        behind.append(np.ascontiguousarray(raw[width * n :].reshape(np.dtype(more).itemsize, -1).T).view(more).reshape(-1))
    sizes = np.array([p.shape[1] for p in parts])
    raw, out, at = np.concatenate(parts, axis=1), [], 0
    del parts
    for k, w in kinds:
        column = np.zeros((raw.shape[1], np.dtype(k).itemsize), np.uint8)
        column[:, :w] = raw[at : at + w].T
        out.append(column.view(k).reshape(-1))
        at += w
    return out, sizes, np.concatenate(behind)


def sources(message: np.ndarray, word: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose probability a message has, in its order, and which of them each entry takes: the probability below a first
    word is the next word's own and stands once in a message, that below hot contexts with each entry."""
    own = np.where(length > 0, np.uint64(1 << 48) + np.arange(len(word), dtype=np.uint64), word.astype(np.uint64))
    if len(message) and message[-1] >= 1 << 15:
        own = distinct(own)[1].astype(np.uint64)
        return distinct((message * len(own)).astype(np.uint64) + own)
    return distinct((message.astype(np.uint64) << np.uint64(49)) | own)


def steps(columns: list[np.ndarray], edges: np.ndarray) -> list[np.ndarray]:
    """Sorted rows as what each adds to the one before, in a column where the columns before it are the same."""
    new, out = np.zeros(len(columns[0]), bool), []
    new[edges] = True
    for v in columns:
        d = v.copy()
        d[1:] -= v[:-1]
        out.append(np.where(new, v, d))
        new = new.copy()
        new[1:] |= v[1:] != v[:-1]
    return out


def summed(columns: list[np.ndarray], edges: np.ndarray, bits: list[int]) -> list[np.ndarray]:
    """The inverse of steps(), of columns of which `bits` bits are there."""
    new, out = np.zeros(len(columns[0]), bool), []
    new[edges] = True
    columns = columns[::-1]
    for n in bits:
        v = columns.pop()
        first, total = np.flatnonzero(new), np.cumsum(v)
        v = (total - (total[first] - v[first])[np.cumsum(new) - 1]) & np.uint64((1 << n) - 1)
        out.append(v)
        new[1:] |= v[1:] != v[:-1]
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an example of each distinct key, in the keys' order; each key's number)"""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def ordered(numbers: np.ndarray) -> np.ndarray:
    """The order of small numbers, equal ones as they stand."""
    n = max(len(numbers), 1)
    return np.sort(numbers.astype(np.int64) * n + np.arange(len(numbers))) % n


def runs(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of equal numbers"""
    edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    return edges, np.append(edges[1:], len(b)) if len(b) else edges


def rows_of(columns: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray]:
    """(an example of each distinct row of numbers below span, in order; the row's number at each place)"""
    key, top = columns[0].astype(np.uint64), span
    for v in columns[1:]:
        if top * span > 1 << 64:
            have, of = distinct(key)
            key, top = of.astype(np.uint64), len(have)
        key, top = key * np.uint64(span) + v.astype(np.uint64), top * span
    return distinct(key)


def short(p: np.ndarray) -> np.ndarray:
    """Probabilities with the eight digits that a test takes."""
    return (p.astype("<f4").view("<u4") & np.uint32(0xFFFF0000)).view("<f4").astype(float)


def first_hash(word: np.ndarray) -> np.ndarray:
    return c.mix(word ^ SALT)


def longer_hash(hashes: np.ndarray, word: np.ndarray, d: int) -> np.ndarray:
    """Hashes of contexts of d words from those without their first word."""
    return c.mix((hashes ^ (word * SALT)) * SALT + np.uint64(d))


class Settings:
    def __init__(self, min_count: int, gain: float, divergence: float, discount: float, hot: int, buckets: int, word_buckets: int, hot_buckets: int):
        self.min_count, self.gain, self.divergence, self.discount, self.hot = min_count, gain, divergence, discount, hot
        self.buckets, self.word_buckets, self.hot_buckets = buckets, word_buckets, hot_buckets
        self.total = self.distinct = self.most = 0
        #: for each length that has hot contexts: (their hashes in order, what each leaves to its parent, or 0)
        self.rests: list[tuple[np.ndarray, np.ndarray]] = []

    def retained(self, entries, occurrences, mass, won, seen):
        """What a retained context leaves to its parent; 0 where it isn't retained."""
        rest = np.clip(1 - mass, 1e-6, 1.0)
        gained = won + (seen - occurrences) * np.log(rest)
        return np.where((entries > 0) & (gained >= self.gain * (entries + 1)) & (gained >= self.divergence * seen), rest, 0.0)


def _word_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of a block's words and the begin mark in order, their order)"""
    hashes = np.concatenate([x.unplanes(row["words"].as_py(), "<u8"), [BEGIN]])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], order


def word_request(row: dict, s: Settings) -> pa.RecordBatch:
    keys, order = _word_keys(row)
    return x.requests(row["block"].as_py(), keys, x.unplanes(row["counts"].as_py(), "<i8")[order], s.word_buckets)


def counted(row: dict, s: Settings) -> pa.RecordBatch:
    """A block with its words' numbers, which are the same in all blocks, and counts in place of their hashes."""
    keys, order = _word_keys(row)
    got = np.concatenate([x.unplanes(p, "<i8", 2) for p in row["words_got"].as_py()])
    count, number = np.empty(len(keys), "<i8"), np.empty(len(keys), "<u8")
    count[order], number[order] = got[:, 0], got[:, 1] * s.word_buckets + x.bucket_of(keys, s.word_buckets)
    by = np.append(np.argsort(number[:-1], kind="stable"), len(number) - 1)  # the begin mark stays last
    place = np.empty(len(by), "<i4")
    place[by] = np.arange(len(by))
    count, number, token = count[by], number[by], place[x.unplanes(row["tokens"].as_py(), "<i4")]
    one = lambda v: pa.array([v], pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array([row[f].as_py()], k) for f, k in (("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())))), one(row["sizes"].as_py()), one(x.planes(token)), one(x.planes(number)), one(x.planes(count))], names=_names(COUNTED))


class Block:
    def __init__(self, row: dict, s: Settings, depth: int):
        self.s, self.block, self.row, self.depth = s, row["block"].as_py(), row, depth
        self.token = x.unplanes(row["tokens"].as_py(), "<i4")
        self.sizes = np.frombuffer(row["sizes"].as_py(), "<i8")
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ids, self.held = row["ids"].values, np.array(row["held"].as_py(), bool)
        self.words, self.count = x.unplanes(row["numbers"].as_py(), "<u8"), x.unplanes(row["counts"].as_py(), "<i8")
        self.train = np.repeat(~self.held, self.sizes)
        self.root = ((self.count + ALPHA) / (s.total + ALPHA * (s.distinct + 1)))[self.token] if s.total else np.ones(len(self.token))
        # the words before each position, up to the text's begin and the first that is rarer than a context can be
        n, live, often = len(self.token), np.ones(len(self.token), bool), self.count >= s.min_count
        place = np.arange(n) - np.repeat(self.first, self.sizes)
        self.before = []
        for d in range(1, depth + 1):
            word = np.full(n, len(self.words) - 1, np.int32)  # the last word is the begin mark
            word[d:][place[d:] >= d] = self.token[: max(n - d, 0)][place[d:] >= d]
            live &= (place >= d - 1) & often[word]
            self.before.append(np.where(live, word, -1))

    def hashes(self, at: np.ndarray, d: int) -> np.ndarray:
        """Hashes of the contexts of d words before some positions."""
        out = first_hash(self.words[self.before[0][at]])
        for k in range(2, d + 1):
            out = longer_hash(out, self.words[self.before[k - 1][at]], k)
        return out

    def learn(self) -> None:
        """The distributions below hot contexts, as far as these are known; the next length's hot contexts."""
        s = self.s
        self.below, self.length, self.alive = self.root.copy(), np.zeros(len(self.token), "<u1"), np.ones(len(self.token), bool)
        self.seen = np.where(self.before[0] >= 0, self.count[self.before[0]], 0)
        self.at = np.flatnonzero(self.seen > s.hot)
        for d, (known, left) in enumerate(s.rests, 1):
            self.hot(d)
            n = np.zeros(len(self.example), np.int64)
            n[self.order] = x.gathered(self.row[f"hot_{d}"], "<i8")
            n, at = n[self.of], self.at
            rest = left[np.searchsorted(known, self.hashes(at, d))]
            on = self.alive[at] & (rest > 0)
            self.below[at[on]] = (np.where(n >= 2, (n - s.discount) / self.seen[at], 0.0) + rest * self.below[at])[on]
            self.alive[at[~on]] = False
            self.length[at] = d
            # what ends at i - 1 and the words of i's context are the context of one word more before i
            self.seen = np.zeros(len(self.token), np.int64)
            self.seen[at] = n
            self.seen = np.concatenate([[0], self.seen[:-1]])
            self.seen[self.first] = 0
            self.at = np.flatnonzero(self.seen > s.hot)

    def hot(self, d: int) -> None:
        """The entries (hot context, next word) of d words, in the order of their buckets."""
        at, s = self.at, self.s
        _, context = distinct(self.hashes(at, d))
        first, self.of = distinct(context * len(self.words) + self.token[at])
        self.example = at[first]
        parts = -(-self.seen[self.example] // s.hot)
        part = c.mix(self.words[self.token[self.example]]) % np.maximum(parts, 1).astype(np.uint64)
        to = x.bucket_of(c.mix(self.hashes(self.example, d) ^ (part + np.uint64(1)) * SALT), s.hot_buckets)
        self.order = ordered(to)
        self.to = to[self.order]

    def counts(self, at: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[self.train[at]], minlength=len(self.example))[self.order]

    def messages(self, columns: list[np.ndarray], kinds: list[tuple[str, int]], edges: np.ndarray, ends: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array(self.to[edges], pa.int32()), pa.array([self.block] * len(edges), pa.int64()), pa.array(packed(columns, kinds, edges, ends, *more) if len(edges) else [], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=_names(ASKED))

    def ask_hot(self) -> pa.RecordBatch:
        self.learn()
        d = len(self.s.rests) + 1
        self.hot(d)
        e, (edges, ends) = self.example[self.order], runs(self.to)
        return self.messages([*steps([self.hashes(e, d), self.seen[e].astype("<u8"), self.words[self.token[e]]], edges), self.counts(self.at), self.below[e]], OF_HOT, edges, ends)

    def entries(self, turn: int | None = None) -> np.ndarray:
        """The positions that some context may speak for, of one turn's buckets or of all; their entries (words before, next
        word) in the order of their buckets."""
        self.learn()
        own = np.concatenate([self.before, np.full((1, len(self.token)), -1, np.int32)])[self.length, np.arange(len(self.token))]
        at = np.flatnonzero(self.alive & (own >= 0))
        length, hashes = self.length[at], first_hash(self.words[self.before[0][at]])
        key = hashes
        for d in range(2, int(length.max(initial=0)) + 2):
            hashes = longer_hash(hashes, self.words[self.before[d - 1][at]], d)
            key = np.where(length == d - 1, hashes, key)
        to = x.bucket_of(key, self.s.buckets)
        if turn is not None:
            now = to % TURNS == turn
            at, to = at[now], to[now]
        first, self.of = rows_of([*(b[at] + 1 for b in self.before), self.token[at]], len(self.words) + 1)
        self.example, to = at[first], to[first]
        self.order = ordered(to)
        self.to = to[self.order]
        return at

    def ask(self, turn: int) -> pa.RecordBatch:
        at = self.entries(turn)
        e, (edges, ends) = self.example[self.order], runs(self.to)
        words = [np.where(b[e] >= 0, self.words[b[e]] + np.uint64(1), np.uint64(0)) for b in self.before]
        message = np.repeat(np.arange(len(edges)), ends - edges)
        given, _ = sources(message, self.token[e], self.length[e])
        begins = np.searchsorted(message[given], np.arange(len(edges) + 1))
        begin_of = np.append(begins[message], len(given))  # by entry
        return self.messages([*steps([*words, self.words[self.token[e]]], edges), self.counts(at), self.length[e]], of_all(self.depth), edges, ends, self.below[e[given]].astype("<f4"), begin_of)

    def scores(self) -> pa.RecordBatch:
        at, first = self.entries(), self.first
        got = np.full(len(self.example), NO_CONTEXT, "<f4")
        if replies := self.row["answers"].as_py():
            got[self.order] = np.concatenate([x.unplanes(p, "<f4") for p in replies])
        log = np.log10(self.below)
        log[at] = np.where(got[self.of] == NO_CONTEXT, log[at], got[self.of])
        add = lambda v: np.add.reduceat(v, first)
        known = add((self.count[self.token] > 0).astype(np.int64))
        cols = [self.ids, pa.array(self.held), pa.array(self.sizes.astype(np.int64)), pa.array(known), pa.array(np.full(len(first), self.s.total, np.int64)), pa.array(add(np.log10(self.root))), pa.array(add(log))]
        return pa.RecordBatch.from_arrays(cols, names=_names(SCORES))


def of_all(depth: int) -> list[tuple[str, int]]:
    return [*[WORD] * (depth + 1), COUNT, LEVEL]


def _totals(group: np.ndarray, n: int, vals: np.ndarray) -> np.ndarray:
    if vals.sum(dtype=float) < 1 << 52:  # exact in doubles
        return np.bincount(group, weights=vals, minlength=n).astype(np.int64)
    total = np.zeros(n, np.int64)
    np.add.at(total, group, vals)
    return total


def _numbered(group: np.ndarray, n: int, vals: np.ndarray) -> np.ndarray:
    """The count of each word, and its number in the bucket, frequent words first."""
    total, number = _totals(group, n, vals), np.empty(n, np.int64)
    number[np.argsort(-total, kind="stable")] = np.arange(n)
    return np.stack([total[group], number[group]], axis=1).astype("<i8")


def _tally(unique: np.ndarray, group: np.ndarray, vals: np.ndarray) -> np.ndarray:
    total = _totals(group, len(unique), vals)
    total[unique == BEGIN] = 0
    most = _totals(group, len(unique), vals)
    return np.array([total.sum(), (total > 0).sum(), most.max(initial=0)], "<i8")


class Tested:
    """Entries of some contexts, added up: n, the count of each row's entry; what a test needs of each context."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, counts: np.ndarray, below: np.ndarray, s: Settings, seen: np.ndarray | None = None):
        some, self.context = distinct(hashes)
        self.contexts = hashes[some]
        m = len(self.contexts)
        if seen is None:
            self.seen = _totals(self.context, m, counts)
        else:
            self.seen = np.zeros(m, np.int64)
            self.seen[self.context] = seen
        first, self.of = distinct(c.mix((hashes ^ (words * SALT)) * SALT + np.uint64(1)))
        n = _totals(self.of, len(first), counts)
        self.n, kept = n[self.of], n >= 2
        self.to, self.k, self.below = self.context[first[kept]], n[kept], short(below[first[kept]])
        self.mass = (self.k - s.discount) / self.seen[self.to]
        self.sums = [self.add(w) for w in (np.ones(len(self.k)), self.k, self.mass, self.k * np.log(self.mass / self.below))]

    def add(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.to, weights=weights, minlength=len(self.contexts))


def _hot_bucket(s: Settings):
    """Adds up the entries of a bucket's parts of hot contexts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        columns, sizes, _ = unpacked(table.column("packed").to_pylist(), OF_HOT)
        hashes, seen, words = summed(columns[:3], np.cumsum(sizes) - sizes, [64, 64, 48])
        t = Tested(hashes, words, columns[3], columns[4], s, seen.astype(np.int64))
        most = np.zeros(len(t.contexts), np.int64)
        np.maximum.at(most, t.context, t.n)
        parts = [dict(zip(("context", "entries", "occurrences", "mass", "won", "seen", "most"), (int(h.astype(np.int64)), *(float(v[i]) for v in t.sums), float(t.seen[i]), float(most[i])))) for i, h in enumerate(t.contexts)]
        return _answers(table, [x.planes(v) for v in np.split(t.n.astype("<i8"), np.cumsum(sizes)[:-1])], parts)

    return run


def _bucket(s: Settings, depth: int):
    """Adds up the entries of a bucket's contexts and tests these, length after length."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        columns, sizes, given = unpacked(table.column("packed").to_pylist(), of_all(depth))
        counts, length = columns[depth + 1], columns[depth + 2]
        *before, words = summed(columns[: depth + 1], np.cumsum(sizes) - sizes, [48] * (depth + 1))
        del columns
        p = given[sources(np.repeat(np.arange(len(sizes)), sizes), words, length)[1]].astype(float)
        grows, said, hashes = np.ones(len(p), bool), np.zeros(len(p), bool), None
        for d in range(1, depth + 1):
            word = before[d - 1] - np.uint64(1)
            hashes = first_hash(word) if d == 1 else longer_hash(hashes, word, d)
            at = np.flatnonzero(grows & (length < d) & (before[d - 1] > 0))
            grows &= length >= d
            if d > 1 and len(at):  # contexts that occur too seldom, left out at once
                some, context = distinct(hashes[at])
                at = at[_totals(context, len(some), counts[at])[context] >= s.min_count]
            if not len(at):
                continue
            t = Tested(hashes[at], words[at], counts[at], p[at], s)
            rest = np.where(t.seen >= s.min_count, s.retained(*t.sums, t.seen), 0.0)
            # what longer contexts can win is at most what these entries cost here; if that isn't enough for one, growth ends
            cost = t.add(-t.k * np.log(t.mass + rest[t.to] * t.below))
            on = rest[t.context] > 0
            more, factor = np.where(t.n >= 2, (t.n - s.discount) / np.maximum(t.seen, 1)[t.context], 0.0)[on], rest[t.context][on]
            grows[at[on & (cost >= 1.98 * s.gain)[t.context]]] = True
            at = at[on]
            p[at], said[at] = more + factor * p[at], True
        return _answers(table, [x.planes(v) for v in np.split(np.where(said, np.minimum(np.log10(p), 0.0), NO_CONTEXT).astype("<f4"), np.cumsum(sizes)[:-1])])

    return run


def _answers(table: pa.Table, replies: list[bytes], parts: list[dict] | None = None) -> pa.Table:
    """The replies to a bucket's messages, and what it has on the parts of hot contexts."""
    blocks, none = table.column("block").to_pylist(), [None] * len(replies)
    if parts is not None:
        blocks, replies, none = [*blocks, -1], [*replies, None], [*none, parts]
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(blocks), pa.int32()), "reply": pa.array(replies, pa.binary()), "hot": pa.array(none, HOT_KIND)})


def _hot_rests(got: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes of the hot contexts in order, what each leaves to its parent, the largest count of an entry)"""
    each = got.where("block < 0").select(F.explode("hot").alias("h")).select("h.*")
    whole = each.groupBy("context").agg(*(F.sum(f).alias(f) for f in ("entries", "occurrences", "mass", "won")), F.max("seen").alias("seen"), F.max("most").alias("most")).collect()
    of = lambda name: np.array([r[name] for r in whole], float)
    hashes = np.array([r["context"] for r in whole], np.int64).astype(np.uint64)
    order, rest = np.argsort(hashes), s.retained(*(of(f) for f in ("entries", "occurrences", "mass", "won", "seen")))
    return hashes[order], np.where(of("seen") >= s.min_count, rest, 0.0)[order], int(of("most").max(initial=0))


def suffix_tree_scores(
    docs: DataFrame, modulus: int = 10, min_count: int = 12, gain: float = 1.0, divergence: float = 0.02, discount: float = 0.6, depth: int = 3, hot: int = 1 << 20
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    spark = docs.sparkSession
    blocks = token_blocks(docs, modulus)
    tokens, words = (n or 0 for n in blocks.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    # as few buckets as what they get allows, since each has a message from each block: blocks' distinct words, positions, and a
    # block's entries behind hot contexts, of which many are equal
    s = Settings(min_count, gain, divergence, discount, hot, x.n_buckets(spark, 5 * tokens), x.n_buckets(spark, 8 * words), x.n_buckets(spark, tokens))

    def over(base: DataFrame, ask, schema: str) -> DataFrame:
        @c.lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in x.each_row(batches):
                yield ask(row, s)

        return base.mapInArrow(run, schema)

    counts = x.answered(over(blocks, word_request, x.REQUEST), _numbered, "<i8", 1, "words", _tally)
    for r in counts.where("block < 0").select("reply").toLocalIterator():
        total, distinct, most = (int(v) for v in x.unplanes(r.reply, "<i8"))
        s.total, s.distinct, s.most = s.total + total, s.distinct + distinct, max(s.most, most)
    base = c.stored_by(over(x.joined(blocks, words_got=counts), counted, COUNTED), "block", "counted-blocks")
    c.release(counts)
    c.release(blocks)
    while s.most > hot and len(s.rests) < depth:
        d = len(s.rests) + 1
        got = c.stored(over(base, lambda row, s: Block(row, s, depth).ask_hot(), ASKED).groupBy("bucket").applyInArrow(_hot_bucket(s), ANSWERS), f"hot-{d}")
        hashes, rests, s.most = _hot_rests(got, s)
        s.rests.append((hashes, rests))
        base = x.joined(base, **{f"hot_{d}": got})
    turns = [c.stored(over(base, lambda row, s, k=k: Block(row, s, depth).ask(k), ASKED).groupBy("bucket").applyInArrow(_bucket(s, depth), ANSWERS), f"answers-{k}") for k in range(TURNS)]
    answers = reduce(DataFrame.unionByName, turns)
    return over(x.joined(base, answers=answers), lambda row, s: Block(row, s, depth).scores(), SCORES)
