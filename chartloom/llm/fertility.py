"""Quality rules from tokeniser fertility.

Two public vocabularies measure every whole text, white space and line ends included: a piece vocabulary with
byte fallback and a byte-level one for many languages. Per document: characters per token of either, the share
of tokens that are fallback bytes, and the entropy of the token distribution relative to its maximum. Runs of
over RUN characters without white space, or of it, are measured in pieces of RUN, as byte-level merging takes
quadratic time in them. The bands within which a document stays are robust statistics (median and median
absolute deviation) of all documents of the same language (lang; the dominant script where lang is null), widened
for short texts, whose measures scatter. They come from counts on a fixed grid of GRID steps a unit, so they are
exact on that grid and the same however the rows are dealt.

Words and lines are told apart by their bytes: hashes only say which to compare.

Edge cases: null and empty texts have no words and fail the base rules; equal rows get equal verdicts;
a language with one document keeps it (its own median); texts are read whole whatever their length;
other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm import common as c

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
RUN = 1024
_CUTS = re.compile(rf"\S{{{RUN}}}(?=\S)|\s{{{RUN}}}(?=\s)")
GRID = 1024
#: Measures over this many grid steps count as this many; a median there would be of texts without words.
LAST = 1 << 16
#: Bands are sent to every task up to so many languages; beyond, rows are joined with them.
FEW = 10_000
NAMES = ["chars_per_piece", "piece_entropy", "chars_per_byte_token", "fallback_share"]

MEASURED = (
    "doc_id long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " chars_per_piece double, fallback_share double, piece_entropy double, chars_per_byte_token double, n_pieces long"
)


def _segments(text: str) -> list[str]:
    ends = [m.end() for m in _CUTS.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]


class Vocabularies:
    """The two tokenisers of a worker; nothing is remembered between texts."""

    def __init__(self, piece_model: bytes, ranks: bytes):
        import base64

        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bytes = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own, special_tokens={})

    def tokens(self, text: str) -> tuple[np.ndarray, int]:
        """(piece ids, number of byte-level tokens) of a whole text."""
        ids, n = [], 0
        for part in _segments(text):
            ids.append(np.array(self.pieces.encode(part), np.int32))
            n += len(self.bytes.encode_ordinary(part))
        return np.concatenate(ids), n


def _repeats(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each word whether some 8-word window over it stands twice or more in its text.

    Windows are named by doubling: a number for each two words, for each four, for each eight.
    """
    n = len(ids)
    covered = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        name = ids
        for step in (1, 2, 4):
            name = np.unique(name[:-step] * (int(name.max()) + 1) + name[step:], return_inverse=True)[1]
        start = np.flatnonzero(row[: len(name)] == row[WINDOW - 1 :])
        key = row[start] * (int(name.max()) + 1) + name[start]
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(order), bool)
        eq = key[order][1:] == key[order][:-1]
        same[1:] |= eq
        same[:-1] |= eq
        twice = start[order[same]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    return np.cumsum(covered[:n]) > 0


def _dup_lines(buf: np.ndarray, off: np.ndarray, word_starts: np.ndarray, n_rows: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text, counted by row."""
    s, e, row = c.spans(buf != 10, off)  # empty lines have no word
    if not len(s):
        return np.zeros(n_rows, np.int64)
    has = np.searchsorted(word_starts, e) > np.searchsorted(word_starts, s)
    s, e, row = s[has], e[has], row[has]
    ids = c.exact_ids(buf, s, e)
    _, first = np.unique(row * (len(ids) + 1) + ids, return_index=True)
    dup = np.ones(len(ids), bool)
    dup[first] = False
    return np.bincount(row[dup], minlength=n_rows)


def _scripts(buf: np.ndarray, off: np.ndarray) -> list[str]:
    """The dominant script class of each row by lead bytes: a stand-in where no language is given."""
    kind = np.zeros(256, np.int8)
    kind[65:91] = kind[97:123] = kind[0xC3:0xCA] = 1
    kind[0xCE:0xD0] = 2
    kind[0xD0:0xD4] = 3
    kind[0xD7:0xE0] = 4
    kind[0xE0:0xF5] = 5
    names = ["none", "latin", "greek", "cyrillic", "semitic", "other"]
    got = kind[buf]
    tallies = [np.diff(np.concatenate([[0], np.cumsum(got == k)])[off]) for k in range(1, 6)]
    return [names[1 + int(np.argmax(t))] if max(t) else "none" for t in zip(*tallies)]


def _measure(own: Vocabularies, part: pa.RecordBatch, buf: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    n = part.num_rows
    inside = ~c.SPACE[buf]
    s, e, row = c.spans(inside, off)
    n_words = np.bincount(row, minlength=n)
    summed = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
    lead = (buf & 0xC0) != 0x80
    word_chars, chars, symbols = summed(lead & inside), summed(lead), summed(SYMBOLS[buf])
    repeat = np.bincount(row[_repeats(c.exact_ids(buf, s, e), row)], minlength=n) if len(s) else np.zeros(n, np.int64)
    dup = _dup_lines(buf, off, s, n)

    n_pieces, fallback, entropy, n_bytes = (np.zeros(n, k) for k in (np.int64, np.int64, float, np.int64))
    raw = buf.tobytes()
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if n_words[i]:
            ids, n_bytes[i] = own.tokens(raw[a:b].decode("utf-8", "replace"))
            n_pieces[i], fallback[i] = len(ids), own.fallback[ids].sum()
            p = np.unique(ids, return_counts=True)[1] / len(ids)
            entropy[i] = -(p * np.log2(p)).sum() / np.log2(max(len(ids), 2))
    lang = part.column("lang").to_pylist() if "lang" in part.schema.names else [None] * n
    if None in lang:
        lang = [x if x is not None else "script:" + y for x, y in zip(lang, _scripts(buf, off))]
    one = np.maximum(n_pieces, 1)
    out = [
        part.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), *(pa.array(x.astype(np.int64)) for x in (n_words, word_chars, symbols, dup, repeat)),
        pa.array(chars / one), pa.array(fallback / one), pa.array(entropy), pa.array(chars / np.maximum(n_bytes, 1)), pa.array(n_pieces),
    ]
    return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in MEASURED.split(",")])


_own: list[Vocabularies] = []


def measures(docs: DataFrame, piece_model: bytes, ranks: bytes) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast((piece_model, ranks))  # two files of under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c.worker_of("fertility", _own.clear)
        if not _own:
            _own.append(Vocabularies(*shipped.value))
        for batch in batches:
            for part, buf, off in c.chunks(batch):
                yield _measure(_own[0], part, buf, off)

    cols = ["doc_id", "text", *(["lang"] if "lang" in docs.columns else [])]
    return docs.select(*cols).mapInArrow(c.lean(run), MEASURED)


def _middle(pairs: Column) -> Column:
    """The lower median of array<struct<v, n>>, sorted by v, n being how often v occurs."""
    half = F.floor((F.aggregate(pairs, F.lit(0).cast("long"), lambda a, p: a + p["n"]) + 1) / 2)
    start = F.struct(half.alias("half"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("v"))
    step = lambda a, p: F.struct(a["half"].alias("half"), (a["seen"] + p["n"]).alias("seen"), F.coalesce(a["v"], F.when(a["seen"] + p["n"] >= a["half"], p["v"])).alias("v"))
    return F.aggregate(pairs, start, step, lambda a: a["v"])


def bands(m: DataFrame) -> DataFrame:
    """band with mid_ and mad_ of each measure over its documents of 20 words or more."""
    step = lambda x: F.least(F.floor(F.col(x) * GRID), F.lit(LAST)).cast("int")
    each = m.where("n_words >= 20").select("band", F.explode(F.array(*[F.struct(F.lit(x).alias("name"), step(x).alias("v")) for x in NAMES])).alias("c"))
    counts = each.groupBy("band", "c.name", "c.v").agg(F.count("*").alias("n"))
    # at most LAST counts for each language and measure, whatever the number of documents
    grid = counts.groupBy("band", "name").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("h")).withColumn("mid", _middle(F.col("h")))
    away = F.array_sort(F.transform("h", lambda p: F.struct(F.abs(p["v"] - F.col("mid")).alias("v"), p["n"].alias("n"))))
    both = grid.select("band", "name", (F.col("mid") + 0.5) / GRID, _middle(away) / GRID).toDF("band", "name", "mid", "mad")
    value = lambda x, kind: F.max(F.when(F.col("name") == x, F.col(kind))).alias(f"{kind}_{x}")
    return both.groupBy("band").agg(*(value(x, kind) for x in NAMES for kind in ("mid", "mad")))


def fertility_verdicts(docs: DataFrame, piece_model: bytes, ranks: bytes, width: float = 8.0, floor: float = 0.08, short: float = 160.0) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the measures behind the verdict.

    A measure fails if it lies over `width` median absolute deviations (each at least `floor` times the
    median, for even corpora) from its language's median, times 1 + sqrt(short / pieces).
    """
    m = c.stored(measures(docs, piece_model, ranks), "fertility")
    own = c.stored(bands(m), "fertility-bands")
    slack = width * (1 + F.sqrt(F.lit(short) / F.greatest("n_pieces", F.lit(1))))
    dev = {x: F.col(x) - F.col(f"mid_{x}") for x in NAMES}
    room = {x: slack * F.greatest(F.col(f"mad_{x}"), F.lit(floor / width) * F.col(f"mid_{x}") if x != "fallback_share" else F.lit(0.01)) for x in NAMES}
    bad = (
        (F.abs(dev["chars_per_piece"]) > room["chars_per_piece"]) | (F.abs(dev["chars_per_byte_token"]) > room["chars_per_byte_token"])
        | (dev["fallback_share"] > room["fallback_share"]) | (dev["piece_entropy"] < -room["piece_entropy"])
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = m.join(F.broadcast(own) if own.count() <= FEW else own, "band", "left").withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("band").alias("fertility_band"), *NAMES)
