"""Similarities of strings, sets and vectors. Set measures are expressions; the Indel ratios and the word error
rate, which are dynamic programs over characters and words, are Arrow UDFs, the ratios over distinct pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chartloom.functions.text import tokens


def _ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b), the LCS by bit-parallel rows (one integer for a row)."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _sorted_words(s: str) -> str:
    return " ".join(sorted(s.split()))


def _set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    p, q = (" ".join(filter(None, [both, " ".join(z)])) for z in (left, right))
    return max(_ratio(p, q), *((_ratio(both, p), _ratio(both, q)) if both else (0.0,)))


def _pairwise(score):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


indel_ratio = _pairwise(_ratio)
token_sort_ratio = _pairwise(lambda a, b: _ratio(_sorted_words(a), _sorted_words(b)))
token_set_ratio = _pairwise(_set_ratio)


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(tokens(text)), " ")


def _word_edits(ref: list[str], hyp: list[str]) -> int:
    """Levenshtein distance over words by bit-parallel columns (one integer for the differences down a column)."""
    where: dict[str, int] = {}
    for i, word in enumerate(ref):
        where[word] = where.get(word, 0) | 1 << i
    edits, full, last = len(ref), (1 << len(ref)) - 1, 1 << len(ref) >> 1
    up, down = full, 0
    for word in hyp:
        hit = where.get(word, 0)
        cross = (((hit & up) + up) ^ up) | hit
        right, left = (down | ~(cross | up)) & full, up & cross
        edits += 1 if not full or right & last else -1 if left & last else 0
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = (left | ~(hit | down | right)) & full, right & (hit | down)
    return edits


@F.pandas_udf(DoubleType())
def word_error_rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Word edits over reference words, 1 at most; arrays of words, of which a null one scores 1."""
    rate = lambda r, h: 1.0 if r is None or h is None else min(1.0, _word_edits(r, h) / len(r)) if len(r) else float(len(h) > 0)
    return pd.Series([rate(r, h) for r, h in zip(ref, hyp)], dtype="float64")


def set_jaccard(gold: Column, pred: Column) -> Column:
    both, either = F.size(F.array_intersect(gold, pred)), F.size(F.array_union(gold, pred))
    return F.when(either == 0, 1.0).when(F.size(gold) == 0, 0.0).otherwise(both / either)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
