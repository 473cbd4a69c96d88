"""Mentions to codes: exact names first, then scored names, margins, ingredients; TF-IDF and vector neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from chartloom.functions import fixed
from chartloom.functions.similarity import indel_ratio, sorted_words
from chartloom.functions.text import drug_string, lower_squashed, tokens


def preferred(names: DataFrame, name: str, kind: str, ranks: list[str]) -> DataFrame:
    """One row a name: the kind that comes first in `ranks`."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ranks)), F.col(kind)), F.lit(0))
    w = Window.partitionBy(name).orderBy(F.when(rank == 0, len(ranks) + 1).otherwise(rank), *[x for x in names.columns if x != name])
    return names.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def token_candidates(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """(mention, name_id): names that share a token; mentions and names are joined on tokens, never crossed."""
    m = mentions.select("mention", F.explode(F.array_distinct(tokens(F.lower("mention")))).alias("t"))
    n = names.select("name_id", F.explode(F.array_distinct(tokens(F.lower("name")))).alias("t"))
    return m.join(n, "t").select("mention", "name_id").distinct()


def _marks(text: Column) -> Column:
    """array<long>: a string's characters, each numbered among its equals, the likely rarer ones first."""
    chars = F.when(F.length(text) > 0, F.array_sort(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1)))))).otherwise(F.array().cast("array<int>"))
    numbered = lambda cs: F.transform(cs, lambda c, i: F.shiftleft((i + 2 - F.array_position(cs, c)).cast("long"), 21) + c)
    return F.sort_array(F.get(F.transform(F.array(chars), numbered), F.lit(0)), False)


def within_reach(want: DataFrame, table: DataFrame, cutoff: float) -> DataFrame:
    """(mention, name_id): every pair whose Indel ratio can reach the mention's floor. want: mention, s, floor (`cutoff` or
    more); table: name_id, t.

    A ratio of r needs r / 200 of both lengths as common characters, counted with their number of times; so two
    strings that reach it share one among the first few of their characters in any common order. The join is on
    those characters alone, and how few they are depends on the floor.
    """
    least = lambda n, floor: F.ceil(n * floor / (200.0 - floor) - 1e-9)  # noqa: E731  common characters with the shortest partner
    m = want.select("mention", "s", "floor", F.length("s").alias("ls"), _marks(F.col("s")).alias("ms"))
    n = table.select("name_id", "t", F.length("t").alias("lt"), _marks(F.col("t")).alias("mt"))
    head = lambda marks, size, floor: F.slice(marks, 1, F.greatest(size - least(size, floor) + 1, F.lit(0)).cast("int"))
    m = m.select("mention", "floor", "ls", "ms", F.posexplode(head(F.col("ms"), F.col("ls"), F.col("floor"))).alias("i", "mark"))
    n = n.select("name_id", "lt", "mt", F.posexplode(head(F.col("mt"), F.col("lt"), F.lit(cutoff))).alias("j", "mark"))
    need = F.ceil(F.col("floor") * (F.col("ls") + F.col("lt")) / 200.0 - 1e-9)
    near = m.join(n, "mark").where((F.least("ls", "lt") >= need) & (F.col("i") <= F.col("ls") - need) & (F.col("j") <= F.col("lt") - need))
    both = near.dropDuplicates(["mention", "name_id"])
    return both.where(F.size(F.array_intersect("ms", "mt")) >= need).select("mention", "name_id")


def _best_codes(scored: DataFrame, k: int) -> DataFrame:
    """(mention, code, score, name_id, rank): one row a code, the k best, ties by name_id; the limit is taken
    before rows meet by mention."""
    best = scored.groupBy("mention", "code").agg(F.max_by(F.struct("score", "name_id"), F.struct("score", -F.col("name_id"))).alias("b"))
    w = Window.partitionBy("mention").orderBy(F.desc("b.score"), "b.name_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("mention", "code", F.col("b.score").alias("score"), F.col("b.name_id").alias("name_id"), "rank")


def exact_then_fuzzy(mentions: DataFrame, names: DataFrame, cutoff: float, k: int = 1, inclusive: bool = False) -> DataFrame:
    """(mention, code, score, rank): the exact names of a mention at 100, or else its k best names over the
    cutoff by sorted words, one row a code, ties in table order. mentions: mention; names: name_id, name, code.

    Complete without scoring all names: those that share a word give each mention a floor, the score of its k-th
    code so far, and only names that can reach it are scored besides. Null and empty mentions and names match nothing.
    """
    want = mentions.select("mention").distinct().withColumn("q", lower_squashed(F.col("mention"))).where("q <> ''")
    table = names.select("name_id", "code", lower_squashed(F.col("name")).alias("q")).where("q <> ''")
    exact = want.join(table, "q").select("mention", "code", "name_id", F.lit(100.0).alias("score"))
    rest = want.join(exact, "mention", "left_anti").select("mention", "q", sorted_words(F.col("q")).alias("s"))
    table = table.withColumn("t", sorted_words(F.col("q")))

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(table.select("name_id", "code", "t"), "name_id").join(rest.select("mention", "s"), "mention")
        out = both.select("mention", "code", "name_id", indel_ratio("s", "t").alias("score"))
        return out.where(F.col("score") >= cutoff if inclusive else F.col("score") > cutoff)

    alike = token_candidates(rest.select("mention"), names)
    first = scored(alike)
    floor = _best_codes(first, k).groupBy("mention").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == k)
    floors = rest.join(floor, "mention", "left").select("mention", "s", F.coalesce("low", F.lit(cutoff)).alias("floor"))
    more = within_reach(floors, table, cutoff).join(alike, ["mention", "name_id"], "left_anti")
    return _best_codes(exact.unionByName(first).unionByName(scored(more)), k).drop("name_id")


def to_ingredients(linked: DataFrame, relations: DataFrame) -> DataFrame:
    """Codes replaced by their ingredients where they have any; each code once a mention."""
    r = relations.select(F.col("code").alias("_c"), "ingredient")
    out = linked.join(r, F.col("code") == F.col("_c"), "left").withColumn("code", F.coalesce("ingredient", "code"))
    return out.groupBy("mention", "code").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))


def brand_ingredients(rel: DataFrame) -> DataFrame:
    """(code, ingredient) from concept relations, read in either direction. rel: rxcui1, stype1, rxcui2, stype2, rela, sab."""
    own = rel.where("sab = 'RXNORM' AND stype1 = 'CUI' AND stype2 = 'CUI'")
    one = own.where("rela = 'tradename_of'").select(F.col("rxcui2").alias("code"), F.col("rxcui1").alias("ingredient"))
    two = own.where("rela = 'has_tradename'").select(F.col("rxcui1").alias("code"), F.col("rxcui2").alias("ingredient"))
    return one.unionByName(two).distinct()


def drugs(mentions: DataFrame, names: DataFrame, relations: DataFrame, k: int = 1) -> DataFrame:
    """(mention, code, score, rank): drug strings without dose words looked up by name, codes as ingredients."""
    plain = mentions.select("mention").distinct().withColumn("_d", drug_string(F.col("mention"))).where("_d <> ''")
    found = exact_then_fuzzy(plain.select(F.col("_d").alias("mention")), names, fixed.DRUG_CUTOFF, k)
    return to_ingredients(plain.join(found.withColumnRenamed("mention", "_d"), "_d").drop("_d"), relations)


def by_margin(scored: DataFrame, margin: float, least: float, key: str = "mention") -> DataFrame:
    """Of a mention's two best: the first alone if both are under `least` or it leads by more than `margin`."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "code")
    two = scored.withColumns({"_n": F.row_number().over(w), "_next": F.lead("score").over(w), "_top": F.first("score").over(w)}).where("_n <= 2")
    second = F.first("_next").over(w)
    alone = second.isNull() | ((F.col("_top") < least) & (second < least)) | (F.col("_top") - second > margin)
    return two.withColumn("_alone", alone).where("_n = 1 OR NOT _alone").drop("_next", "_top", "_alone").withColumnRenamed("_n", "rank")


#: Vectors of queries sent to every task at a time, and scores that a task holds at once.
QUERY_BLOCK, SCORES = 10_000, 1 << 21
#: More than the scores of one pair of vectors can differ by the order in which products are added.
SLACK = 1e-9


def _matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(a row for each vector, its length in numbers); vectors that are null or hold a null have length -1, rows are as long as the longest."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors).cast(pa.float64())
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    out = np.zeros((len(size), max(1, size.max(initial=0))))
    if len(row):
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))] = flat.to_numpy(zero_copy_only=False)
        size[row[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
    return out, size


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added from the left as functions.similarity.cosine adds them."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt(_in_turn(rows, rows))
    return rows / np.where(norm > 0, norm, 1.0)[:, None], norm


class _Best:
    """The k best items, or the k best codes by their best item, of each query so far: scores by one matrix product a batch; what
    can be among the best is scored again, so that equal vectors have equal scores."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, k: int, by_code: bool):
        self.k, self.by_code, self.raw, self.sizes = k, by_code, vectors, sizes
        self.unit, self.norm = _unit(vectors)
        self.least = np.full(len(vectors), -np.inf)
        self.held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros(0, object)]  # query, score, whether it is null, name

    def add(self, vectors: np.ndarray, sizes: np.ndarray, names: np.ndarray) -> None:
        unit, norm = _unit(vectors)
        odd = ~np.isfinite(vectors).all(axis=1)
        wide = max(vectors.shape[1], self.raw.shape[1])
        items = np.pad(vectors, ((0, 0), (0, wide - vectors.shape[1])))
        code = pd.factorize(names)[0] if self.by_code else np.arange(len(names))
        order = np.argsort(code, kind="stable")
        begins = np.flatnonzero(np.diff(code[order], prepend=-2)) if self.by_code else None
        for lo in range(0, len(self.raw), max(1, SCORES // max(1, len(names)))):
            q = slice(lo, lo + max(1, SCORES // max(1, len(names))))
            common = min(unit.shape[1], self.unit.shape[1])
            with np.errstate(invalid="ignore", over="ignore"):
                score = self.unit[q, :common] @ unit[:, :common].T
            none = (self.sizes[q, None] != sizes) | (sizes < 0) | (norm == 0) | (self.norm[q, None] == 0)
            score[odd[None, :] | ~np.isfinite(score)] = np.inf
            score[none] = -np.inf
            top = score if begins is None else np.maximum.reduceat(score[:, order], begins, axis=1)
            here = np.partition(top, -self.k, axis=1)[:, -self.k] if top.shape[1] >= self.k else np.full(len(top), -np.inf)
            hit = np.nonzero(score >= np.maximum(self.least[q], here)[:, None] - SLACK)
            self._keep(lo + hit[0], hit[1], items, norm, none[hit], names)

    def _keep(self, query: np.ndarray, item: np.ndarray, items: np.ndarray, norm: np.ndarray, none: np.ndarray, names: np.ndarray) -> None:
        if not len(query):
            return
        raw = np.pad(self.raw, ((0, 0), (0, items.shape[1] - self.raw.shape[1])))
        score, some = np.full(len(query), np.nan), np.flatnonzero(~none)
        for lo in range(0, len(some), SCORES // 64):
            at = some[lo : lo + SCORES // 64]
            with np.errstate(invalid="ignore", over="ignore"):
                score[at] = _in_turn(raw[query[at]], items[item[at]]) / (self.norm[query[at]] * norm[item[at]])
        seen = np.unique(query)
        old = np.isin(self.held[0], seen)
        q, s, null, name = (np.concatenate([a[old], b]) for a, b in zip(self.held, (query, score, none, names[item])))
        key = np.where(null, np.inf, np.where(np.isnan(s), -np.inf, -s))
        place = pd.factorize(name, sort=True)[0]  # nulls come first
        order = np.lexsort((place, key, q))
        if self.by_code:
            order = order[np.sort(np.unique(np.stack([q[order], place[order]]), axis=1, return_index=True)[1])]
        first = np.searchsorted(q[order], q[order])
        order = order[np.arange(len(order)) - first < self.k]
        q, s, null, name, key = q[order], s[order], null[order], name[order], key[order]
        full = np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1
        self.least[q[full]] = -key[full]
        self.held = [np.concatenate([a[~old], b]) for a, b in zip(self.held, (q, s, null, name))]


def _nearest(queries: DataFrame, items: DataFrame, k: int, name: str, by_code: bool) -> DataFrame:
    """(q, name, score): the k best of each query in each task of items. queries: q, _q; items: `name`, _v."""
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    kind = StructType([StructField("q", queries.schema["q"].dataType), StructField(name, items.schema[name].dataType), StructField("score", DoubleType())])
    sent = to_arrow_schema(kind)

    def block(i: int) -> DataFrame:
        some = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)).toArrow().combine_chunks()
        vectors, sizes = _matrix(pa.array([], pa.list_(pa.float64())) if not len(some) else some["_q"].chunk(0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(vectors, sizes, k, by_code)
            for b in batches:
                if len(b) and len(vectors):
                    best.add(*_matrix(b.column("_v")), np.array(b.column(name).to_pylist() + [None], object)[:-1])
            q, score, null, names = best.held
            for lo in range(0, len(q), 1 << 16):
                at = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([some["q"].take(pa.array(q[at])).combine_chunks().cast(sent.field(0).type), pa.array(names[at].tolist(), sent.field(1).type), pa.array(score[at], mask=null[at])], schema=sent)

        return items.select(name, "_v").mapInArrow(run, kind)

    return reduce(DataFrame.unionByName, map(block, range(blocks)))


def nearest(queries: DataFrame, items: DataFrame, k: int, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """(q, id, score, rank): the k items of highest cosine of each of a stated set of queries; ties by id.

    Every pair is scored, by matrix products: queries go to the items in blocks of a bounded size, a task holds a bounded number of scores
    and hands on its k best a query. Vectors without a cosine (null, of zeros, of another length) have a null score and come last.
    """
    found = _nearest(queries.select(F.col(id_col).alias("q"), F.col(vec).alias("_q")), items.select(F.col(id_col).alias("id"), F.col(vec).alias("_v")), k, "id", False)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_codes(queries: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(q, code, score): at least the k codes of highest cosine of each query, a code by its best name; ties by code. A task hands on its own k
    best codes: one that k others beat there is beaten by them everywhere. queries: id, embedding; names: code, embedding."""
    found = _nearest(queries.select(F.col("id").alias("q"), F.col("embedding").alias("_q")), names.select("code", F.col("embedding").alias("_v")), k, "code", True)
    return found.groupBy("q", "code").agg(F.max("score").alias("score"))


def merged(first: DataFrame, second: DataFrame, key: str = "mention") -> DataFrame:
    """Two ranked lists one after the other; a code stays where it comes first."""
    both = first.withColumn("_s", F.lit(0)).unionByName(second.withColumn("_s", F.lit(1)))
    w = Window.partitionBy(key, "code").orderBy("_s", "rank")
    kept = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_s", "rank"))).drop("_s")


def char_grams(names: DataFrame, id_col: str, text: str, low: int = 2, high: int = 4) -> DataFrame:
    """(id, gram, tf): character n-grams of space-padded words; a word shorter than n gives itself once."""
    word = names.select(F.col(id_col).alias("id"), F.explode(tokens(F.lower(F.col(text)))).alias("w")).withColumn("p", F.concat(F.lit(" "), "w", F.lit(" ")))
    sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n <= F.length("p")) | (n == low))
    gram = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("p") - n + 1, F.lit(1))), lambda i: F.substring(F.col("p"), i, n))))
    return word.select("id", F.explode(gram).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))


def tfidf(terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(id, term, w): unit vectors of tf * (ln((1 + n) / (1 + df)) + 1). terms: id, term, tf; n_docs: one row n."""
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    raw = terms.join(df, "term").join(F.broadcast(n_docs.select("n")), F.lit(True)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # rows move by id once, and not to be met by their own sums
    return raw.select("id", "term", (F.col("w") / norm).alias("w"))
