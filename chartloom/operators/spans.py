"""Algebra of character spans [start, end): owners, one-to-one matching, islands, overlap removal."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from chartloom.functions import fixed


#: Characters of a position bucket: spans meet in the buckets they touch, so a long text is many small groups.
BUCKET = 256


def _overlapping(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """left and right (columns of different names but for key) where their intervals overlap: an equi-join on key and
    position bucket, each pair in the bucket where the later of the two begins."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / BUCKET), F.floor((F.col(hi) - 1) / BUCKET)))
    x = left.where(F.col(a[0]) < F.col(a[1])).withColumn("_cell", cells(*a))
    y = right.where(F.col(b[0]) < F.col(b[1])).withColumn("_cell", cells(*b))
    meets = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col("_cell") == F.floor(F.greatest(a[0], b[0]) / BUCKET))
    return x.join(y, [key, "_cell"]).where(meets).drop("_cell")


def owners(words: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each word with the span (idx) that covers most of it, the lowest idx of equals; null without overlap.

    words: key, pos, start, end; spans: key, idx, start, end and more. The best span of a word is an aggregate, so
    no word is sorted. Null keys and empty intervals own and are owned by nothing.
    """
    s = spans.select(F.col(key), F.col("idx").alias("_i"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = _overlapping(words.select(key, "pos", "start", "end"), s, key, ("start", "end"), ("_s", "_e"))
    size = F.least("end", "_e") - F.greatest("start", "_s")
    best = hit.groupBy(key, "pos").agg(F.max_by("_i", F.struct(size, -F.col("_i"))).alias("owner"), F.max(size).alias("overlap"))
    return words.join(best, [key, "pos"], "left")


def bio(owned: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """owned words with label: B- on a span's first word, I- on its others, O without an owner.

    labels: key, idx, label. `broken` tells words of spans whose words aren't consecutive.
    """
    w = Window.partitionBy(key, "owner")
    out = owned.join(labels.select(key, F.col("idx").alias("owner"), F.col("label").alias("_l")), [key, "owner"], "left")
    first = F.row_number().over(w.orderBy("pos")) == 1
    broken = F.max("pos").over(w) - F.min("pos").over(w) + 1 != F.count("*").over(w)
    has = F.col("owner").isNotNull() & F.col("_l").isNotNull()
    return out.withColumns({"label": F.when(has, F.concat(F.when(first, "B-").otherwise("I-"), "_l")).otherwise("O"), "broken": has & broken}).drop("_l")


def islands(words: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """BIO labels grouped: key, kind, start, end, n_words. An I- that continues nothing opens a group."""
    w = Window.partitionBy(key).orderBy(*order)
    kind = F.when(F.substring("label", 1, 2).isin("B-", "I-"), F.expr("substring(label, 3)"))
    k = words.withColumn("kind", kind)
    opens = F.col("kind").isNotNull() & ~(F.col("label").startswith("I-") & F.lag("kind").over(w).eqNullSafe(F.col("kind")))
    k = k.withColumn("island", F.sum(opens.cast("int")).over(w)).where(F.col("kind").isNotNull())
    return k.groupBy(key, "island").agg(F.first("kind").alias("kind"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_words")).drop("island")


class _Owned:
    """The atoms of a batch of texts with the span that owns each: all texts of the batch at once, positions set apart by text."""

    def __init__(self, texts: pa.Array, listed: pa.Array, pattern: str):
        import regex

        find = regex.compile(pattern).finditer
        places = [[m.span() for m in find(t)] if t is not None else [] for t in texts.to_pylist()]
        count = np.fromiter(map(len, places), np.int64, len(places))
        at = np.fromiter(chain.from_iterable(chain.from_iterable(places)), np.int64, 2 * int(count.sum())).reshape(-1, 2)
        self.texts, self.places, self.count, self.start, self.end = texts, places, count, at[:, 0], at[:, 1]
        self.text = np.repeat(np.arange(len(count)), count)
        size = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
        idx, lo, hi, self.label = pc.list_flatten(listed).flatten()
        there = pc.and_(pc.is_valid(idx), pc.fill_null(pc.less(lo, hi), False)).to_numpy(zero_copy_only=False)
        idx, lo, hi = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (idx, lo, hi))
        of = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((idx, lo, of))
        order = order[there[order]]
        idx, lo, hi = idx[order], (of[order] << 32) + lo[order], (of[order] << 32) + hi[order]
        a, b = (self.text << 32) + self.start, (self.text << 32) + self.end
        first = np.searchsorted(np.maximum.accumulate(hi), a, "right")
        n = np.maximum(np.searchsorted(lo, b, "left") - first, 0)
        own, self.overlap = np.full(len(a), -1), np.zeros(len(a), np.int64)
        total = np.cumsum(n)
        begin = 0
        while begin < len(n):  # a bounded number of pairs at a time
            end = max(begin + 1, int(np.searchsorted(total, total[begin] - n[begin] + PAIRS_AT_ONCE, "right")))
            m = n[begin:end]
            word = np.repeat(np.arange(begin, end), m)
            span = np.arange(len(word)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[begin:end], m)
            common = np.minimum(b[word], hi[span]) - np.maximum(a[word], lo[span])
            word, span, common = (x[common > 0] for x in (word, span, common))
            best = np.lexsort((idx[span], -common, word)) if (m > 1).any() else np.arange(len(word))
            best = best[np.diff(word[best], prepend=-1) != 0]
            own[word[best]], self.overlap[word[best]] = span[best], common[best]
            begin = end
        self.has = own >= 0
        self.owner = np.zeros(len(a), np.int64) if not len(idx) else idx[own]
        self.span = np.full(len(a), -1) if not len(idx) else np.where(self.has, order[own], -1)
        # spans of one text with one idx are one owner
        same = np.unique(np.stack([of[order], idx]), axis=1, return_inverse=True)[1].reshape(-1)
        group = np.zeros(len(a), np.int64) if not len(idx) else same[own]
        self.opens, self.broken = np.zeros(len(a), bool), np.zeros(len(a), bool)
        place = np.flatnonzero(self.has)
        if len(place):
            least, most = np.zeros((2, len(idx)), np.int64)
            most[group[place]], least[group[place[::-1]]] = place, place[::-1]
            much = np.bincount(group[place], minlength=len(idx))
            self.opens[place] = least[group[place]] == place
            self.broken[place] = (most - least + 1 != much)[group[place]]

    def lists(self, fields: dict[str, pa.Array], count: np.ndarray) -> pa.ListArray:
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    def words(self, surface: bool) -> pa.ListArray:
        whole = lambda x, none=None: pa.array(x.astype(np.int32), mask=none)
        pos = np.arange(len(self.start)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        text = [t[a:b] for t, at in zip(self.texts.to_pylist(), self.places) for a, b in at] if surface else [""] * len(pos)
        labelled = self.has & self.known()
        label = pc.if_else(pa.array(labelled), pc.binary_join_element_wise(pc.if_else(pa.array(self.opens), "B", "I"), self.labels(), "-"), "O")
        fields = {"pos": whole(pos), "surface": pa.array(text, pa.string()), "start": whole(self.start), "end": whole(self.end), "owner": whole(self.owner, ~self.has), "overlap": whole(self.overlap, ~self.has)}
        return self.lists(fields | {"label": label, "broken": pa.array(labelled & self.broken)}, self.count)

    def labels(self) -> pa.Array:
        return self.label.take(pa.array(self.span, mask=self.span < 0))

    def known(self) -> np.ndarray:
        return pc.is_valid(self.labels()).to_numpy(zero_copy_only=False)

    def islands(self) -> pa.ListArray:
        kind = pc.fill_null(pc.index_in(self.label, value_set=pc.unique(self.label.drop_null())), -1).to_numpy(zero_copy_only=False)
        kind = np.where(self.span < 0, -1, kind[self.span]) if len(kind) else np.full(len(self.span), -1)
        goes_on = ~self.opens & (np.diff(self.text, prepend=-1) == 0) & (kind == np.concatenate([[-1], kind[:-1]]))
        some = kind >= 0
        first = np.flatnonzero(some & ~goes_on)
        group = (np.cumsum(some & ~goes_on) - 1)[some]
        last = np.zeros(len(first), np.int64)
        last[group] = np.flatnonzero(some)
        fields = {"kind": self.labels().take(pa.array(first)), "start": pa.array(self.start[first].astype(np.int32)), "end": pa.array(self.end[last].astype(np.int32)), "n_words": pa.array(np.bincount(group, minlength=len(first)))}
        return self.lists(fields, np.bincount(self.text[first], minlength=len(self.count)))


#: Pairs of words and spans that a task holds at once.
PAIRS_AT_ONCE = 1 << 21
WORDS = "array<struct<pos:int,surface:string,start:int,end:int,owner:int,overlap:int,label:string,broken:boolean>>"
ISLANDS = "array<struct<kind:string,start:int,end:int,n_words:long>>"


def _with_spans(docs: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """docs with _s, the spans of each text: texts move once, and no word does."""
    label = F.col("label").cast("string") if "label" in spans.columns else F.lit(None).cast("string")
    listed = spans.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), label.alias("label"))).alias("_s"))
    return docs.select(key, text).join(listed, key, "left")


def labelled_atoms(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = fixed.ATOM, surface: bool = True) -> DataFrame:
    """(key, pos, surface, start, end, owner, overlap, label, broken): what owners() and bio() give for the atoms of texts, a text at a time: its
    words are found and labelled where it is. spans: key, idx, start, end, and label if there are any. surface: False leaves these empty."""

    @F.arrow_udf(WORDS)
    def run(texts: pa.Array, listed: pa.Array) -> pa.Array:
        return _Owned(texts, listed, pattern).words(surface)

    return _with_spans(docs, spans, key, text).select(key, F.explode(run(F.col(text), F.col("_s"))).alias("w")).select(key, "w.*")


def atom_islands(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = fixed.ATOM) -> DataFrame:
    """(key, kind, start, end, n_words): islands() of labelled_atoms()."""

    @F.arrow_udf(ISLANDS)
    def run(texts: pa.Array, listed: pa.Array) -> pa.Array:
        return _Owned(texts, listed, pattern).islands()

    return _with_spans(docs, spans, key, text).select(key, F.explode(run(F.col(text), F.col("_s"))).alias("w")).select(key, "w.*")


def concept_lines(rows: DataFrame, key: str = "file", kept: list[str] | None = None) -> DataFrame:
    """(key, text, kind, first, last): the words of each BIO group, joined by blanks, with its first and last line number.

    rows: key, line, word, label, a null word for a blank line. Labels of kinds not in `kept` are read as O.
    """
    w = Window.partitionBy(key).orderBy("line")
    kind = F.when(F.col("word").isNotNull() & F.substring("label", 1, 2).isin("B-", "I-") & (F.length("label") > 2), F.expr("substring(label, 3)"))
    kind = kind if kept is None else F.when(kind.isin(kept), kind)
    k = rows.withColumn("_kind", kind)
    opens = F.col("_kind").isNotNull() & ~(F.col("label").startswith("I-") & F.lag("_kind").over(w).eqNullSafe(F.col("_kind")))
    k = k.withColumn("_group", F.sum(opens.cast("int")).over(w)).where(F.col("_kind").isNotNull())
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "word"))), lambda x: x["word"]), " ")
    return k.groupBy(key, "_group").agg(words.alias("text"), F.first("_kind").alias("kind"), F.min("line").alias("first"), F.max("line").alias("last")).drop("_group")


def blocks(words: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """words (key, pos, word, label) with block: runs of at most `most` words, cut after the last sentence end in a run's last
    quarter where there is one; words without a character are left out, and so are the I- words a block begins with."""
    from chartloom.operators.words import packed

    ends = F.substring("word", -1, 1).isin(fixed.SENTENCE_ENDS)
    listed = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(ends, F.lit(False)).alias("e")))).alias("w"))
    cut = listed.select(key, "w", F.posexplode(packed(F.transform("w", lambda x: F.lit(1)), F.transform("w", lambda x: x["e"]), most)).alias("block", "c"))
    rows = cut.select(key, "block", F.explode(F.slice("w", F.col("c.lo") + 1, F.col("c.hi") - F.col("c.lo"))).alias("x")).select(key, "block", "x.pos").join(words, [key, "pos"])
    begins = F.min(F.when(~F.col("label").startswith("I-"), F.col("pos"))).over(Window.partitionBy(key, "block"))
    return rows.withColumn("_from", begins).where("pos >= _from AND trim(word) <> ''").drop("_from")


def runs(df: DataFrame, key: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """Maximal runs of an equal value in a key's order: key, run, value, n."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


PAIRS = ArrayType(StructType([StructField(x, IntegerType()) for x in "ogp"]))


@F.pandas_udf(PAIRS)
def _taken(pairs: pd.Series) -> pd.Series:
    """Of pairs in order those whose ends are both free; one pass with the sets of ends in use."""

    def of(listed) -> list[dict]:
        used_g, used_p, out = set(), set(), []
        for x in listed:
            if x["g"] not in used_g and x["p"] not in used_p:
                used_g.add(x["g"])
                used_p.add(x["p"])
                out.append(x)
        return out

    return pairs.map(of)


def greedy_pairs(gold: DataFrame, pred: DataFrame, key: str = "doc_id", same_type: bool = True) -> DataFrame:
    """One-to-one pairs (key, g, p, overlap) taken by largest overlap, then lowest g, then lowest p.

    gold and pred: key, idx, type, start, end. Only overlapping pairs meet; a document's are folded over in that
    total order, in linear time. Null types pair with nothing where types count.
    """
    g = gold.select(key, F.col("idx").cast("int").alias("g"), F.col("type").alias("_gt"), F.col("start").alias("_gs"), F.col("end").alias("_ge"))
    p = pred.select(key, F.col("idx").cast("int").alias("p"), F.col("type").alias("_pt"), F.col("start").alias("_ps"), F.col("end").alias("_pe"))
    pairs = _overlapping(g, p, key, ("_gs", "_ge"), ("_ps", "_pe"))
    if same_type:
        pairs = pairs.where(F.col("_gt") == F.col("_pt"))
    pairs = pairs.select(key, (F.greatest("_gs", "_ps") - F.least("_ge", "_pe")).cast("int").alias("o"), "g", "p")
    listed = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "g", "p"))).alias("c"))
    return listed.select(key, F.explode(_taken("c")).alias("t")).select(key, "t.g", "t.p", (-F.col("t.o")).alias("overlap"))


def unmatched(side: DataFrame, pairs: DataFrame, which: str, key: str = "doc_id") -> DataFrame:
    return side.join(pairs.select(key, F.col(which).alias("idx")), [key, "idx"], "left_anti")


def without_overlaps(spans: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("start", "source", "-len")) -> DataFrame:
    """Spans kept from the left: by start, source, longest first; one that starts before the last kept ends goes.

    With spans sorted by start and none empty, the last kept end is the only thing to compare with.
    """
    rest = [F.col(x) for x in spans.columns if x != key]
    src = F.col("source") if "source" in spans.columns else F.lit(0)
    keyed = F.struct(F.col("start").alias("_1"), src.alias("_2"), (F.col("start") - F.col("end")).alias("_3"), F.struct(*rest).alias("s"))
    listed = spans.groupBy(key).agg(F.array_sort(F.collect_list(keyed)).alias("c"))
    kind = listed.schema["c"].dataType.simpleString()
    kept = F.aggregate("c", F.array().cast(kind), lambda t, x: F.when((F.size(t) > 0) & (F.element_at(t, -1)["s"]["end"] > x["s"]["start"]), t).otherwise(F.concat(t, F.array(x))))
    return listed.select(key, F.explode(F.transform(kept, lambda x: x["s"])).alias("s")).select(key, "s.*")


def adjacent_overlaps(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans that the next one (by start, end, idx) begins inside."""
    w = Window.partitionBy(key).orderBy("start", "end", "idx")
    return spans.withColumn("next_start", F.lead("start").over(w)).where("next_start < end")


def occurrences(text: Column, surface: Column) -> Column:
    """array<int>: starts of the non-overlapping occurrences of surface in text, in code points."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), surface, F.lit(r"\E")))
    starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, p: F.struct((a["at"] + F.length(p) + F.length(surface)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(p))).alias("out")), lambda a: a["out"])
    return F.slice(starts, 1, F.size(parts) - 1)
