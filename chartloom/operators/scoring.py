"""Scores of predicted against gold spans: text, assertions, candidates; per document, corpus, type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions import fixed
from chartloom.functions.similarity import set_jaccard, word_error_rate
from chartloom.functions.text import nfc, tokens
from chartloom.operators.spans import greedy_pairs, unmatched


def paired(gold_docs: DataFrame, pred_docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(gold documents with has_pred, predicted documents that gold doesn't have)."""
    g, p = gold_docs.select(key).distinct(), pred_docs.select(key).distinct()
    return g.join(p.withColumn("has_pred", F.lit(True)), key, "left").fillna(False), p.join(g, key, "left_anti")


def _words(text, lower: bool, strip: bool):
    t = nfc(text)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " ") if strip else t
    return tokens(F.lower(t) if lower else t)


def documents(docs: DataFrame, gold: DataFrame, pred: DataFrame, scope: str = "all", lower: bool = False, strip: bool = False, key: str = "doc_id") -> DataFrame:
    """A score row for each document of docs.

    gold, pred: key, idx, text, type, start, end, assertions, candidates. Missed and spurious spans count 0
    in each score that their type takes part in; a document without units scores 1. Candidates weigh one
    more than the gold codes.
    """
    pairs = greedy_pairs(gold, pred, key)
    missed, spurious = unmatched(gold, pairs, "g", key), unmatched(pred, pairs, "p", key)
    wrong = greedy_pairs(missed, spurious, key, same_type=False)
    side = lambda d, n: d.select(key, F.col("idx").alias(n), *[F.col(x).alias(f"{n}_{x}") for x in ("text", "type", "assertions", "candidates")])
    both = pairs.join(side(gold, "g"), [key, "g"]).join(side(pred, "p"), [key, "p"])
    unit = F.lit(1.0) - word_error_rate(F.col("_gw"), F.col("_pw"))
    matched = both.withColumns({"_gw": _words(F.col("g_text"), lower, strip), "_pw": _words(F.col("p_text"), lower, strip)}).select(
        key, F.col("g_type").alias("type"), unit.alias("t"), set_jaccard(F.col("g_assertions"), F.col("p_assertions")).alias("a"), set_jaccard(F.col("g_candidates"), F.col("p_candidates")).alias("c"), (F.size(F.array_distinct("g_candidates")) + 1).alias("w"), F.lit("matched").alias("how")
    )
    zero = lambda d, how, w: d.select(key, "type", *[F.lit(0.0).alias(x) for x in "tac"], w.alias("w"), F.lit(how).alias("how"))
    units = matched.unionByName(zero(missed, "missed", F.size(F.array_distinct("candidates")) + 1)).unionByName(zero(spurious, "spurious", F.lit(1)))
    flagged = F.col("type").isin(fixed.ASSERTION_TYPES)
    coded = F.lit(True) if scope == "all" else F.col("type").isin(fixed.CODEABLE_TYPES)
    count = lambda how: F.count_if(F.col("how") == how)
    rows = units.groupBy(key).agg(
        F.avg("t").alias("text"), F.avg(F.when(flagged, F.col("a"))).alias("assertions"), F.avg(F.when(coded, F.col("c"))).alias("candidates"), F.sum(F.when(coded, F.col("w"))).alias("weight"),
        (count("matched") + count("missed")).alias("n_gold"), (count("matched") + count("spurious")).alias("n_pred"), count("matched").alias("n_matched"), count("missed").alias("n_missed"), count("spurious").alias("n_spurious"),
    )
    rows = docs.select(key).distinct().join(rows, key, "left").join(wrong.groupBy(key).agg(F.count("*").alias("n_wrong_type")), key, "left")
    return rows.fillna(1.0, ["text", "assertions", "candidates"]).fillna(0)


def corpus(scores: DataFrame) -> DataFrame:
    """One row: macro means of text and assertions, the weighted mean of candidates, and the final score."""
    w = F.sum("weight")
    out = scores.agg(F.avg("text").alias("text"), F.avg("assertions").alias("assertions"), F.coalesce(F.when(w > 0, F.sum(F.col("candidates") * F.col("weight")) / w), F.avg("candidates")).alias("candidates"), w.alias("weight"))
    return out.withColumn("final", sum(F.col(k) * v for k, v in fixed.WEIGHTS.items()))


def by_type(gold: DataFrame, pred: DataFrame, key: str = "doc_id") -> DataFrame:
    """(type, n_gold, n_pred, n_matched, n_missed, n_spurious, precision, recall, text, assertions, candidates), the
    scored types first; the last three are means over matched pairs, assertions only for types that carry them.

    gold and pred without assertions or candidates are read as without any.
    """
    none = F.array().cast("array<string>")
    full = lambda d: d.select(key, "idx", "type", "text", *[F.coalesce(F.col(x), none).alias(x) if x in d.columns else none.alias(x) for x in ("assertions", "candidates")])
    side = lambda d, n: full(d).select(key, F.col("idx").alias(n), *[F.col(x).alias(f"{n}_{x}") for x in ("type", "text", "assertions", "candidates")])
    both = greedy_pairs(gold, pred, key).join(side(gold, "g"), [key, "g"]).join(side(pred, "p"), [key, "p"])
    words = both.withColumns({"_gw": _words(F.col("g_text"), False, False), "_pw": _words(F.col("p_text"), False, False)})
    m = words.groupBy(F.col("g_type").alias("type")).agg(
        F.count("*").alias("n_matched"), F.avg(1.0 - word_error_rate("_gw", "_pw")).alias("text"),
        F.avg(F.when(F.col("g_type").isin(fixed.ASSERTION_TYPES), set_jaccard(F.col("g_assertions"), F.col("p_assertions")))).alias("assertions"),
        F.avg(set_jaccard(F.col("g_candidates"), F.col("p_candidates"))).alias("candidates"),
    )
    g, p = (d.groupBy("type").agg(F.count("*").alias(n)) for d, n in ((gold, "n_gold"), (pred, "n_pred")))
    counts = ["n_gold", "n_pred", "n_matched"]
    out = g.join(p, "type", "full").join(m, "type", "left").fillna(0, counts)
    out = out.withColumns({"n_missed": F.col("n_gold") - F.col("n_matched"), "n_spurious": F.col("n_pred") - F.col("n_matched"), "precision": F.try_divide("n_matched", "n_pred"), "recall": F.try_divide("n_matched", "n_gold")})
    place = F.array_position(F.array(*map(F.lit, fixed.OUTPUT_TYPES)), F.col("type"))
    return out.orderBy(F.when(place == 0, 99).otherwise(place), "type")


def unofficial(spans: DataFrame) -> DataFrame:
    """(type, n) of the types that aren't scored, null included, the most frequent first."""
    return spans.where(~F.coalesce(F.col("type").isin(fixed.OUTPUT_TYPES), F.lit(False))).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def worst(scores: DataFrame, n: int, score: str = "final", key: str = "doc_id") -> DataFrame:
    """The n rows of lowest score, ties by key; nulls first."""
    return scores.orderBy(score, key).limit(n)


def best_cutoff(swept: DataFrame) -> DataFrame:
    """(cutoff, k, jaccard): the row of highest mean; of equal ones the first by cutoff, then by k."""
    return swept.orderBy(F.desc("jaccard"), "cutoff", "k").limit(1)


def ceiling(ranked: DataFrame, gold: DataFrame, depth: int = 10, key: str = "mention") -> DataFrame:
    """(ceiling, found, n): the mean Jaccard if of a mention's `depth` best codes the right ones were always chosen, how many mentions with
    codes have one among them, and how many there are. ranked: mention, code, rank; gold: mention, codes."""
    top = ranked.where(F.col("rank") <= depth).groupBy(key).agg(F.collect_set("code").alias("_top"))
    both = gold.join(top, key, "left").withColumn("_hit", F.array_intersect("codes", F.coalesce("_top", F.array().cast("array<string>"))))
    return both.agg(F.avg(set_jaccard(F.col("codes"), F.col("_hit"))).alias("ceiling"), F.count_if(F.size("_hit") > 0).alias("found"), F.count_if(F.size("codes") > 0).alias("n"))


def rank_histogram(ranked: DataFrame, gold: DataFrame, depth: int = 10, key: str = "mention") -> DataFrame:
    """(rank, n): at which rank a mention's first right code stands, null for none among the `depth` best; mentions without
    codes don't count."""
    each = gold.where(F.size("codes") > 0).select(key, "codes")
    hit = each.join(ranked.where(F.col("rank") <= depth), key, "left").groupBy(key).agg(F.min(F.when(F.array_contains("codes", F.col("code")), F.col("rank"))).alias("rank"))
    return hit.groupBy("rank").agg(F.count("*").alias("n"))


def bad_offsets(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans whose slice of the raw text isn't their text, both in NFC."""
    return spans.join(docs.select(key, F.col("text").alias("_raw")), key).where(nfc(F.expr("substring(_raw, start + 1, end - start)")) != nfc(F.col("text"))).drop("_raw")


def cutoffs(ranked: DataFrame, gold: DataFrame, grid: DataFrame, key: str = "mention") -> DataFrame:
    """(cutoff, k, jaccard): the mean over mentions of what the k best codes over the cutoff score.

    ranked: mention, code, score, rank; gold: mention, codes; grid: cutoff, k (a stated parameter table).
    """
    cells = gold.join(F.broadcast(grid), F.lit(True))
    hit = cells.join(ranked, key, "left")
    ok = (F.col("score") > F.col("cutoff")) & (F.col("rank") <= F.col("k"))
    got = hit.groupBy(key, "cutoff", "k").agg(F.first("codes").alias("codes"), F.collect_set(F.when(ok, F.col("code"))).alias("got"))
    return got.groupBy("cutoff", "k").agg(F.avg(set_jaccard(F.col("codes"), F.col("got"))).alias("jaccard"))
