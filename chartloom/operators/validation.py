"""Rules over annotated documents; each gives rows (level, code, doc_id, idx, text, msg), reports are their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions import fixed
from chartloom.functions.similarity import token_set_ratio
from chartloom.functions.text import folded, lower_squashed
from chartloom.operators.spans import adjacent_overlaps, occurrences

COLUMNS = ["level", "code", "doc_id", "idx", "text", "msg"]


def _issue(rows: DataFrame, level: str, code: str, msg) -> DataFrame:
    have = {x: F.col(x) if x in rows.columns else F.lit(None) for x in ("doc_id", "idx", "text")}
    return rows.select(F.lit(level).alias("level"), F.lit(code).alias("code"), have["doc_id"].alias("doc_id"), have["idx"].cast("int").alias("idx"), have["text"].cast("string").alias("text"), (msg if not isinstance(msg, str) else F.lit(msg)).alias("msg"))


def positions(docs: DataFrame, spans: DataFrame) -> DataFrame:
    raw = spans.join(docs.select("doc_id", F.col("text").alias("_raw")), "doc_id")
    gone = F.col("start").isNull() | F.col("end").isNull()
    out = ~gone & ~((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.length("_raw")))
    other = ~gone & ~out & (F.expr("substring(_raw, start + 1, end - start)") != F.col("text"))
    hint = F.concat(F.lit("first at "), (F.expr("locate(text, _raw)") - 1).cast("string"))
    return _issue(raw.where(gone), "ERROR", "A_NO_POS", "no position").unionByName(_issue(raw.where(out), "ERROR", "A_OUT_OF_RANGE", "outside the text")).unionByName(_issue(raw.where(other), "ERROR", "A_MISMATCH", hint))


def candidates(spans: DataFrame) -> DataFrame:
    n = F.size("candidates")
    extra = spans.where(F.col("type").isin(fixed.NO_CODE_TYPES) & (n > 0))
    none = spans.where(F.col("type").isin(fixed.CODEABLE_TYPES) & (n == 0))
    return _issue(extra, "ERROR", "D_UNEXPECTED_CAND", "codes on a type without").unionByName(_issue(none, "WARN", "D_MISSING_CAND", "no code"))


def unknown_codes(spans: DataFrame, names: DataFrame) -> DataFrame:
    """names: code, name."""
    each = spans.where(F.col("type").isin(fixed.CODEABLE_TYPES)).withColumn("_c", F.explode("candidates"))
    return _issue(each.join(names.select(F.col("code").alias("_c")).distinct(), "_c", "left_anti"), "ERROR", "B_CODE_NOT_FOUND", F.col("_c"))


def mismatched_codes(spans: DataFrame, names: DataFrame) -> DataFrame:
    each = spans.where(F.col("type").isin(fixed.CODEABLE_TYPES)).withColumn("_c", F.explode("candidates"))
    pairs = each.select("text", "_c").distinct().join(names.select(F.col("code").alias("_c"), "name"), "_c")
    best = pairs.groupBy("text", "_c").agg(F.max(token_set_ratio(folded(F.col("text"), True), folded(F.col("name"), True))).alias("_best")).where(F.col("_best") < fixed.MISMATCH_CUTOFF)
    return _issue(each.join(best, ["text", "_c"]), "WARN", "C_CODE_MISMATCH", F.concat_ws(" ", "_c", F.round("_best", 1).cast("string")))


def suggestions(spans: DataFrame, suggested: DataFrame) -> DataFrame:
    """suggested: text, codes (array, at the cutoff or over it). What none of the assigned codes agrees with."""
    s = spans.where(F.col("type").isin(fixed.CODEABLE_TYPES)).join(suggested, "text", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    family = lambda x: F.array_distinct(F.transform(x, lambda c: F.split_part(c, F.lit("."), F.lit(1))))
    none, some = F.size("candidates") == 0, F.size("codes") > 0
    apart = ~F.arrays_overlap("candidates", "codes")
    kin = (F.col("type") == "CHẨN_ĐOÁN") & F.arrays_overlap(family(F.col("candidates")), family(F.col("codes")))
    msg = F.array_join("codes", ",")
    return _issue(s.where(some & (none | (apart & ~kin))), "WARN", "C2_SUGGEST", msg).unionByName(_issue(s.where(some & ~none & apart & kin), "INFO", "C2_GRANULARITY", msg)).unionByName(_issue(s.where(~some & ~none), "INFO", "C2_NO_MATCH", "no suggestion"))


def missing_flags(docs: DataFrame, spans: DataFrame) -> DataFrame:
    s = spans.where(F.col("type").isin(fixed.CODEABLE_TYPES)).join(docs.select("doc_id", F.col("text").alias("_raw")), "doc_id")
    left = lower_squashed(F.expr(f"substring(_raw, greatest(start - {fixed.CUE_WINDOW}, 0) + 1, least(start, {fixed.CUE_WINDOW}))"))

    def rule(cues: list[str], flag: str, code: str) -> DataFrame:
        first = F.get(F.filter(F.array(*map(F.lit, cues)), lambda q: F.contains(left, q)), F.lit(0))
        return _issue(s.withColumn("_cue", first).where(F.col("_cue").isNotNull() & ~F.array_contains("assertions", flag)), "WARN", code, F.col("_cue"))

    return rule(fixed.CHECK_NEGATION_CUES, "isNegated", "H_MAYBE_NEG").unionByName(rule(fixed.CHECK_HISTORY_CUES, "isHistorical", "H_MAYBE_HIST"))


def missed(docs: DataFrame, spans: DataFrame, shortest: int = 4) -> DataFrame:
    """Occurrences of a document's own surfaces that no span of it covers."""
    surface = spans.where(F.length("text") >= shortest).select("doc_id", "text").distinct()
    at = surface.join(docs.select("doc_id", F.col("text").alias("_raw")), "doc_id").select("doc_id", "text", F.explode(occurrences(F.col("_raw"), F.col("text"))).alias("at"))
    s = spans.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    free = at.join(s, (F.col("doc_id") == F.col("_d")) & (F.col("_s") <= F.col("at")) & (F.col("at") < F.col("_e")), "left_anti")
    return _issue(free, "WARN", "F_MISSED", F.col("at").cast("string"))


def overlaps(spans: DataFrame) -> DataFrame:
    return _issue(adjacent_overlaps(spans), "WARN", "I_OVERLAP", F.col("next_start").cast("string"))


def across(spans: DataFrame) -> DataFrame:
    """Texts with several types, texts of a type with several code sets, and the histogram of assertions."""
    t = spans.withColumn("_n", lower_squashed(F.col("text")))
    kinds = t.groupBy("_n").agg(F.array_sort(F.collect_set("type")).alias("k")).where(F.size("k") > 1)
    sets = t.where(F.size("candidates") > 0).groupBy("_n", "type").agg(F.collect_set(F.array_join(F.array_sort("candidates"), ",")).alias("k")).where(F.size("k") > 1)
    uses = spans.select(F.explode("assertions").alias("text")).groupBy("text").agg(F.count("*").cast("string").alias("_m"))
    named = lambda d: d.withColumnRenamed("_n", "text")
    out = _issue(named(kinds), "WARN", "G_TYPE_CONFLICT", F.array_join("k", ",")).unionByName(_issue(named(sets), "WARN", "G_CODE_CONFLICT", F.array_join(F.array_sort("k"), " | ")))
    return out.unionByName(_issue(uses, "INFO", "E_ASSERTION_VOCAB", F.col("_m")))


def report(docs: DataFrame, spans: DataFrame, names: DataFrame, suggested: DataFrame | None = None) -> DataFrame:
    """All rules, errors first."""
    spans = spans.withColumns({x: F.coalesce(F.col(x), F.array().cast("array<string>")) for x in ("candidates", "assertions")})
    rules = [positions(docs, spans), candidates(spans), unknown_codes(spans, names), mismatched_codes(spans, names), missing_flags(docs, spans), missed(docs, spans), overlaps(spans), across(spans)]
    if suggested is not None:
        rules.append(suggestions(spans, suggested))
    rank = F.array_position(F.array(F.lit("ERROR"), F.lit("WARN"), F.lit("INFO")), F.col("level"))
    return reduce(DataFrame.unionByName, rules).orderBy(rank, "code", "doc_id", "idx", "text", "msg")
