"""Linkers of mentions to codes, look-up by name or code, suggestions for annotators, and what their rankings are worth.

Names are a table (name_id, name, code, and kind where term types rank). Null and empty mentions link to nothing, repeated ones
are looked up once, an empty table gives no rows; ties go to table order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions import fixed
from chartloom.functions.similarity import indel_ratio, token_set_ratio, token_sort_ratio
from chartloom.functions.text import code_key, drug_string, folded, lower_squashed
from chartloom.operators.linking import by_margin, drugs, exact_then_fuzzy, nearest_codes, to_ingredients, token_candidates

BACKENDS = {"fuzzy": "fuzzy", "rapid": "fuzzy", "rapidfuzz": "fuzzy", "dense": "dense", "sapbert": "dense"}
KINDS = {"drug": "drug", "thuoc": "drug", "thuốc": "drug", "rxnorm": "drug", "rx": "drug", "diagnosis": "diagnosis", "icd": "diagnosis", "disease": "diagnosis", "benh": "diagnosis", "bệnh": "diagnosis", "chan_doan": "diagnosis", "chẩn_đoán": "diagnosis"}


def diseases(mentions: DataFrame, names: DataFrame, k: int = 1) -> DataFrame:
    """(mention, code, score, rank): diagnoses by name, exact or over the cutoff."""
    return exact_then_fuzzy(mentions, names, fixed.DISEASE_CUTOFF, k)


def tests(mentions: DataFrame) -> DataFrame:
    """(mention, codes): laboratory tests have no codes."""
    return mentions.select("mention").distinct().withColumn("codes", F.array().cast("array<string>"))


def fuzzy_links(mentions: DataFrame, names: DataFrame, margin: float = fixed.FUZZY_MARGIN, least: float = fixed.FUZZY_MIN) -> DataFrame:
    """(mention, code, score from 0 to 1, rank): an exact name's first code alone, or the two best codes by sorted words, of
    which the second stays only if it is close and one of them good."""
    same = names.select(lower_squashed(F.col("name")).alias("_q")).distinct()
    exact = mentions.select("mention").distinct().join(same, lower_squashed(F.col("mention")) == F.col("_q"), "left_semi").withColumn("_exact", F.lit(True))
    ranked = exact_then_fuzzy(mentions, names, 0.0, 2).join(exact, "mention", "left").where("rank = 1 OR _exact IS NULL")
    return by_margin(ranked.select("mention", "code", (F.col("score") / 100).alias("score")), margin, least)


def dense_links(mentions: DataFrame, names: DataFrame, margin: float = fixed.DENSE_MARGIN, least: float = fixed.DENSE_MIN) -> DataFrame:
    """(mention, code, score, rank): the two best codes by cosine under the same rule. mentions: mention, embedding; names:
    name_id, code, embedding. A code has its best name's score."""
    best = nearest_codes(mentions.select(F.col("mention").alias("id"), "embedding"), names, 2).withColumnRenamed("q", "mention")
    return by_margin(best, margin, least)


def linker(backend: str):
    """dense_links or fuzzy_links by the name of a backend."""
    kind = BACKENDS.get(backend.strip().lower())
    if kind is None:
        raise ValueError(f"unknown backend {backend!r}; known: {sorted(BACKENDS)}")
    return fuzzy_links if kind == "fuzzy" else dense_links


def _forms(mentions: DataFrame, drug: bool) -> DataFrame:
    """(mention, form, key): the mention and, for drugs, what is left without dose words, folded; empty forms go."""
    forms = F.array(F.col("mention"), drug_string(F.col("mention"))) if drug else F.array(F.col("mention"))
    rows = mentions.select("mention").distinct().select("mention", F.posexplode(forms).alias("form", "t"))
    return rows.withColumn("key", folded(F.col("t"), punctuation=True)).where("key <> ''").select("mention", "form", "key")


def suggested(mentions: DataFrame, names: DataFrame, limit: int = 3, drug: bool = False) -> DataFrame:
    """(mention, code, name, kind, score, rank): codes to suggest. The entries that equal the first form that equals any, preferred
    kinds first; else of the entries that share a word with the first form the max(8 * limit, 40) best by words as sets, the
    `limit` best of these by that score, then by likeness of the whole. names: name_id, name, code, kind."""
    table = names.withColumn("key", folded(F.col("name"), punctuation=True)).where("key <> ''")
    table = table.groupBy("key", "code").agg(F.min(F.struct("name_id", "name", "kind")).alias("e")).select("key", "code", "e.*")
    forms = _forms(mentions, drug)
    place = F.array_position(F.array(*map(F.lit, fixed.SUGGESTION_KINDS)), F.col("kind"))
    place = F.when(F.coalesce(place, F.lit(0)) == 0, 99).otherwise(place)
    w = Window.partitionBy("mention")
    same = forms.join(table, "key").withColumn("_first", F.min("form").over(w)).where("form = _first")
    exact = same.select("mention", "code", "name", "kind", F.lit(100.0).alias("score"), F.row_number().over(w.orderBy(place, "name_id")).alias("rank")).where(F.col("rank") <= limit)
    rest = forms.join(exact.select("mention").distinct(), "mention", "left_anti").groupBy("mention").agg(F.min_by("key", "form").alias("q"))
    pairs = token_candidates(rest.select(F.col("q").alias("mention")).distinct(), table.select("name_id", F.col("key").alias("name"))).withColumnRenamed("mention", "q")
    scored = pairs.join(table, "name_id").select("q", "name_id", "code", "name", "kind", "key", token_set_ratio("q", "key").alias("score"))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "name_id"))).where(F.col("_n") <= max(8 * limit, 40))
    close = best.withColumn("_r", indel_ratio("q", "key")).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("_r"), "_n"))).where(F.col("rank") <= limit)
    return exact.unionByName(rest.join(close, "q").select("mention", "code", "name", "kind", F.round("score", 1).alias("score"), "rank"))


def looked_up(queries: DataFrame, names: DataFrame, kind: str, by_code: bool = False, limit: int = 5, cutoff: float = fixed.LOOKUP_CUTOFF) -> DataFrame:
    """(mention, match, method, candidates): queries by name (exact after folding, else the `limit` best names that share a word, a match
    from `cutoff` on) or by code in any spelling. candidates: array<struct<code, name, score>>, best first. kind: drug or diagnosis, or an alias;
    another is a ValueError. Queries without a character have no row."""
    drug = {"drug": True, "diagnosis": False}.get(KINDS.get(kind.strip().lower(), ""))
    if drug is None:
        raise ValueError(f"kind is drug or diagnosis, not {kind!r}")
    asked = queries.select("mention").distinct().where("trim(mention) <> ''")
    listed = lambda: F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_s"), F.col("_n"), F.struct("code", "name", "score").alias("c"))))
    if by_code:
        found = asked.withColumn("_k", code_key(F.col("mention"))).join(names.select(code_key(F.col("code")).alias("_k"), "name", F.col("name_id").alias("_n")), "_k")
        hits = found.select("mention", F.trim("mention").alias("code"), "name", "_n", F.lit(100.0).alias("score"), F.lit("exact").alias("method"))
    else:
        fold = lambda c: folded(c)
        table = names.withColumn("_k", fold(F.col("name"))).where("_k <> ''")
        forms = F.array(F.col("mention"), drug_string(F.col("mention"))) if drug else F.array("mention")
        rows = asked.select("mention", F.posexplode(forms).alias("form", "t")).withColumn("_k", fold(F.col("t"))).where("_k <> ''")
        same = rows.join(table, "_k").groupBy("mention").agg(F.min_by(F.struct("code", "name", "name_id"), F.struct("form", "name_id")).alias("e"))
        exact = same.select("mention", "e.code", "e.name", F.col("e.name_id").alias("_n"), F.lit(100.0).alias("score"), F.lit("exact").alias("method"))
        rest = rows.join(exact, "mention", "left_anti").groupBy("mention").agg(F.min_by("_k", "form").alias("q"))
        pairs = token_candidates(rest.select(F.col("q").alias("mention")).distinct(), table.select("name_id", F.col("_k").alias("name"))).withColumnRenamed("mention", "q")
        scored = pairs.join(table, "name_id").select("q", "code", "name", F.col("name_id").alias("_n"), F.round(token_sort_ratio("q", "_k"), 1).alias("score"))
        top = scored.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "_n"))).where(F.col("_r") <= limit)
        hits = exact.unionByName(rest.join(top, "q").select("mention", "code", "name", "_n", "score", F.lit("fuzzy").alias("method")))
    out = hits.groupBy("mention").agg(F.first("method").alias("method"), F.max("score").alias("_best"), F.transform(listed(), lambda x: x["c"]).alias("candidates"))
    none = F.array().cast("array<struct<code:string,name:string,score:double>>")
    missing = F.lit("exact" if by_code else "fuzzy")
    return asked.join(out, "mention", "left").select("mention", F.coalesce(F.col("_best") >= cutoff, F.lit(False)).alias("match"), F.coalesce("method", missing).alias("method"), F.coalesce("candidates", none).alias("candidates"))


def looked_up_dense(ranked: DataFrame, cutoff: float = fixed.DENSE_LOOKUP_CUTOFF, limit: int = 5) -> DataFrame:
    """looked_up's rows from a linker's ranking (mention, code, name, score from 0 to 100, rank)."""
    top = ranked.where(F.col("rank") <= limit)
    out = top.groupBy("mention").agg(F.max("score").alias("_best"), F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("code", "name", F.round("score", 1).alias("score")).alias("c")))), lambda x: x["c"]).alias("candidates"))
    return out.select("mention", (F.round("_best", 1) >= cutoff).alias("match"), F.when(F.round("_best", 1) >= 99.9, "exact").otherwise("dense").alias("method"), "candidates")


def query_string(text: Column, kind: Column) -> Column:
    """What is looked up for a span: a drug without its dose words, unless nothing is left, other types as they are."""
    return F.when(kind == "THUỐC", F.coalesce(F.nullif(drug_string(text), F.lit("")), F.lower(F.trim(text)))).otherwise(text)


def ranked_ingredients(ranked: DataFrame, relations: DataFrame) -> DataFrame:
    """A ranking (mention, code, score, rank) with codes as ingredients: each stays where it comes first, ranks without gaps."""
    out = to_ingredients(ranked, relations)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("mention").orderBy("rank", "code")))


def emitted(ranked: DataFrame, k: int, cutoff: float) -> DataFrame:
    """(mention, codes): the k first of a ranking, of these the ones over the cutoff; mentions without any have no row."""
    return ranked.where((F.col("rank") <= k) & (F.col("score") > cutoff)).groupBy("mention").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def routed(spans: DataFrame, disease_names: DataFrame, drug_names: DataFrame, relations: DataFrame, k: int = 1, link=diseases) -> DataFrame:
    """spans with candidates: diagnoses by `link`, drugs by name and ingredient, other types and masked texts (stars) none. Each
    distinct text is linked once."""
    texts = spans.where(~F.coalesce(F.col("text").contains("*"), F.lit(True))).select("type", F.col("text").alias("mention")).distinct()
    found = [link(texts.where("type = 'CHẨN_ĐOÁN'"), disease_names).select(F.lit("CHẨN_ĐOÁN").alias("type"), "mention", "code", "rank"), drugs(texts.where("type = 'THUỐC'"), drug_names, relations, k).select(F.lit("THUỐC").alias("type"), "mention", "code", "rank")]
    codes = found[0].unionByName(found[1]).groupBy("type", F.col("mention").alias("text")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("candidates"))
    return spans.drop("candidates").join(codes, ["type", "text"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
