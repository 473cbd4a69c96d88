"""Dictionary phrases in text: leftmost-longest hits, exact, inner and partial look-ups.

A phrase is its tokens (NFC, case-folded, by one function for dictionary and text). Texts are joined with phrases on
token n-grams of the lengths the dictionary has, so a dictionary of any size is a hash join; where its phrases begin with at most FIRSTS
different tokens these travel to the tasks, and n-grams are made only where a phrase can begin. Only a text's own
hits are folded over. Null and empty texts and phrases have no hits; an empty dictionary finds nothing.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from chartloom.functions import fixed

GLUE = "\u0001"
GRAMS = ArrayType(StructType([*(StructField(x, IntegerType()) for x in ("pos", "n_tokens", "start", "end")), StructField("key", StringType())]))


#: First tokens that are sent to every task at most, with the lengths of their phrases.
FIRSTS = 200_000


def _tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    import regex

    at = [m.span() for m in regex.compile(fixed.PHRASE_TOKEN).finditer(text)]
    return [unicodedata.normalize("NFC", text[a:b]).casefold() for a, b in at], at


@F.pandas_udf(StringType())
def phrase_key(text: pd.Series) -> pd.Series:
    return text.map(lambda t: GLUE.join(_tokens(unicodedata.normalize("NFC", t))[0]), na_action="ignore")


def build(entries: DataFrame, phrase: str = "phrase", order: str = "entry") -> DataFrame:
    """entries with key and n_tokens; of equal phrases the first by `order` counts."""
    keyed = entries.withColumn("key", phrase_key(F.col(phrase))).where("key <> ''").withColumn("n_tokens", F.size(F.split("key", GLUE)))
    first = F.row_number().over(Window.partitionBy("key").orderBy(order))
    return keyed.withColumn("_n", first).where("_n = 1").drop("_n")


def partial(gazetteer: DataFrame, code: str = "code") -> DataFrame:
    """Every proper run of two tokens or more of a phrase, with the shortest phrase that has it (ties by code)."""
    toks = F.split("key", GLUE)
    n = F.col("n_tokens")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(toks, i, k), GLUE))))
    piece = gazetteer.where("n_tokens > 2").withColumn("piece", F.explode(F.array_distinct(runs)))
    w = Window.partitionBy("piece").orderBy("n_tokens", code, "key")
    return piece.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _grams(lengths: list[int], begins: dict[str, list[int]] | None):
    """Token n-grams where a phrase can begin, or of the given lengths everywhere: array<struct<pos, n_tokens, start, end, key>>."""

    @F.pandas_udf(GRAMS)
    def run(s: pd.Series) -> pd.Series:
        def of(text: str) -> list[tuple]:
            words, at = _tokens(text)
            sizes = [lengths] * len(words) if begins is None else [begins.get(w, ()) for w in words]
            return [(i, k, at[i][0], at[i + k - 1][1], GLUE.join(words[i : i + k])) for i, ks in enumerate(sizes) for k in ks if i + k <= len(words)]

        return s.map(of, na_action="ignore")

    return run


def _beginnings(gazetteer: DataFrame) -> dict[str, list[int]] | None:
    """The lengths of the phrases by first token, if there are at most FIRSTS of these."""
    first = gazetteer.select(F.split_part("key", F.lit(GLUE), F.lit(1)).alias("first"), "n_tokens").groupBy("first").agg(F.collect_set("n_tokens").alias("n"))
    rows = first.limit(FIRSTS + 1).collect()
    return {r["first"]: sorted(r["n"]) for r in rows} if len(rows) <= FIRSTS else None


def hits(docs: DataFrame, gazetteer: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, n_tokens, phrase key and payload): leftmost-longest, without overlaps."""
    begins = _beginnings(gazetteer)
    lengths = [] if begins is not None else sorted(r[0] for r in gazetteer.select("n_tokens").distinct().collect())  # a phrase's possible lengths
    found = docs.select(F.col(key).alias("_doc"), F.explode(_grams(lengths, begins)(F.col("text"))).alias("g")).select("_doc", "g.*").join(gazetteer.drop("n_tokens"), "key")
    rest = [x for x in found.columns if x != "_doc"]
    listed = found.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("pos", (-F.col("n_tokens")).alias("_l"), F.struct(*rest).alias("h")))).alias("c"))
    kind = listed.schema["c"].dataType.simpleString()
    kept = F.aggregate("c", F.array().cast(kind), lambda t, x: F.when((F.size(t) > 0) & (F.element_at(t, -1)["pos"] - F.element_at(t, -1)["_l"] > x["pos"]), t).otherwise(F.concat(t, F.array(x))))
    out = listed.select("_doc", F.explode(F.transform(kept, lambda x: x["h"])).alias("h")).select(F.col("_doc").alias(key), "h.*")
    return out.withColumnRenamed("key", "phrase_key") if key != "key" else out


def look_up(mentions: DataFrame, gazetteer: DataFrame, parts: DataFrame, mention: str = "mention", code: str = "code") -> DataFrame:
    """mentions with code and how: exact, inside (its longest inner phrase) or part (of a longer phrase)."""
    distinct = mentions.select(mention).distinct().withColumn("_key", phrase_key(F.col(mention)))
    exact = distinct.join(gazetteer.select(F.col("key").alias("_key"), F.col(code).alias("_exact")), "_key", "left")
    inner = hits(distinct.select(F.col(mention).alias("_m"), F.col(mention).alias("text")), gazetteer.withColumnRenamed(code, "_inside"), "_m")
    inner = inner.groupBy(F.col("_m").alias(mention)).agg(F.max_by("_inside", F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("_inside"))
    part = distinct.join(parts.select(F.col("piece").alias("_key"), F.col(code).alias("_part")), "_key").select(mention, "_part")
    found = exact.join(inner, mention, "left").join(part, mention, "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_inside").isNotNull(), "inside").when(F.col("_part").isNotNull(), "part")
    return mentions.join(found.select(mention, F.coalesce("_exact", "_inside", "_part").alias(code), how.alias("how")), mention, "left")


#: Keywords that are sent to every task at most.
KEYWORDS = 200_000


def keyword_labels(words: DataFrame, keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """words (key, pos, word) with label: from left to right the longest keyword, in characters, that consecutive words make when
    joined by blanks, all in lower case; of equal keywords the first type. A word of blanks alone ends a match.

    keywords: keyword, type, a dictionary of at most KEYWORDS rows (ValueError beyond). Null words and keywords match nothing.
    """
    rows = keywords.where("keyword IS NOT NULL").select("keyword", "type").limit(KEYWORDS + 1).collect()
    if len(rows) > KEYWORDS:
        raise ValueError(f"a keyword dictionary has at most {KEYWORDS} rows")
    types: dict[str, str] = {}
    for r in rows:
        k = " ".join(r.keyword.lower().split())
        if k:
            types[k] = min(r.type, types.get(k, r.type))
    prefixes = {" ".join(k.split(" ")[:i]) for k in types for i in range(1, k.count(" ") + 2)}

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        def of(listed) -> list[str]:
            plain = [(w or "").lower().strip() for w in listed]
            out, i = ["O"] * len(plain), 0
            while i < len(plain):
                joined, end, j = "", i, i
                while j < len(plain) and plain[j]:
                    joined = f"{joined} {plain[j]}" if j > i else plain[j]
                    j += 1
                    if joined in types:
                        end, kind = j, types[joined]
                    if joined not in prefixes:
                        break
                if end > i:
                    out[i:end] = [f"B-{kind}", *[f"I-{kind}"] * (end - i - 1)]
                i = max(end, i + 1)
            return out

        return lists.map(of)

    listed = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("l"))
    labels = listed.select(key, F.explode(F.arrays_zip(F.transform("l", lambda x: x["pos"]).alias("pos"), run(F.transform("l", lambda x: x["word"])).alias("label"))).alias("z"))
    return words.join(labels.select(key, "z.pos", "z.label"), [key, "pos"])
