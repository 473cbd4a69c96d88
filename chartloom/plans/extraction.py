"""From texts to coded, flagged concepts without a model: dictionaries, overlap removal, flags, codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions import fixed
from chartloom.operators import corpus, gazetteer, spans, structure, words


def sweep(docs: DataFrame, dictionaries: dict[str, DataFrame], least: dict[str, int] | None = None) -> DataFrame:
    """Hits of the dictionaries by type, each over phrases of a least number of tokens, without overlaps."""
    least = least or {"CHẨN_ĐOÁN": 3, "THUỐC": 1}
    found = None
    for kind, table in dictionaries.items():
        hits = gazetteer.hits(docs, table.where(F.col("n_tokens") >= least.get(kind, 2)))
        code = F.col("code") if "code" in hits.columns else F.lit(None)
        rows = hits.select("doc_id", "start", "end", F.lit(kind).alias("type"), code.cast("string").alias("code"), F.lit(1).alias("source"))
        found = rows if found is None else found.unionByName(rows)
    return spans.without_overlaps(found)


def concepts(docs: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """doc_id, text, type, candidates, assertions, start, end. Texts should be NFC: offsets count their code points."""
    found = structure.with_flags(docs, sweep(docs, dictionaries))
    coded = F.col("type").isin(fixed.CODEABLE_TYPES) & F.col("code").isNotNull()
    out = found.join(docs.select("doc_id", F.col("text").alias("_raw")), "doc_id")
    return out.select("doc_id", F.expr("substring(_raw, start + 1, end - start)").alias("text"), "type", F.when(coded, F.array("code")).otherwise(F.array().cast("array<string>")).alias("candidates"), "assertions", "start", "end")


def training_words(docs: DataFrame, annotated: DataFrame) -> DataFrame:
    """Words of documents labelled by the spans that own them: doc_id, pos, word, label, broken."""
    names = {v: k for k, v in fixed.LABEL_TYPES.items()}
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return spans.labelled_atoms(docs, annotated.withColumn("label", label[F.col("type")])).select("doc_id", "pos", F.col("surface").alias("word"), "start", "end", "label", "broken")


def keyword_training(docs: DataFrame, keywords: DataFrame, segment: Callable[[str], list[str]] | None = None) -> DataFrame:
    """doc_id, pos, word, label of texts labelled by keywords, ready for write_bio: words by `segment`, atoms without one."""
    w = words.segmented(docs.select("doc_id", "text"), segment).select("doc_id", "pos", F.col("surface").alias("word"))
    return gazetteer.keyword_labels(w, keywords)


def bio_from_texts(docs: DataFrame, dictionaries: dict[str, DataFrame], most: int = 200) -> DataFrame:
    """The model-free tagger as one job: dictionaries swept over texts, spans as word labels, words in blocks: doc_id,
    pos, word, start, end, label, broken, block."""
    found = sweep(docs, dictionaries)
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end")) - 1
    return spans.blocks(training_words(docs, found.withColumn("idx", idx)), most)


def marked_concepts(marked: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """Concepts of texts with 〔KIND|words〕 marks: the marked spans and the dictionaries' hits in the clean text, without
    overlaps (by start, marks before hits, the longest), with codes and flags: doc_id, text, type, candidates, assertions, start, end."""
    clean = corpus.unwrapped(marked, aliases=fixed.MARK_ALIASES, allowed=fixed.OUTPUT_TYPES)
    docs = clean.select("doc_id", "text")
    own = clean.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.type", F.lit(None).cast("string").alias("code"), F.lit(0).alias("source"))
    found = spans.without_overlaps(own.unionByName(sweep(docs, dictionaries)))
    raw = found.join(docs.withColumnRenamed("text", "_raw"), "doc_id").withColumn("text", F.expr("substring(_raw, start + 1, end - start)")).drop("_raw")
    known = None
    for kind, table in dictionaries.items():
        if kind in fixed.CODEABLE_TYPES:
            named = table.select(F.lit(kind).alias("type"), "key", F.col("code").cast("string").alias("_code"))
            known = named if known is None else known.unionByName(named)
    if known is not None:  # marked spans take the code of the phrase that they are; masked ones none
        raw = raw.withColumn("key", gazetteer.phrase_key(F.col("text"))).join(known, ["type", "key"], "left").withColumn("code", F.when(~F.col("text").contains("*"), F.coalesce("code", "_code")))
    flagged = structure.with_flags(docs, raw.select("doc_id", "start", "end", "type", "text", "code"))
    coded = F.col("type").isin(fixed.CODEABLE_TYPES) & F.col("code").isNotNull()
    return flagged.select("doc_id", "text", "type", F.when(coded, F.array("code")).otherwise(F.array().cast("array<string>")).alias("candidates"), "assertions", "start", "end")


def tagged(batches_of_words: DataFrame, tag: Callable[[list[str]], list[str]]) -> DataFrame:
    """A tagger of one's own over (doc_id, words): labels by word. The model is the caller's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(labels=[tag(list(w)) for w in f["words"]])[["doc_id", "words", "labels"]]

    return batches_of_words.select("doc_id", "words").mapInPandas(run, "doc_id string, words array<string>, labels array<string>")
