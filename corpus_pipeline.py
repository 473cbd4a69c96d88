"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
documents; the last returns token counts, digests and token ids. In every stage a null or empty text is no reason
to go, null ids and repeated rows are rows like any other but where it says otherwise, texts of any length are read
whole, an empty table gives no rows, and extra columns of any name pass through to the last stage, which drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import bpe, common, contamination, jaccardjoin, linededup, toxicity
from chartloom.llm.queries import held_out, table
from chartloom.sources.session import importable


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; a text without a known word has the prior's score and stays. Rows of equal
    text have equal scores, repeated or not."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out(5)))
    return toxicity.without_toxic(docs, index)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of two lines and 40 bytes go from the texts but for their first copy; n_chars follows the text.
    No row goes; rows equal in id and text count as one and keep the same lines."""
    importable(spark)
    own = {x: f"_own_{x}" for x in ("n_lines", "n_removed_lines") if x in docs.columns}  # results of these names are not asked for
    out = linededup.dedup_line_chunks(docs.withColumnsRenamed(own), windows=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_removed_lines").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that Jaccard links connect, the one of the least id stays, nulls last, ties by the text's hash; of
    equal rows one. Rows without a word stay."""
    importable(spark)
    return jaccardjoin.one_of_each_class(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; texts that are shorter than an item's shingles stay."""
    return contamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as tokens; a null or empty text has none."""
    importable(spark)
    return bpe.encode_documents(docs, bpe.vocabulary_bytes(), ids=True)


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", lines_once),
    ("n-gram Jaccard join", one_of_each_class),
    ("benchmark decontamination", benchmark_out),
    ("BPE encoding and decoding", encoded),
]
#: The stages are learned models, hashes and a tokeniser: no SQL gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
