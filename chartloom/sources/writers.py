"""Writers: spans by document, BIO, issues, scores; and what an output folder holds beyond what is expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import fixed


def span_arrays(spans: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): a document's spans as one array in order of position; documents without any get []."""
    none = F.array().cast("array<string>")
    record = F.struct("text", "type", F.coalesce("candidates", none).alias("candidates"), F.coalesce("assertions", none).alias("assertions"), F.array("start", "end").alias("position"))
    rows = spans.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", record.alias("r")))), lambda x: x["r"]).alias("a")).select("doc_id", F.to_json("a").alias("json"))
    return rows if docs is None else docs.select("doc_id").distinct().join(rows, "doc_id", "left").fillna("[]", ["json"])


def write_spans(spans: DataFrame, path: str, docs: DataFrame | None = None) -> None:
    span_arrays(spans, docs).write.mode("overwrite").json(path)


def write_span_files(spans: DataFrame, path: str, docs: DataFrame | None = None) -> None:
    """A folder for each document (doc_id=...) with its array as one line of text; what an earlier run left goes."""
    span_arrays(spans, docs).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A JSON object for each row; null fields are left out."""
    df.write.mode("overwrite").json(path)


def write_bio(words: DataFrame, path: str) -> None:
    """words: doc_id, block, pos, word, label. A blank line ends a block; unknown labels and words with line
    ends are errors."""
    known = ["O", *[f"{p}-{x}" for x in [*fixed.LABEL_TYPES, *fixed.UNSCORED_LABELS] for p in "BI"]]
    if not words.where(~F.col("label").isin(known) | F.col("word").contains("\n")).isEmpty():
        raise ValueError("labels must be known and words without line ends")
    line = F.concat_ws(" ", "word", "label")
    blocks = words.groupBy("doc_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("value"))
    blocks.orderBy("doc_id", "block").select(F.concat("value", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_issues(issues: DataFrame, path: str) -> None:
    issues.withColumns({"verdict": F.lit(""), "fix": F.lit("")}).write.mode("overwrite").option("header", True).csv(path)


def write_scores(scores: DataFrame, total: DataFrame, path: str) -> None:
    scores.unionByName(total.withColumn("doc_id", F.lit("_total")), allowMissingColumns=True).write.mode("overwrite").json(path)


def stale(spark: SparkSession, folder: str, expected: DataFrame, suffix: str = ".json") -> DataFrame:
    """Documents that a folder holds and `expected` doesn't."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("doc_id"))
    return there.join(expected.select("doc_id"), "doc_id", "left_anti")
