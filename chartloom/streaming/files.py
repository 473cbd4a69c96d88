"""A folder of texts as a stream: the extraction plan on what arrives, spans appended with exactly-once commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.plans.extraction import concepts


def text_stream(spark: SparkSession, folder: str, files_each: int = 1000) -> DataFrame:
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_each).load(folder)
    return raw.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def extract_stream(spark: SparkSession, folder: str, dictionaries: dict[str, DataFrame], out: str, checkpoint: str):
    """A query that writes the concepts of new files to `out`, a batch at a time; each batch has its own folder,
    so one that is run again replaces itself."""

    def batch(docs: DataFrame, number: int) -> None:
        concepts(docs, dictionaries).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return text_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
