"""Readers: text folders, annotations, BIO files, terminologies, JSON lines."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions import fixed
from chartloom.functions.text import nfc, numeric_order, tokens

SPAN = "text STRING, type STRING, candidates ARRAY<STRING>, assertions ARRAY<STRING>, position ARRAY<INT>"


def _stem():
    return F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of the .txt files of a folder, numbers first."""
    return spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(_stem().alias("doc_id"), F.col("value").alias("text"))


def in_order(docs: DataFrame) -> DataFrame:
    return docs.orderBy(*numeric_order(F.col("doc_id")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """A row for each run of lines between blank lines."""
    return docs.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "text")).where(F.trim("text") != "")


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of JSON arrays, one file a document, strings in NFC; a missing position is null."""
    raw = spark.read.option("pathGlobFilter", "*.json").option("multiLine", True).schema(SPAN).json(folder)
    rows = raw.select(_stem().alias("doc_id"), *raw.columns, F.monotonically_increasing_id().alias("_at")).where("text IS NOT NULL OR type IS NOT NULL")
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at")) - 1
    each = lambda x: F.coalesce(F.col(x), F.array().cast("array<string>"))
    return rows.select("doc_id", idx.alias("idx"), nfc(F.coalesce("text", F.lit(""))).alias("text"), nfc(F.trim(F.coalesce("type", F.lit("")))).alias("type"), F.transform(each("candidates"), lambda c: F.trim(c)).alias("candidates"), each("assertions").alias("assertions"), F.get("position", F.lit(0)).alias("start"), F.get("position", F.lit(1)).alias("end"))


def with_annotations(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that have annotations, those that have none)."""
    ids = spans.select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi"), docs.join(ids, "doc_id", "left_anti")


def bio(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(file, block, idx, word, label): the label is what follows a line's last space; blank lines part blocks.

    A line without a word is left out. strict: labels that aren't known become O and `unknown` tells.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    blank = F.trim("value") == ""
    w = Window.partitionBy("file").orderBy("line")
    rows = raw.withColumn("block", F.sum(blank.cast("int")).over(w)).withColumns({"word": F.regexp_extract("value", r"^(.*\S)\s+(\S+)\s*$", 1), "label": F.regexp_extract("value", r"^(.*\S)\s+(\S+)\s*$", 2)}).where("word <> ''")
    rows = rows.withColumn("block", F.dense_rank().over(Window.partitionBy("file").orderBy("block")) - 1).withColumn("idx", F.row_number().over(Window.partitionBy("file", "block").orderBy("line")) - 1)
    if strict:
        known = ["O", *[f"{p}-{x}" for x in [*fixed.LABEL_TYPES, *fixed.UNSCORED_LABELS] for p in "BI"]]
        rows = rows.withColumn("unknown", ~F.col("label").isin(known)).withColumn("label", F.when(F.col("unknown"), "O").otherwise(F.col("label")))
    return rows.drop("value", "line")


def disease_table(spark: SparkSession, path: str, code_names: tuple[str, ...] = ("mã bệnh", "ma benh", "code"), name_names: tuple[str, ...] = ("tên bệnh", "ten benh", "name")) -> DataFrame:
    """(name_id, code, name): the header is the first row that has both columns, by exact names in order."""
    head = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 65536).alias("v")).first()
    rows = list(csv.reader(io.StringIO((head.v if head else "").lstrip("﻿"))))  # the first 64 kB

    def column(row: list[str], names: tuple[str, ...]) -> int | None:
        low = [x.strip().lower() for x in row]
        return next((low.index(n) for n in names if n in low), None)

    at = next((i for i, r in enumerate(rows) if column(r, code_names) is not None and column(r, name_names) is not None), None)
    if at is None:
        raise ValueError(f"no header with {code_names} and {name_names} in {path}")
    code, name = column(rows[at], code_names), column(rows[at], name_names)
    wide = ", ".join(f"c{i} STRING" for i in range(len(rows[at])))
    table = spark.read.option("multiLine", True).option("escape", '"').schema(wide).csv(path).withColumn("name_id", F.monotonically_increasing_id())
    first = table.where((F.lower(F.trim(f"c{code}")) == code_names[0]) | F.lower(F.trim(f"c{code}")).isin(*code_names)).agg(F.min("name_id")).first()[0]
    body = table.where(F.col("name_id") > (first if first is not None else -1))
    return body.select("name_id", F.trim(f"c{code}").alias("code"), F.trim(f"c{name}").alias("name")).where("code <> '' AND name <> ''")


def unpivoted(table: DataFrame, pairs: dict[str, list[str]]) -> DataFrame:
    """(code, name): each code column with each of its name columns."""
    each = [F.struct(F.trim(F.col(f"`{code}`")).alias("code"), F.trim(F.col(f"`{n}`")).alias("name")) for code, names in pairs.items() for n in names]
    return table.select(F.explode(F.array(*each)).alias("p")).select("p.code", "p.name").where("code <> '' AND name <> ''").distinct()


def aliases(names: DataFrame, low: int = 2, high: int = 5, shortest: int = 6) -> DataFrame:
    """Disease names cut at commas and semicolons: the first piece, and later ones that begin with a capital;
    of equal aliases the first stays."""
    cut = names.select("name_id", "code", F.posexplode(F.split("name", "[,;]")).alias("pos", "alias")).withColumn("alias", F.trim("alias"))
    n = F.size(F.split("alias", r"\s+"))
    ok = cut.where(((F.col("pos") == 0) | F.col("alias").rlike(r"^\p{Lu}")) & n.between(low, high) & (F.length("alias") >= shortest))
    w = Window.partitionBy(F.lower("alias")).orderBy("name_id", "pos")
    return ok.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drug_table(spark: SparkSession, path: str) -> DataFrame:
    """(name_id, code, name, tty): English names of the six kinds, one row a name, ingredients first."""
    from chartloom.operators.linking import preferred

    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = raw.select(F.trim("rxcui").alias("code"), F.trim("str").alias("name"), F.trim("tty").alias("tty"), F.trim("lat").alias("lat")).where("code <> '' AND name <> ''").where("lat = 'ENG' OR lat IS NULL")
    kinds = rows.where(F.col("tty").isin(fixed.DRUG_KINDS))
    use = rows if kinds.isEmpty() else kinds
    return preferred(use.drop("lat"), "name", "tty", ["IN", "PIN", "MIN", "SCD", "SBD", "BN"]).withColumn("name_id", F.xxhash64("name"))


def names_and_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(code, names, kinds): every name and term type of each code of a drug terminology, unfiltered, as sorted sets."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = raw.select(F.trim("rxcui").alias("code"), F.trim("str").alias("name"), F.trim("tty").alias("kind")).where("code <> ''")
    names = F.array_sort(F.collect_set(F.when(F.col("name") != "", F.col("name"))))
    return rows.groupBy("code").agg(names.alias("names"), F.array_sort(F.collect_set(F.when(F.col("kind") != "", F.col("kind")))).alias("kinds"))


def drug_aliases(spark: SparkSession, path: str, ingredients: DataFrame | None = None, stop: list[str] = (), most_words: int = 5) -> DataFrame:
    """(code, alias, codes): names as records write them. Ingredients and brands that aren't suppressed, 4 to 40 characters, at
    most `most_words` words, not in `stop`; names of over 4 characters all in capitals in title case; of equal names, whatever
    the case, the first row; codes are the brand's ingredients (code, ingredient) or the code itself."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn("_at", F.monotonically_increasing_id())
    text = lambda x: F.trim(F.coalesce(F.col(x), F.lit("")))
    rows = raw.where(text("tty").isin("IN", "BN") & text("suppress").isin("", "N")).select(text("rxcui").alias("code"), text("str").alias("alias"), "_at")
    capitals = (F.length("alias") > 4) & (F.upper("alias") == F.col("alias")) & (F.lower("alias") != F.col("alias"))
    rows = rows.withColumn("alias", F.when(capitals, title_case(F.col("alias"))).otherwise(F.col("alias")))
    ok = (F.col("code") != "") & F.length("alias").between(4, 40) & (F.size(tokens(F.col("alias"))) <= most_words) & ~F.lower("alias").isin(list(stop))
    first = rows.where(ok).groupBy(F.lower("alias").alias("_k")).agg(F.min_by(F.struct("code", "alias"), "_at").alias("f")).select("f.code", "f.alias")
    if ingredients is None:
        return first.withColumn("codes", F.array("code"))
    own = ingredients.groupBy("code").agg(F.array_sort(F.collect_set("ingredient")).alias("codes"))
    return first.join(own, "code", "left").withColumn("codes", F.coalesce("codes", F.array("code")))


def title_case(text: Column) -> Column:
    """The first letter of each run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def common(names: DataFrame, frequencies: DataFrame, name: str = "alias") -> DataFrame:
    """names that a table of frequent names (name) has, in any case."""
    return names.join(frequencies.select(F.lower("name").alias("_k")).distinct(), F.lower(F.col(name)) == F.col("_k"), "left_semi")


def inline(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, text) of a text given as such, else of a file."""
    if text is not None:
        return spark.createDataFrame([("input", text)], "doc_id string, text string")
    return spark.read.text(path, wholetext=True).select(_stem().alias("doc_id"), F.col("value").alias("text"))


def gold_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The spans of all annotation files whose type takes codes."""
    return annotations(spark, folder).where(F.col("type").isin(fixed.CODEABLE_TYPES))


def without_partner(labels: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key) of labelled documents, once each, that have no text."""
    return labels.select(key).distinct().join(docs.select(key), key, "left_anti")


def labelled_split(rows: DataFrame, held: float = 0.1, seed: int = 42, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(training, held-out) rows by a hash of key and seed; a key is on one side as a whole."""
    dice = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    return rows.where(dice >= held), rows.where(dice < held)


def new_id(old: Column) -> Column:
    """cmp0007 as synthetic_0007: a stem's digits, four at least, under a new name; other stems stay."""
    digits = F.regexp_extract(old, r"^cmp(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("synthetic_"), F.lpad(digits, 4, "0"))).otherwise(old)


def relations(spark: SparkSession, path: str) -> DataFrame:
    """The used fields of a pipe-separated relation file."""
    f = F.split("value", r"\|")
    return spark.read.text(path).select(*[F.get(f, F.lit(i)).alias(n) for n, i in (("rxcui1", 0), ("stype1", 2), ("rxcui2", 4), ("stype2", 6), ("rela", 7), ("sab", 10))])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def element_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, line): the line on which each object of a JSON array of objects begins, by a fold over
    characters that matter; strings are skipped whole."""
    marks = F.regexp_extract_all("text", F.lit(r'("(?:[^"\\]|\\.)*"|[\[\]{}\n])'), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("line"), F.array().cast("array<int>").alias("out"))
    step = lambda a, m: F.struct(
        (a["depth"] + F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0)).alias("depth"), (a["line"] + F.when(m == "\n", 1).otherwise(0)).alias("line"),
        F.when((m == "{") & (a["depth"] == 1), F.concat(a["out"], F.array(a["line"]))).otherwise(a["out"]).alias("out"),
    )
    return docs.select("doc_id", F.posexplode(F.aggregate(marks, start, step, lambda a: a["out"])).alias("idx", "line"))
