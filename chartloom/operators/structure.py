"""Headings, sections and the context flags of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions import fixed
from chartloom.functions.text import without_list_marker
from chartloom.operators.words import lines


def headings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, at, heading): line starts of 2 to 40 characters up to a colon, and where the colon ends."""
    found = lines(docs.select(key, "text")).withColumn("head", F.regexp_extract("line", fixed.HEADING, 1)).where("head <> ''")
    return found.select(key, (F.col("start") + F.length("head") + 1).cast("int").alias("at"), F.col("head").alias("heading"))


def last_before(points: DataFrame, marks: DataFrame, key: str = "doc_id", at: str = "start", value: str = "heading") -> DataFrame:
    """points with the value of the last mark at or before them, by one window over the union of both."""
    rest = [x for x in points.columns if x not in (key, at)]
    both = points.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_v"), F.struct(*rest).alias("_r")).unionByName(
        marks.select(key, F.col("at").alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).alias("_r")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("_at", "_side")
    seen = both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select(key, F.col("_at").alias(at), *[F.col(f"_r.{x}").alias(x) for x in rest], value)


def flags(heading: Column, line_prefix: Column, kind: Column | None = None) -> Column:
    """isFamily or isHistorical by the heading's prefix, isNegated by a cue at most 30 characters before,
    with no full stop or semicolon between. kind: only the three types that carry flags get any."""
    head = without_list_marker(F.coalesce(heading, F.lit("")))
    starts = lambda table: F.exists(F.array(*map(F.lit, table)), lambda h: head.startswith(h))
    place = F.when(starts(fixed.FAMILY_HEADINGS), F.array(F.lit("isFamily"))).when(starts(fixed.HISTORY_HEADINGS), F.array(F.lit("isHistorical"))).otherwise(F.array())
    cues = "|".join(c.lower() for c in fixed.NEGATION_CUES)
    negated = F.lower(line_prefix).rlike(rf"(?U)(?:{cues})\b[^.;]{{0,30}}$")
    out = F.concat(place, F.when(negated, F.array(F.lit("isNegated"))).otherwise(F.array()))
    return out if kind is None else F.when(kind.isin(fixed.ASSERTION_TYPES), out).otherwise(F.array().cast("array<string>"))


def with_flags(docs: DataFrame, spans: DataFrame, key: str = "doc_id", gated: bool = True) -> DataFrame:
    """spans (key, start, end, type, ...) with assertions. Cues are matched on the text as given: NFC."""
    under = last_before(spans, headings(docs, key), key)
    prefix = F.substring_index(F.expr("substring(_of_doc, 1, start)"), "\n", -1)
    joined = under.join(docs.select(key, F.col("text").alias("_of_doc")), key)
    return joined.withColumn("assertions", flags(F.col("heading"), prefix, F.col("type") if gated else None)).drop("_of_doc", "heading")


def caps_sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place, section, body): headings in capitals and what follows up to the next; of a repeated
    heading the last body counts, at the first one's place; a text without headings is section ''."""
    mark = F.regexp_extract_all("text", F.lit(fixed.CAPS_SECTION), F.lit(1))
    parts = F.split("text", fixed.CAPS_SECTION)
    body = lambda x: F.trim(F.regexp_replace(F.trim(x), r"^,+|,+$", ""))
    rows = F.when(F.size(mark) > 0, F.zip_with(mark, F.slice(parts, 2, F.size(mark)), lambda m, p: F.struct(F.trim(m).alias("section"), body(p).alias("body")))).otherwise(F.array(F.struct(F.lit("").alias("section"), F.trim("text").alias("body"))))
    out = docs.select(key, F.posexplode(rows).alias("pos", "s")).where("s.body <> '' OR s.section = ''")
    return out.groupBy(key, F.col("s.section").alias("section")).agg(F.min("pos").alias("place"), F.max_by("s.body", "pos").alias("body")).select(key, "place", "section", "body")


def relaid(body: Column) -> Column:
    """A section's body with numbered items and sub-headings on lines of their own: cut into lines where an item or
    a sub-heading begins, each line's sentences joined by a stop and a blank, each run of blanks one."""
    cut = lambda parts, where: F.flatten(F.transform(parts, lambda x: F.split(x, where)))
    rows = cut(cut(F.array(body), fixed.BEFORE_ITEM), fixed.BEFORE_SUBHEAD)
    joined = F.array_join(F.transform(rows, lambda x: F.array_join(F.split(x, fixed.STOP_AND_COMMA), ". ")), "\n")
    return F.trim(F.regexp_replace(joined, r"[ \t]{2,}", " "))


def traits(docs: DataFrame) -> DataFrame:
    from chartloom.functions.text import nfc

    return docs.withColumns({"masked": F.contains("text", F.lit("***")), "not_nfc": nfc("text") != F.col("text"), "headed": F.col("text").rlike(fixed.HEADING_LINE)})


#: Steps of the order key within which rows are counted apart.
STEPS = 1024


def numbered(df: DataFrame, prefix: str, order: tuple[str, ...], width: int = 4) -> DataFrame:
    """seq_id: the prefix column and a zero-padded count within it, by `order`, nulls first.

    Where the first order column is a number, rows are counted in STEPS equal ranges of it and numbered within a range, so
    one frequent prefix is many tasks; else a prefix is one task. A null prefix gives a number alone.
    """
    first = order[0]
    if dict(df.dtypes)[first] in ("bigint", "int", "smallint", "tinyint", "double", "float"):
        low, high = df.agg(F.min(first).cast("double"), F.max(first).cast("double")).first()
        size = ((high or 0.0) - (low or 0.0)) / STEPS or 1.0
        step = F.when(F.col(first).isNull(), -1).otherwise(F.least(F.floor((F.col(first).cast("double") - F.lit(low or 0.0)) / size), F.lit(STEPS - 1))).cast("int")
        rows = df.withColumn("_step", step)
        counts = rows.groupBy(prefix, "_step").agg(F.count("*").alias("_c"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(prefix).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.select(F.col(prefix).alias("_p"), F.col("_step").alias("_s"), before.alias("_before"))
        rows = rows.join(offsets, F.col(prefix).eqNullSafe(F.col("_p")) & (F.col("_step") == F.col("_s")))
        n = F.col("_before") + F.row_number().over(Window.partitionBy(prefix, "_step").orderBy(*order))
        return rows.withColumn("seq_id", F.concat_ws("_", F.col(prefix), F.lpad(n.cast("string"), width, "0"))).select(*df.columns, "seq_id")
    n = F.row_number().over(Window.partitionBy(prefix).orderBy(*order))
    return df.withColumn("seq_id", F.concat_ws("_", F.col(prefix), F.lpad(n.cast("string"), width, "0")))
