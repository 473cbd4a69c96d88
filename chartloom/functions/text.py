"""Text columns: atoms, folding, markers, drug strings, codes. JVM-side but for Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from chartloom.functions import fixed


PIECES = ArrayType(StructType([StructField("surface", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
LINES = ArrayType(StructType([StructField("line_no", IntegerType()), StructField("line", StringType()), StructField("start", IntegerType())]))


def normal_form(form: str):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run


nfc, nfd = normal_form("NFC"), normal_form("NFD")


def pieces(text: Column, pattern: str = fixed.ATOM) -> Column:
    """array<struct<surface, start, end>> of what `pattern` matches; starts and ends count code points.

    Prefix sums over an array are quadratic as expressions and a shuffle as windows; one Arrow pass is linear.
    """

    @F.pandas_udf(PIECES)
    def run(s: pd.Series) -> pd.Series:
        import regex

        found = regex.compile(pattern)
        return s.map(lambda t: [(m[0], m.start(), m.end()) for m in found.finditer(t)], na_action="ignore")

    return run(text)


@F.pandas_udf(LINES)
def text_lines(s: pd.Series) -> pd.Series:
    def cut(t: str) -> list[tuple[int, str, int]]:
        out, at = [], 0
        for i, line in enumerate(t.split("\n")):
            if line.strip(" "):
                out.append((i, line, at))
            at += len(line) + 1
        return out

    return s.map(cut, na_action="ignore")


def lower_squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def folded(text: Column, punctuation: bool = False) -> Column:
    """Without marks, đ as d, lower-cased; text in any normal form. punctuation: turn it into spaces."""
    out = F.regexp_replace(nfd(F.lower(text)), r"\p{Mn}", "")
    out = F.translate(out, "đ", "d")
    if punctuation:
        out = F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}_\s]", " ")
    return squash(out)


def without_list_marker(heading: Column) -> Column:
    return F.trim(F.regexp_replace(heading, fixed.LIST_MARKER, ""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def drug_string(text: Column) -> Column:
    """Lower-case words without routes and frequencies, each cut at its first colon."""
    words = F.transform(tokens(F.lower(text)), lambda w: F.split_part(w, F.lit(":"), F.lit(1)))
    drop = [*fixed.ROUTES, *fixed.FREQUENCIES]
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(drop) & ~w.rlike(fixed.EVERY_HOURS)), " ")


def code_key(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, r"[\s.]", ""))


def code_family(code: Column) -> Column:
    return F.split_part(code, F.lit("."), F.lit(1))


def numeric_order(stem: Column) -> list[Column]:
    """Sort keys: whole-number names by value, then the others by name."""
    number = stem.rlike(r"^\d+$")
    return [F.when(number, 0).otherwise(1), F.when(number, stem.cast("decimal(38,0)")), stem]
