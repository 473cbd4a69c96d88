"""Building corpora: markup, masking, re-location, stratified holdouts, quotas, statistics, multisets."""

from __future__ import annotations

import heapq
import os
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

from chartloom.functions import fixed
from chartloom.functions.text import nfc, nfd, tokens

OPEN, CLOSE = "〔", "〕"
MOST_WEIGHTS = 100_000


_UNWRAPPED = "struct<text:string,spans:array<struct<type:string,text:string,start:int,end:int,extras:array<string>>>>"


def _unwrap(clean: Column, field_mark: str) -> Column:
    """struct<text, spans>: marks 〔KIND|words|...〕 replaced by their words, trimmed, with where these then stand; one pass a text."""

    @F.arrow_udf(_UNWRAPPED)
    def run(texts: pa.Array) -> pa.Array:
        find, broken = re.compile(field_mark).finditer, str.maketrans("", "", OPEN + CLOSE)
        span = pa.struct([("type", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("extras", pa.list_(pa.string()))])
        kind = pa.struct([("text", pa.string()), ("spans", pa.list_(span))])

        def of(t: str | None) -> dict | None:
            if t is None:
                return None
            parts, spans, at, done = [], [], 0, 0
            for m in find(t):
                own, words, *extras = [f.strip(" ") for f in m[0][1:-1].split("|")]
                plain = t[done : m.start()].translate(broken)
                parts += [plain, words]
                at, done = at + len(plain) + len(words), m.end()
                if words:
                    spans.append({"type": own, "text": words, "start": at - len(words), "end": at, "extras": extras})
            return {"text": "".join([*parts, t[done:].translate(broken)]), "spans": spans}

        return pa.array(list(map(of, texts.to_pylist())), kind)

    return run(clean)


def unwrapped(docs: DataFrame, key: str = "doc_id", aliases: dict[str, str] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """(key, text, spans) of texts with 〔KIND|words〕 marks: marks go, spans keep what they held, trimmed; bold and
    heading marks and broken brackets go before offsets are counted. aliases: kinds by (upper-cased) short name, others stay as they are; allowed:
    the kinds that make spans, the words of others stay as text. Null texts have null text and spans."""
    clean = F.regexp_replace(F.regexp_replace("text", fixed.BOLD_MARK, ""), fixed.HEADING_MARK, "")
    u = docs.select(key, _unwrap(clean, rf"{OPEN}[^|{OPEN}{CLOSE}]+\|[^{OPEN}{CLOSE}]+{CLOSE}").alias("u"))
    known = F.create_map(*[F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv])
    spans = F.transform("u.spans", lambda s: F.struct(F.coalesce(known[F.upper(s["type"])], s["type"]).alias("type"), *(s[x].alias(x) for x in ("text", "start", "end"))))
    if allowed is not None:
        spans = F.filter(spans, lambda s: s["type"].isin(allowed))
    return u.select(key, F.col("u.text").alias("text"), spans.alias("spans"))


def bundled(composed: DataFrame, bundles: DataFrame, least: int = 12) -> DataFrame:
    """(bundle_id, text, spans) of composed texts whose marks name surfaces of their bundle, with the bundle's codes and
    type, where at least `least` spans are left. composed: bundle_id, text; bundles: bundle_id, surface, type, codes."""
    u = unwrapped(composed.withColumnRenamed("bundle_id", "doc_id")).withColumnRenamed("doc_id", "bundle_id")
    each = u.select("bundle_id", "text", F.posexplode("spans").alias("i", "s")).withColumn("_k", F.lower("s.text"))
    b = bundles.groupBy("bundle_id", F.lower("surface").alias("_k")).agg(F.min_by(F.struct("type", "codes"), F.struct("type", "surface")).alias("b"))
    rows = each.join(b, ["bundle_id", "_k"]).groupBy("bundle_id", "text").agg(F.array_sort(F.collect_list(F.struct("i", F.struct("b.type", "s.text", "s.start", "s.end", "b.codes").alias("s")))).alias("l"))
    return rows.where(F.size("l") >= least).select("bundle_id", "text", F.transform("l", lambda x: x["s"]).alias("spans"))


def hand_marked(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(spans, errors) of hand-annotated texts with marks 〔KIND|words|code or assertion, ...|...〕: spans as (key, idx, text, type,
    candidates, assertions, start, end), errors as (key, idx, reason, about) for marks of an unknown kind, unknown assertions,
    and assertions or codes on types that take none, which are dropped."""
    alias = F.create_map(*[F.lit(x) for kv in fixed.MARK_ALIASES.items() for x in kv])
    u = docs.select(key, _unwrap(F.col("text"), rf"{OPEN}[^|{OPEN}{CLOSE}]+\|[^{OPEN}{CLOSE}]+{CLOSE}").alias("u"))
    s = u.select(key, F.posexplode("u.spans").alias("idx", "s")).select(key, "idx", "s.*")
    s = s.withColumn("kind", F.coalesce(alias[F.upper("type")], F.when(F.col("type").isin(fixed.OUTPUT_TYPES), F.col("type"))))
    items = F.filter(F.transform(F.flatten(F.transform("extras", lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")
    s = s.withColumn("items", items)
    known, flag = lambda x: x.isin(fixed.ASSERTIONS), lambda x: x.startswith("is")
    s = s.withColumns({"flags": F.filter("items", known), "wrong": F.filter("items", lambda x: flag(x) & ~known(x)), "codes": F.filter("items", lambda x: ~flag(x))})
    takes = {"flags": F.col("kind").isin(fixed.ASSERTION_TYPES), "codes": F.col("kind").isin(fixed.CODEABLE_TYPES)}
    own = lambda x: F.when(takes[x], F.array_sort(F.array_distinct(x))).otherwise(F.array().cast("array<string>"))
    spans = s.where("kind IS NOT NULL").select(key, "idx", "text", F.col("kind").alias("type"), own("codes").alias("candidates"), own("flags").alias("assertions"), "start", "end")
    told = lambda where, why, about: F.when(where, F.struct(F.lit(why).alias("reason"), about.alias("about")))
    errors = F.array(
        told(F.col("kind").isNull(), "kind", F.col("type")), told(F.col("kind").isNotNull() & (F.size("wrong") > 0), "assertion", F.array_join("wrong", ",")),
        told((F.size("flags") > 0) & ~takes["flags"], "takes no assertion", F.col("kind")), told((F.size("codes") > 0) & ~takes["codes"], "takes no code", F.col("kind")),
    )
    return spans, s.select(key, "idx", F.explode(F.array_compact(errors)).alias("e")).select(key, "idx", "e.*")


def compiled(marked: DataFrame, originals: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, same, why, at): whether a marked text without its marks is the original, and if not whether only the
    normal form changed ("form") or characters from `at` on ("text")."""
    clean = marked.select(key, _unwrap(F.col("text"), rf"{OPEN}[^|{OPEN}{CLOSE}]+\|[^{OPEN}{CLOSE}]+{CLOSE}")["text"].alias("_c"))
    both = clean.join(originals.select(key, F.col("text").alias("_o")), key)
    same, form = F.col("_c") == F.col("_o"), nfc("_c") == nfc("_o")
    return both.select(key, same.alias("same"), F.when(same, None).when(form, "form").otherwise("text").alias("why"), F.when(~same & ~form, first_difference(F.col("_c"), F.col("_o"))).alias("at"))


@F.pandas_udf(IntegerType())
def first_difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """Where two texts part, in code points."""
    return pd.Series([None if x is None or y is None else len(os.path.commonprefix([x, y])) for x, y in zip(a, b)], dtype="Int32")


def relocated(text: Column, surfaces: Column) -> Column:
    """Starts of surfaces found one after the other from a moving cursor; null if one is missing."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(a, s):
        found = F.call_function("locate", s, text, a["at"] + 1) - 1
        return F.when((a["at"] >= 0) & (found >= 0), F.struct((found + F.length(s)).alias("at"), F.concat(a["out"], F.array(found)).alias("out"))).otherwise(F.struct(F.lit(-1).alias("at"), a["out"].alias("out")))

    return F.aggregate(surfaces, start, step, lambda a: F.when(a["at"] >= 0, a["out"]))


def masked(text: Column, spans: Column) -> Column:
    """text with stars over the spans (array<struct<start, end>>), length unchanged."""
    return F.aggregate(spans, text, lambda t, s: F.overlay(t, F.repeat(F.lit("*"), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))


def perturbed(docs: DataFrame, rate: Column, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """docs in decomposed form for a share of rows that depends on key and seed alone."""
    dice = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    return docs.withColumn("text", F.when(dice < rate, nfd("text")).otherwise(F.col("text")))


def quotas(sizes: dict[str, int], count: int) -> dict[str, int]:
    """Rows to take of each stratum: its rounded share of `count`, one at least and no more than it has; one by one
    the largest quota (then the largest stratum, then the first name) gives up a row, or the stratum with most rows left (then
    the largest, then the first name) gets one, until the sum is `count` or the rows are used up."""
    total = sum(sizes.values())
    quota = {s: min(n, max(1, round(count * n / total))) for s, n in sizes.items()}
    apart = min(count, total) - sum(quota.values())
    rank = (lambda s: (-quota[s], -sizes[s], s)) if apart < 0 else (lambda s: (quota[s] - sizes[s], -sizes[s], s))
    heap = [rank(s) for s in quota]
    heapq.heapify(heap)
    for _ in range(abs(apart)):
        *_, s = heapq.heappop(heap)
        quota[s] += 1 if apart > 0 else -1
        heapq.heappush(heap, rank(s))
    return quota


def holdout(docs: DataFrame, stratum: str, count: int, key: str = "doc_id", order: Column | None = None) -> DataFrame:
    """`count` rows by strata, see quotas(). Within a stratum rows go by `order` (a hash) and key. Rows without a
    stratum are never held out. Strata are a small dimension: a row for each reaches the driver."""
    sizes = {r[0]: r["n"] for r in docs.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return docs.limit(0)
    quota = docs.sparkSession.createDataFrame(list(quotas(sizes, count).items()), f"`{stratum}` string, _quota long")
    w = Window.partitionBy(stratum).orderBy(order if order is not None else F.xxhash64(key), key)
    first = docs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count)  # a task hands on `count` rows a stratum
    return first.join(F.broadcast(quota), stratum).where("_n <= _quota").select(*docs.columns)


def take_then_fill(docs: DataFrame, category: str, each: int, total: int, order: list[Column]) -> DataFrame:
    """Up to `each` rows of a category, then the best of the others until there are `total`."""
    most = max(each, total)  # no category gives more rows, and a task hands on no more
    place = docs.withColumn("place", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("place") <= most)
    chosen = place.orderBy(F.when(F.col("place") <= each, 0).otherwise(1), *order).limit(total)
    return chosen.withColumn("backfill", F.col("place") > each)


def picked_by_traits(docs: DataFrame, n: int, rates: dict[str, float], seed: int = 0, key: str = "doc_id") -> DataFrame:
    """n rows in the order of a hash of key and seed: first, trait by trait (boolean columns), as many with it as its
    rounded rate of n asks for, counting those already there; then any. A bounded number of rows decides.

    rates: trait to rate, in order. Ties by key; null traits count as absent.
    """
    w = Window.orderBy("_h", key)
    hashed = docs.withColumn("_h", F.xxhash64(key, F.lit(seed)))
    first = lambda d: d.orderBy("_h", key).limit(n)  # noqa: E731  of rows with a trait, and of all, the first n are enough
    pool = first(hashed)
    for trait in rates:
        pool = pool.unionByName(first(hashed.where(F.col(trait))))
    pool = pool.dropDuplicates([key, "_h"]).orderBy("_h", key).collect()  # at most n rows for each trait and n more
    picked: list = []
    for trait, rate in rates.items():
        for row in pool:
            if len(picked) >= n or sum(bool(p[trait]) for p in picked) >= round(rate * n):
                break
            if row[trait] and row not in picked:
                picked.append(row)
    picked += [row for row in pool if row not in picked][: max(0, n - len(picked))]
    return docs.sparkSession.createDataFrame(picked, hashed.schema).select(*docs.columns)


def statistics(docs: DataFrame, spans: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    """A row over all and one by `by`, a column of docs: n_docs, n_spans, spans a document, shares of codeable spans
    that have a code, of spans with assertions, of documents with masked spans, not in NFC and with heading lines, mean words a
    span, and bad_offsets. Spans whose slice isn't their text count as bad and for n_spans alone."""
    s = spans.join(docs.select(key, F.col("text").alias("_raw")), key)
    good = F.coalesce(F.expr("substring(_raw, start + 1, end - start)") == F.col("text"), F.lit(False))
    codeable = good & F.col("type").isin(fixed.CODEABLE_TYPES)
    per_doc = s.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(~good).alias("bad"), F.count_if(codeable).alias("codeable"), F.count_if(codeable & (F.size("candidates") > 0)).alias("coded"),
        F.count_if(good & (F.size("assertions") > 0)).alias("flagged"), F.sum(F.when(good, F.size(tokens(F.col("text"))))).alias("words"), F.count_if(good).alias("good"), F.max(F.col("text").contains("*").cast("int")).alias("masked"),
    )
    own = docs.select(key, by, (nfc("text") != F.col("text")).cast("int").alias("not_nfc"), F.col("text").rlike(fixed.HEADING_LINE).cast("int").alias("headed"))
    rows = own.join(per_doc, key, "left").fillna(0, ["n", "bad", "codeable", "coded", "flagged", "words", "good", "masked"])
    share = lambda a, b: F.sum(a) / F.greatest(F.sum(b), F.lit(1))
    return rows.groupingSets([[], [F.col(by)]], F.col(by)).agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_spans"), (F.sum("n") / F.count("*")).alias("spans_a_doc"), share("coded", "codeable").alias("coded"), share("flagged", "n").alias("flagged"),
        F.avg("masked").alias("masked"), F.avg("not_nfc").alias("not_nfc"), F.avg("headed").alias("headed"), share("words", "good").alias("words"), F.sum("bad").alias("bad_offsets"), F.grouping(by).cast("int").alias("overall"),
    )


def words_by_type(spans: DataFrame) -> DataFrame:
    """(type, words, n): mean words of a type's spans."""
    return spans.groupBy("type").agg(F.avg(F.size(tokens(F.col("text")))).alias("words"), F.count("*").alias("n"))


def gated(rows: DataFrame, gates: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all gates, (reason, n) of the first gate that each of the others fails). gates: reason to
    condition, in order; a null condition fails."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in gates.items()], F.lit(None).cast("string"))
    told = rows.withColumn("_reason", reason)
    return told.where("_reason IS NULL").drop("_reason"), counted(told.where("_reason IS NOT NULL").select(F.col("_reason").alias("reason")), "reason")


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n), the most frequent first, ties by value."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def usable(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(spans whose slice is their text, both in NFC, and whose type has a label; (reason, n) of the others)."""
    joined = spans.join(docs.select(key, F.col("text").alias("_raw")), key)
    fits = nfc(F.expr("substring(_raw, start + 1, end - start)")) == nfc(F.col("text"))
    kept, why = gated(joined, {"offset": fits, "type": F.col("type").isin(list(fixed.LABEL_TYPES.values()))})
    return kept.drop("_raw"), why


def ordered_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label): the distinct labels, "0" read as "O", O first."""
    own = F.when(F.col(label) == "0", "O").otherwise(F.col(label))
    return rows.select(own.alias("label")).where("label IS NOT NULL").distinct().orderBy(F.col("label") != "O", "label")


def codes_by_surface(spans: DataFrame, table: DataFrame) -> DataFrame:
    """spans with candidates by their text: a diagnosis takes the codes of the first entry (by `entry`) that it equals
    or contains, a drug those of the first that it equals, in lower case; others and misses have none.

    table: entry, kind (the type), surface, codes: a small dictionary of surfaces. It meets the distinct texts, not the spans.
    """
    t = table.select("entry", F.col("kind").alias("type"), F.lower("surface").alias("_s"), "codes")
    texts = spans.select("type", "text").distinct().withColumn("_k", F.lower(F.trim("text")))
    same = texts.join(t.withColumnRenamed("_s", "_k"), ["type", "_k"])
    inside = texts.where(F.col("type") == "CHẨN_ĐOÁN").join(t.where("_s <> ''"), "type").where(F.contains("_k", F.col("_s")))
    first = same.select("type", "text", "entry", "codes").unionByName(inside.select("type", "text", "entry", "codes")).groupBy("type", "text").agg(F.min_by("codes", "entry").alias("candidates"))
    return spans.drop("candidates").join(first, ["type", "text"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def kept_share(before: DataFrame, after: DataFrame, key: str, item: str) -> DataFrame:
    """(key, share): of the items before, as a multiset, what is still there after."""
    a, b = (d.groupBy(key, item).agg(F.count("*").alias(n)) for d, n in ((before, "n"), (after, "m")))
    return a.join(b, [key, item], "left").groupBy(key).agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("share"))


def rank_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """The upper middle of a group's values, with least and largest: exact, from how often each value occurs."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by)
    r = counts.withColumns({"_to": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    middle = F.floor(F.col("_n") / 2) + 1
    return r.groupBy(by).agg(F.min(F.when(F.col("_to") >= middle, F.col(value))).alias("median"), F.min(value).alias("least"), F.max(value).alias("largest"), F.sum("_c").alias("n"))


def generated(draws: DataFrame, templates: DataFrame, values: DataFrame, seed: int = 0) -> DataFrame:
    """draws (draw) with text: a template, by hash, with each {slot} replaced by one of the slot's values, by hash. A slot
    without values stays. templates: template; values: slot, value; both small tables of at most MOST_WEIGHTS rows."""
    rows = templates.select("template").distinct().orderBy("template").limit(MOST_WEIGHTS + 1).collect()
    pool: dict[str, list[str]] = {}
    for r in values.select("slot", "value").distinct().orderBy("slot", "value").limit(MOST_WEIGHTS + 1).collect():
        pool.setdefault(r.slot, []).append(r.value)
    if len(rows) > MOST_WEIGHTS or sum(map(len, pool.values())) > MOST_WEIGHTS:
        raise ValueError(f"templates and values have at most {MOST_WEIGHTS} rows each")
    if not rows:
        return draws.limit(0).withColumn("text", F.lit(""))
    pick = lambda listed, *salt: F.get(F.array(*map(F.lit, listed)), F.pmod(F.xxhash64("draw", F.lit(seed), *map(F.lit, salt)), F.lit(len(listed))).cast("int"))
    text = pick([r.template for r in rows], "template")
    for slot, listed in pool.items():
        text = F.replace(text, F.lit("{" + slot + "}"), pick(listed, "slot", slot))
    return draws.withColumn("text", text)


def weighted_picks(pool: DataFrame, draws: DataFrame, weight: str, seed: int = 0) -> DataFrame:
    """For each row of draws (draw) one row of pool by weight: a point in the running sums, from a hash.

    The pool is a small dimension table of weights; draws may be many.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(*pool.columns)
    sums = pool.withColumn("_hi", F.sum(weight).over(w)).withColumn("_lo", F.col("_hi") - F.col(weight))
    n, total = pool.agg(F.count("*"), F.sum(weight)).first()
    if n > MOST_WEIGHTS:
        raise ValueError(f"a pool of weights has at most {MOST_WEIGHTS} rows")
    total = total or 0
    point = draws.withColumn("_p", F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) * total)
    return point.join(F.broadcast(sums), (F.col("_p") >= F.col("_lo")) & (F.col("_p") < F.col("_hi"))).drop("_p", "_lo", "_hi")
