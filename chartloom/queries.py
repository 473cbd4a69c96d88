"""Queries over the test tables, one for each operator, with equivalent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions import fixed, similarity
from chartloom.functions import text as T
from chartloom.operators import corpus, gazetteer, linkers, linking, scoring, spans, structure, validation, words
from chartloom.sources.session import importable

WORD = r"[\p{L}\p{M}\p{N}_]"
PHRASE = fixed.PHRASE_TOKEN.replace("'", "''")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _line_spans(spark, sf_dir):
    """Lines as spans of a document, typed by the parity of their number."""
    out = words.lines(_docs(spark, sf_dir))
    kind = F.when(F.col("line_no") % 2 == 0, "CHẨN_ĐOÁN").otherwise("THUỐC")
    return out.select("doc_id", F.col("line_no").alias("idx"), kind.alias("type"), "start", (F.col("start") + F.length("line")).alias("end"), F.col("line").alias("text"))


LINE_SPANS = """
line_spans AS (
  SELECT doc_id, i - 1 AS idx, CASE WHEN i % 2 = 1 THEN 'CHẨN_ĐOÁN' ELSE 'THUỐC' END AS type, ls[i] AS text,
    CAST(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS s,
    CAST(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) + length(ls[i]) AS BIGINT) AS e
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  WHERE trim(ls[i]) <> '')
"""


def atoms_count(spark, sf_dir):
    runs = F.regexp_extract_all("text", F.lit(f"({fixed.ATOM})"), F.lit(1))
    return _docs(spark, sf_dir).select("doc_id", F.size(runs).cast("long").alias("n_atoms"))


def atom_offsets(spark, sf_dir):
    a = words.atoms(_docs(spark, sf_dir))
    return a.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("starts"), F.sum(F.col("end").cast("long")).alias("ends"), F.max("end").cast("long").alias("last"))


def line_offsets(spark, sf_dir):
    return words.lines(_docs(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").cast("long").alias("start"), F.length("line").cast("long").alias("n"))


def word_freq_top(spark, sf_dir):
    w = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD}+)"), F.lit(1))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


def squash_ws(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length(T.squash(F.col("text"))).cast("long").alias("n"), F.md5(T.squash(F.col("text"))).alias("digest"))


def fold_accents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.folded(F.col("text"))).alias("digest"))


def section_heading(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":\n"), F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"]), "\n")
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(body.alias("text"))
    points = words.lines(docs).select("doc_id", "start", "line_no")
    under = structure.last_before(points, structure.headings(docs))
    return under.groupBy("heading").agg(F.count("*").alias("n"))


def bio_islands(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return spans.runs(e, "user_id", "event_type", ("ts", "event_id")).select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n")


def span_owner(spark, sf_dir):
    owned = spans.labelled_atoms(_docs(spark, sf_dir), _line_spans(spark, sf_dir), surface=False)
    return owned.groupBy("doc_id", F.col("owner").cast("long").alias("owner")).agg(F.count("*").alias("n"), F.sum(F.col("overlap").cast("long")).alias("covered"))


def greedy_match(spark, sf_dir):
    gold = _line_spans(spark, sf_dir)
    pred = gold.withColumns({"start": F.col("start") + 3, "end": F.col("end") + 5})
    return spans.greedy_pairs(gold, pred).select("doc_id", F.col("g").cast("long").alias("g"), F.col("p").cast("long").alias("p"), F.col("overlap").cast("long").alias("overlap"))


def deoverlap(spark, sf_dir):
    s = _line_spans(spark, sf_dir).withColumn("end", F.col("end") + 40).withColumn("source", F.lit(1))
    return spans.without_overlaps(s).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def adjacent_overlap(spark, sf_dir):
    s = _line_spans(spark, sf_dir).withColumn("end", F.col("end") + 2)
    return spans.adjacent_overlaps(s).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("next_start").cast("long").alias("next_start"))


def spans_missed(spark, sf_dir):
    gold = _line_spans(spark, sf_dir)
    pred = gold.where(F.col("idx") % 3 != 0)
    return spans.unmatched(gold, spans.greedy_pairs(gold, pred), "g").groupBy("type").agg(F.count("*").alias("n"))


def chunk_budget(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    turn = F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"), (F.expr("turn % 3") == 0).alias("e"))))
    c = t.groupBy("conv_id").agg(turn.alias("t")).select("conv_id", F.transform("t", lambda x: x["n"]).alias("sizes"), F.transform("t", lambda x: x["e"]).alias("ends"))
    return c.select("conv_id", F.explode(words.packed(F.col("sizes"), F.col("ends"), 2000)).alias("c")).select("conv_id", F.col("c.lo").cast("long").alias("lo"), F.col("c.hi").cast("long").alias("hi"))


def gazetteer_partial(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), F.concat_ws(" ", "p_name", F.regexp_replace("p_type", "[^A-Za-z ]", " ")).alias("phrase"), F.col("p_brand").alias("code"))
    return gazetteer.partial(gazetteer.build(p)).groupBy("n_tokens").agg(F.countDistinct("piece").alias("n"))


def alias_split(spark, sf_dir):
    from chartloom.sources.readers import aliases

    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name_id"), F.col("p_brand").alias("code"), F.concat(F.initcap("p_name"), F.lit("; "), F.initcap("p_type"), F.lit(", of "), "p_brand").alias("name"))
    return aliases(p).select(F.col("alias"), "name_id", F.col("pos").cast("long").alias("pos"))


def tty_dedupe(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_name", "p_brand", "p_partkey").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    return linking.preferred(p, "p_name", "p_brand", ["Brand#31", "Brand#12", "Brand#55", "Brand#11"])


def exact_then_fuzzy(spark, sf_dir):
    names = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("name_id")).select("name_id", F.col("p_name").alias("name"), F.col("name_id").cast("string").alias("code"))
    mentions = names.select("name").unionByName(names.select(F.concat("name", F.lit(" tab")).alias("name"))).withColumnRenamed("name", "mention")
    return linking.exact_then_fuzzy(mentions, names, fixed.DRUG_CUTOFF, 2).select("mention", "code", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def token_block_candidates(spark, sf_dir):
    p = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("name_id"))
    return linking.token_candidates(p.select(F.col("p_name").alias("mention")), p.select("name_id", F.col("p_name").alias("name")))


def token_sort_key(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", similarity.sorted_words(F.concat_ws(" ", "p_name", "p_type")).alias("key"))


def wer_conversations(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = t.withColumn("before", F.lag("text").over(w)).where("before IS NOT NULL")
    return t.select("conv_id", "turn", F.round(similarity.word_error_rate(T.tokens(F.col("before")), T.tokens(F.col("text"))), 6).alias("wer"))


def jaccard_words(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = t.withColumn("before", F.lag("text").over(w)).where("before IS NOT NULL")
    return t.select("conv_id", "turn", F.round(similarity.set_jaccard(F.split("before", " "), F.split("text", " ")), 6).alias("jaccard"))


def cosine_topk(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return linking.nearest(e.where("id % 100 = 0"), e, 5).select("q", "id", F.round("score", 4).alias("score"))


def margin_select(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    top = linking.nearest(e.where("id % 100 = 0"), e, 3).where("q <> id").select(F.col("q").alias("mention"), F.col("id").alias("code"), "score")
    return linking.by_margin(top, 0.05, 0.2).select("mention", "code", F.col("rank").cast("long").alias("rank"))


def dense_lex_merge(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    top = linking.nearest(e.where("id % 100 = 0"), e, 4).select(F.col("q").alias("mention"), F.col("id").alias("code"), "score", "rank")
    alike = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    first = lambda d, key: d.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("vec_id"))).where("rank <= 4")  # noqa: E731  no label gives a vector more than its four first
    lex = first(alike.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "label").join(first(alike, "label").drop("rank"), "label"), "q")
    return linking.merged(top.drop("score"), lex.select(F.col("q").alias("mention"), F.col("vec_id").alias("code"), "rank")).select("mention", "code", F.col("place").cast("long").alias("place"))


def tfidf_terms(spark, sf_dir):
    d = _docs(spark, sf_dir).where("doc_id IS NOT NULL")
    t = d.repartition("doc_id").select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD}+)"), F.lit(1))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    w = linking.tfidf(t, d.agg(F.count("*").alias("n")))
    return w.groupBy(F.col("id").alias("doc_id")).agg(F.round(F.sum("w"), 4).alias("mass"), F.count("*").alias("n"))


def char_tfidf(spark, sf_dir):
    names = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("name_id"))
    grams = linking.char_grams(names, "name_id", "p_name")
    return grams.groupBy("gram").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


def pair_left(spark, sf_dir):
    docs, labels = _docs(spark, sf_dir).select("doc_id"), _table(spark, sf_dir, "labels")
    have, extra = scoring.paired(docs, labels)
    return have.groupBy("has_pred").agg(F.count("*").alias("n")).unionByName(extra.agg(F.count("*").alias("n")).select(F.lit(None).cast("boolean").alias("has_pred"), "n"))


def score_weighted(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    s = d.select("doc_id", F.col("quality").cast("double").alias("text"), (1.0 - F.col("toxic")).alias("assertions"), ((F.col("doc_id") % 10) / 10.0).alias("candidates"), (F.col("n_chars") % 7).alias("weight"))
    return scoring.corpus(s).select(*[F.round(x, 6).alias(x) for x in ("text", "assertions", "candidates", "final")], "weight")


def _line_scores(spark, sf_dir):
    gold = _line_spans(spark, sf_dir).withColumns({"assertions": F.array().cast("array<string>"), "candidates": F.array(F.col("idx").cast("string"))})
    pred = gold.where(F.col("idx") % 4 != 1).withColumn("text", F.regexp_replace("text", r"\s\S+$", ""))
    return scoring.documents(_docs(spark, sf_dir), gold, pred)


def score_documents(spark, sf_dir):
    return _line_scores(spark, sf_dir).select("doc_id", "n_gold", "n_pred", "n_matched", "n_missed", "n_spurious", "weight", F.round("candidates", 6).alias("candidates"))


def score_texts(spark, sf_dir):
    """The text score of score_documents, whose SQL has the other columns."""
    return _line_scores(spark, sf_dir).select("doc_id", F.round("text", 6).alias("text"))


def type_report(spark, sf_dir):
    gold = _line_spans(spark, sf_dir).withColumns({"assertions": F.array(F.lit("isFamily")), "candidates": F.array(F.col("idx").cast("string"))})
    return scoring.by_type(gold, gold.where(F.col("idx") % 3 != 0)).select("type", "n_gold", "n_pred", "n_matched", "n_missed", F.round("recall", 6).alias("recall"), "text", "assertions", "candidates")


def rank_hist_median(spark, sf_dir):
    return corpus.rank_median(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


def cutoff_sweep(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    grid = spark.createDataFrame([(float(c), k) for c in (20, 40, 60, 80) for k in (1, 2)], "cutoff double, k int")
    ranked = d.select(F.col("doc_id").alias("mention"), F.col("quality").cast("string").alias("code"), (F.col("n_chars") % 101).cast("double").alias("score"), F.lit(1).alias("rank"))
    gold = d.select(F.col("doc_id").alias("mention"), F.array(F.lit("1")).alias("codes"))
    return scoring.cutoffs(ranked, gold, grid).select("cutoff", F.col("k").cast("long").alias("k"), F.round("jaccard", 6).alias("jaccard"))


def ingredient_map(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    linked = n.select(F.col("n_name").alias("mention"), F.col("n_nationkey").cast("string").alias("code"), F.lit(100.0).alias("score"), F.lit(1).alias("rank"))
    rel = n.where("n_regionkey <> 2").select(F.col("n_nationkey").cast("string").alias("code"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("ingredient"))
    return linking.to_ingredients(linked, rel).select("mention", "code")


def marker_multiset(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    each = t.select("conv_id", "turn", F.explode(F.split("text", " ")).alias("item"))
    before, after = each.where("turn = 0").drop("turn"), each.where("turn = 1").drop("turn")
    return corpus.kept_share(before, after, "conv_id", "item").select("conv_id", F.round("share", 6).alias("share"))


def take_backfill(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return corpus.take_then_fill(d, "lang", 10, 60, [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "lang", "backfill")


def seq_ids(spark, sf_dir):
    return structure.numbered(_table(spark, sf_dir, "documents"), "lang", ("doc_id",), 6).select("doc_id", "seq_id")


def issue_report(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    s = _line_spans(spark, sf_dir).withColumns({"end": F.when(F.col("idx") % 5 == 0, F.col("end") + 2).otherwise(F.col("end")), "candidates": F.when(F.col("idx") % 4 == 0, F.array(F.lit("X1"))).otherwise(F.array().cast("array<string>"))})
    issues = validation.positions(docs, s).unionByName(validation.candidates(s)).unionByName(validation.overlaps(s))
    return issues.groupBy("level", "code").agg(F.count("*").alias("n"))


def mask_overlay(spark, sf_dir):
    some = F.array(F.struct(F.lit(2).alias("start"), F.lit(7).alias("end")), F.struct(F.lit(10).alias("start"), F.lit(13).alias("end")))
    return _docs(spark, sf_dir).where(F.length("text") >= 20).select("doc_id", F.md5(corpus.masked(F.col("text"), some)).alias("digest"))


def json_props(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select(F.from_json("props", "k LONG").alias("p")).groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


def paragraphs(spark, sf_dir):
    from chartloom.sources.readers import paragraphs as cut

    turns = _table(spark, sf_dir, "conversations").where("text IS NOT NULL AND trim(text) <> ''")
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n \n").alias("text"))
    return cut(docs).groupBy("doc_id").agg(F.count("*").alias("n"))


def negation_window(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    heading = F.when(F.col("p_size") % 5 == 0, "1. Tiền sử gia đình").when(F.col("p_size") % 5 == 1, "TS").when(F.col("p_size") % 5 == 2, "Khám")
    prefix = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " Không có ").otherwise(" có "), F.when(F.col("p_size") % 3 == 0, "sốt. ").otherwise("sốt, "), "p_type")
    kind = F.when(F.col("p_size") % 7 == 0, "TÊN_XÉT_NGHIỆM").otherwise("TRIỆU_CHỨNG")
    return p.select("p_partkey", F.array_join(structure.flags(heading, prefix, kind), ",").alias("flags"))


def _part_spans(spark, sf_dir):
    none = F.array(F.concat(F.lit("is"), (F.col("p_size") % 3).cast("string")))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("idx"), F.col("p_name").alias("text"), F.col("p_type").alias("type"), F.array("p_brand").alias("candidates"), none.alias("assertions"))


def across_issues(spark, sf_dir):
    return validation.across(_part_spans(spark, sf_dir)).select("level", "code", "text", "msg")


def missed_mentions(spark, sf_dir):
    s = _line_spans(spark, sf_dir).where(F.col("idx") % 2 == 0)
    return validation.missed(_docs(spark, sf_dir), s).select("doc_id", "text", F.col("msg").cast("long").alias("at"))


def code_absent(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    s = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("idx"), F.col("o_orderpriority").alias("text"), F.when(F.col("o_orderkey") % 4 == 0, "TRIỆU_CHỨNG").otherwise("CHẨN_ĐOÁN").alias("type"), F.array(F.col("o_custkey").cast("string"), F.concat(F.lit("x"), (F.col("o_custkey") % 50).cast("string"))).alias("candidates"))
    names = _table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("name"))
    return validation.unknown_codes(s, names).groupBy("level", "code", "msg").agg(F.count("*").alias("n"))


def code_mismatch(spark, sf_dir):
    p = _part_spans(spark, sf_dir).withColumns({"type": F.lit("THUỐC"), "candidates": F.array(F.col("doc_id").cast("string"))})
    names = p.select(F.col("doc_id").cast("string").alias("code"), F.when(F.col("doc_id") % 3 == 0, F.lpad(F.col("doc_id").cast("string"), 9, "0")).otherwise(F.upper("text")).alias("name"))
    return validation.mismatched_codes(p, names).select("doc_id", "level", "code", "msg")


def suggestion_issues(spark, sf_dir):
    p = _part_spans(spark, sf_dir).withColumn("type", F.lit("CHẨN_ĐOÁN"))
    code = F.concat(F.lit("A"), (F.col("doc_id") % 4).cast("string"), F.lit("."), (F.col("doc_id") % 3).cast("string"))
    p = p.withColumns({"text": F.concat("text", F.lit(" "), F.col("doc_id").cast("string")), "candidates": F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(code))})
    s = p.where("doc_id % 7 <> 0").select("text", F.array(F.concat(F.lit("A"), (F.col("doc_id") % 8).cast("string"), F.lit("."), (F.col("doc_id") % 6).cast("string"))).alias("codes"))
    return validation.suggestions(p, s).groupBy("level", "code").agg(F.count("*").alias("n"))


def flag_issues(spark, sf_dir):
    p = _table(spark, sf_dir, "part").withColumn("left_", F.when(F.col("p_size") % 4 == 0, "có tiền sử và không ").when(F.col("p_size") % 4 == 1, "KHÔNG ").otherwise("có "))
    docs = p.select(F.col("p_partkey").alias("doc_id"), F.concat("left_", "p_name").alias("text"))
    s = p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("idx"), F.col("p_name").alias("text"), F.when(F.col("p_size") % 3 == 0, "TRIỆU_CHỨNG").otherwise("THUỐC").alias("type"), F.when(F.col("p_size") % 8 == 0, F.array(F.lit("isNegated"))).otherwise(F.array().cast("array<string>")).alias("assertions"), F.length("left_").alias("start"), F.length(F.concat("left_", "p_name")).alias("end"))
    return validation.missing_flags(docs, s).groupBy("code", "msg").agg(F.count("*").alias("n"))


def unexpected_codes(spark, sf_dir):
    s = _part_spans(spark, sf_dir).withColumn("type", F.element_at(F.array(*map(F.lit, fixed.OUTPUT_TYPES)), (F.col("doc_id") % 5 + 1).cast("int")))
    s = s.withColumn("candidates", F.when(F.col("doc_id") % 2 == 0, F.col("candidates")).otherwise(F.array().cast("array<string>")))
    return validation.candidates(s).select("doc_id", "level", "code")


def dataset_statistics(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("?")).alias("source"))
    s = _line_spans(spark, sf_dir).withColumns({"end": F.when(F.col("idx") % 6 == 5, F.col("end") + 1).otherwise(F.col("end")), "type": F.when(F.col("idx") % 3 == 0, "TRIỆU_CHỨNG").otherwise(F.col("type")), "candidates": F.when(F.col("idx") % 4 == 1, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>")), "assertions": F.when(F.col("idx") % 2 == 1, F.array(F.lit("isFamily"))).otherwise(F.array().cast("array<string>"))})
    return corpus.statistics(docs, s, "source").select("overall", "source", "n_docs", "n_spans", "bad_offsets", *[F.round(x, 6).alias(x) for x in ("spans_a_doc", "coded", "flagged", "masked", "not_nfc", "headed")])


def worst_n(spark, sf_dir):
    return scoring.worst(_table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("score")), 20, "score")


def event_vocab(spark, sf_dir):
    return corpus.counted(_table(spark, sf_dir, "events"), "event_type")


def gazetteer_hits(spark, sf_dir):
    phrase = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry"), F.col("text").alias("phrase"), F.col("item_id").cast("string").alias("code"))
    return gazetteer.hits(_docs(spark, sf_dir), gazetteer.build(phrase)).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


def markup_unwrap(spark, sf_dir):
    docs = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("**ab** 〔DX| "), "text", F.lit(" 〕 mid 〔bad 〔ZZ|cut〕〔DRUG|xyz〕")).alias("text"))
    u = corpus.unwrapped(docs, aliases=fixed.MARK_ALIASES, allowed=fixed.OUTPUT_TYPES)
    return u.select("doc_id", "text", F.explode("spans").alias("s")).select("doc_id", F.md5("text").alias("digest"), F.col("s.type").alias("type"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def holdout_stratified(spark, sf_dir):
    return corpus.holdout(_table(spark, sf_dir, "documents"), "lang", 102, order=F.col("doc_id")).groupBy("lang").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


def _part_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("name_id")).select("name_id", F.col("p_name").alias("name"), F.col("name_id").cast("string").alias("code"), F.element_at(F.array(*map(F.lit, fixed.SUGGESTION_KINDS)), (F.col("name_id") % 7 + 1).cast("int")).alias("kind"))


def drug_links(spark, sf_dir):
    names = _part_names(spark, sf_dir)
    rel = names.select("code", F.concat(F.lit("in"), F.col("name_id") % 7).alias("ingredient"))
    return linking.drugs(names.select(F.concat(F.upper("name"), F.lit(" po q6h:prn")).alias("mention")), names, rel).select("mention", "code", "score")


def disease_links(spark, sf_dir):
    names = _part_names(spark, sf_dir)
    return linkers.diseases(names.select(F.concat(F.lit("  "), F.upper("name")).alias("mention")), names, 2).select("mention", "code", "score", F.col("rank").cast("long").alias("rank"))


def dense_links(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    names = e.select(F.col("vec_id").alias("name_id"), (F.col("vec_id") % 100).cast("string").alias("code"), "embedding")
    return linkers.dense_links(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("mention"), "embedding"), names).select("mention", "code", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def suggested_codes(spark, sf_dir):
    names = _part_names(spark, sf_dir)
    extra = names.select((F.col("name_id") + 1_000_000).alias("name_id"), F.upper("name").alias("name"), F.concat(F.lit("b"), "code").alias("code"), F.lit("SCD").alias("kind"))
    return linkers.suggested(names.select(F.concat("name", F.lit(" PO bid")).alias("mention")), names.unionByName(extra), 2, drug=True).select("mention", "code", "kind", "score", F.col("rank").cast("long").alias("rank"))


def codes_looked_up(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("code"))
    asked = p.select(F.lower("code").alias("mention")).unionByName(p.select(F.concat(F.lit("no"), "code").alias("mention")))
    return linkers.looked_up(asked, p, "drug", by_code=True, cutoff=90).select("mention", "match", "method", F.size("candidates").cast("long").alias("n"))


def names_looked_up(spark, sf_dir):
    names = _part_names(spark, sf_dir)
    return linkers.looked_up(names.select(F.concat(F.initcap("name"), F.lit(" iv stat")).alias("mention")), names, "rx").select("mention", "match", "method", F.col("candidates")[0]["code"].alias("code"))


def bio_labels(spark, sf_dir):
    w = spans.labelled_atoms(_docs(spark, sf_dir), _line_spans(spark, sf_dir).withColumn("label", F.lit("BENH")), surface=False)
    return w.groupBy("doc_id").agg(F.count_if(F.col("label").startswith("B-")).alias("b"), F.count_if(F.col("label").startswith("I-")).alias("i"), F.count_if(F.col("label") == "O").alias("o"), F.count_if("broken").alias("broken"))


def label_islands(spark, sf_dir):
    w = spans.atom_islands(_docs(spark, sf_dir), _line_spans(spark, sf_dir).withColumn("label", F.lit("BENH")))
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.sum(F.col("start").cast("long")).alias("starts"))


def concept_lines(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select(F.col("user_id").alias("file"), line.alias("line"), F.col("event_id").cast("string").alias("word"), F.concat(F.lit("I-"), "event_type").alias("label"))
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())[:2]  # a vocabulary
    return spans.concept_lines(rows, kept=kinds).select("file", "kind", "text", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def wrong_type_pairs(spark, sf_dir):
    gold = _line_spans(spark, sf_dir)
    pred = gold.withColumn("type", F.lit("TRIỆU_CHỨNG"))
    return spans.greedy_pairs(gold, pred, same_type=False).select("doc_id", F.col("g").cast("long").alias("g"), F.col("p").cast("long").alias("p"), F.col("overlap").cast("long").alias("overlap"))


def bad_offsets(spark, sf_dir):
    s = _line_spans(spark, sf_dir).withColumn("start", F.when(F.col("idx") % 3 == 1, F.col("start") + 1).otherwise(F.col("start")))
    return scoring.bad_offsets(_docs(spark, sf_dir), s).groupBy("doc_id").agg(F.count("*").alias("n"))


def usable_spans(spark, sf_dir):
    s = _line_spans(spark, sf_dir).withColumns({"start": F.when(F.col("idx") % 3 == 1, F.col("start") + 1).otherwise(F.col("start")), "type": F.when(F.col("idx") % 4 == 0, "LẠ").otherwise(F.col("type"))})
    kept, why = corpus.usable(_docs(spark, sf_dir), s)
    return why.unionByName(kept.agg(F.lit("kept").alias("reason"), F.count("*").alias("n")))


def drug_strings(spark, sf_dir):
    doses = F.when(F.col("p_size") % 3 == 0, " PO q12h:x BID").when(F.col("p_size") % 3 == 1, " 40 mg:iv stat").otherwise(" qh q1h prn")
    return _table(spark, sf_dir, "part").select("p_partkey", T.drug_string(F.concat("p_name", doses)).alias("t"))


def code_forms(spark, sf_dir):
    code = F.concat(F.lit(" a"), F.col("p_size").cast("string"), F.lit(" ."), F.col("p_partkey").cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", T.code_key(code).alias("key"), T.code_family(F.trim(code)).alias("family"))


def list_markers(spark, sf_dir):
    mark = F.when(F.col("p_size") % 4 == 0, " 12. - ").when(F.col("p_size") % 4 == 1, "a) ").when(F.col("p_size") % 4 == 2, "> • ").otherwise("")
    return _table(spark, sf_dir, "part").select("p_partkey", T.without_list_marker(F.concat(mark, F.upper("p_name"))).alias("t"))


def doc_traits(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\nab cd:\n***").otherwise("")))
    return structure.traits(d).select("doc_id", "masked", "not_nfc", "headed")


def caps_sections(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("HISTORY:, "), F.lower("p_name"), F.lit(".,PLAN: x,HISTORY: "), F.lower("p_type"), F.lit(",")).alias("text"))
    return structure.caps_sections(p).select("doc_id", F.col("place").cast("long").alias("place"), "section", "body")


def relaid_bodies(spark, sf_dir):
    body = F.concat("p_name", F.lit(" , 1. one.,HEART: "), F.lower("p_name"), F.lit(".,  ok, Vital Signs: z , 2. t  w"))
    return _table(spark, sf_dir, "part").select("p_partkey", structure.relaid(body).alias("t"))


def relocated_lines(spark, sf_dir):
    ls = _line_spans(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("s"))
    at = _docs(spark, sf_dir).join(ls, "doc_id").select("doc_id", corpus.relocated(F.col("text"), F.col("s")).alias("a"))
    return at.select("doc_id", F.size("a").cast("long").alias("n"), F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x).alias("starts"))


def hand_marks(spark, sf_dir):
    text = F.concat(F.lit("x 〔dx|"), "p_name", F.lit("|"), "p_brand", F.lit(", isNegated〕 và 〔TEST| "), "p_type", F.lit(" |isFamily〕 〔NO|y〕"))
    s, errors = corpus.hand_marked(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    good = s.select("doc_id", F.col("type").alias("what"), F.concat_ws("|", "text", F.array_join("candidates", ","), F.array_join("assertions", ",")).alias("about"), F.col("start").cast("long").alias("start"))
    return good.unionByName(errors.select("doc_id", F.col("reason").alias("what"), "about", F.lit(-1).cast("long").alias("start")))


def surface_codes(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    t = n.select(F.col("n_nationkey").alias("entry"), F.when(F.col("n_nationkey") % 2 == 0, "CHẨN_ĐOÁN").otherwise("THUỐC").alias("kind"), F.col("n_name").alias("surface"), F.array(F.col("n_nationkey").cast("string")).alias("codes"))
    s = n.select(F.lower("n_name").alias("text"), F.lit("CHẨN_ĐOÁN").alias("type")).unionByName(n.select(F.concat(F.lit("in "), "n_name", F.lit(" x")).alias("text"), F.lit("CHẨN_ĐOÁN").alias("type"))).unionByName(n.select(F.col("n_name").alias("text"), F.lit("THUỐC").alias("type")))
    return corpus.codes_by_surface(s, t).select("type", "text", F.array_join("candidates", ",").alias("codes"))


def rank_worth(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    ranked = p.where("p_size <= 12").select(F.col("p_brand").alias("mention"), F.col("p_size").cast("string").alias("code"), F.col("p_size").alias("rank")).distinct()
    gold = p.groupBy(F.col("p_brand").alias("mention")).agg(F.array_sort(F.collect_set(F.when(F.col("p_size") > 8, F.col("p_size").cast("string")))).alias("codes"))
    return scoring.ceiling(ranked, gold).select(F.round("ceiling", 6).alias("ceiling"), "found", "n")


def right_ranks(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    ranked = d.select(F.col("doc_id").alias("mention"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("rank")).select("mention", F.col("rank").cast("string").alias("code"), "rank")
    gold = d.select(F.col("doc_id").alias("mention"), F.when(F.col("n_chars") % 15 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("n_chars") % 15).cast("string"), F.lit("9"))).alias("codes"))
    return scoring.rank_histogram(ranked, gold).select(F.col("rank").cast("long").alias("rank"), "n")


def best_cutoff(spark, sf_dir):
    return scoring.best_cutoff(cutoff_sweep(spark, sf_dir))


def label_order(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 9 == 0, "0").otherwise(F.concat(F.lit("B-"), "event_type")).alias("label"))
    return corpus.ordered_labels(e)


def span_words(spark, sf_dir):
    return corpus.words_by_type(_line_spans(spark, sf_dir)).select("type", F.round("words", 6).alias("words"), "n")


def gate_counts(spark, sf_dir):
    kept, why = corpus.gated(_table(spark, sf_dir, "documents"), {"short": F.col("n_chars") >= 200, "lang": F.col("lang") != "de", "odd": F.col("doc_id") % 2 == 0})
    return why.unionByName(kept.agg(F.lit("kept").alias("reason"), F.count("*").alias("n")))


def segmented_words(spark, sf_dir):
    w = words.segmented(_docs(spark, sf_dir), lambda line: line.split(" "))
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("starts"))


def keyword_bio(spark, sf_dir):
    w = words.segmented(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" "), "p_type").alias("text")))
    keys = _table(spark, sf_dir, "part").select(F.split("p_type", " ")[0].alias("keyword"), F.lit("T").alias("type")).distinct()
    return gazetteer.keyword_labels(w.select("doc_id", "pos", F.col("surface").alias("word")), keys).groupBy("label").agg(F.count("*").alias("n"))


def dictionary_exact(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("code"))
    return linking.exact_then_fuzzy(p.select(F.upper("name").alias("mention")), p, 100.0, 2).select("mention", "code", "score", F.col("rank").cast("long").alias("rank"))


def routed_codes(spark, sf_dir):
    names = _part_names(spark, sf_dir)
    rel = names.select("code", F.concat(F.lit("in"), F.col("name_id") % 3).alias("ingredient")).where("code NOT LIKE '%5'")
    s = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit("*"))).otherwise(F.upper("p_name")).alias("text"), F.element_at(F.array(*map(F.lit, fixed.OUTPUT_TYPES)), (F.col("p_partkey") % 5 + 1).cast("int")).alias("type"))
    return linkers.routed(s, names, names, rel).select("doc_id", F.array_join("candidates", ",").alias("codes"))


def unofficial_types(spark, sf_dir):
    return scoring.unofficial(_table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 == 0, "THUỐC").when(F.col("p_size") % 3 == 1, F.col("p_type")).alias("type")))


def labels_without_text(spark, sf_dir):
    from chartloom.sources.readers import without_partner

    return without_partner(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    atoms_count, atom_offsets, line_offsets, word_freq_top, squash_ws, fold_accents, section_heading, negation_window, bio_islands, span_owner, greedy_match, deoverlap,
    adjacent_overlap, spans_missed, chunk_budget, gazetteer_hits, gazetteer_partial, alias_split, tty_dedupe, exact_then_fuzzy, drug_links, token_block_candidates, token_sort_key,
    wer_conversations, jaccard_words, cosine_topk, margin_select, dense_lex_merge, tfidf_terms, char_tfidf, pair_left, score_weighted, score_documents, score_texts, type_report, dataset_statistics,
    across_issues, event_vocab, rank_hist_median, cutoff_sweep, ingredient_map, code_absent, marker_multiset, worst_n, holdout_stratified, take_backfill, seq_ids,
    issue_report, missed_mentions, mask_overlay, markup_unwrap, json_props, paragraphs, code_mismatch, suggestion_issues, flag_issues, unexpected_codes, disease_links, dense_links,
    suggested_codes, codes_looked_up, names_looked_up, bio_labels, label_islands, concept_lines, wrong_type_pairs, bad_offsets, usable_spans, drug_strings, code_forms, list_markers, doc_traits,
    caps_sections, relaid_bodies, relocated_lines, hand_marks, surface_codes, rank_worth, right_ranks, best_cutoff, label_order, span_words, gate_counts, segmented_words, keyword_bio, dictionary_exact,
    routed_codes, unofficial_types, labels_without_text,
)}

ORACLES = {
    "atoms_count": rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{fixed.ATOM}')) AS BIGINT) AS n_atoms FROM documents",
    "line_offsets": f"WITH {LINE_SPANS} SELECT doc_id, idx AS line_no, s AS start, e - s AS n FROM line_spans",
    "word_freq_top": f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD}+')) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 50",
    "squash_ws": r"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)",
    "bio_islands": """SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n FROM (
        SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
          SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
        GROUP BY user_id, run""",
    "adjacent_overlap": f"WITH {LINE_SPANS} SELECT doc_id, idx, n AS next_start FROM (SELECT doc_id, idx, e + 2 AS e2, lead(s) OVER (PARTITION BY doc_id ORDER BY s, e, idx) AS n FROM line_spans) WHERE n < e2",
    "spans_missed": f"WITH {LINE_SPANS} SELECT type, count(*) AS n FROM line_spans WHERE idx % 3 = 0 AND e > s GROUP BY 1",
    "tty_dedupe": """SELECT p_name, p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY coalesce(list_position(['Brand#31','Brand#12','Brand#55','Brand#11'], p_brand), 5), p_brand, p_partkey) AS n
        FROM (SELECT p_name, p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2)) WHERE n = 1""",
    "token_block_candidates": """WITH p AS (SELECT p_name, min(p_partkey) AS name_id FROM part GROUP BY 1), t AS (SELECT p_name, name_id, unnest(string_split(lower(p_name), ' ')) AS t FROM p)
        SELECT DISTINCT a.p_name AS mention, b.name_id FROM t a JOIN t b USING (t)""",
    "token_sort_key": "SELECT p_partkey, array_to_string(list_sort(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: x <> '')), ' ') AS key FROM part",
    "jaccard_words": """SELECT conv_id, turn, round(CAST(len(list_intersect(b, a)) AS DOUBLE) / len(list_distinct(list_concat(b, a))), 6) AS jaccard FROM (
        SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ') AS b FROM conversations WHERE text IS NOT NULL) WHERE b IS NOT NULL""",
    "event_vocab": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "rank_hist_median": """SELECT l_returnflag, max(CASE WHEN r = n // 2 + 1 THEN l_quantity END) AS median, min(l_quantity) AS least, max(l_quantity) AS largest, count(*) AS n FROM (
        SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_quantity IS NOT NULL) GROUP BY 1""",
    "pair_left": """SELECT has_pred, count(*) AS n FROM (SELECT DISTINCT d.doc_id, l.doc_id IS NOT NULL AS has_pred FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1
        UNION ALL SELECT CAST(NULL AS BOOLEAN), count(*) FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))""",
    "score_weighted": """WITH s AS (SELECT CAST(quality AS DOUBLE) AS t, 1.0::DOUBLE - toxic AS a, (doc_id % 10) / 10.0::DOUBLE AS c, n_chars % 7 AS w FROM documents JOIN labels USING (doc_id)),
        m AS (SELECT avg(t) AS t, avg(a) AS a, sum(c * w) / sum(w) AS c, CAST(sum(w) AS BIGINT) AS weight FROM s)
        SELECT round(t, 6) AS text, round(a, 6) AS assertions, round(c, 6) AS candidates, round(t * 0.3::DOUBLE + a * 0.3::DOUBLE + c * 0.4::DOUBLE, 6) AS final, weight FROM m""",
    "cutoff_sweep": """SELECT cutoff, k, round(avg(CASE WHEN (n_chars % 101) > cutoff AND quality = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS jaccard FROM documents JOIN labels USING (doc_id),
        (SELECT CAST(unnest([20, 40, 60, 80]) AS DOUBLE) AS cutoff), (SELECT CAST(unnest([1, 2]) AS BIGINT) AS k) GROUP BY 1, 2""",
    "ingredient_map": "SELECT n_name AS mention, CASE WHEN n_regionkey <> 2 THEN 'r' || n_regionkey ELSE CAST(n_nationkey AS VARCHAR) END AS code FROM nation",
    "marker_multiset": """WITH e AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS item FROM conversations WHERE text IS NOT NULL),
        a AS (SELECT conv_id, item, count(*) AS n FROM e WHERE turn = 0 GROUP BY 1, 2), b AS (SELECT conv_id, item, count(*) AS m FROM e WHERE turn = 1 GROUP BY 1, 2)
        SELECT conv_id, round(CAST(sum(least(n, coalesce(m, 0))) AS DOUBLE) / sum(n), 6) AS share FROM a LEFT JOIN b USING (conv_id, item) GROUP BY 1""",
    "worst_n": "SELECT doc_id, n_chars % 97 AS score FROM documents ORDER BY score, doc_id LIMIT 20",
    "seq_ids": "SELECT doc_id, lang || '_' || lpad(CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS VARCHAR), 6, '0') AS seq_id FROM documents",
    "take_backfill": """SELECT doc_id, lang, place > 10 AS backfill FROM (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents)
        ORDER BY CASE WHEN place <= 10 THEN 0 ELSE 1 END, n_chars DESC, doc_id LIMIT 60""",
    "mask_overlay": "SELECT doc_id, md5(left(text, 2) || '*****' || substring(text, 8, 3) || '***' || substring(text, 14)) AS digest FROM documents WHERE length(text) >= 20",
    "json_props": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "paragraphs": "SELECT conv_id AS doc_id, count(*) AS n FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1",
    "cosine_topk": """SELECT q, id, round(s, 4) AS score FROM (SELECT a.vec_id AS q, b.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE n <= 5""",
    "tfidf_terms": f"""WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}+')) AS term FROM documents) GROUP BY 1, 2),
        d AS (SELECT term, count(*) AS df FROM t GROUP BY 1), r AS (SELECT doc_id, tf * (ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM t JOIN d USING (term))
        SELECT doc_id, round(sum(w) / sqrt(sum(w * w)), 4) AS mass, count(*) AS n FROM r GROUP BY 1""",
    "atom_offsets": rf"""WITH r AS (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{fixed.ATOM}|\s+') AS ps FROM documents)),
        o AS (SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM r)
        SELECT doc_id, count(*) AS n, CAST(sum(e - length(p)) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends, CAST(max(e) AS BIGINT) AS last FROM o WHERE NOT regexp_matches(p, '^\s') GROUP BY 1""",
    "margin_select": """WITH s AS (SELECT a.vec_id AS q, b.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
        t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS n FROM s), u AS (SELECT q, id, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS r FROM t WHERE n <= 3 AND q <> id),
        m AS (SELECT q, max(s) FILTER (r = 1) AS a, max(s) FILTER (r = 2) AS b FROM u GROUP BY 1)
        SELECT q AS mention, id AS code, r AS rank FROM u JOIN m USING (q) WHERE r = 1 OR (r = 2 AND NOT ((a < 0.2 AND b < 0.2) OR a - b > 0.05))""",
    "issue_report": f"""WITH {LINE_SPANS}, t AS (SELECT doc_id, idx, type, text, s, CASE WHEN idx % 5 = 0 THEN e + 2 ELSE e END AS e FROM line_spans), x AS (SELECT t.*, d.text AS raw, lead(s) OVER (PARTITION BY t.doc_id ORDER BY s, e, idx) AS nxt FROM t JOIN documents d USING (doc_id))
        SELECT 'ERROR' AS level, 'A_OUT_OF_RANGE' AS code, count(*) AS n FROM x WHERE e > length(raw) HAVING count(*) > 0 UNION ALL
        SELECT 'ERROR', 'A_MISMATCH', count(*) FROM x WHERE e <= length(raw) AND substring(raw, s + 1, e - s) <> text HAVING count(*) > 0 UNION ALL
        SELECT 'WARN', 'D_MISSING_CAND', count(*) FROM x WHERE idx % 4 <> 0 HAVING count(*) > 0 UNION ALL
        SELECT 'WARN', 'I_OVERLAP', count(*) FROM x WHERE nxt < e HAVING count(*) > 0""",
    "alias_split": r"""WITH p AS (SELECT p_partkey AS name_id, list_transform(string_split_regex(array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ') || '; ' || array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ') || ', of ' || p_brand, '[,;]'), lambda a: trim(a)) AS ps FROM part),
        c AS (SELECT name_id, unnest(ps) AS alias, unnest(range(0, len(ps))) AS pos FROM p)
        SELECT alias, name_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY lower(alias) ORDER BY name_id, pos) AS n FROM c WHERE (pos = 0 OR regexp_matches(alias, '^[A-Z]')) AND len(string_split_regex(alias, '\s+')) BETWEEN 2 AND 5 AND length(alias) >= 6) WHERE n = 1""",
    "score_documents": f"""WITH {LINE_SPANS} SELECT d.doc_id, count(idx) AS n_gold, count(idx) FILTER (idx % 4 <> 1) AS n_pred, count(idx) FILTER (idx % 4 <> 1) AS n_matched, count(idx) FILTER (idx % 4 = 1) AS n_missed, CAST(0 AS BIGINT) AS n_spurious,
        CAST(2 * count(idx) AS BIGINT) AS weight, round(CASE WHEN count(idx) = 0 THEN 1.0::DOUBLE ELSE CAST(count(idx) FILTER (idx % 4 <> 1) AS DOUBLE) / count(idx) END, 6) AS candidates FROM documents d LEFT JOIN line_spans l ON d.doc_id = l.doc_id GROUP BY 1""",
    "negation_window": r"""WITH p AS (SELECT p_partkey, p_size, p_name || CASE WHEN p_size % 2 = 0 THEN ' Không có ' ELSE ' có ' END || CASE WHEN p_size % 3 = 0 THEN 'sốt. ' ELSE 'sốt, ' END || p_type AS t FROM part)
        SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' ELSE array_to_string(list_filter([CASE p_size % 5 WHEN 0 THEN 'isFamily' WHEN 1 THEN 'isHistorical' END,
          CASE WHEN regexp_matches(lower(t), '(?:không|không có|không kèm|không phải|phủ nhận|chưa ghi nhận)(?:[^\p{L}\p{M}\p{N}_.;][^.;]{0,29})?$') THEN 'isNegated' END], lambda x: x IS NOT NULL), ',') END AS flags FROM p""",
    "across_issues": """WITH s AS (SELECT lower(p_name) AS text, p_type, p_brand, p_size FROM part), c AS (SELECT text, p_type, list_sort(list(DISTINCT p_brand)) AS k FROM s GROUP BY 1, 2)
        SELECT 'WARN' AS level, 'G_TYPE_CONFLICT' AS code, text, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS msg FROM s GROUP BY text HAVING count(DISTINCT p_type) > 1 UNION ALL
        SELECT 'WARN', 'G_CODE_CONFLICT', text, array_to_string(k, ' | ') FROM c WHERE len(k) > 1 UNION ALL
        SELECT 'INFO', 'E_ASSERTION_VOCAB', 'is' || (p_size % 3), CAST(count(*) AS VARCHAR) FROM s GROUP BY 3""",
    "missed_mentions": f"""WITH {LINE_SPANS}, x AS (SELECT DISTINCT doc_id, text AS t FROM line_spans WHERE idx % 2 = 0 AND length(text) >= 4),
        occ AS (SELECT doc_id, t, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i, len(ps) AS k FROM (SELECT doc_id, t, string_split(d.text, t) AS ps FROM x JOIN documents d USING (doc_id))),
        a AS (SELECT doc_id, t, CAST(sum(length(p) + length(t)) OVER (PARTITION BY doc_id, t ORDER BY i) - length(t) AS BIGINT) AS place, i, k FROM occ)
        SELECT doc_id, t AS text, place AS at FROM a WHERE i < k AND NOT EXISTS (SELECT 1 FROM line_spans l WHERE l.doc_id = a.doc_id AND idx % 2 = 0 AND s <= place AND place < e)""",
    "code_absent": """SELECT 'ERROR' AS level, 'B_CODE_NOT_FOUND' AS code, c AS msg, count(*) AS n FROM (SELECT unnest([CAST(o_custkey AS VARCHAR), 'x' || (o_custkey % 50)]) AS c FROM orders WHERE o_orderkey % 4 <> 0)
        WHERE c NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 <> 0) GROUP BY c""",
    "code_mismatch": "SELECT p_partkey AS doc_id, 'WARN' AS level, 'C_CODE_MISMATCH' AS code, p_partkey || ' 0.0' AS msg FROM part WHERE p_partkey % 3 = 0",
    "suggestion_issues": """WITH p AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 5 <> 0 THEN 'A' || (p_partkey % 4) || '.' || (p_partkey % 3) END AS have, CASE WHEN p_partkey % 7 <> 0 THEN 'A' || (p_partkey % 8) || '.' || (p_partkey % 6) END AS want FROM part),
        k AS (SELECT CASE WHEN want IS NULL AND have IS NULL THEN NULL WHEN want IS NULL THEN 'C2_NO_MATCH' WHEN have IS NULL THEN 'C2_SUGGEST' WHEN have = want THEN NULL WHEN split_part(have, '.', 1) = split_part(want, '.', 1) THEN 'C2_GRANULARITY' ELSE 'C2_SUGGEST' END AS code FROM p)
        SELECT CASE code WHEN 'C2_SUGGEST' THEN 'WARN' ELSE 'INFO' END AS level, code, count(*) AS n FROM k WHERE code IS NOT NULL GROUP BY code""",
    "flag_issues": """SELECT code, msg, count(*) AS n FROM (SELECT 'H_MAYBE_NEG' AS code, 'không' AS msg FROM part WHERE p_size % 4 IN (0, 1) AND p_size % 3 <> 0 AND p_size % 8 <> 0
        UNION ALL SELECT 'H_MAYBE_HIST', 'tiền sử' FROM part WHERE p_size % 4 = 0 AND p_size % 3 <> 0) GROUP BY 1, 2""",
    "unexpected_codes": """SELECT p_partkey AS doc_id, 'ERROR' AS level, 'D_UNEXPECTED_CAND' AS code FROM part WHERE p_partkey % 5 IN (0, 1) AND p_partkey % 2 = 0
        UNION ALL SELECT p_partkey, 'WARN', 'D_MISSING_CAND' FROM part WHERE p_partkey % 5 IN (3, 4) AND p_partkey % 2 = 1""",
    "dataset_statistics": rf"""WITH {LINE_SPANS}, s AS (SELECT l.doc_id, idx, substring(d.text, s + 1, (CASE WHEN idx % 6 = 5 THEN e + 1 ELSE e END) - s) = l.text AS ok, l.text, CASE WHEN idx % 3 = 0 THEN 'TRIỆU_CHỨNG' ELSE type END AS type FROM line_spans l JOIN documents d USING (doc_id)),
        r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT ok) AS bad, count(*) FILTER (ok AND type <> 'TRIỆU_CHỨNG') AS cb, count(*) FILTER (ok AND type <> 'TRIỆU_CHỨNG' AND idx % 4 = 1) AS cd, count(*) FILTER (ok AND idx % 2 = 1) AS fl, max(CAST(contains(text, '*') AS INT)) AS masked FROM s GROUP BY 1),
        d AS (SELECT coalesce(source, '?') AS source, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(cb, 0) AS cb, coalesce(cd, 0) AS cd, coalesce(fl, 0) AS fl, coalesce(masked, 0) AS masked, CAST(nfc_normalize(text) <> text AS INT) AS form, CAST(regexp_matches(text, '(?m)^[^\n]{{3,40}}:\s*$') AS INT) AS head FROM documents LEFT JOIN r USING (doc_id))
        SELECT CAST(grouping(source) AS INT) AS overall, source, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_spans, CAST(sum(bad) AS BIGINT) AS bad_offsets, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS spans_a_doc, round(CAST(sum(cd) AS DOUBLE) / greatest(sum(cb), 1), 6) AS coded,
          round(CAST(sum(fl) AS DOUBLE) / greatest(sum(n), 1), 6) AS flagged, round(avg(masked), 6) AS masked, round(avg(form), 6) AS not_nfc, round(avg(head), 6) AS headed FROM d GROUP BY ROLLUP (source)""",
    "gazetteer_hits": rf"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(nfc_normalize(text), '{PHRASE}'), lambda x: lower(x)) AS w FROM documents),
        b AS (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, list_transform(regexp_extract_all(nfc_normalize(text), '{PHRASE}'), lambda x: lower(x)) AS w FROM benchmark) WHERE len(w) > 0 GROUP BY w),
        t AS (SELECT doc_id, w, unnest(w) AS first, unnest(range(1, len(w) + 1)) AS i FROM d)
        SELECT doc_id, CAST(item_id AS VARCHAR) AS code, count(*) AS n FROM t JOIN b ON first = b.w[1] WHERE t.w[i:i + len(b.w) - 1] = b.w GROUP BY 1, 2""",
    "markup_unwrap": """SELECT doc_id, digest, type, start, "end" FROM (SELECT item_id AS doc_id, md5('ab ' || text || ' mid bad cutxyz') AS digest, length(text) AS a FROM (SELECT item_id, trim(text) AS text FROM benchmark)) x,
        LATERAL (SELECT 'CHẨN_ĐOÁN' AS type, CAST(3 AS BIGINT) AS start, CAST(3 + a AS BIGINT) AS "end" UNION ALL SELECT 'THUỐC', CAST(15 + a AS BIGINT), CAST(18 + a AS BIGINT)) y""",
    "holdout_stratified": """WITH RECURSIVE z AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1),
        q AS (SELECT 0 AS step, lang, n, least(n, greatest(1, CAST(round_even(102.0 * n / sum(n) OVER (), 0) AS BIGINT))) AS quota FROM z
          UNION ALL SELECT step + 1, lang, n, quota + CASE WHEN over > 0 AND most = 1 THEN -1 WHEN over < 0 AND room = 1 THEN 1 ELSE 0 END
          FROM (SELECT *, sum(quota) OVER () - least(102, sum(n) OVER ()) AS over, row_number() OVER (ORDER BY quota DESC, n DESC, lang) AS most, row_number() OVER (ORDER BY n - quota DESC, n DESC, lang) AS room FROM q) WHERE over <> 0),
        f AS (SELECT lang, quota FROM q WHERE step = (SELECT max(step) FROM q))
        SELECT lang, count(*) AS n, max(doc_id) AS last FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) JOIN f USING (lang) WHERE k <= quota GROUP BY 1""",
    "drug_links": "SELECT upper(p_name) || ' po q6h:prn' AS mention, 'in' || (min(p_partkey) % 7) AS code, CAST(100 AS DOUBLE) AS score FROM part GROUP BY p_name",
    "disease_links": "SELECT '  ' || upper(p_name) AS mention, CAST(min(p_partkey) AS VARCHAR) AS code, CAST(100 AS DOUBLE) AS score, CAST(1 AS BIGINT) AS rank FROM part GROUP BY p_name",
    "dense_links": """WITH s AS (SELECT a.vec_id AS q, b.vec_id % 100 AS code, max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 GROUP BY 1, 2),
        u AS (SELECT q, CAST(code AS VARCHAR) AS code, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, CAST(code AS VARCHAR)) AS r FROM s), m AS (SELECT q, max(s) FILTER (r = 1) AS a, max(s) FILTER (r = 2) AS b FROM u GROUP BY 1)
        SELECT q AS mention, code, round(s, 4) AS score, r AS rank FROM u JOIN m USING (q) WHERE r = 1 OR (r = 2 AND NOT ((a < 0.2 AND b < 0.2) OR a - b > 0.2))""",
    "suggested_codes": """WITH n AS (SELECT p_name, min(p_partkey) AS i FROM part GROUP BY 1), k AS (SELECT *, ['SCD', 'SBD', 'GPCK', 'BPCK', 'BN', 'PIN', 'IN'][i % 7 + 1] AS kind FROM n)
        SELECT p_name || ' PO bid' AS mention, CASE o WHEN 0 THEN CAST(i AS VARCHAR) ELSE 'b' || i END AS code, CASE o WHEN 0 THEN kind ELSE 'SCD' END AS kind, CAST(100 AS DOUBLE) AS score, CAST(CASE WHEN kind = 'SCD' THEN o + 1 ELSE 2 - o END AS BIGINT) AS rank FROM k, (SELECT unnest([0, 1]) AS o)""",
    "codes_looked_up": """SELECT lower(p_brand) AS mention, TRUE AS match, 'exact' AS method, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT DISTINCT 'no' || p_brand, FALSE, 'exact', CAST(0 AS BIGINT) FROM part""",
    "names_looked_up": """SELECT array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ') || ' iv stat' AS mention, TRUE AS match, 'exact' AS method, CAST(min(p_partkey) AS VARCHAR) AS code FROM part GROUP BY p_name""",
    "bio_labels": rf"""WITH {LINE_SPANS}, a AS (SELECT d.doc_id, len(regexp_extract_all(d.text, '{fixed.ATOM}')) AS n FROM documents d), b AS (SELECT doc_id, count(*) AS k FROM line_spans WHERE regexp_matches(text, '{fixed.ATOM}') GROUP BY 1)
        SELECT doc_id, coalesce(k, 0) AS b, n - coalesce(k, 0) AS i, CAST(0 AS BIGINT) AS o, CAST(0 AS BIGINT) AS broken FROM a LEFT JOIN b USING (doc_id) WHERE n > 0""",
    "label_islands": rf"""WITH {LINE_SPANS} SELECT doc_id, count(*) AS n, CAST(sum(len(regexp_extract_all(text, '{fixed.ATOM}'))) AS BIGINT) AS words, CAST(sum(s + length(text) - length(ltrim(text, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS BIGINT) AS starts
        FROM line_spans WHERE regexp_matches(text, '{fixed.ATOM}') GROUP BY 1""",
    "concept_lines": """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events), r AS (SELECT *, line - row_number() OVER (PARTITION BY user_id, event_type ORDER BY line) AS g FROM e)
        SELECT user_id AS file, event_type AS kind, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY line) AS text, min(line) AS first, max(line) AS last FROM r WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) GROUP BY user_id, event_type, g""",
    "wrong_type_pairs": f"WITH {LINE_SPANS} SELECT doc_id, idx AS g, idx AS p, e - s AS overlap FROM line_spans WHERE e > s",
    "bad_offsets": f"WITH {LINE_SPANS} SELECT doc_id, count(*) AS n FROM line_spans JOIN documents d USING (doc_id) WHERE nfc_normalize(substring(d.text, CASE WHEN idx % 3 = 1 THEN s + 2 ELSE s + 1 END, e - CASE WHEN idx % 3 = 1 THEN s + 1 ELSE s END)) <> nfc_normalize(line_spans.text) GROUP BY 1",
    "usable_spans": f"""WITH {LINE_SPANS}, k AS (SELECT CASE WHEN nfc_normalize(substring(d.text, CASE WHEN idx % 3 = 1 THEN s + 2 ELSE s + 1 END, e - CASE WHEN idx % 3 = 1 THEN s + 1 ELSE s END)) <> nfc_normalize(line_spans.text) THEN 'offset' WHEN idx % 4 = 0 THEN 'type' ELSE 'kept' END AS reason FROM line_spans JOIN documents d USING (doc_id))
        SELECT reason, count(*) AS n FROM k GROUP BY 1""",
    "drug_strings": """SELECT p_partkey, trim(array_to_string(list_filter(list_transform(list_filter(string_split(lower(p_name || CASE p_size % 3 WHEN 0 THEN ' PO q12h:x BID' WHEN 1 THEN ' 40 mg:iv stat' ELSE ' qh q1h prn' END), ' '), lambda w: w <> ''), lambda w: split_part(w, ':', 1)),
        lambda w: NOT list_contains(['po', 'bid', 'stat', 'prn', 'iv'], w) AND NOT regexp_full_match(w, 'q\\d+h')), ' ')) AS t FROM part""",
    "code_forms": "SELECT p_partkey, 'A' || p_size || p_partkey AS key, 'a' || p_size || ' ' AS family FROM part",
    "list_markers": "SELECT p_partkey, upper(p_name) AS t FROM part",
    "doc_traits": r"""SELECT doc_id, contains(t, '***') AS masked, nfc_normalize(t) <> t AS not_nfc, regexp_matches(t, '(?m)^[^\n]{3,40}:\s*$') AS headed FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'ab cd:' || chr(10) || '***' ELSE '' END AS t FROM documents)""",
    "caps_sections": """SELECT p_partkey AS doc_id, CAST(0 AS BIGINT) AS place, 'HISTORY' AS section, lower(p_type) AS body FROM part UNION ALL SELECT p_partkey, CAST(1 AS BIGINT), 'PLAN', 'x' FROM part""",
    "relaid_bodies": "SELECT p_partkey, p_name || chr(10) || '1. one.' || chr(10) || 'HEART: ' || lower(p_name) || '. ok' || chr(10) || 'Vital Signs: z' || chr(10) || '2. t w' AS t FROM part",
    "relocated_lines": f"WITH {LINE_SPANS} SELECT doc_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts FROM line_spans GROUP BY 1",
    "hand_marks": """SELECT p_partkey AS doc_id, w.what, w.about, w.start FROM part, LATERAL (SELECT 'CHẨN_ĐOÁN' AS what, p_name || '|' || p_brand || '|isNegated' AS about, CAST(2 AS BIGINT) AS start UNION ALL SELECT 'TÊN_XÉT_NGHIỆM', trim(p_type) || '||', CAST(2 + length(p_name) + 4 AS BIGINT)
        UNION ALL SELECT 'kind', 'NO', CAST(-1 AS BIGINT) UNION ALL SELECT 'takes no assertion', 'TÊN_XÉT_NGHIỆM', CAST(-1 AS BIGINT)) w""",
    "surface_codes": """WITH t AS (SELECT n_nationkey AS i, lower(n_name) AS s, n_nationkey % 2 = 0 AS dx FROM nation),
        s AS (SELECT lower(n_name) AS text, TRUE AS dx FROM nation UNION ALL SELECT 'in ' || n_name || ' x', TRUE FROM nation UNION ALL SELECT n_name, FALSE FROM nation)
        SELECT CASE WHEN dx THEN 'CHẨN_ĐOÁN' ELSE 'THUỐC' END AS type, text, coalesce((SELECT CAST(min(i) AS VARCHAR) FROM t WHERE t.dx = s.dx AND (lower(trim(s.text)) = t.s OR (s.dx AND contains(lower(s.text), t.s)))), '') AS codes FROM s""",
    "rank_worth": """WITH g AS (SELECT p_brand, list(DISTINCT p_size) FILTER (p_size > 8) AS c FROM part GROUP BY 1), r AS (SELECT p_brand, list(DISTINCT p_size) FILTER (p_size <= 10) AS t FROM part GROUP BY 1),
        b AS (SELECT coalesce(c, []) AS c, len(list_intersect(coalesce(c, []), coalesce(t, []))) AS k FROM g JOIN r USING (p_brand))
        SELECT round(avg(CASE WHEN len(c) = 0 THEN 1.0::DOUBLE ELSE CAST(k AS DOUBLE) / len(c) END), 6) AS ceiling, count(*) FILTER (k > 0) AS found, count(*) FILTER (len(c) > 0) AS n FROM b""",
    "right_ranks": "SELECT CASE WHEN n_chars % 15 <= 9 THEN n_chars % 15 ELSE 9 END AS rank, count(*) AS n FROM documents WHERE n_chars % 15 <> 0 GROUP BY 1",
    "best_cutoff": """SELECT cutoff, k, jaccard FROM (SELECT cutoff, k, round(avg(CASE WHEN (n_chars % 101) > cutoff AND quality = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS jaccard FROM documents JOIN labels USING (doc_id),
        (SELECT CAST(unnest([20, 40, 60, 80]) AS DOUBLE) AS cutoff), (SELECT CAST(unnest([1, 2]) AS BIGINT) AS k) GROUP BY 1, 2) ORDER BY jaccard DESC, cutoff, k LIMIT 1""",
    "label_order": "SELECT DISTINCT CASE WHEN event_id % 9 = 0 THEN 'O' ELSE 'B-' || event_type END AS label FROM events",
    "span_words": rf"WITH {LINE_SPANS} SELECT type, round(avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))), 6) AS words, count(*) AS n FROM line_spans GROUP BY 1",
    "gate_counts": "SELECT CASE WHEN n_chars < 200 OR n_chars IS NULL THEN 'short' WHEN lang = 'de' OR lang IS NULL THEN 'lang' WHEN doc_id % 2 <> 0 OR doc_id IS NULL THEN 'odd' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "segmented_words": rf"""WITH r AS (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \n]+|[ \n]+') AS ps FROM documents)),
        o AS (SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) AS s FROM r)
        SELECT doc_id, count(*) AS n, CAST(sum(s + length(p) - length(ltrim(p, chr(9) || chr(11) || chr(12) || chr(13)))) AS BIGINT) AS starts FROM o WHERE regexp_matches(p, '{fixed.ATOM}') GROUP BY 1""",
    "keyword_bio": rf"""WITH k AS (SELECT DISTINCT lower(string_split(p_type, ' ')[1]) AS k FROM part), w AS (SELECT unnest(regexp_extract_all(p_name || ' ' || p_type, '{fixed.ATOM}')) AS w FROM part)
        SELECT CASE WHEN lower(w) IN (SELECT k FROM k) THEN 'B-T' ELSE 'O' END AS label, count(*) AS n FROM w GROUP BY 1""",
    "dictionary_exact": """WITH n AS (SELECT upper(p_name) AS mention, p_brand AS code, min(p_partkey) AS i FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY i) AS rank FROM n) SELECT mention, code, CAST(100 AS DOUBLE) AS score, rank FROM r WHERE rank <= 2""",
    "type_report": f"""WITH {LINE_SPANS} SELECT type, count(*) AS n_gold, count(*) FILTER (idx % 3 <> 0) AS n_pred, count(*) FILTER (idx % 3 <> 0 AND e > s) AS n_matched, count(*) - count(*) FILTER (idx % 3 <> 0 AND e > s) AS n_missed,
        round(CAST(count(*) FILTER (idx % 3 <> 0 AND e > s) AS DOUBLE) / count(*), 6) AS recall, CAST(1 AS DOUBLE) AS text, CAST(1 AS DOUBLE) AS assertions, CAST(1 AS DOUBLE) AS candidates FROM line_spans GROUP BY 1""",
    "fold_accents": r"SELECT doc_id, md5(trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '\s+', ' ', 'g'))) AS digest FROM documents",
    "section_heading": r"""WITH t AS (SELECT conv_id, string_agg(role || ':' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1),
        l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t), h AS (SELECT conv_id, i, line, nullif(regexp_extract(line, '^([^\n:]{2,40}):', 1), '') AS head FROM l WHERE trim(line) <> ''),
        u AS (SELECT lag(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS heading FROM h) SELECT heading, count(*) AS n FROM u GROUP BY 1""",
    "span_owner": rf"""WITH {LINE_SPANS}, r AS (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{fixed.ATOM}|\s+') AS ps FROM documents)),
        o AS (SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM r), a AS (SELECT doc_id, CAST(e - length(p) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM o WHERE NOT regexp_matches(p, '^\s'))
        SELECT a.doc_id, l.idx AS owner, count(*) AS n, CAST(sum(least(a.e, l.e) - greatest(a.s, l.s)) AS BIGINT) AS covered FROM a LEFT JOIN line_spans l ON l.doc_id = a.doc_id AND a.s < l.e AND l.s < a.e GROUP BY 1, 2""",
    "greedy_match": f"""WITH {LINE_SPANS}, c AS (SELECT g.doc_id, g.idx AS g, p.idx AS p, least(g.e, p.e + 5) - greatest(g.s, p.s + 3) AS overlap FROM line_spans g JOIN line_spans p ON g.doc_id = p.doc_id AND g.type = p.type AND g.s < p.e + 5 AND p.s + 3 < g.e AND g.s < g.e AND p.s + 3 < p.e + 5),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY overlap DESC, p) AS a, row_number() OVER (PARTITION BY doc_id, p ORDER BY overlap DESC, g) AS b FROM c)
        SELECT doc_id, g, p, overlap FROM k WHERE a = 1 AND b = 1""",
    "deoverlap": f"""WITH RECURSIVE {LINE_SPANS}, f AS (SELECT doc_id, idx, s, e + 40 AS e FROM line_spans WHERE e + 40 > s), k AS (SELECT doc_id, arg_min(idx, s) AS idx, min(s) AS s, arg_min(e, s) AS e FROM f GROUP BY 1
          UNION ALL SELECT k.doc_id, arg_min(f.idx, f.s), min(f.s), arg_min(f.e, f.s) FROM k JOIN f ON f.doc_id = k.doc_id AND f.s >= k.e GROUP BY k.doc_id)
        SELECT doc_id, idx, s AS start, e AS "end" FROM k""",
    "gazetteer_partial": rf"""WITH p AS (SELECT p_partkey, list_transform(regexp_extract_all(nfc_normalize(p_name || ' ' || regexp_replace(p_type, '[^A-Za-z ]', ' ', 'g')), '{PHRASE}'), lambda x: lower(x)) AS w FROM part), u AS (SELECT w FROM p WHERE len(w) > 0 GROUP BY w),
        s AS (SELECT w, unnest(range(2, len(w))) AS k FROM u WHERE len(w) > 2), t AS (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s), x AS (SELECT w[i:i + k - 1] AS piece, min(len(w)) AS n_tokens FROM t GROUP BY 1)
        SELECT CAST(n_tokens AS INT) AS n_tokens, count(*) AS n FROM x GROUP BY 1""",
    "dense_lex_merge": """WITH s AS (SELECT a.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
        l AS (SELECT a.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS r FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0),
        u AS (SELECT q, id, 0 AS o, r FROM s WHERE r <= 4 UNION ALL SELECT q, id, 1, r FROM l WHERE r <= 4), f AS (SELECT q, id, min((o, r)) AS k FROM u GROUP BY 1, 2)
        SELECT q AS mention, id AS code, row_number() OVER (PARTITION BY q ORDER BY k) AS place FROM f""",
    "char_tfidf": """WITH n AS (SELECT p_name, min(p_partkey) AS i FROM part GROUP BY 1), w AS (SELECT i, ' ' || unnest(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')) || ' ' AS p FROM n),
        s AS (SELECT i, p, unnest([2, 3, 4]) AS k FROM w), g AS (SELECT i, substring(p, unnest(range(1, greatest(length(p) - k + 1, 1) + 1)), k) AS gram FROM s WHERE k <= length(p) OR k = 2), t AS (SELECT i, gram, count(*) AS tf FROM g GROUP BY 1, 2)
        SELECT gram, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM t GROUP BY 1""",
    "routed_codes": """WITH n AS (SELECT p_name, min(p_partkey) AS i FROM part GROUP BY 1)
        SELECT p_partkey AS doc_id, CASE WHEN p_size % 4 = 0 OR p_partkey % 5 NOT IN (3, 4) THEN '' WHEN p_partkey % 5 = 3 THEN CAST(i AS VARCHAR) WHEN CAST(i AS VARCHAR) LIKE '%5' THEN CAST(i AS VARCHAR) ELSE 'in' || (i % 3) END AS codes FROM part JOIN n USING (p_name)""",
    "unofficial_types": "SELECT CASE WHEN p_size % 3 = 1 THEN p_type END AS type, count(*) AS n FROM part WHERE p_size % 3 <> 0 GROUP BY 1",
    "labels_without_text": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
