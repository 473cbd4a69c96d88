"""Operators on empty tables, null values and repeated rows."""

import pytest
from pyspark.sql import functions as F

from chartloom.operators import corpus, gazetteer, linkers, linking, scoring, spans, structure, validation, words
from chartloom.plans import extraction

SPAN = "doc_id string, idx int, text string, type string, candidates array<string>, assertions array<string>, start int, end int"
NAME = "name_id long, name string, code string, kind string"


@pytest.fixture(scope="module")
def empty(spark):
    make = lambda kind: spark.createDataFrame([], kind)
    return {
        "docs": make("doc_id string, text string"), "spans": make(SPAN), "names": make(NAME), "mentions": make("mention string"), "entries": make("entry int, phrase string, code string"),
        "rel": make("code string, ingredient string"), "ranked": make("mention string, code string, score double, rank int"), "gold": make("mention string, codes array<string>"), "words": make("doc_id string, pos int, word string, label string, start int, end int"),
    }


def test_empty_tables(spark, empty):
    d, s, n, m, r, g, w = (empty[k] for k in ("docs", "spans", "names", "mentions", "ranked", "gold", "words"))
    gaz = gazetteer.build(empty["entries"])
    results = {
        "atoms": words.atoms(d), "lines": words.lines(d), "segmented": words.segmented(d, str.split), "subwords": words.subwords(w, list), "owners": spans.owners(w, s), "bio": spans.bio(spans.owners(w.drop("label"), s), s.select("doc_id", "idx", F.lit("X").alias("label"))),
        "islands": spans.islands(w), "pairs": spans.greedy_pairs(s, s), "overlaps": spans.without_overlaps(s), "adjacent": spans.adjacent_overlaps(s), "blocks": spans.blocks(w, 5), "concepts": spans.concept_lines(w.withColumnsRenamed({"doc_id": "file", "pos": "line"})),
        "headings": structure.headings(d), "flags": structure.with_flags(d, s), "sections": structure.caps_sections(d), "traits": structure.traits(d), "numbered": structure.numbered(d, "text", ("doc_id",)), "numbered by number": structure.numbered(n, "name", ("name_id",)),
        "hits": gazetteer.hits(d, gaz), "partial": gazetteer.partial(gaz), "look_up": gazetteer.look_up(m, gaz, gazetteer.partial(gaz)), "keywords": gazetteer.keyword_labels(w.drop("label"), spark.createDataFrame([], "keyword string, type string")),
        "fuzzy": linking.exact_then_fuzzy(m, n, 55.0), "drugs": linking.drugs(m, n, empty["rel"]), "diseases": linkers.diseases(m, n), "links": linkers.fuzzy_links(m, n), "suggested": linkers.suggested(m, n), "looked up": linkers.looked_up(m, n, "icd"), "by code": linkers.looked_up(m, n, "icd", by_code=True),
        "documents": scoring.documents(d, s, s), "types": scoring.by_type(s, s), "offsets": scoring.bad_offsets(d, s), "ranks": scoring.rank_histogram(r, g), "report": validation.report(d, s, n), "unwrapped": corpus.unwrapped(d), "marked": corpus.hand_marked(d)[0], "compiled": corpus.compiled(d, d),
        "holdout": corpus.holdout(d, "text", 3), "filled": corpus.take_then_fill(d, "text", 2, 5, [F.col("doc_id")]), "usable": corpus.usable(d, s)[0], "surfaces": corpus.codes_by_surface(s, spark.createDataFrame([], "entry int, kind string, surface string, codes array<string>")),
        "traits picked": corpus.picked_by_traits(d.withColumn("t", F.lit(True)), 3, {"t": 0.5}), "sweep": extraction.sweep(d, {"THUỐC": gaz}), "concepts of texts": extraction.concepts(d, {"THUỐC": gaz}), "bio of texts": extraction.bio_from_texts(d, {"THUỐC": gaz}), "marked concepts": extraction.marked_concepts(d, {"THUỐC": gaz}),
    }
    for name, df in results.items():
        assert df.count() == 0, name
    assert scoring.corpus(scoring.documents(d, s, s)).count() == 1 and scoring.ceiling(r, g).first().n == 0


def test_nulls_and_repeats(spark):
    docs = spark.createDataFrame([("a", "Tiền sử:\nsốt, ho"), ("b", None), (None, "sốt"), ("c", ""), ("a2", "sốt sốt")], "doc_id string, text string")
    s = spark.createDataFrame([("a", 0, "sốt", "CHẨN_ĐOÁN", None, None, 9, 12), ("a", 0, "sốt", "CHẨN_ĐOÁN", ["R50"], [], 9, 12), ("a", 1, None, None, None, None, None, None), ("b", 0, "x", "THUỐC", [], [], 0, 1), (None, 0, "sốt", "CHẨN_ĐOÁN", [], [], 0, 3)], SPAN)
    names = spark.createDataFrame([(0, "Sốt", "R50", None), (0, "Sốt", "R50", None), (1, None, "X", "IN"), (2, "ho", None, "IN")], NAME)
    gaz = gazetteer.build(spark.createDataFrame([(0, "sốt", "R50"), (1, None, "x"), (2, "", "y")], "entry int, phrase string, code string"))
    assert {(r.doc_id, r.start) for r in gazetteer.hits(docs, gaz).collect()} == {("a", 9), (None, 0), ("a2", 0), ("a2", 4)}
    assert {r.surface for r in words.atoms(docs).where("doc_id = 'c' OR doc_id = 'b'").collect()} == set()
    flagged = {(r.doc_id, r.start): r.assertions for r in structure.with_flags(docs, s.where("start IS NOT NULL AND doc_id = 'a'")).collect()}
    assert flagged == {("a", 9): ["isHistorical"]}
    codes = {(r.code, r.doc_id) for r in validation.report(docs, s, names).collect()}
    assert ("A_NO_POS", "a") in codes and ("D_MISSING_CAND", "a") in codes
    m = spark.createDataFrame([("SỐT",), (None,), ("",), ("SỐT",), ("ho",)], "mention string")
    assert [(r.mention, r.code, r.score) for r in linkers.diseases(m, names.where("code IS NOT NULL")).collect()] == [("SỐT", "R50", 100.0)]
    assert {(r.mention, r.match) for r in linkers.looked_up(m, names, "icd").collect()} == {("SỐT", True), ("ho", True)}
    rows = scoring.documents(docs, s.where("start IS NOT NULL"), s.where("start IS NOT NULL")).collect()
    assert {r.doc_id for r in rows} >= {"a", "b", "c", "a2"}
    u = {r.doc_id: r.text for r in corpus.unwrapped(docs).collect()}
    assert u["b"] is None and u["c"] == ""
    found = extraction.concepts(docs, {"CHẨN_ĐOÁN": gaz, "THUỐC": gaz}).collect()
    assert {(r.doc_id, r.text) for r in found if r.doc_id} == {("a", "sốt"), ("a2", "sốt")}


def test_marked_concepts(spark):
    gaz = gazetteer.build(spark.createDataFrame([(0, "aspirin", "1191"), (1, "lasix", "4603")], "entry int, phrase string, code string"))
    docs = spark.createDataFrame([("d", "Tiền sử: dùng\n〔DRUG|Aspirin〕, không lasix, 〔DRUG|****〕 và 〔XX|ho〕")], "doc_id string, text string")
    got = {(r.text, tuple(r.candidates), tuple(r.assertions)) for r in extraction.marked_concepts(docs, {"THUỐC": gaz}).collect()}
    assert got == {("Aspirin", ("1191",), ("isHistorical",)), ("lasix", ("4603",), ("isHistorical", "isNegated")), ("**", (), ("isHistorical", "isNegated"))}  # bold marks go, also out of stars
    bio = extraction.bio_from_texts(spark.createDataFrame([("d", "uống aspirin .")], "doc_id string, text string"), {"THUỐC": gaz}).orderBy("pos").collect()
    assert [(r.word, r.label, r.block) for r in bio] == [("uống", "O", 0), ("aspirin", "B-THUOC", 0), (".", "O", 0)]
    k = extraction.keyword_training(spark.createDataFrame([("d", "Đau ngực trái dữ")], "doc_id string, text string"), spark.createDataFrame([("đau ngực", "B"), ("đau", "A"), ("ngực trái", "C"), ("đau ngực", "A2")], "keyword string, type string"))
    assert [r.label for r in k.orderBy("pos").collect()] == ["B-A2", "I-A2", "O", "O"]
