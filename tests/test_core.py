"""Core operators against golden cases and plain Python."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from chartloom.functions import similarity
from chartloom.functions import text as T
from chartloom.operators import corpus, gazetteer, linkers, linking, scoring, spans, structure, validation, words

NFD = lambda s: unicodedata.normalize("NFD", s)


def test_atoms_keep_offsets(spark):
    texts = ["đau 325-650 mg,\n ****", NFD("mất ngủ"), "a😀b mất", "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = words.atoms(docs).collect()
    assert all(texts[r.doc_id][r.start : r.end] == r.surface for r in rows)
    assert [r.surface for r in rows if r.doc_id == 1] == NFD("mất ngủ").split()
    ls = words.lines(spark.createDataFrame([(0, "ab\n\n cd\n")], "doc_id long, text string")).collect()
    assert [(r.line_no, r.line, r.start) for r in ls] == [(0, "ab", 0), (2, " cd", 4)]


def test_alignment():
    assert words.aligned("đau ngực", ["đau ngực"]) == [("đau ngực", 0, 8)]
    assert words.aligned("đau\nngực trái", ["đau ngực", "trái"]) == [("đau\nngực", 0, 8), ("trái", 9, 13)]
    assert words.aligned("325-650 ****", ["325-650", "****"]) == [("325-650", 0, 7), ("****", 8, 12)]
    assert words.aligned(NFD("mất ngủ"), ["mất ngủ"])[0][0] == NFD("mất ngủ")
    assert words.aligned("a b c", ["a", "zz", "c"]) == [("a", 0, 1), ("c", 4, 5)]
    assert words.aligned("a b c a", ["b x", None, "", "a"]) == [("b", 2, 3), ("a", 6, 7)]
    assert words.aligned(None, ["a"]) == words.aligned("a", None) == words.aligned("", []) == []


def legal_cut(sizes, ends, budget, lo):
    """Where the chunk from lo on has to end: of all end points that fit (or the first), the last in the chunk's last quarter
    that ends a sentence, if the rest doesn't fit as a whole."""
    fits = [j for j in range(lo + 1, len(sizes) + 1) if j == lo + 1 or sum(sizes[lo:j]) <= budget]
    far = max(j for j in fits if j == lo + 1 or j - 1 in fits)
    quarter = range(max(lo + 1, far - max(1, (far - lo) // 4)), far + 1)
    return far if far == len(sizes) else max((j for j in quarter if ends[j - 1]), default=far)


def test_packing(spark):
    rnd = random.Random(1)
    cases = [([1] * 40, [i % 10 == 9 for i in range(40)], 12), ([50, 1, 1], [False] * 3, 12), ([], [], 12)]
    cases += [([rnd.randint(1, 6) for _ in range(n)], [rnd.random() < 0.2 for _ in range(n)], 12) for n in range(1, 40)]
    rows = spark.createDataFrame([(i, s, e) for i, (s, e, _) in enumerate(cases)], "i int, s array<int>, e array<boolean>")
    got = {r.i: [(x.lo, x.hi) for x in r.c] for r in rows.select("i", words.packed(F.col("s"), F.col("e"), 12).alias("c")).collect()}
    assert got[0] == [(0, 10), (10, 20), (20, 30), (30, 40)]
    for i, (sizes, ends, budget) in enumerate(cases):
        assert [lo for lo, _ in got[i]] == [0, *(hi for _, hi in got[i])][: len(got[i])] and (not sizes or got[i][-1][1] == len(sizes))
        assert all(hi == legal_cut(sizes, ends, budget, lo) for lo, hi in got[i])


def test_islands_owners_and_labels(spark):
    labels = ["B-BENH", "I-BENH", "O", "I-THUOC", "I-BENH", "B-BENH", "I-BENH"]
    w = spark.createDataFrame([("d", i, lab, 2 * i, 2 * i + 1) for i, lab in enumerate(labels)], "doc_id string, pos int, label string, start int, end int")
    got = sorted((r.start, r.end, r.kind) for r in spans.islands(w).collect())
    assert got == [(0, 3, "BENH"), (6, 7, "THUOC"), (8, 9, "BENH"), (10, 13, "BENH")]
    s = spark.createDataFrame([("d", 0, 0, 3, "A"), ("d", 1, 2, 9, "B")], "doc_id string, idx int, start int, end int, label string")
    out = spans.bio(spans.owners(w.drop("label"), s), s).orderBy("pos").collect()
    assert [r.label for r in out] == ["B-A", "I-A", "B-B", "I-B", "I-B", "O", "O"]


def plain_greedy(gold, pred):
    c = sorted((-(min(g[2], p[2]) - max(g[1], p[1])), g[0], p[0]) for g in gold for p in pred if g[3] == p[3] and min(g[2], p[2]) > max(g[1], p[1]))
    used_g, used_p, out = set(), set(), set()
    for _, g, p in c:
        if g not in used_g and p not in used_p:
            used_g.add(g), used_p.add(p), out.add((g, p))
    return out


def test_greedy_and_overlap_removal(spark):
    rnd = random.Random(4)
    some = lambda n: [(i, a, a + rnd.randint(1, 9), rnd.choice("xy")) for i, a in enumerate(rnd.randint(0, 60) for _ in range(n))]
    docs = {d: (some(12), some(12)) for d in range(12)}
    frame = lambda k: spark.createDataFrame([(d, *r) for d, both in docs.items() for r in both[k]], "doc_id long, idx int, start int, end int, type string")
    got = {(r.doc_id, r.g, r.p) for r in spans.greedy_pairs(frame(0), frame(1)).collect()}
    assert got == {(d, g, p) for d, (a, b) in docs.items() for g, p in plain_greedy(a, b)}
    kept = spans.without_overlaps(frame(0)).collect()
    want = set()
    for d, (a, _) in docs.items():
        last = -1
        for i, s, e, _ in sorted(a, key=lambda r: (r[1], -(r[2] - r[1]), r[0])):
            if s >= last:
                want.add((d, i))
                last = e
    assert {(r.doc_id, r.idx) for r in kept} == want


def test_similarities(spark):
    pairs = [("rung nhĩ", "rung nhĩ và cuồng nhĩ"), ("a b", "b a"), ("a b c", "c a"), ("", ""), ("abc", ""), ("a x", "a y")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(F.round(similarity.indel_ratio("a", "b"), 2), similarity.token_sort_ratio("a", "b"), similarity.token_set_ratio("a", "b")).collect()
    assert got[0][0] == 55.17 and got[1][1] == 100.0 and got[2][2] == 100.0 and got[3][0] == 100.0 and got[4][0] == 0.0
    wer = df.select(F.round(similarity.word_error_rate(T.tokens(F.col("a")), T.tokens(F.col("b"))), 4)).collect()
    assert [r[0] for r in wer] == [1.0, 1.0, 1.0, 0.0, 1.0, 0.5]


@pytest.mark.parametrize(("pred", "want"), [
    ([("ho đờm xanh", "TRIỆU_CHỨNG", [], [], 0, 11), ("aspirin", "THUỐC", ["1191"], ["isHistorical"], 20, 27)], 1.0),
    ([(NFD("ho đờm xanh"), "TRIỆU_CHỨNG", [], [], 0, 11), ("aspirin", "THUỐC", ["1191"], ["isHistorical"], 20, 27)], 1.0),
    ([("ho đờm", "TRIỆU_CHỨNG", [], [], 0, 6), ("aspirin", "THUỐC", ["1191", "999"], [], 20, 27)], 0.7),
    ([("ho đờm xanh", "TRIỆU_CHỨNG", [], [], 0, 11)], 0.5),
    ([("ho đờm xanh", "TRIỆU_CHỨNG", [], [], 0, 11), ("aspirin", "CHẨN_ĐOÁN", ["1191"], ["isHistorical"], 20, 27)], 1 / 3),
    ([], 0.0),
])
def test_golden_scores(spark, pred, want):
    kind = "doc_id string, idx int, text string, type string, candidates array<string>, assertions array<string>, start int, end int"
    gold = [("ho đờm xanh", "TRIỆU_CHỨNG", [], [], 0, 11), ("aspirin", "THUỐC", ["1191"], ["isHistorical"], 20, 27)]
    frame = lambda rows: spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], kind)
    docs = spark.createDataFrame([("d",)], "doc_id string")
    assert scoring.corpus(scoring.documents(docs, frame(gold), frame(pred))).first().final == pytest.approx(want, abs=1e-9)


def test_flags(spark):
    text = "Tiền sử bệnh:\n rung nhĩ\n3. Tiền sử gia đình:\nung thư\nKhám:\nbệnh nhân phủ nhận đau ngực, khó thở. Có ho"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    at = [(w, text.index(w)) for w in ("rung nhĩ", "ung thư", "đau ngực", "khó thở", "ho")]
    at[-1] = ("ho", text.rindex("ho"))
    s = spark.createDataFrame([("d", i, a, a + len(w), "TRIỆU_CHỨNG", w) for i, (w, a) in enumerate(at)] + [("d", 9, at[0][1], at[0][1] + 4, "TÊN_XÉT_NGHIỆM", "x")], "doc_id string, idx int, start int, end int, type string, w string")
    got = {r.idx: r.assertions for r in structure.with_flags(docs, s).collect()}
    assert got == {0: ["isHistorical"], 1: ["isFamily"], 2: ["isNegated"], 3: ["isNegated"], 4: [], 9: []}


def test_gazetteer(spark):
    entries = spark.createDataFrame([(0, "tăng huyết áp", "I10"), (1, "tăng huyết áp thứ phát", "I15"), (2, "Bệnh lý suy tim", "I50"), (3, "áp xe", "L02"), (4, "TĂNG huyết ÁP", "dup")], "entry int, phrase string, code string")
    g = gazetteer.build(entries)
    docs = spark.createDataFrame([("a", "Có tăng huyết áp thứ phát, tăng Huyết áp xe và suy tim."), ("b", NFD("tăng huyết áp")), ("c", None)], "doc_id string, text string")
    got = sorted((r.doc_id, r.start, r.end, r.code) for r in gazetteer.hits(docs, g).collect())
    assert got == [("a", 3, 25, "I15"), ("a", 27, 40, "I10"), ("b", 0, len(NFD("tăng huyết áp")), "I10")]
    m = spark.createDataFrame([("tăng huyết áp",), ("bị áp xe nặng",), ("suy tim",), ("khác",)], "mention string")
    how = {r.mention: (r.code, r.how) for r in gazetteer.look_up(m, g, gazetteer.partial(g)).collect()}
    assert how == {"tăng huyết áp": ("I10", "exact"), "bị áp xe nặng": ("L02", "inside"), "suy tim": ("I50", "part"), "khác": (None, None)}


def test_linking(spark):
    names = spark.createDataFrame([(0, "aspirin", "1191"), (1, "aspirin 81 mg", "2"), (2, "lasix", "3")], "name_id long, name string, code string")
    m = spark.createDataFrame([("Aspirin PO q6h:prn",), ("aspirin 80 mg daily",), ("lasix iv",), ("none",)], "mention string")
    rel = spark.createDataFrame([("3", "4603")], "code string, ingredient string")
    got = {(r.mention, r.code) for r in linking.drugs(m, names, rel).collect()}
    assert got == {("Aspirin PO q6h:prn", "1191"), ("aspirin 80 mg daily", "2"), ("lasix iv", "4603")}
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.6), ("b", "x", 0.9), ("b", "y", 0.8), ("c", "x", 0.1), ("c", "y", 0.05), ("d", "x", 0.1)], "mention string, code string, score double")
    picked = {(r.mention, r.code) for r in linking.by_margin(scored, 0.2, 0.2).collect()}
    assert picked == {("a", "x"), ("b", "x"), ("b", "y"), ("c", "x"), ("d", "x")}
    one = spark.createDataFrame([("1", "CUI", "2", "CUI", "tradename_of", "RXNORM"), ("5", "CUI", "6", "CUI", "has_tradename", "RXNORM"), ("7", "CUI", "8", "CUI", "tradename_of", "X")], "rxcui1 string, stype1 string, rxcui2 string, stype2 string, rela string, sab string")
    assert {tuple(r) for r in linking.brand_ingredients(one).collect()} == {("2", "1"), ("5", "6")}


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else max(last[j], row[-1]))
    return row[-1]


def _sorted_ratio(a, b):
    a, b = (" ".join(sorted(x.lower().split())) for x in (a, b))
    return 200 * _lcs(a, b) / (len(a) + len(b))


def _misspelt():
    rnd = random.Random(12)
    names = sorted({"".join(rnd.choice("aeinrstlx") for _ in range(rnd.randint(3, 9))) + rnd.choice(["", " 40 mg", " acid", " sodium"]) for _ in range(90)} | {"aspirin", "furosemide", "lasix"})
    wrong = ["asprin", "furosemid 40mg", "LASIX", "", "zzzzzz", "mg"]
    for n in names[:40]:
        w = list(n)
        for _ in range(rnd.randint(1, 4)):
            w[rnd.randrange(len(w))] = rnd.choice("aeinrst ")
        wrong.append("".join(w))
    return names, wrong


@pytest.mark.parametrize(("cutoff", "k"), [(55.0, 1), (55.0, 3), (80.0, 2), (0.0, 2)])
def test_fuzzy_misses_no_name(spark, cutoff, k):
    names, wrong = _misspelt()
    table = spark.createDataFrame([(i, n, f"c{i // 2}") for i, n in enumerate(names)], "name_id long, name string, code string")
    got = {}
    for r in linking.exact_then_fuzzy(spark.createDataFrame([(w,) for w in [*wrong, None]], "mention string"), table, cutoff, k).collect():
        got.setdefault(r.mention, {})[r["rank"]] = (r.code, round(r.score, 6))
    for w in set(wrong):
        plain = " ".join(w.lower().split())
        same = [i for i, n in enumerate(names) if n == plain]
        scores = [(100.0, i) for i in same] if same else [(_sorted_ratio(w, n), i) for i, n in enumerate(names) if plain and _sorted_ratio(w, n) > cutoff]
        best = {}
        for score, i in sorted(scores, key=lambda x: (-x[0], x[1])):
            best.setdefault(f"c{i // 2}", round(score, 6))
        assert got.get(w, {}) == {n + 1: x for n, x in enumerate(list(best.items())[:k])}, w


def test_linkers(spark):
    kind = "name_id long, name string, code string, kind string"
    names = spark.createDataFrame([(0, "Rung nhĩ", "I48", "SCD"), (1, "rung nhĩ và cuồng nhĩ", "I48.9", "IN"), (2, "Tăng huyết áp", "I10", "IN"), (3, "aspirin", "1191", "IN"), (4, "Aspirin", "9", "SCD"), (5, "aspirin 81 mg", "2", "SCD")], kind)
    m = lambda *xs: spark.createDataFrame([(x,) for x in xs], "mention string")
    got = {(r.mention, r.code): r.score for r in linkers.diseases(m("rung nhi", "tang huyet ap", "xyz", "RUNG NHĨ"), names).collect()}
    assert set(got) == {("rung nhi", "I48"), ("tang huyet ap", "I10"), ("RUNG NHĨ", "I48")} and got["RUNG NHĨ", "I48"] == 100.0
    fuzzy = {(r.mention, r.code) for r in linkers.linker("RapidFuzz")(m("rung nhĩ", "rung nhĩ cuồng"), names).collect()}
    assert ("rung nhĩ", "I48") in fuzzy and len({c for x, c in fuzzy if x == "rung nhĩ"}) == 1 and ("rung nhĩ cuồng", "I48.9") in fuzzy
    with pytest.raises(ValueError):
        linkers.linker("none")
    v = spark.createDataFrame([(0, "A", [1.0, 0.0]), (1, "A", [0.9, 0.1]), (2, "B", [0.8, 0.6]), (3, "C", [0.0, 1.0])], "name_id long, code string, embedding array<double>")
    q = spark.createDataFrame([("x", [1.0, 0.1]), ("y", [0.0, 1.0]), ("z", [0.95, 0.3])], "mention string, embedding array<double>")
    dense = sorted((r.mention, r.code) for r in linkers.dense_links(q, v).collect())
    assert dense == [("x", "A"), ("x", "B"), ("y", "C"), ("z", "A"), ("z", "B")]
    s = {}
    for r in linkers.suggested(m("ASPIRIN PO daily", "rung nhi cuong", "huyết áp cao", "?"), names, 2, drug=True).orderBy("mention", "rank").collect():
        s.setdefault(r.mention, []).append((r.code, r.score))
    assert s["ASPIRIN PO daily"] == [("9", 100.0), ("1191", 100.0)] and s["rung nhi cuong"] == [("I48.9", 100.0), ("I48", 100.0)] and s["huyết áp cao"][0][0] == "I10" and "?" not in s
    up = {r.mention: r for r in linkers.looked_up(m("aspirin po", "tăng huyết áp", "tăng huyết ép", "nothing", " "), names, "Thuốc").collect()}
    assert up["aspirin po"].match and up["aspirin po"].method == "exact" and up["tăng huyết áp"].candidates[0].code == "I10"
    assert up["tăng huyết ép"].method == "fuzzy" and up["tăng huyết ép"].match == (up["tăng huyết ép"].candidates[0].score >= 90) and not up["nothing"].match and " " not in up
    code = linkers.looked_up(m("i48.9", "I4 8", "zz"), names, "icd", by_code=True).collect()
    assert {(r.mention, r.match, tuple(c.name for c in r.candidates)) for r in code} == {("i48.9", True, ("rung nhĩ và cuồng nhĩ",)), ("I4 8", True, ("Rung nhĩ",)), ("zz", False, ())}
    with pytest.raises(ValueError):
        linkers.looked_up(m("x"), names, "other")


def test_rankings(spark):
    ranked = spark.createDataFrame([("a", "x", 90.0, 1), ("a", "y", 80.0, 2), ("b", "z", 70.0, 1)], "mention string, code string, score double, rank int")
    gold = spark.createDataFrame([("a", ["y"]), ("b", ["q"]), ("c", []), ("d", ["x"])], "mention string, codes array<string>")
    assert {(r["rank"], r.n) for r in scoring.rank_histogram(ranked, gold).collect()} == {(2, 1), (None, 2)}
    top = scoring.ceiling(ranked, gold).first()
    assert (round(top.ceiling, 6), top.found, top.n) == (0.5, 1, 3)
    grid = spark.createDataFrame([(c, k) for c in (50.0, 75.0) for k in (1, 2)], "cutoff double, k int")
    assert tuple(scoring.best_cutoff(scoring.cutoffs(ranked, gold, grid)).first())[:2] == (50.0, 2)
    rel = spark.createDataFrame([("x", "i"), ("y", "i")], "code string, ingredient string")
    assert {(r.mention, r.code, r["rank"]) for r in linkers.ranked_ingredients(ranked, rel).collect()} == {("a", "i", 1), ("b", "z", 1)}
    assert {(r.mention, tuple(r.codes)) for r in linkers.emitted(ranked, 1, 75.0).collect()} == {("a", ("x",))}


def test_validation(spark):
    docs = spark.createDataFrame([("d", "không sốt cao. sốt cao, ho khan")], "doc_id string, text string")
    kind = "doc_id string, idx int, text string, type string, candidates array<string>, assertions array<string>, start int, end int"
    s = spark.createDataFrame([("d", 0, "sốt cao", "CHẨN_ĐOÁN", ["R50"], None, 6, 13), ("d", 1, "ho", "TRIỆU_CHỨNG", ["R05"], [], 24, 26), ("d", 2, "xyz", "THUỐC", [], [], 0, 3), ("d", 3, "ho", "THUỐC", [], [], None, None), ("d", 4, "ho", "THUỐC", [], [], 50, 60), ("d", 5, "o k", "THUỐC", ["1"], [], 25, 28)], kind)
    names = spark.createDataFrame([("R50", "Sốt"), ("1", "hoàn toàn khác")], "code string, name string")
    got = {(r.code, r.idx) for r in validation.report(docs, s, names).collect()}
    assert {("A_MISMATCH", 2), ("A_NO_POS", 3), ("A_OUT_OF_RANGE", 4), ("D_UNEXPECTED_CAND", 1), ("D_MISSING_CAND", 2), ("C_CODE_MISMATCH", 5), ("I_OVERLAP", 1), ("F_MISSED", None), ("H_MAYBE_NEG", 0), ("G_TYPE_CONFLICT", None)} <= got


def test_corpus_tools(spark):
    docs = spark.createDataFrame([("d", "**A** 〔DX|sốt〕 và 〔DRUG|aspirin〕 〔hỏng")], "doc_id string, text string")
    r = corpus.unwrapped(docs).first()
    assert r.text == "A sốt và aspirin hỏng" and all(r.text[s.start : s.end] == s.text for s in r.spans) and len(r.spans) == 2
    row = spark.createDataFrame([("a b a b", ["a", "b", "a"]), ("a b", ["b", "a"])], "t string, s array<string>").select(corpus.relocated(F.col("t"), F.col("s"))).collect()
    assert [x[0] for x in row] == [[0, 2, 4], None]
    d = spark.createDataFrame([(i, "abc"[min(2, i // 50)]) for i in range(120)], "doc_id long, lang string")
    for count in (3, 10, 50, 119):
        assert corpus.holdout(d, "lang", count).count() == count
    sec = structure.caps_sections(spark.createDataFrame([(0, "HISTORY:, He fell.,PLAN: rest. PLAN: walk"), (1, "no heads")], "doc_id int, text string")).orderBy("doc_id", "place").collect()
    assert [(x.section, x.body) for x in sec] == [("HISTORY", "He fell."), ("PLAN", "walk"), ("", "no heads")]


def test_sources_round_trip(spark, tmp_path):
    from chartloom.plans.extraction import concepts, training_words
    from chartloom.sources import readers, writers
    from chartloom.streaming.files import extract_stream

    folder = tmp_path / "in"
    folder.mkdir()
    text = "Tiền sử:\ntăng huyết áp, dùng aspirin"
    for i in (10, 9):
        (folder / f"{i}.txt").write_text(text, encoding="utf-8")
        (folder / f"{i}.json").write_text(json.dumps([{"text": "aspirin", "type": "THUỐC", "candidates": ["1191"], "assertions": [], "position": [29, 36]}, {"text": "x", "type": "THUỐC"}]), encoding="utf-8")
    docs = readers.texts(spark, str(folder))
    assert [r.doc_id for r in readers.in_order(docs).collect()] == ["9", "10"]
    ann = readers.annotations(spark, str(folder))
    assert ann.count() == 4 and ann.where("start IS NULL").count() == 2
    tagged = training_words(docs, ann.where("start IS NOT NULL"))
    assert [r.label for r in tagged.where("doc_id = '9' AND word = 'aspirin'").collect()] == ["B-THUOC"]
    writers.write_bio(tagged.withColumn("block", F.lit(0)), str(tmp_path / "bio"))
    back = readers.bio(spark, str(tmp_path / "bio"), strict=True)
    assert back.where("label = 'B-THUOC'").count() == 2
    g = {"CHẨN_ĐOÁN": gazetteer.build(spark.createDataFrame([(0, "tăng huyết áp", "I10")], "entry int, phrase string, code string")), "THUỐC": gazetteer.build(spark.createDataFrame([(0, "aspirin", "1191")], "entry int, phrase string, code string"))}
    got = {(r.text, tuple(r.candidates), tuple(r.assertions)) for r in concepts(docs, g).where("doc_id = '9'").collect()}
    assert got == {("tăng huyết áp", ("I10",), ("isHistorical",)), ("aspirin", ("1191",), ("isHistorical",))}
    q = extract_stream(spark, str(folder), g, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    icd = tmp_path / "icd.csv"
    icd.write_text('title,,\nMÃ LOẠI,MÃ BỆNH,TÊN BỆNH\nI1,I10,"Tăng huyết áp, vô căn"\nI1,,bỏ\n', encoding="utf-8")
    table = readers.disease_table(spark, str(icd))
    assert [(r.code, r.name) for r in table.collect()] == [("I10", "Tăng huyết áp, vô căn")]
    lines = readers.element_lines(spark.createDataFrame([("d", '[\n {"a": "{[",\n "b": [{}]},\n\n{}]')], "doc_id string, text string")).collect()
    assert [r.line for r in lines] == [2, 5]


def test_corpus_jobs(spark):
    marked = spark.createDataFrame([("d", "〔dx|sốt|R50, isNegated〕 và 〔TEST|CRP|isFamily,X1〕 〔BAD|x〕 〔SYM| ho |isWrong〕 〔hỏng"), ("e", None)], "doc_id string, text string")
    s, errors = corpus.hand_marked(marked)
    assert {(r.text, r.type, tuple(r.candidates), tuple(r.assertions), r.start) for r in s.collect()} == {("sốt", "CHẨN_ĐOÁN", ("R50",), ("isNegated",), 0), ("CRP", "TÊN_XÉT_NGHIỆM", (), (), 7), ("ho", "TRIỆU_CHỨNG", (), (), 13)}
    assert sorted((r.reason, r.about) for r in errors.collect()) == [("assertion", "isWrong"), ("kind", "BAD"), ("takes no assertion", "TÊN_XÉT_NGHIỆM"), ("takes no code", "TÊN_XÉT_NGHIỆM")]
    original = spark.createDataFrame([("d", "sốt và CRP x ho hỏng"), ("f", "y")], "doc_id string, text string")
    assert tuple(corpus.compiled(marked, original).first()) == ("d", True, None, None)
    for text, why, at in ((NFD("sốt và CRP x ho hỏng"), "form", None), ("sốt và CRX", "text", 9)):
        assert tuple(corpus.compiled(marked, spark.createDataFrame([("d", text)], "doc_id string, text string")).first())[1:] == (False, why, at)
    u = corpus.unwrapped(spark.createDataFrame([("d", "〔DX| a 〕b〔ZZ|c〕〔SYM| 〕")], "doc_id string, text string"), aliases={"DX": "D"}, allowed=["D", "SYM"]).first()
    assert u.text == "abc" and [(x.type, x.text, x.start, x.end) for x in u.spans] == [("D", "a", 0, 1)]
    b = spark.createDataFrame([("k", "Sốt", "CHẨN_ĐOÁN", ["R50"])], "bundle_id string, surface string, type string, codes array<string>")
    composed = spark.createDataFrame([("k", "〔a|sốt〕 〔b|ho〕")], "bundle_id string, text string")
    assert corpus.bundled(composed, b).count() == 0 and [x.codes for x in corpus.bundled(composed, b, 1).first().spans] == [["R50"]]
    kind = "doc_id string, idx int, text string, type string, candidates array<string>, assertions array<string>, start int, end int"
    docs = spark.createDataFrame([("d", "sốt cao\nTiền sử:\n*** ho", "x"), ("e", NFD("mất ngủ"), "y"), ("n", None, "y")], "doc_id string, text string, source string")
    sp = spark.createDataFrame([("d", 0, "sốt cao", "CHẨN_ĐOÁN", ["R50"], ["isNegated"], 0, 7), ("d", 1, "***", "THUỐC", [], [], 17, 20), ("d", 2, "no", "THUỐC", [], [], 1, 3), ("e", 0, NFD("mất"), "LẠ", [], [], 0, len(NFD("mất")))], kind)
    st = {(r.overall, r.source): r for r in corpus.statistics(docs, sp, "source").collect()}
    assert (st[1, None].n_docs, st[1, None].n_spans, st[1, None].bad_offsets) == (3, 4, 1) and st[0, "x"].coded == 0.5 and st[0, "x"].masked == 1.0 and st[0, "x"].headed == 1.0 and st[0, "y"].not_nfc == 1.0
    kept, why = corpus.usable(docs, sp)
    assert kept.count() == 2 and {(r.reason, r.n) for r in why.collect()} == {("offset", 1), ("type", 1)}
    assert [r.label for r in corpus.ordered_labels(spark.createDataFrame([("I-B",), ("0",), ("B-B",), ("O",), (None,)], "label string")).collect()] == ["O", "B-B", "I-B"]
    t = spark.createDataFrame([(0, "CHẨN_ĐOÁN", "Sốt", ["A"]), (1, "CHẨN_ĐOÁN", "sốt cao", ["B"]), (2, "THUỐC", "x", ["C"])], "entry int, kind string, surface string, codes array<string>")
    assert {(r.text, tuple(r.candidates)) for r in corpus.codes_by_surface(sp, t).collect()} == {("sốt cao", ("A",)), ("***", ()), ("no", ()), (NFD("mất"), ())}
    d = spark.createDataFrame([(i, i % 10 == 0, i % 4 == 0) for i in range(100)], "doc_id long, mask boolean, form boolean")
    p = corpus.picked_by_traits(d, 20, {"mask": 0.3, "form": 0.2}).collect()
    assert len(p) == 20 and sum(r.mask for r in p) >= 6 and sum(r.form for r in p) >= 4 and corpus.picked_by_traits(d, 200, {"mask": 0.3}).count() == 100
    assert corpus.quotas({"a": 25, "b": 25, "c": 25, "d": 25}, 10) == {"a": 3, "b": 3, "c": 2, "d": 2}
    assert corpus.quotas({"a": 3, "b": 1, "c": 1}, 2) == {"a": 0, "b": 1, "c": 1} or sum(corpus.quotas({"a": 3, "b": 1, "c": 1}, 2).values()) == 2


def test_words_jobs(spark):
    docs = spark.createDataFrame([("d", "đau ngực\n\nsốt cao"), ("e", None), ("f", " ")], "doc_id string, text string")
    w = words.segmented(docs, lambda line: [line[:3], line[3:]]).collect()
    assert [(r.pos, r.surface, r.start) for r in w] == [(0, "đau", 0), (1, "ngực", 4), (2, "sốt", 10), (3, "cao", 14)]
    assert words.segmented(docs).count() == 4
    k = spark.createDataFrame([("d", 0, "đau", "B-X"), ("d", 1, "x", "O"), ("d", 2, "", "O")], "doc_id string, pos int, word string, label string")
    sub = words.subwords(k, lambda x: [x[:1], x[1:]] if len(x) > 1 else [])
    assert sorted((r.pos, r.piece, r.label, r.first) for r in sub.collect()) == [(0, "au", "I-X", False), (0, "đ", "B-X", True), (1, "x", "O", True), (2, "", "O", True)]
    assert {r.pos: r.label for r in words.from_subwords(sub.where("pos = 0"), k).collect()} == {0: "B-X", 1: "O", 2: "O"}
    rows = [("f", i, *x) for i, x in enumerate([("a", "B-BENH"), ("b", "I-BENH"), (None, None), ("c", "I-BENH"), ("d", "B-X"), ("e", "B-THUOC"), ("f", "I-BENH")], 1)]
    got = spans.concept_lines(spark.createDataFrame(rows, "file string, line int, word string, label string"), kept=["BENH", "THUOC"]).collect()
    assert {(r.text, r.kind, r["first"], r["last"]) for r in got} == {("a b", "BENH", 1, 2), ("c", "BENH", 4, 4), ("e", "THUOC", 6, 6), ("f", "BENH", 7, 7)}
    long = spark.createDataFrame([("d", i, "." if i == 8 else f"w{i}", "I-X" if i in (9, 10) else "B-X" if i == 3 else "O") for i in range(14)], "doc_id string, pos int, word string, label string")
    out = spans.blocks(long, 10).orderBy("pos").collect()
    assert [(r.pos, r.block) for r in out] == [(i, 0) for i in range(9)] + [(i, 1) for i in range(11, 14)]
    body = spark.createDataFrame([("a, 1. ESRD , 2. x.,HEART: ok.,O2  y, Vital Signs: z",)], "b string").select(structure.relaid(F.col("b"))).first()[0]
    assert body == "a\n1. ESRD\n2. x.\nHEART: ok. O2 y\nVital Signs: z"
    n = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(50)] + [(None, "a"), (7, None)], "doc_id long, lang string")
    ids = {(r.doc_id, r.lang): r.seq_id for r in structure.numbered(n, "lang", ("doc_id",), 3).collect()}
    assert ids[None, "a"] == "a_001" and ids[0, "a"] == "a_002" and ids[1, "b"] == "b_001" and ids[49, "b"] == "b_025" and ids[7, None] == "001"


def test_drug_terminology(spark, tmp_path):
    from chartloom.sources import readers

    f = tmp_path / "RX.csv"
    f.write_text("rxcui,str,tty,lat,suppress\n1,HEPARIN,IN,ENG,N\n2,E.E.S.,BN,ENG,\n2,heparin,BN,ENG,N\n3,gone,IN,ENG,O\n4,abc,IN,ENG,N\n5,a b c d e ff,BN,ENG,N\n6,MEN'S HAIR-TONIC,BN,ENG,N\n7,oral gel,SCD,ENG,N\n8,stop it,IN,ENG,N\n", encoding="utf-8")
    rel = spark.createDataFrame([("6", "60"), ("6", "61")], "code string, ingredient string")
    got = {(r.code, r.alias, tuple(r.codes)) for r in readers.drug_aliases(spark, str(f), rel, ["stop it"]).collect()}
    assert got == {("1", "Heparin", ("1",)), ("2", "E.E.S.", ("2",)), ("6", "Men'S Hair-Tonic", ("60", "61"))}
    sets = {r.code: (r.names, r.kinds) for r in readers.names_and_kinds(spark, str(f)).collect()}
    assert sets["2"] == (["E.E.S.", "heparin"], ["BN"]) and len(sets) == 8
    assert readers.common(readers.drug_aliases(spark, str(f)), spark.createDataFrame([("HEPARIN",)], "name string")).count() == 1
    ids = spark.createDataFrame([("cmp0007",), ("cmp12",), ("x1",)], "s string").select(readers.new_id(F.col("s"))).collect()
    assert [r[0] for r in ids] == ["synthetic_0007", "synthetic_0012", "x1"]
    assert readers.inline(spark, "hi").first().text == "hi" and readers.inline(spark, path=str(f)).first().doc_id == "RX"


def test_writers_and_templates(spark, tmp_path):
    from chartloom.sources import readers, writers

    s = spark.createDataFrame([("a", "sốt", "CHẨN_ĐOÁN", ["R50"], [], 3, 6), ("a", "ho", "TRIỆU_CHỨNG", None, [], 0, 2)], "doc_id string, text string, type string, candidates array<string>, assertions array<string>, start int, end int")
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    writers.write_span_files(s, str(tmp_path / "out"), docs)
    got = {r.doc_id: json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert [x["text"] for x in got["a"]] == ["ho", "sốt"] and got["a"][1]["position"] == [3, 6] and got["b"] == []
    writers.write_json_lines(s, str(tmp_path / "lines"))
    assert readers.json_lines(spark, str(tmp_path / "lines"), "text string").count() == 2
    (tmp_path / "out2").mkdir()
    for stem in ("a", "old"):
        (tmp_path / "out2" / f"{stem}.json").write_text("[]")
    assert [r.doc_id for r in writers.stale(spark, str(tmp_path / "out2"), docs).collect()] == ["old"]
    draws = spark.range(200).withColumnRenamed("id", "draw")
    t = corpus.generated(draws, spark.createDataFrame([("{x} and {y} {z}",), ("only {x}",)], "template string"), spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3")], "slot string, value string"))
    assert {r.text for r in t.collect()} == {"1 and 3 {z}", "2 and 3 {z}", "only 1", "only 2"} and t.exceptAll(t).count() == 0
    train, held = readers.labelled_split(draws, 0.2, key="draw")
    assert train.count() + held.count() == 200 and 20 < held.count() < 60
    pool = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "name string, weight double")
    picks = corpus.weighted_picks(pool, draws, "weight").groupBy("name").count().collect()
    assert {r.name for r in picks} == {"a", "b"} and sum(r["count"] for r in picks) == 200
    p = corpus.perturbed(spark.createDataFrame([(i, "mất") for i in range(100)], "doc_id long, text string"), F.lit(0.5)).where("length(text) > 3").count()
    assert 25 < p < 75
    with pytest.raises(ValueError):
        writers.write_bio(spark.createDataFrame([("d", 0, 0, "w", "B-NEW")], "doc_id string, block int, pos int, word string, label string"), str(tmp_path / "bio"))
