"""Steps that grew faster than their input: the same results, by plans that don't."""

import math
import random

from chartloom.operators import corpus, linkers, linking, spans, words


def _plan(df):
    return df._jdf.queryExecution().toString()


def _cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / norm if norm else None


def test_nearest_is_exact_without_a_cross_join(spark, monkeypatch):
    rnd = random.Random(3)
    vectors = [[float(rnd.randint(-2, 2)) for _ in range(3)] for _ in range(300)] + [None, [0.0, 0.0, 0.0], [1.0, None, 1.0], [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(vectors)]
    monkeypatch.setattr(linking, "SCORES", 500)
    monkeypatch.setattr(linking, "QUERY_BLOCK", 20)
    items = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    queries = items.where("id % 10 = 0 OR id >= 300")
    found = linking.nearest(queries, items, 4)
    assert "NestedLoopJoin" not in _plan(found) and "CartesianProduct" not in _plan(found)
    got = {(r.q, r["rank"]): (r.id, r.score) for r in found.collect()}
    want = {}
    for q, v in rows:
        if q % 10 == 0 or q >= 300:
            scored = sorted(((_cosine(v, x), i) for i, x in rows), key=lambda t: (t[0] is None, -(t[0] or 0.0), t[1]))[:4]
            want |= {(q, n + 1): (i, s) for n, (s, i) in enumerate(scored)}
    assert got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all((got[k][1] is None) == (want[k][1] is None) and (want[k][1] is None or abs(got[k][1] - want[k][1]) < 1e-12) for k in want)


def test_dense_links_take_a_code_by_its_best_name(spark):
    rnd = random.Random(5)
    names = [(i, f"c{i % 7}", [rnd.random() - 0.5 for _ in range(4)]) for i in range(200)]
    table = spark.createDataFrame(names, "name_id long, code string, embedding array<double>").repartition(6)
    mentions = spark.createDataFrame([(f"m{i}", names[i][2]) for i in range(0, 200, 9)], "mention string, embedding array<double>")
    got = {(r.mention, r["rank"]): (r.code, round(r.score, 9)) for r in linkers.dense_links(mentions, table, 2.0, 0.0).collect()}
    for i in range(0, 200, 9):
        best = {}
        for _, c, v in names:
            best[c] = max(best.get(c, -2.0), _cosine(names[i][2], v))
        for n, (c, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:2]):
            assert got[f"m{i}", n + 1] == (c, round(s, 9))
    assert linkers.dense_links(mentions.limit(0), table).count() == linkers.dense_links(mentions, table.limit(0)).count() == 0


def test_atoms_are_labelled_where_their_text_is(spark):
    rnd = random.Random(7)
    docs = [(d, " ".join("ab. c"[: rnd.randint(1, 5)] for _ in range(rnd.randint(0, 30)))) for d in range(40)] + [(40, None), (41, ""), (42, "no spans here"), (None, "no key")]
    marks = [(d, i, s := rnd.randint(0, 60), s + rnd.randint(0, 25), rnd.choice(["A", "B", None])) for d in range(41) for i in range(rnd.randint(0, 8))] + [(None, 0, 0, 3, "A"), (42, 0, None, 5, "A")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    s = spark.createDataFrame(marks, "doc_id long, idx int, start int, end int, label string").repartition(3)
    slow = spans.bio(spans.owners(words.atoms(d), s), s.select("doc_id", "idx", "label"))
    columns = ["doc_id", "pos", "surface", "start", "end", "owner", "overlap", "label", "broken"]
    rows = lambda df: sorted(map(repr, df.collect()))
    fast = spans.labelled_atoms(d, s)
    assert rows(fast.select(columns)) == rows(slow.select(columns))
    kinds = ["doc_id", "kind", "start", "end", "n_words"]
    assert rows(spans.atom_islands(d, s).select(kinds)) == rows(spans.islands(slow).select(kinds))
    assert "Window" not in _plan(spans.atom_islands(d, s)) and _plan(fast).count("Exchange") <= _plan(slow).count("Exchange") // 2
    assert spans.labelled_atoms(d.limit(0), s).count() == spans.atom_islands(d, s.limit(0)).count() == 0


def test_hand_marks_are_read_once_for_all_errors(spark):
    many = ",".join(f"c{i}" for i in range(3)) + "|" + "|".join(f"d{i}" for i in range(150))
    texts = [f"a 〔dx| x |{many}, isOdd〕 b〕 〔", "〔NO|y〕〔TEST|z|isFamily|Q1〕", None, "", "〔DX| 〕.\n〔DRUG|w〕"]
    found, errors = corpus.hand_marked(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert "Union" not in _plan(errors)
    got = {(r.doc_id, r.idx): (r.text, r.type, len(r.candidates), r.start, r.end) for r in found.collect()}
    assert got == {(0, 0): ("x", "CHẨN_ĐOÁN", 153, 2, 3), (1, 1): ("z", "TÊN_XÉT_NGHIỆM", 0, 1, 2), (4, 0): ("w", "THUỐC", 0, 2, 3)}
    assert {(r.doc_id, r.idx, r.reason, r.about) for r in errors.collect()} == {(0, 0, "assertion", "isOdd"), (1, 0, "kind", "NO"), (1, 1, "takes no assertion", "TÊN_XÉT_NGHIỆM"), (1, 1, "takes no code", "TÊN_XÉT_NGHIỆM")}
