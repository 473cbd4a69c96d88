"""The Jaccard join against all pairs."""

import random
import re

import numpy as np

from chartloom.llm import jaccardjoin
from chartloom.llm.jaccardjoin import jaccard_classes, runs_needed


def shingles(text):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    n, near = len(docs), [[] for _ in docs]
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if k >= 0.8 * (len(sets[i]) + len(sets[j]) - k) - 1e-6:
                    near[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [docs[j][0] for j in seen if docs[j][0] is not None]
        out.append((docs[i][0], min(ids, default=None), len(near[i])))
    return out


def corpus():
    rnd = random.Random(2)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randint(0, 30))
    text = lambda n: [word() for _ in range(n)]
    docs = [(i, " ".join(text(rnd.randint(0, 60)))) for i in range(60)]
    k = 100
    for base_size, copies, edits in ((80, 30, 2), (200, 60, 8), (40, 5, 1), (120, 12, 5)):
        base = text(base_size)
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(len(w))] = word()
            docs.append((k, " ".join(w)))
            k += 1
    passage = " ".join(text(25))
    docs += [(500 + i, passage + " " + " ".join(text(40))) for i in range(50)]
    docs += [(k, docs[70][1]), (k + 1, docs[70][1].upper() + "!"), (70, docs[70][1]), (900, None), (901, ""), (902, "one two"), (903, "One, two."), (904, "!?"), (None, docs[3][1])]
    return docs


def test_matches_all_pairs(spark, monkeypatch):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS n_links")
    got = sorted((tuple(r) for r in jaccard_classes(frame).collect()), key=str)
    assert got == sorted(brute(docs), key=str)
    monkeypatch.setattr(jaccardjoin, "TILE", 7)
    monkeypatch.setattr(jaccardjoin, "LIMIT", 4)
    assert sorted((tuple(r) for r in jaccard_classes(frame).collect()), key=str) == got
    monkeypatch.setattr(jaccardjoin, "PAIRS", 12)
    monkeypatch.setattr(jaccardjoin, "FIRST", range(1))
    assert sorted((tuple(r) for r in jaccard_classes(frame).collect()), key=str) == got


def test_measured_recall_asks_for_more_runs(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(jaccardjoin, "runs_needed", lambda recall: 1)
    first, waves = jaccardjoin.wave_links, []
    monkeypatch.setattr(jaccardjoin, "wave_links", lambda *a: (waves.append(a[2:]), first(*a))[1])
    got = jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(brute(docs), key=str)
    assert len(waves) > 1


def test_spanning_links_of_a_large_bucket():
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 256, (3, jaccardjoin.T)).astype(np.uint8)
    sk = np.concatenate([np.repeat(base[:1], 300, axis=0), np.repeat(base[1:2], 200, axis=0), base[:1], base[2:]])
    key, comp = np.arange(len(sk)), np.array([0] * 300 + [7] * 200 + [8, 9])
    u, v = jaccardjoin._spanning(np.zeros(len(sk), np.int64), key, comp, sk)
    assert {comp[a] for a in (*u, *v)} == {0, 8} and 500 in {*u, *v}


def test_components_by_rounds(spark, monkeypatch):
    from chartloom.llm import components

    rnd = random.Random(5)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(400, i) for i in range(401, 460)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "u long, v long")
    got = [sorted(map(tuple, components.components(frame).collect()))]
    monkeypatch.setattr(components, "FEW", 0)
    got.append(sorted(map(tuple, components.components(frame).collect())))
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got[0] == got[1] == sorted(label.items())


def test_one_of_each_class(spark):
    docs = [*corpus(), (None, corpus()[61][1]), (901, ""), (3, corpus()[3][1])]
    docs.append((61, corpus()[61][1] + " end"))  # a near copy whose id repeats
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS _jj_root", "'x' AS root").drop("_jj_root")
    got = jaccardjoin.one_of_each_class(frame).collect()
    sets, rows = [shingles(t) for _, t in docs], brute(docs)
    classes, want = {}, [d for d, s in zip(docs, sets) if not s]
    near = lambda i, j: sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-6
    seen = set()
    for i in range(len(docs)):
        if sets[i] and i not in seen:
            group, todo = {i}, [i]
            while todo:
                k = todo.pop()
                for j in range(len(docs)):
                    if j not in group and near(k, j):
                        group.add(j)
                        todo.append(j)
            seen |= group
            classes[i] = group
            least = min((docs[j][0] is None, docs[j][0] or 0) for j in group)
            want.append({docs[j] for j in group if (docs[j][0] is None, docs[j][0] or 0) == least})
    have = [(r.doc_id, r.text) for r in got]
    assert len(have) == len(want) and len(rows) == len(docs) and all(r.root == "x" for r in got)
    for w in want:
        if isinstance(w, set):
            assert sum(h in w for h in have) >= 1
        else:
            assert w in have
    assert jaccardjoin.one_of_each_class(frame.limit(0)).count() == 0


def test_runs_and_empty(spark):
    assert runs_needed(0.9999) == 20
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
