"""Registered queries read whole texts: against plain Python on small tables."""

import random

import pytest

from chartloom import queries
from chartloom.functions import similarity


def _wer(ref, hyp):
    row = list(range(len(hyp) + 1))
    for i, r in enumerate(ref, 1):
        last, row = row, [i]
        for j, h in enumerate(hyp, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (r != h)))
    return min(1.0, row[-1] / len(ref)) if ref else float(len(hyp) > 0)


def test_word_edits():
    rnd = random.Random(2)
    for _ in range(400):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 90))] for _ in "ab")
        if rnd.random() < 0.5:
            b = [x for x in a if rnd.random() < 0.8]
        assert (min(1.0, similarity._word_edits(a, b) / len(a)) if a else float(len(b) > 0)) == pytest.approx(_wer(a, b))


def test_wer_of_whole_turns(spark, tmp_path):
    rnd = random.Random(4)
    same = [f"w{i}" for i in range(12)]
    turns = [[*same, *(rnd.choice("abc") for _ in range(rnd.randint(0, 60)))] for _ in range(12)]
    rows = [(k // 4, k % 4, "user", " ".join(t)) for k, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.wer for r in queries.QUERIES["wer_conversations"](spark, str(tmp_path)).collect()}
    want = {(k // 4, k % 4): round(_wer(turns[k - 1], t), 6) for k, t in enumerate(turns) if k % 4}
    assert got == pytest.approx(want) and max(want.values()) > 0


def test_spans_and_accents_of_whole_documents(spark, tmp_path):
    line = lambda d, k: " ".join(f"doc{d}line{k}word{j}" for j in range(3 + 9 * (k % 3)))
    texts = {d: [line(d, k) for k in range(1 + d % 6)] for d in range(12)}
    rows = [(d, "\n".join(ls), [None, "fr", "vi", "en"][d % 4]) for d, ls in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: round(sum(0.0 if k % 4 == 1 else 1 - 1 / len(x.split()) for k, x in enumerate(ls)) / len(ls), 6) for d, ls in texts.items()}
    got = {r.doc_id: r.text for r in queries.QUERIES["score_texts"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    assert {r.doc_id for r in queries.QUERIES["fold_accents"](spark, str(tmp_path)).collect()} == set(texts)
