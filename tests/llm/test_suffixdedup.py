"""Repeated strings against a plain window count."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from chartloom.llm import suffixdedup
from chartloom.llm.suffixdedup import repeated_strings

LENGTH = 60


def brute(docs, keep, LENGTH=LENGTH):  # noqa: N803
    raw = [(t or "").encode() for _, t in docs]
    where = defaultdict(list)
    for i, b in enumerate(raw):
        for p in range(len(b) - LENGTH + 1):
            where[b[p : p + LENGTH]].append((i, p))
    gone = [bytearray(len(b)) for b in raw]
    for places in where.values():
        if len(places) > 1:
            for i, p in places if keep == "none" else places[1:]:
                gone[i][p : p + LENGTH] = b"\1" * LENGTH
    out = []
    for (doc_id, _), b, g in zip(docs, raw, gone):
        kept = bytes(x for x, r in zip(b, g) if not r)
        spans = sum(r and (not k or not g[k - 1]) for k, r in enumerate(g))
        out.append((doc_id, len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(90), text(150), text(61), text(59)]
    docs = [(i, text(rnd.randint(0, 200)) + rnd.choice(shared) + text(rnd.randint(0, 100))) for i in range(70)]
    docs += [(100, None), (101, ""), (102, "x" * 500), (103, "ab" * 200), (104, docs[5][1]), (5, docs[5][1]), (105, docs[6][1][1:]), (106, docs[7][1][:80] + "!" + docs[7][1][80:])]
    docs += [(None, shared[1] + shared[1]), (107, shared[0][:60]), (108, "yz" * 15 + "xy" * 40)]
    return docs


@pytest.mark.parametrize(("keep", "hot"), [("none", 4_000), ("none", 3), ("first", 4_000)])
def test_matches_window_counts(spark, keep, hot):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).selectExpr("*", "1 AS block", "2 AS n_bytes")
    got = [tuple(r) for r in repeated_strings(frame, LENGTH, keep, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, keep), key=str)


def test_at_the_length_of_the_query(spark):
    """Two letters only, equal to polynomial hashes; copies, edits inside copies, texts longer than a block."""
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    twist = "a"
    for _ in range(10):
        twist += twist.translate(str.maketrans("ab", "ba"))
    shared = [word(n) for n in (199, 200, 201, 400, 900)]
    docs = [(i, word(rnd.randint(0, 150)) + rnd.choice(shared) + word(rnd.randint(0, 150))) for i in range(60)]
    docs += [(100, twist + word(300)), (101, twist.translate(str.maketrans("ab", "ba")) + word(300)), (102, "b" * 450), (103, shared[4][:600] + "c" + shared[4][601:]), (103, docs[7][1]), (None, docs[7][1])]
    docs += [(200, word(1_300_000) + shared[2] + word(100)), (201, word(30_000))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    for keep, hot in (("none", 4_000), ("none", 1)):
        got = [tuple(r) for r in repeated_strings(frame, 200, keep, hot=hot).collect()]
        assert sorted(got, key=str) == sorted(brute(docs, keep, 200), key=str)


def test_previous_factors():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 17, 300):
        place, joined = rnd.permutation(n), rnd.random(n) < 0.8
        joined[:1] = False
        got = suffixdedup.previous_factor_reaches(place, joined)
        run = np.cumsum(~joined)
        want = [any(run[i] == run[j] and place[j] < place[i] for j in range(n)) for i in range(n)]
        assert got.tolist() == want


def test_empty_table(spark):
    assert repeated_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
