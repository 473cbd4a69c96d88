"""Suffix-tree scores against the same model written plainly over strings."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chartloom.llm import suffixtree
from chartloom.llm.suffixtree import suffix_tree_scores

OPTS = {"min_count": 4, "gain": 0.5, "divergence": 0.01, "discount": 0.6}


def tokens(text):
    low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), "<end>"]


def cut(p):
    """A probability with eight binary digits."""
    return float((np.array([p], "<f4").view("<u4") & np.uint32(0xFFFF0000)).view("<f4")[0])


def brute(docs, min_count, gain, divergence, discount, depth=9):
    """(rows, what retained contexts leave, distributions, word counts)"""
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    toks = [["<begin>", *tokens(t)] for _, t in docs]
    train = [t for t, h in zip(toks, held) if not h]
    one = Counter(w for t in train for w in t[1:])
    n, v = sum(one.values()), len(one)
    root = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1)) if n else 1.0
    nexts, rest = defaultdict(Counter), {}

    def p(ctx, w):
        if not ctx or ctx not in rest:
            return p(ctx[1:], w) if ctx else root(w)
        k = nexts[ctx][w]
        return ((k - discount) / sum(nexts[ctx].values()) if k >= 2 else 0.0) + rest[ctx] * p(ctx[1:], w)

    for d in range(1, depth + 1):
        found = defaultdict(Counter)
        for t in train:
            for i in range(d, len(t)):
                if d == 1 or tuple(t[i - d + 1 : i]) in rest:
                    found[tuple(t[i - d : i])][t[i]] += 1
        nexts.update({ctx: after for ctx, after in found.items() if sum(after.values()) >= min_count})
        new = {}
        for ctx, after in found.items():
            kept, seen = {w: k for w, k in after.items() if k >= 2}, sum(after.values())
            if seen < min_count or not kept:
                continue
            left = min(1.0, max(1e-6, 1 - sum((k - discount) / seen for k in kept.values())))
            won = sum(k * math.log((k - discount) / seen / cut(p(ctx[1:], w))) for w, k in kept.items()) + (seen - sum(kept.values())) * math.log(left)
            if won >= gain * (len(kept) + 1) and won >= divergence * seen:
                new[ctx] = left
        rest.update(new)
    longest = max(map(len, rest), default=0)
    out = []
    for (i, _), t, h in zip(docs, toks, held):
        score = sum(math.log10(p(tuple(t[max(0, j - longest) : j]), t[j])) for j in range(1, len(t)))
        out.append((i, h, len(t) - 1, sum(one[w] > 0 for w in t[1:]), n, sum(math.log10(root(w)) for w in t[1:]), score))
    return out, rest, p, one


def corpus():
    rnd = random.Random(5)
    words = ["the", "a", "Cat", "dog", "sat", "ran", "on", "mat", "É", "b|c"]
    docs = []
    for i in range(160):
        t = []
        for _ in range(rnd.randint(0, 40)):
            t += ["the", rnd.choice(["cat", "dog"]), "sat", "on"] if rnd.random() < 0.3 else [rnd.choice(words)]
        docs.append((i, " ".join(t)))
    return [*docs, (None, "the cat sat"), (500, None), (501, ""), (502, "unseen\x0bwords\there"), (3, docs[3][1]), (600, "the cat " * 3000)]


@pytest.mark.parametrize(("depth", "hot"), [(1, 1 << 20), (2, 1 << 20), (6, 40), (6, 1 << 20)])
def test_matches_brute_force(spark, depth, hot):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS block", "2 AS score")
    got = [tuple(r) for r in suffix_tree_scores(frame, **OPTS, depth=depth, hot=hot).collect()]
    want, rest, p, one = brute(docs, **OPTS, depth=depth)
    assert len(rest) > 5 and max(map(len, rest)) >= min(depth, 3)
    for ctx in list(rest)[:20]:
        assert sum(p(ctx, w) for w in [*one, "?unknown?"]) == pytest.approx(1.0)
    key = lambda r: (str(r[0]), r[2], round(r[6], 4))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-5)


def test_counts_have_64_bits():
    group, big = np.array([0, 0, 1, 0]), 2**31 - 1
    assert suffixtree._numbered(group, 2, np.array([big, big, 5, big])).tolist() == [[3 * big, 0], [3 * big, 0], [5, 1], [3 * big, 0]]


def test_empty_and_untrained(spark):
    assert suffix_tree_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert tuple(suffix_tree_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()) == (held, True, 3, 0, 0, 0.0, 0.0)


def test_contexts_of_any_length(spark):
    rnd = random.Random(6)
    docs = []
    for i in range(150):
        t = []
        for _ in range(rnd.randint(1, 12)):
            # what ends the passage depends on the word three before it
            k = rnd.randint(0, 3)
            t += [f"start{k}", "all", "of", f"end{k}"] if rnd.random() < 0.5 else [rnd.choice(["all", "of", "this", "x", "y"])]
        docs.append((i, " ".join(t)))
    docs += [(None, "all of this"), (500, None), (501, ""), (3, docs[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.score) for r in suffix_tree_scores(frame, **OPTS, depth=20).collect()]
    want, rest, *_ = brute(docs, **OPTS, depth=20)
    want = [(*w[:3], w[6]) for w in want]
    assert max(map(len, rest)) >= 3
    key = lambda r: (str(r[0]), r[2], round(r[3], 4))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3]
        assert g[3] == pytest.approx(w[3], rel=1e-5)


def test_words_equal_to_polynomial_hashes(spark):
    """Two words of 1,024 letters that a hash modulo 2**64 can't tell apart are two words."""
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    rows = suffix_tree_scores(spark.createDataFrame([(1, f"{x} {x}"), (2, "c"), (11, y)], "doc_id long, text string")).collect()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in (1, 2, 11)}
    words = Counter(w for i, t in ((1, [x, x, 0]), (2, ["c", 0]), (11, [y, 0])) if not held[i] for w in t)
    n, v = sum(words.values()), len(words)
    for r in rows:
        t = {1: [x, x, 0], 2: ["c", 0], 11: [y, 0]}[r.doc_id]
        assert r.n_known == sum(words[w] > 0 for w in t) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))


def test_contexts_whose_beginning_is_no_candidate(spark):
    """What follows "a b c" counts though nothing is learnt from "b", so that "a b" is no candidate."""
    rnd = random.Random(8)
    docs = []
    for i in range(1200):
        t = []
        for _ in range(40):
            # independent words, but that which of x, y, z and w comes after "c" depends on the two words before it
            w = rnd.choices("bxyzwacdefg", [6, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1])[0]
            if w in "xyzw" and len(t) > 2 and t[-1] == "c":
                w = ("x" if t[-3] in "bad" else "y") if t[-2] == "b" else rnd.choice("zw")
            t.append(w)
        docs.append((i, " ".join(t)))
    want, rest, *_ = brute(docs, **OPTS, depth=3)
    assert ("b",) not in rest and ("b", "b", "c") in rest
    got = [(r.doc_id, r.score) for r in suffix_tree_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), **OPTS, depth=3).collect()]
    for g, w in zip(sorted(got), sorted((w[0], w[6]) for w in want), strict=True):
        assert g == (w[0], pytest.approx(w[1], rel=1e-5))


def test_positions_move_once_for_all_lengths(spark, monkeypatch):
    """Tables that are moved to the buckets of contexts: one for each turn of the buckets, however long contexts are."""
    moved, stored = [], suffixtree.c.stored
    monkeypatch.setattr(suffixtree.c, "stored", lambda df, name: moved.append(name) or stored(df, name))
    frame = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    assert suffix_tree_scores(frame, **OPTS, depth=3).count() == len(corpus())
    assert sorted(moved) == [*(f"answers-{k}" for k in range(suffixtree.TURNS)), "words"]
