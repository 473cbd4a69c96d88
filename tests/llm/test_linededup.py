"""Line dedup against the same rule written plainly."""

import random
import struct

import xxhash
from pyspark.sql import functions as F

from chartloom.llm.linededup import dedup_line_chunks


def _h(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def _pair(a, b):
    return _h(struct.pack("<Q", b), _h(struct.pack("<Q", a)))


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(docs, divisor=2, min_bytes=40):
    seen, out = {}, {}
    for doc_id, text in sorted(set(docs), key=lambda d: (d[0] if d[0] is not None else -(2**63), _signed(_h(d[1].encode())) if d[1] is not None else 42)):
        if text is None:
            out[doc_id, text] = (None, 0, 0)
            continue
        lines = text.split("\n")
        hashes = [_h(x.encode()) for x in lines]
        marks = [False] + [_signed(_pair(a, b)) % divisor == 0 for a, b in zip(hashes, hashes[1:])]
        starts = [0] + [i + 1 for i in range(1, len(lines) - 1) if marks[i] and not marks[i - 1]]
        gone = set()
        for s, e in zip(starts, starts[1:] + [len(lines)]):
            chunk = lines[s:e]
            if len(chunk) >= 2 and sum(len(x.encode()) for x in chunk) >= min_bytes:
                if tuple(chunk) in seen:
                    gone.update(range(s, e))
                else:
                    seen[tuple(chunk)] = (doc_id, s)
        out[doc_id, text] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    docs = [(i, "\n".join(f"line {rnd.randint(0, 400)} alpha beta gamma" for _ in range(rnd.randint(0, 14)))) for i in range(80)]
    block = "\n".join(f"shared block line {k} with several words" for k in range(14))
    for i in (3, 9, 17, 40):
        docs[i] = (i, docs[i][1] + "\n" + block + f"\nunique tail {i}")
    docs += [(200 + i, docs[5][1] + "\n" + block) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "one line"), (3, docs[3][1]), (None, block), (103, "\n\n\n"), (104, block + "\n" + block)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("ch", F.lit(1))
    got = dedup_line_chunks(frame).collect()
    want = brute(docs)
    assert len(got) == len(docs)
    texts = {}
    for d in docs:
        texts.setdefault(d[0], []).append(d[1])
    for r in got:
        assert (r.text, r.n_lines, r.n_removed_lines) in [want[r.doc_id, t] for t in texts[r.doc_id]]
    assert sum(r.n_removed_lines for r in got) > 100


def test_empty_table(spark):
    assert dedup_line_chunks(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def passages(docs, min_bytes=40):
    """Every run of two lines and min_bytes or more that an earlier place has too goes, but for what the first place holds."""
    first, lines, gone = {}, {}, {}
    for k, (doc_id, text) in enumerate(sorted(set(docs), key=lambda d: (d[0], _signed(_h(d[1].encode()))))):
        ls = lines[doc_id, text] = text.split("\n")
        gone[doc_id, text] = set()
        for s in range(len(ls)):
            for e in range(s + 2, len(ls) + 1):
                if sum(len(x.encode()) for x in ls[s:e]) >= min_bytes:
                    at = first.setdefault(tuple(ls[s:e]), (k, s))
                    if at != (k, s):
                        gone[doc_id, text].update(range(max(s, at[1] + e - s) if at[0] == k else s, e))
    return {d: ("\n".join(x for i, x in enumerate(ls) if i not in gone[d]), len(ls), len(gone[d])) for d, ls in lines.items()}


def test_short_passages_between_differing_lines(spark):
    rnd = random.Random(8)
    own = lambda i, k: [f"text {i} has its own line {j} {rnd.random()}" for j in range(k)]
    docs, planted = [], 0
    for p in range(60):
        block = [f"passage {p} line {j} with some more words" for j in range(2 + p % 7)]
        planted += len(block)
        docs += [(2 * p + i, "\n".join([*own(2 * p + i, 3), *block, *own(2 * p + i, 3)])) for i in (0, 1)]
    short = ["ab", "", "c", "d" * 9, "", "e" * 60, "", "f", "é"]
    docs += [(200 + i, "\n".join(rnd.choice(short) for _ in range(rnd.randint(1, 12)))) for i in range(30)]
    docs += [(300, "\n".join(["the same line again and again"] * 7)), (301, "\n" * 90 + "z" * 50 + "\n" * 90), (302, "\n" * 80 + "z" * 50 + "\n" * 99), (302, "\n" * 80 + "z" * 50 + "\n" * 99)]
    want = passages(docs)
    got = dedup_line_chunks(spark.createDataFrame(docs, "doc_id long, text string"), windows=True).collect()
    assert sum(r.n_removed_lines for r in got if r.doc_id < 200) == planted
    texts = {}
    for d in docs:
        texts.setdefault(d[0], []).append(d[1])
    assert len(got) == len(docs)
    for r in got:
        assert (r.text, r.n_lines, r.n_removed_lines) in [want[r.doc_id, t] for t in texts[r.doc_id]]
