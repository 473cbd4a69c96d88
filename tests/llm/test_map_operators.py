"""Sharding, fertility, WARC, containment, toxicity and BPE against plain versions on small tables."""

import base64
import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chartloom.llm import bpe, common, contamination, fertility, sharding, toxicity, warc
from chartloom.llm.queries import _file

WORDS = re.compile("[^\x20\x09-\x0d]+")
ODD = [(9000, None), (9001, ""), (9002, " \n\t "), (9003, "x" * 30000), (9004, "a\x0bb\x1cc\x85d"), (None, "null id here"), (9005, "dup"), (9005, "dup")]


def _corpus(n=120, seed=7):
    rnd = random.Random(seed)
    words = [rnd.choice(["the", "of", "être", "größe", "Año"]) + rnd.choice(["", "ing", "tion", ",", "."]) for _ in range(40)]
    return [(i, "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 15))) for _ in range(rnd.randint(1, 6)))) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---------------------------------------------------------------- sharding

@pytest.mark.parametrize("hot", [0, 150])
def test_shards(spark, monkeypatch, hot):
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    rows = [*_corpus(300), *ODD[:3], *ODD[4:], *((20000 + i, "copy " * 20) for i in range(hot))]
    got = sharding.histogram_shards(_frame(spark, rows), 8, tolerance=0.01).collect()
    key = lambda i, t: (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in got))) == sorted(map(str, (key(*r) for r in rows)))
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    assert set(by_shard) == set(range(8))
    for rs in by_shard.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    total = sum(r.size for r in got)
    largest = max(r.size for r in got)
    assert all(abs(sum(r.size for r in rs) - total / 8) <= 2 * (0.01 * total / 8 + largest) for rs in by_shard.values())


def test_shards_follow_the_splitters(spark):
    """Shards are stretches of rows by (hash of the text, id), each boundary as near to its target as rows allow."""
    import xxhash

    rows = [*_corpus(400, 8), (9000, None), (9001, ""), *((20000 + i, "copy " * 20) for i in range(90)), *((7, "the same row") for _ in range(200))]
    got = sharding.histogram_shards(_frame(spark, rows).repartition(5), 10, tolerance=0.002).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    place = {(i, crc(t)): (xxhash.xxh64_intdigest(t.encode(), seed=42) >> 2 if t is not None else 42 >> 2, i) for i, t in rows}
    ordered = sorted(((*place[r.doc_id, r.text_crc32], r.shard, r.size) for r in got))
    assert [x[2] for x in ordered] == sorted(x[2] for x in ordered)
    total, largest = sum(x[3] for x in ordered), max(x[3] for x in ordered)
    for k in range(1, 10):
        below = sum(x[3] for x in ordered if x[2] < k)
        assert abs(below - total * k / 10) <= max(0.002 * total / 10, largest)
    same = [r.shard for r in got if r.doc_id == 7 and r.text_crc32 == crc("the same row")]
    assert len(same) >= 200 and len(set(same)) > 0
    for shard in range(10):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_shards_refuse_clashes_and_take_empty(spark):
    assert sharding.histogram_shards(_frame(spark, []), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.histogram_shards(_frame(spark, []).withColumn("slot", F.lit(1)), 4, carry=("slot",))


# ---------------------------------------------------------------- fertility

def _base(text):
    text = text or ""
    w, seen, dup = WORDS.findall(text), set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def _thue_morse(n=10):
    """Two texts of 2**n letters each that polynomial hashes modulo 2**64 can't tell apart."""
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_bytes_apart():
    import numpy as np

    rnd = random.Random(8)
    x, y = _thue_morse()
    words = [x, y, x, "", "a", "a\0", *("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 200))) for _ in range(400))]
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    buf, s = np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw]
    for got in (common.range_hash(buf, s, ends), common.exact_ids(buf, s, ends)):
        by = {}
        for r, h in zip(raw, got.tolist()):
            by.setdefault(r, set()).add(h)
        assert all(len(v) == 1 for v in by.values()) and len({h for v in by.values() for h in v}) == len(by)
    a, b = rnd.choices(range(len(raw)), k=300), rnd.choices(range(len(raw)), k=300)
    size = np.array([min(len(raw[i]), len(raw[j])) for i, j in zip(a, b)])
    assert common.same_ranges(buf, s[a], s[b], size).tolist() == [raw[i][:n] == raw[j][:n] for i, j, n in zip(a, b, size.tolist())]


def test_workers_forget_other_operators(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    gone = []
    common.worker_of("a", lambda: gone.append("a"))
    common.worker_of("a", lambda: gone.append("a"))
    assert not gone
    common.worker_of("b")
    common.worker_of("a", lambda: gone.append("a"))
    assert gone == ["a"]


def _fertility(rows, names, width=8.0, floor=0.08, short=160.0):
    """The verdicts by plain Python: measures of whole texts, lower medians on the grid."""
    own = fertility.Vocabularies(*names)
    out = []
    for i, t, lang in rows:
        t, base = t or "", _base(t)
        got = [0.0] * 4 + [0]
        if base[0]:
            parts = [m[0] for m in re.finditer(r"\S{1024}(?=\S)|\s{1024}(?=\s)|[\s\S]", t)]
            joined, cut = [""], False
            for q in parts:
                joined[-1] += q
                if len(q) == 1024:
                    joined.append("")
            ids = [x for q in joined for x in own.pieces.encode(q)]
            n = sum(len(own.bytes.encode_ordinary(q)) for q in joined)
            p = [k / len(ids) for k in Counter(ids).values()]
            got = [len(t) / len(ids), -sum(x * math.log2(x) for x in p) / math.log2(max(2, len(ids))), len(t) / n, sum(own.pieces.is_byte(x) for x in ids) / len(ids), len(ids)]
        out.append((i, lang, base, got))
    low = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    grid = lambda x: min(int(x * 1024), 1 << 16)
    band, want = {}, []
    for lang in {x[1] for x in out}:
        solid = [x[3] for x in out if x[1] == lang and x[2][0] >= 20]
        if solid:
            mids = [low([grid(x[k]) for x in solid]) for k in range(4)]
            band[lang] = [((mids[k] + 0.5) / 1024, low([abs(grid(x[k]) - mids[k]) for x in solid]) / 1024) for k in range(4)]
    for i, lang, base, got in out:
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        bad = False
        if lang in band:
            slack = width * (1 + math.sqrt(short / max(1, got[4])))
            for k, (mid, mad) in enumerate(band[lang]):
                room, dev = slack * max(mad, 0.01 if k == 3 else floor / width * mid), got[k] - mid
                bad |= abs(dev) > room if k in (0, 2) else dev > room if k == 3 else dev < -room
        want.append(str((i, *base, failed, not failed and not bad)))
    return sorted(want)


def test_fertility(spark):
    x, y = _thue_morse()
    prose = [(i, t) for i, t in _corpus(160)]
    rows = [*prose, *ODD, (500, "line one two\n" * 9), (501, "#a *b $c " * 30), (502, "THE OF!! " * 60), (503, "@@##" * 2000 + " a b " * 12), (504, f"{x}\n{y}\n{x}"), (505, " \n" * 3000 + "w " * 25), (506, "ж ц 中 😀 " * 30)]
    rows += [(600 + k, " ".join("".join(chr(0x1F300 + (7 * j + 13 * i + k) % 400) for i in range(5)) for j in range(80))) for k in range(3)]
    rows = [(i, t, ["fr", "de", "xx"][k % 3]) for k, (i, t) in enumerate(rows)]
    names = _file("piece_bpe_32k.model"), _file("byte_bpe_multi_50k.tiktoken")
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))
    got = [fertility.fertility_verdicts(f, *names).collect() for f in (frame, frame.repartition(7))]
    have = [sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)) for r in g) for g in got]
    assert have[0] == have[1] == _fertility(rows, names)
    by = {r.doc_id: r for r in got[0]}
    assert sum(r.kept for r in got[0]) > 40 and any(not r.kept and not r.base_failed for r in got[0]) and by[504].n_dup_lines == 1
    assert fertility.fertility_verdicts(_frame(spark, []), *names).count() == 0
    no_lang = fertility.fertility_verdicts(_frame(spark, [(1, "ж ц " * 40), (2, "of the " * 40), (3, None)]), *names).collect()
    assert {r.fertility_band for r in no_lang} == {"script:cyrillic", "script:latin", "script:none"}


# ---------------------------------------------------------------- WARC

def test_warc(spark):
    rnd = random.Random(3)
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    payloads = ["", "", None, "x", "x", "a WARC/1.1\r\n b", "a WARC/1.1\r\n b", record, "pre " + record * 2, "WARC/1.1\r\n", "é" * 3000 + record]
    payloads += [f"p{i}" * rnd.randint(1, 3000) for i in range(40)] + ["same" * 50] * 40
    rows = [(i, f"http://x/{i}\r\nX: y", p) for i, p in enumerate(payloads)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        path = common.fresh_path(spark, "warc-test")
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
        got = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    head = {p or "": i for i, _, p in rows}
    want = []
    for i, _, p in rows:
        raw, first = (p or "").encode(), head[p or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first == i else "revisit", None if first == i else first, True))
    assert sorted(tuple(r) for r in got) == want


def test_warc_odd_tables(spark):
    rows = [(None, "http://n", "null id"), (None, None, "null id"), (1, None, "p"), (1, "u", "p"), (2, "u", None)]
    path = common.fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")), path)
    got = sorted(str((r.page_id, r.record_type, r.refers_to, r.payload_bytes)) for r in warc.read_archives(spark, path).collect())
    assert got == sorted(map(str, [(None, "response", None, 7), (None, "response", None, 7), (1, "response", None, 1), (1, "response", None, 1), (2, "response", None, 0)]))
    empty = common.fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def _shuffled(spark):
    """Bytes of shuffles that all stages so far wrote."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    there = spark._jsc.sc().statusStore().executorList(False)
    return sum(there.apply(i).totalShuffleWrite() for i in range(there.size()))


def test_warc_single_payloads_stay_where_they_are(spark):
    rnd = random.Random(4)
    rows = [(i, f"http://x/{i}", rnd.randbytes(10_000).hex()) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2).localCheckpoint()
    before, path = _shuffled(spark), common.fresh_path(spark, "warc-test")
    warc.write_archives(pages, path)
    assert _shuffled(spark) - before < 200_000  # of 4 MB
    assert {(r.page_id, r.record_type, r.payload_bytes) for r in warc.read_archives(spark, path).collect()} == {(i, "response", 20_000) for i in range(200)}


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_warc_filter_of_repeated_payloads(spark, monkeypatch, words):
    """A filter that lets nearly everything through changes no record."""
    monkeypatch.setattr(warc, "MOST_WORDS", words)
    rows = [(i, None, f"page {i if i % 3 else i % 200}") for i in range(400)]
    path, head = common.fresh_path(spark, "warc-test"), {p: i for i, _, p in rows}
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect())
    assert 20 < sum(head[p] != i for i, _, p in rows) < 200
    assert got == [(i, "response", None) if head[p] == i else (i, "revisit", head[p]) for i, _, p in rows]


def test_warc_long_headers(spark):
    rows = [(i, "data:text/html," + "x" * (200_000 if i in (3, 11) else 10), f"page {i}" * 50) for i in range(20)]
    path = common.fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = warc.read_archives(spark, path).collect()
    assert sorted((r.page_id, r.verified) for r in got) == [(i, True) for i, _, _ in rows]


def test_warc_chain_that_breaks_off(spark, tmp_path):
    record = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %s\r\n\r\nhello\r\n\r\n"
    for k, (n, text) in enumerate([(1, record % 5), (None, record % 5 + record % "?" + record % 5), (None, record % 5 + record % 9), (None, "junk"), (0, "")]):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.txt").write_bytes(text.encode())
        if n is None:
            with pytest.raises(ValueError, match="do not end"):
                warc.read_archives(spark, f"{tmp_path}/{k}")
        else:
            assert warc.read_archives(spark, f"{tmp_path}/{k}").count() == n


# ---------------------------------------------------------------- containment

def _shingles(text):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_containment(spark, monkeypatch):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(50)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 5, 8, 14, 30, 60, 30, 14])] + [(50, None), (51, ""), (None, "a b c d e f")]
    items.append((52, items[4][1]))
    docs = [*_corpus(60), *ODD]
    for k in range(90):
        parts = [text(rnd.randint(0, 200))]
        for _ in range(rnd.randint(0, 3)):
            w = rnd.choice(items[1:8])[1].split()
            cut = rnd.choice([0, 0, 2, 5, 12])
            parts += [" ".join(w[cut:]).upper() if rnd.random() < 0.3 else " ".join(w[: len(w) - cut]), text(rnd.randint(0, 300))]
        docs.append((1000 + k, "; ".join(parts)))
    docs.append((2000, " . ".join(t for _, t in items[1:8])))
    want = set()
    for d, t in docs:
        for i, x in items:
            q = _shingles(x)
            if q and i is not None and len(q & _shingles(t)) >= 0.8 * len(q) - 1e-9:
                want.add((d, i, len(q & _shingles(t)), len(q)))
    frames = _frame(spark, docs).withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    run = lambda: {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in contamination.leaks(*frames).collect()}
    assert run() == want and len(want) > 30
    clean = {r.doc_id for r in contamination.without_leaks(*frames).collect()}
    assert clean == {d for d, _ in docs} - {w[0] for w in want}
    monkeypatch.setattr(contamination, "BLOCK_SHINGLES", 40)
    assert run() == want
    assert contamination.leaks(frames[0], spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_exact_way_for_huge_sets():
    import numpy as np

    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 2**63, 10, dtype=np.uint64)) for _ in range(3)]
    index = contamination.Items(np.arange(3), np.concatenate(sets), np.array([0, 10, 20, 30]), 0.8, 1e-6)
    monster = np.unique(np.concatenate([sets[0], sets[1][:3]]))
    old, contamination.MOST_VALUES = contamination.MOST_VALUES, 0
    try:
        assert set(index.candidates(monster, np.array([0, len(monster)])).tolist()) == {0, 1}
    finally:
        contamination.MOST_VALUES = old


# ---------------------------------------------------------------- toxicity

def _toxic_corpus():
    rnd = random.Random(5)
    vocab, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["idiot", "scum", "loser"]
    docs = []
    for i in range(600):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 60))]
        if i % 6 == 0:
            w += [rnd.choice(bad).upper() for _ in range(rnd.randint(1, 4))]
        rnd.shuffle(w)
        docs.append((i, " ".join(w)))
    return docs + ODD, [(i, int(i % 6 == 0)) for i in range(400)] + [(None, 1), (3, None)]


def _plain_scores(docs, labels, k):
    """Scores by plain Python: every example's cosine, the k best, votes, a logistic by gradient steps."""
    words = lambda t: Counter(re.findall("[a-z\x80-\U0010ffff]+", "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t or "")))
    of = {i: y for i, y in labels if i is not None and y is not None}
    ids = sorted(of)
    by_id = dict(docs)
    bags = {i: words(by_id[i]) for i in ids}
    n, n1 = len(ids), sum(of.values())
    m, a = Counter(w for i in ids for w in bags[i]), Counter(w for i in ids if of[i] for w in bags[i])
    chi2 = {w: n * (a[w] * (n - n1 - m[w] + a[w]) - (m[w] - a[w]) * (n1 - a[w])) ** 2 / max(1, m[w] * (n - m[w]) * n1 * (n - n1)) if m[w] < n else 0.0 for w in m}
    df = Counter(w for _, t in docs for w in set(words(t)))
    weight = {w: (math.log((1 + len(docs)) / (1 + df[w])) + 1) * math.sqrt(chi2[w]) for w in m}

    def vector(bag):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in bag.items() if weight.get(w)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    own = {i: vector(bags[i]) for i in ids}
    rate = n1 / n

    def vote(v, but=None):
        cos = sorted((sum(x * own[i].get(w, 0.0) for w, x in v.items()), of[i]) for i in ids if i != but)
        cos = [(c, y) for c, y in cos if c >= 1e-6][::-1]
        assert len(cos) <= k or cos[k - 1][0] - cos[k][0] > 3e-7 or cos[k - 1][1] == cos[k][1], "a tie"
        return (sum(c * c * y for c, y in cos[:k]) + 0.05 * rate) / (sum(c * c for c, _ in cos[:k]) + 0.05)

    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    z, y = [logit(vote(own[i], i)) for i in ids], [of[i] for i in ids]
    loss = lambda p: sum(math.log1p(math.exp(-(p[0] * q + p[1]) * (1 if l else -1))) for q, l in zip(z, y)) + (p[0] - 1) ** 2 / 2 + p[1] ** 2 * 5e-4
    best, step = (1.0, 0.0), 1.0
    while step > 1e-7:
        near = [(best[0] + step * i, best[1] + step * j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        low = min(near, key=loss)
        best, step = (low, step) if loss(low) < loss(best) else (best, step / 2)
    return {i: 1 / (1 + math.exp(-(best[0] * logit(vote(vector(words(t)))) + best[1]))) for i, t in docs}


def test_toxicity(spark):
    docs, marks = _toxic_corpus()
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    frame = _frame(spark, docs).withColumn("score", F.lit("clash"))
    index = toxicity.fit(frame, labels, k=9)
    got = {r.doc_id: r for r in toxicity.score(frame, index).collect() if r.doc_id is not None}
    want = _plain_scores(docs, marks, 9)
    assert all(got[i].score == pytest.approx(want[i], abs=1e-3) for i in got)
    assert sum((got[i].score >= 0.5) == (i % 6 == 0) for i in range(400, 600)) / 200 > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9001].score < 0.5 and not got[9001].evidence
    assert got[402].evidence and all(e.label == 1 for e in got[402].evidence)
    kept = {r.doc_id for r in toxicity.without_toxic(frame, index).collect()}
    assert kept >= {9000, 9001} and not kept & {i for i in got if got[i].score >= 0.5}


def test_toxicity_index_is_exact(monkeypatch):
    import numpy as np

    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rnd = np.random.default_rng(2)
    n, v = 300, 500
    x = np.where(rnd.random((n, v)) < rnd.random(v) ** 4, rnd.random((n, v)), 0.0).astype(np.float32)
    x /= np.maximum(np.sqrt((x**2).sum(axis=1)), 1e-9)[:, None]
    row, term = np.nonzero(x)
    index = toxicity.Index(np.arange(n), rnd.integers(0, 2, n), row, term, x[row, term], np.arange(v).astype(np.uint64), np.ones(v), 0.1, 7)
    assert 0 < index.dense.shape[1] < v and len(index.first) > 300
    at, cos = index.nearest(n, row, term, x[row, term])
    full = np.rint(np.clip(x @ x.T, 0, 1) * 1e7)
    assert (np.abs(np.rint(cos * 1e7) - -np.sort(-full, axis=1)[:, :7]) <= 3).all()
    assert (np.abs(full[np.arange(n)[:, None], index.ids[at]] - np.rint(cos * 1e7)) <= 3).all()


def test_toxicity_bounds_and_empty_tables(spark):
    docs, marks = _toxic_corpus()
    labels, frame = spark.createDataFrame(marks, "doc_id long, toxic int"), _frame(spark, docs)
    assert len(toxicity.fit(frame.unionByName(_frame(spark, [docs[0]] * 1000)), labels, max_examples=50).ids) == 50
    few = toxicity.fit(frame, labels, max_postings=2500)
    assert 5 < len(few.ids) < 200 and len(few.terms) <= 2500
    nothing = toxicity.fit(frame, labels.where("toxic = 0"))
    assert len({r.score for r in toxicity.score(frame, nothing).collect()}) == 1
    none = toxicity.fit(_frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(frame, none).collect()} == {0.5} and toxicity.score(_frame(spark, []), few).count() == 0


# ---------------------------------------------------------------- BPE

def test_bpe_equals_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(1)
    pieces = ["a", "b", "e", "th", "ing", " ", "'", "é", "é", "ß", "Σ", "İ", "1", "!", "#", "\n", "\x1c", "​", "ж", "中", "😀", "<|endoftext|>", "<|endof", "\x85", "'s"]
    rows = [(i, "".join(rnd.choice(pieces[:6] if rnd.random() < 0.6 else pieces) for _ in range(rnd.choice([3, 30, 300])))) for i in range(300)]
    rows += [(1000 + n, ch * n) for n in (1, 63, 64, 65, 500, 3000) for ch in "ae!"] + ODD
    got = sorted(str(tuple(r)) for r in bpe.encode_documents(_frame(spark, rows), bpe.vocabulary_bytes()).collect())
    want = []
    for i, t in rows:
        e = library.encode(t or "", add_special_tokens=False)
        dec = library.decode(e.ids, skip_special_tokens=False)
        want.append(str((i, len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(dec.encode()).hexdigest())))
    assert got == sorted(want)


def test_streaming_machines():
    import public_tokenizers
    from tokenizers import Tokenizer

    v = bpe.Vocabulary(bpe.vocabulary_bytes())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(3)
    for text in ("theingtionanre" * 900, "".join(rnd.choice("aeinrst") for _ in range(9000)), "abababc" * 1300):
        machine, out, most, early = bpe.Transducer(v), [], 0, 0
        for ch in text[:-1]:
            out += machine.push(ch)
            most = max(most, len(machine.text))
        early = len(out)
        out += machine.finish(text[-1])
        assert [v.vocab[t] for t in out] == library.encode(text, add_special_tokens=False).ids
        assert early and most <= 2 * v.sufficient_lookahead()
    ids = [int(i) for p in bpe.Encoder(v).plain("größe中") for i in p[1].split()]
    assert bpe.Decoder(v, as_bytes=True).decode(ids) == unicodedata.normalize("NFC", "größe中") + " "
    assert bpe.Decoder(v).decode(ids) == " ".join(v.token_of[i] for i in ids)


def test_bpe_lookahead_and_decoder_decide(spark, monkeypatch):
    """A text longer than a slice and a word longer than the window; what is decoded comes from the decoder."""
    v = bpe.Vocabulary(bpe.vocabulary_bytes())
    encoder, text = bpe.Encoder(v), " ".join(["größe"] * 20_000 + ["zxq" * 4000, "end"])
    n, _, decoded = encoder.document(text, ids := [])
    assert n == len(ids) and decoded == hashlib.sha256(bpe.Decoder(v).decode(ids).encode()).hexdigest()
    pushed = []
    monkeypatch.setattr(bpe.Transducer, "push", lambda self, symbol, f=bpe.Transducer.push: pushed.append(len(got := f(self, symbol))) or got)
    encoder.document("zxq" * 4000)
    assert len(pushed) == 11_999 and sum(pushed) > 0
    assert bpe.encode_documents(_frame(spark, []), bpe.vocabulary_bytes()).count() == 0
    with pytest.raises(ValueError, match="no tokens"):
        bpe.Vocabulary(bpe.vocabulary_bytes().replace(b'"a":', b'"no a":'))
