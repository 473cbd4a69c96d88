"""N-gram Jaccard self-join by chosen paths.

Texts are sets of five-word shingles (a text of one to four words is one shingle); texts with equal sets are
one record. A record's MinHash values are the tokens it is split by. In each run all records start in
one bucket; a bucket picks each of the T positions with probability 1 / (threshold * T) and sends a
record to the child bucket of its value at each picked position, so records of Jaccard similarity
`threshold` share one child bucket on average. Buckets of at most LIMIT records are compared pair by
pair on sketches of their values.

The links found that way (estimates over CUT, well under the threshold) only say which records may belong
together, so pairs that are already connected need no further look. Large groups of near copies are connected
first: in a few single-position buckets of over LIMIT records all are compared with a few leaders. From then on a
bucket of one component is done, one of several compares only across them if it has at most ROWS records and that takes at
most PAIRS comparisons, and what is left first compares all with one leader: those similar to it leave, since by the
triangle inequality whatever is similar to them is linked with the leader too, and the rest is split on.

Runs repeat until a pair at the threshold is missed with a probability of at most 1 - recall, by the survival of
its branching process down to depth DEPTH, and on until the recall measured on a sample is met as well: SAMPLE texts of
at most SAMPLE_BYTES, those of the lowest hash, whose links with all documents are counted exactly in the first
pass over the texts.

Inside components every pair of records is verified by exact set intersection, tile by tile for large
components. So links are exact, and are counted without being written out.

Edge cases: null and empty texts have no set, no link, and are a class of their own; repeated rows and
equal texts are links of each other; null ids count as rows but can't name a class unless alone; texts of
any length are whole sets; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm import common as c
from chartloom.llm.components import components, least_labels

N = 5
T = 128
LIMIT = 256
PAIRS, ROWS = 1 << 22, 1 << 16
DEPTH = 3
#: What is under 1 - SAME from a leader has its links, 1 - threshold further, within 1 - CUT of it; 0.1 is left for noise.
CUT, SAME = 0.5, 0.8
#: Positions of the buckets in which large groups are connected first, and leaders of each.
FIRST, LEADERS = range(0, T, T // 6), 4
MORE_RUNS = 8
SAMPLE, SAMPLE_BYTES = 256, 16_000
TILE, TILE_BYTES = 1024, 4 << 20
COLUMNS = 2048
FEW_BYTES = 32 << 20
NO_ID = -(2**63)
_odd = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_needed(recall: float) -> int:
    p = 1.0
    for _ in range(DEPTH):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def picked(path: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the T positions each bucket picks, from its path alone."""
    dice = c.mix(path[:, None] ^ c.mix(np.arange(1, T + 1, dtype=np.uint64))[None, :])
    return dice < np.uint64(min(2**64 - 1, int(2**64 / (threshold * T))))


def child(path: np.ndarray, position: np.ndarray, value: np.ndarray) -> np.ndarray:
    return c.mix(c.mix(path + position.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (value.astype(np.uint64) + np.uint64(1)))


def sets_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle), distinct and sorted."""
    words, row = c.word_hashes(buf, off)
    h, who = c.shingles(words, row, N)
    n = np.bincount(row, minlength=len(off) - 1)
    begin = np.concatenate([[0], np.cumsum(n)])
    short = np.flatnonzero((n > 0) & (n < N))
    if len(short):  # the whole text is one shingle
        h = np.concatenate([h, [c.ngram_hash(words[begin[r] : begin[r + 1]], int(n[r]))[0] for r in short]]).astype(np.uint64)
        who = np.concatenate([who, short])
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return who[new], h[new]


def _keys(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One number for each set: equal for equal sets."""
    return c.mix(np.add.reduceat(c.mix(h + np.uint64(0x632BE59BD9B4E019)), starts)).astype(np.int64)


class Sample:
    """The sampled sets, with which every text is compared exactly."""

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.threshold, self.sizes = threshold, np.array([len(s) for s in sets], np.int64)
        self.universe, local = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        order = np.argsort(local, kind="stable")
        self.item = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.begin = np.searchsorted(local[order], np.arange(len(self.universe) + 1))

    def near(self, who: np.ndarray, h: np.ndarray, n_rows: int) -> list[list[int]]:
        """For each row the sampled sets it is linked with, but for its equals."""
        out: list[list[int]] = [[] for _ in range(n_rows)]
        if not len(self.universe) or not len(h):
            return out
        at = np.minimum(np.searchsorted(self.universe, h), len(self.universe) - 1)
        hit = self.universe[at] == h
        sizes = np.bincount(who, minlength=n_rows)
        at, rows = at[hit], who[hit]
        many = self.begin[at + 1] - self.begin[at]
        items = self.item[np.repeat(self.begin[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
        pair, k = np.unique(np.repeat(rows, many) * len(self.sizes) + items, return_counts=True)
        row, item = pair // len(self.sizes), pair % len(self.sizes)
        whole = sizes[row] + self.sizes[item] - k
        for r, i in zip(*(v[(k >= self.threshold * whole - 1e-6) & (k < whole)].tolist() for v in (row, item))):
            out[r].append(i)
        return out


def sampled(docs: DataFrame) -> list[np.ndarray]:
    """The sets of the sample, at most SAMPLE."""
    short = docs.select("text", F.xxhash64("text").alias("h")).where(F.octet_length("text") <= SAMPLE_BYTES)
    lowest = short.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]  # hashes move, texts don't
    few = short.where(F.col("h") <= F.lit(lowest)).dropDuplicates(["text"]).orderBy("h", "text").limit(SAMPLE).toArrow()
    buf, off = c.buffer_of(few.column("text"))
    who, h = sets_of(buf, off)
    rows, starts = np.unique(who, return_index=True)
    return [h[a:b] for a, b in zip(starts, [*starts[1:], len(h)])]


def records(docs: DataFrame, sample: Sample) -> DataFrame:
    """doc_id, key, n (shingles), MinHash values and links with the sample of each row of docs; key is null without shingles."""
    shipped = docs.sparkSession.sparkContext.broadcast(sample)  # at most SAMPLE sets of SAMPLE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c.worker_of("jaccardjoin")
        for batch in batches:
            for part, buf, off in c.chunks(batch):
                who, h = sets_of(buf, off)
                rows, starts = np.unique(who, return_index=True)
                at = np.full(part.num_rows, -1)
                at[rows] = np.arange(len(rows))
                keys, vals = np.zeros(0, np.int64), np.zeros((0, T), "<u4")
                if len(rows):
                    keys = _keys(h, starts)
                    vals = np.stack([(np.minimum.reduceat(h * a, starts) >> np.uint64(8)).astype("<u4") for a in _odd], axis=1)
                sizes = np.diff(np.concatenate([starts, [len(h)]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()), pa.array([int(keys[i]) if i >= 0 else None for i in at], pa.int64()),
                        pa.array([int(sizes[i]) if i >= 0 else 0 for i in at], pa.int64()), pa.array([vals[i].tobytes() if i >= 0 else None for i in at], pa.binary()),
                        pa.array(shipped.value.near(who, h, part.num_rows), pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "key", "n", "vals", "near"],
                )

    return c.stored(docs.select("doc_id", "text").mapInArrow(c.lean(run), "doc_id long, key long, n long, vals binary, near array<int>"), "records")


def _vals(column: pa.Array) -> np.ndarray:
    buf, off = c.buffer_of(column)
    return buf.view("<u4").reshape(len(off) - 1, T) if len(off) > 1 else np.zeros((0, T), "<u4")


def _sketches(column: pa.Array) -> np.ndarray:
    buf, off = c.buffer_of(column)
    return buf.reshape(len(off) - 1, T) if len(off) > 1 else np.zeros((0, T), np.uint8)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of sketches, row by row."""
    return (a == b).mean(axis=-1)


PATHS = "path long, key long, comp long"
LINKS = "u long, v long"


def _placed(path: np.ndarray, key: np.ndarray, comp: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(key), pa.array(comp), *more], names=["path", "key", "comp", "sk"][: 3 + len(more)])


def _links(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])


def root_paths(reps: DataFrame, roots: np.ndarray, positions: np.ndarray, sketches: bool = False) -> DataFrame:
    """The buckets of every record at some positions of some roots, with its sketch if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vals, key, comp = _vals(batch.column("vals")), batch.column("key").to_numpy(), batch.column("comp").to_numpy()
            for root, at in zip(roots, positions):
                yield _placed(child(np.full(len(key), root), np.full(len(key), at), vals[:, at]), key, comp, *([batch.column("sk")] if sketches else []))

    return reps.select("key", "comp", "vals", *(["sk"] if sketches else [])).mapInArrow(c.lean(run), PATHS + ", sk binary" * sketches)


def _spanning(path: np.ndarray, key: np.ndarray, comp: np.ndarray, sk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what pairs of estimates over CUT and of different components connect; rows by path."""
    new = np.concatenate([[True], path[1:] != path[:-1]]) if len(path) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(path)]]))
    place = np.arange(len(path)) - np.repeat(first, size)
    of = np.repeat(size, size)
    us, vs = [], []
    for d in range(1, int(place[of <= LIMIT].max(initial=0)) + 1):
        at = np.flatnonzero((place >= d) & (of <= LIMIT))
        at = at[comp[at] != comp[at - d]]
        for i in range(0, len(at), 20000):
            some = at[i : i + 20000]
            ok = some[_alike(sk[some], sk[some - d]) >= CUT]
            us.append(ok)
            vs.append(ok - d)
    for lo, n in zip(first[size > LIMIT], size[size > LIMIT]):  # few comparisons across components, by the choice of such buckets
        own = np.arange(lo, lo + n)
        kinds, times = np.unique(comp[own], return_counts=True)
        for i in own[comp[own] != kinds[np.argmax(times)]]:
            ok = own[(comp[own] != comp[i]) & (_alike(sk[i], sk[own]) >= CUT)]
            us.append(np.full(len(ok), i))
            vs.append(ok)
    a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
    label = least_labels(a, b, len(path))  # of a bucket's links those that span its components are enough
    on = np.flatnonzero(label != np.arange(len(path)))
    return key[on], key[label[on]]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each bucket; rows come sorted by path."""
    held: tuple | None = None
    for batch in batches:
        now = *(batch.column(x).to_numpy() for x in ("path", "key", "comp")), _sketches(batch.column("sk"))
        if held is not None:
            now = tuple(np.concatenate([a, b]) for a, b in zip(held, now))
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on in the next batch
        yield _links(*_spanning(*(a[:cut] for a in now)))
        held = tuple(a[cut:] for a in now)
    if held is not None:
        yield _links(*_spanning(*held))


def _with_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their estimate against the bucket's leader."""
    for batch in batches:
        est = _alike(_sketches(batch.column("sk")), _sketches(batch.column("leader_sk")))
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("path", "key", "comp", "leader", "leader_comp")), pa.array(est, pa.float64())], names=["path", "key", "comp", "leader", "leader_comp", "est"])


def _led(rows: DataFrame, heads: DataFrame, reps: DataFrame) -> DataFrame:
    """rows (path, key, comp, sk) whose path is in heads (path, leader, leader_comp), with est, their likeness to its leader."""
    few = _few(c.stored(heads, "heads"))
    own = _few(c.stored(reps.select(F.col("key").alias("leader"), F.col("sk").alias("leader_sk")).join(few, "leader"), "leaders"), 200)
    return rows.join(own, "path").mapInArrow(c.lean(_with_leader), PATHS + ", leader long, leader_comp long, est double")


def _children(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, key, comp = (batch.column(x).to_numpy() for x in ("path", "key", "comp"))
            vals, path = _vals(batch.column("vals")), path.view(np.uint64)
            for lo in range(0, len(path), 4096):
                row, at = np.nonzero(picked(path[lo : lo + 4096], threshold))
                row += lo
                yield _placed(child(path[row], at, vals[row, at]), key[row], comp[row])

    return run


def _few(df: DataFrame, row_bytes: int = 40) -> DataFrame:
    """A stored table, sent to every task if it has at most FEW_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= FEW_BYTES else df


def hot_links(reps: DataFrame) -> DataFrame | None:
    """Links that connect large groups: all of a bucket of over LIMIT records with some of them."""
    roots, positions = np.zeros(len(FIRST), np.uint64), np.array(FIRST)
    some = [F.min_by("key", F.xxhash64("key", F.lit(i))) for i in range(LEADERS)]
    heads = root_paths(reps, roots, positions).groupBy("path").agg(F.count("*").alias("m"), *[x.alias(f"l{i}") for i, x in enumerate(some)]).where(F.col("m") > LIMIT)
    leaders = F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)]))
    heads = c.stored(heads.select("path", F.explode(leaders).alias("leader")).withColumn("leader_comp", F.col("leader")), "hot-heads")
    if heads.isEmpty():
        return None
    est = _led(root_paths(reps, roots, positions, sketches=True), heads, reps)
    return c.stored(est.where((F.col("est") >= CUT) & (F.col("key") != F.col("leader"))).select(F.col("key").alias("u"), F.col("leader").alias("v")).distinct(), "hot-links")


def wave_links(reps: DataFrame, threshold: float, first_run: int, runs: int) -> list[DataFrame]:
    """Links across components found in some runs. reps: key, comp, vals, sk."""
    roots = c.mix(np.arange(first_run + 1, first_run + runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    run_of, at = np.nonzero(picked(roots, threshold))
    rows = root_paths(reps, roots[run_of], at)
    sketched = root_paths(reps, roots[run_of], at, sketches=True)  # made again rather than moved with every row
    links: list[DataFrame] = []
    while True:
        sizes = rows.groupBy("path").agg(F.count("*").alias("m"), F.min("comp").alias("least"), F.max("comp").alias("most"))
        sizes = c.stored(sizes.where("least <> most").select("path", "m", F.col("least").alias("leader_comp")), "buckets")
        big = c.stored(sizes.where(F.col("m") > LIMIT), "large")
        easy = sizes.where(F.col("m") <= LIMIT).select("path")
        if any_big := not big.isEmpty():
            parts = rows.join(_few(big.select("path")), "path").groupBy("path", "comp").agg(F.count("*").alias("n"))
            across = parts.groupBy("path").agg(F.sum("n").alias("m"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("across"))
            across = c.stored(across.select("path", ((F.col("across") <= PAIRS) & (F.col("m") <= ROWS)).alias("few")), "across")
            easy = easy.unionByName(across.where("few").select("path"))
            big = c.stored(big.join(across.where("NOT few").select("path"), "path"), "large")
        easy = _few(c.stored(easy, "easy"), 16)
        links.append(c.stored(sketched.join(easy, "path").repartition("path").sortWithinPartitions("path", "comp", "key").mapInArrow(c.lean(_small), LINKS).distinct(), "links"))
        if not any_big or big.isEmpty():
            return links
        heads = rows.join(_few(big.select("path", F.col("leader_comp").alias("comp"))), ["path", "comp"]).groupBy("path").agg(F.min("key").alias("leader"), F.min("comp").alias("leader_comp"))
        est = c.stored(_led(sketched, heads, reps), "led")
        links.append(est.where((F.col("est") >= CUT) & (F.col("comp") != F.col("leader_comp"))).select(F.col("key").alias("u"), F.col("leader").alias("v")).distinct())
        rest = _few(c.stored(est.where(F.col("est") < SAME).select("path", "key", "comp"), "rest"))
        rows = c.stored(reps.select("key", "vals").join(rest, "key").mapInArrow(c.lean(_children(threshold)), PATHS).distinct(), "paths")
        sketched = reps.select("key", "sk").join(_few(rows), "key").select("path", "key", "comp", "sk")


def candidate_groups(reps: DataFrame, sample_keys: list[int], threshold: float, recall: float) -> DataFrame:
    """(key, grp): the components of what may be linked. reps: key, vals, sk, near."""
    spark = reps.sparkSession
    hot = hot_links(reps.withColumn("comp", F.col("key")))
    links = [hot] if hot is not None else []
    state = reps.withColumn("comp", F.col("key"))
    if hot is not None:
        own = c.stored(components(hot).withColumnRenamed("node", "key"), "hot-groups")
        state = reps.join(_few(own), "key", "left").withColumn("comp", F.coalesce("root", "key"))
    others = spark.createDataFrame(list(enumerate(sample_keys)), "item int, other long")  # at most SAMPLE rows
    truth = c.stored(reps.select("key", F.explode("near").alias("item")).join(F.broadcast(others), "item").where("key <> other").select("key", "other"), "sample-links")
    n_truth, done, runs = truth.count(), 0, runs_needed(recall)
    while True:
        state = c.stored(state.select("key", "comp", "vals", "sk"), "state")
        links += wave_links(state, threshold, done, runs)
        c.release(state)
        groups = c.stored(components(reduce(DataFrame.unionByName, links).where("u <> v").distinct()).select(F.col("node").alias("key"), F.col("root").alias("grp")), "groups")
        done, runs = done + runs, MORE_RUNS
        together = truth.join(groups, "key").join(groups.select(F.col("key").alias("other"), F.col("grp").alias("_g")), "other").where("grp = _g").count() if n_truth else 0
        if together >= recall * n_truth:
            return groups
        state = reps.join(_few(groups), "key", "left").withColumn("comp", F.coalesce("grp", "key"))


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, exact in float32 (under 2**24)."""
    flat = np.concatenate([*a, *b])
    values, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in [*a, *b]])
    shared = np.cumsum(times > 1) - 1  # what one set alone has can't be shared
    keep = (times > 1)[at]
    at, row = shared[at[keep]], row[keep]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        i, j = np.searchsorted(at, [lo, lo + COLUMNS])
        m = np.zeros((len(a) + len(b), COLUMNS), np.float32)
        m[row[i:j], at[i:j] - lo] = 1
        used = int(at[j - 1]) - lo + 1
        out += m[: len(a), :used] @ m[len(a) :, :used].T
    return out


def _linked(pdf: pa.Table, threshold: float) -> pa.Table:
    """Verified links in one tile or between two: links of each record, and edges that span what is linked."""
    key, side = pdf.column("key").to_numpy(), pdf.column("side").to_numpy()
    copies = pdf.column("copies").to_numpy()
    sets = [np.frombuffer(s, "<u8") for s in pdf.column("set").to_pylist()]
    one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: the tile with itself
    size = np.array([len(s) for s in sets], float)
    both = _intersections([sets[i] for i in one], [sets[i] for i in two]) if len(one) and len(two) else np.zeros((len(one), len(two)), np.float32)
    hit = both >= threshold * (size[one][:, None] + size[two][None, :] - both) - 1e-6
    hit &= key[one][:, None] != key[two][None, :]
    links = np.zeros(len(key), np.int64)
    np.add.at(links, one, hit @ copies[two])
    if not (side == 2).all():
        np.add.at(links, two, copies[one] @ hit)
    label = np.arange(len(key))
    while True:  # each takes the least label among itself and its neighbours, then its label's label
        after = label.copy()
        if hit.any():
            far = len(key)
            np.minimum.at(after, one, np.where(hit, label[two][None, :], far).min(axis=1))
            np.minimum.at(after, two, np.where(hit, label[one][:, None], far).min(axis=0))
        after = after[after]
        if (after == label).all():
            break
        label = after
    return pa.table({"key": key, "links": links, "other": key[label]})


def classes(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id and key of each row, key with root, class_id and n_links of each set)."""
    spark = docs.sparkSession
    sets = sampled(docs)
    rows = records(docs, Sample(sets, threshold))
    own = F.coalesce("doc_id", F.lit(NO_ID))
    first = lambda x: F.first(x).alias(x)
    reps = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), first("n"), first("vals"), first("near"))
    reps = c.stored(reps.mapInArrow(c.lean(_sketched), "key long, rep long, copies long, n long, vals binary, near array<int>, sk binary"), "reps")
    sample_keys = [int(_keys(s, np.zeros(1, np.int64))[0]) for s in sets]
    groups = candidate_groups(reps.select("key", "vals", "sk", "near"), sample_keys, threshold, recall)
    members = c.stored(groups.join(reps.select("key", "rep", "copies", "n"), "key"), "members")
    # a group is one tile unless it has many or large sets
    tiles = F.ceil(F.greatest(F.count("*") / TILE, 8 * F.sum("n") / TILE_BYTES)).cast("int").alias("tiles")
    sizes = members.groupBy("grp").agg(tiles)

    # the sets of the members, made again from one text each
    wanted = _few(c.stored(members.join(sizes, "grp").select(F.coalesce("rep", F.lit(NO_ID)).alias("_id"), "key", "grp", "copies", "tiles"), "wanted"))  # if many, the texts move

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in c.chunks(batch):
                who, h = sets_of(buf, off)
                rows, starts = np.unique(who, return_index=True)
                if not len(rows):
                    continue
                ok = _keys(h, starts) == part.column("key").to_numpy()[rows]
                ends = np.concatenate([starts[1:], [len(h)]])
                take = pa.array(rows[ok])
                yield pa.RecordBatch.from_arrays([*(part.column(n).take(take) for n in ("key", "grp", "copies", "tiles")), pa.array([h[a:b].astype("<u8").tobytes() for a, b, k in zip(starts, ends, ok) if k], pa.binary())], names=["key", "grp", "copies", "tiles", "set"])

    texts = docs.select(own.alias("_id"), "text").join(wanted, "_id").select("text", "key", "grp", "copies", "tiles")
    full = c.stored(texts.mapInArrow(c.lean(made), "key long, grp long, copies long, tiles int, set binary").dropDuplicates(["key"]), "sets")

    n_bytes = full.agg(F.sum(F.length("set"))).first()[0] or 0
    placed = full.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    single = placed.where("tiles = 1").select("grp", F.lit(2).alias("side"), "key", "copies", "set")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("mine", o).alias("a"), F.greatest("mine", o).alias("b"), F.when(o == F.col("mine"), 2).when(F.col("mine") < o, 0).otherwise(1).alias("side")))
    several = placed.where("tiles > 1").select("grp", F.explode(pairs).alias("p"), "key", "copies", "set").select("grp", "p.a", "p.b", "p.side", "key", "copies", "set")
    verified = "grp long, key long, links long, other long"

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("key", "ascending")])
        grp = table.column("grp").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
        out = [_linked(table.slice(i, j - i), threshold).add_column(0, "grp", pa.array(grp[i:j])) for i, j in zip(edges, [*edges[1:], len(grp)])]
        return pa.concat_tables(out).select(["grp", "key", "links", "other"])

    n = max(c.partitions(spark), math.ceil(n_bytes / TILE_BYTES))
    by_group = single.groupBy(F.pmod(F.xxhash64("grp"), F.lit(n))).applyInArrow(verify, verified)
    by_tile = several.groupBy("grp", "a", "b").applyInArrow(verify, verified)
    checked = c.stored(by_group.withColumn("last", F.lit(True)).unionByName(by_tile.withColumn("last", F.lit(False))), "verified")
    c.release(full)
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    root = checked.where("last").select("key", F.col("other").alias("root"))
    apart = checked.where("NOT last")
    if not apart.isEmpty():
        root = root.unionByName(components(apart.select(F.col("key").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("key"), "root"))
    known = reps.select("key", "rep", "copies").join(root, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    return rows.select("doc_id", "key"), c.stored(known.join(names, "root").select("key", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """doc_id, class_id (the least doc_id that links connect it with) and n_links (other rows at least
    `threshold` similar) of each row of docs."""
    rows, known = classes(docs, threshold, recall)
    return rows.join(known, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each_class(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """Of the rows of docs that links connect the one of the least id, nulls last, and of these of the least hash of
    the text; with all columns. Rows without a word have no link and all stay; of equal rows with a word one stays."""
    _, known = classes(docs, threshold, recall)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in c.chunks(batch):
                who, h = sets_of(buf, off)
                rows, starts = np.unique(who, return_index=True)
                key = np.zeros(part.num_rows, np.int64)
                key[rows] = _keys(h, starts) if len(rows) else 0
                none = np.ones(part.num_rows, bool)
                none[rows] = False
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key, pa.int64(), mask=none)], names=[*part.schema.names, "_jj_key"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    linked = known.select(F.col("key").alias("_jj_key"), F.col("root").alias("_jj_root"), F.col("n_links").alias("_jj_links"))
    rows = c.stored(docs.mapInArrow(c.lean(keyed), f"{names}, _jj_key long").join(linked, "_jj_key", "left"), "rows-by-class")
    alone = F.coalesce("_jj_links", F.lit(0)) == 0
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
    # a task hands on one row a class, however large the class
    best = rows.where(~alone).groupBy("_jj_root").agg(F.min_by(F.struct(*docs.columns), order).alias("_jj_row"))
    return rows.where(alone).select(*docs.columns).unionByName(best.select(*[F.col(f"_jj_row.{x}").alias(x) for x in docs.columns]))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with a byte of each of their values."""
    for batch in batches:
        sk = (_vals(batch.column("vals")) & np.uint32(255)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in sk], pa.binary())], names=[*batch.schema.names, "sk"])
