"""WARC archives: written with revisit records, read back by boundary-chain verification.

Writing: payloads are digested, equal ones grouped by digest and length, the row of the largest id of a
group becomes a response record and the others revisit records without a body. Groups are found from digests alone. A
filter of bits of the repeated ones, of bounded size, tells most other rows apart: these are written where they are read;
only rows that the filter lets through move with their payload, to be joined with the groups. Spark's text writer makes
the files, its line separator being the blank lines that end a record, so commits survive lost tasks.

Reading: Spark's text reader cuts the files at the magic that begins a record, wherever it stands, also
inside payloads, and its splits keep this parallel within a file. A task turns each piece into a candidate:
the offset at which it starts, and the successor offset that its header declares. Chains inside one
split are shortened to the offset at which they leave it; among the few offsets at which chains enter
splits, pointer jumping from each file's start finds the reachable ones, the jumps doubling every round. Only
candidates on the chain from the start are records; magic inside a payload starts no reachable candidate
unless its declared lengths happened to lie on the chain itself, which offsets rule out. Records whose
payload contains magic span several pieces; those alone are read a second time and put together.

Edge cases: a null payload is written as empty; empty payloads are equal payloads; rows of one group that
share the largest id (a repeated row) are all responses; a null id is smaller than any other and is written without an
identifier; an empty table writes no record; extra columns are ignored; headers may be of any length; one
that is cut short, holds magic or lacks a length has no successor. Reading fails where a file's chain does not
end at the file's size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import common as c

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
NULL_ID = -(2**63)
CELL = 1 << 20
#: Words of 64 bits of the filter of repeated payloads: one for four of them, and at most so many (8 MB).
MOST_WORDS = 1 << 20

CANDIDATE = (
    "file string, split long, file_size long, at long, size long, next_at long, body_at long, body_size long, record_type string, page_id long,"
    " refers_to long, payload_bytes long, payload_digest string, digest_seen string"
)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> None:
    """A WARC file for each task; payloads of under min_revisit bytes are never revisits. Payloads are equal if their
    SHA-1, their BLAKE2b-128 and their length are."""

    spark = pages.sparkSession
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url") if url_col in pages.columns else F.lit(None).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    # the largest id of each repeated payload; singles need no join partner
    keys = slim.select("id", "payload").mapInArrow(_digests(), "id long, digest string, other binary, size long")
    heads = keys.groupBy("digest", "other", "size").agg(F.max(F.coalesce("id", F.lit(NULL_ID))).alias("head"), F.count("*").alias("n")).where(f"n > 1 AND size >= {min_revisit}").drop("n")
    heads = c.stored(heads, "warc-heads")
    repeated = _filter(heads)
    schema = "id long, url string, payload string, digest string, other binary, size long"
    rows = slim.mapInArrow(_digests(repeated, False), schema).withColumn("head", F.lit(None).cast("long"))
    if len(repeated):
        rows = rows.unionByName(slim.mapInArrow(_digests(repeated, True), schema).join(heads, ["digest", "other", "size"], "left"))
    revisit = F.col("head").isNotNull() & (F.coalesce("id", F.lit(NULL_ID)) != F.col("head"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        optional("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        optional("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("head").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body,
    )
    with c.shuffles_dropped(spark):
        rows.select(record.alias("value")).write.option("lineSep", END.decode()).option("compression", "none").text(path)
    c.release(heads)


def _places(other: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, its bits) of the filter for some BLAKE2b digests: four bits of one word each."""
    h = np.frombuffer(b"".join(other), "<u8").reshape(-1, 2)
    bits = np.zeros(len(h), np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << (h[:, 1] >> np.uint64(6 * k) & np.uint64(63))
    return (h[:, 0] % np.uint64(words)).astype(np.int64), bits


def _filter(heads: DataFrame) -> np.ndarray:
    """The words of a filter that lets all repeated payloads through, and few others; none if none is repeated."""
    n = heads.count()
    words = min(MOST_WORDS, max(1, n // 4))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bits = _places(batch.column("other").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    if not n:
        return np.zeros(0, np.uint64)
    got = heads.select("other").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _digests(repeated: np.ndarray | None = None, through: bool = False):
    """Rows with SHA-1, BLAKE2b-128 and length of the payload; with a filter, those and their payloads that it lets through, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = c.buffer_of(batch.column("payload"))
            raw = memoryview(buf.tobytes())
            cuts = [*zip(off[:-1].tolist(), off[1:].tolist())]
            other = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in cuts]
            if repeated is not None:
                word, bits = _places(other, max(len(repeated), 1))
                let = repeated[word] & bits == bits if len(repeated) else np.zeros(len(word), bool)
                at = np.flatnonzero(let == through).tolist()
                batch, other, cuts = batch.take(pa.array(at, pa.int64())), [other[i] for i in at], [cuts[i] for i in at]
            found = pa.array([_digest(raw[a:b]) for a, b in cuts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *(batch.columns[1:] if repeated is not None else []), found, pa.array(other, pa.binary()), pa.array([b - a for a, b in cuts], pa.int64())], names=[*batch.schema.names[: 1 if repeated is None else None], "digest", "other", "size"])

    return run


def _parse(head: bytes) -> dict[str, str] | None:
    """The header fields of a piece that starts behind the magic, or None if the header isn't whole."""
    stop = head.find(END)
    if stop < 0:
        return None
    out = {"": str(stop + len(END))}
    for row in head[:stop].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if colon:
            out[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _number(text: str | None) -> int | None:
    text = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() and len(text) < 20 else None


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between occurrences of the magic, in file order within each split; the first piece of a file is empty."""
    return spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "*.txt").text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each occurrence of the magic; offsets are relative to the first piece of its split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at = None, 0
        for batch in batches:
            rows: list[tuple] = []
            for piece, file, split, file_size in zip(batch.column("piece"), *(batch.column(x).to_pylist() for x in ("file", "split", "file_size"))):
                raw = piece.as_py()
                if (file, split) != place:
                    place, at = (file, split), 0
                    leading = split == 0
                else:
                    leading = False
                if leading:  # what stands before the first magic of a file
                    rows.append((file, split, file_size, -1, len(raw), *[None] * 9))
                    at += len(raw)
                    continue
                rows.append(_candidate(file, split, file_size, at, raw))
                at += len(MAGIC) + len(raw)
            names = [x.split()[0] for x in CANDIDATE.split(",")]
            kinds = [pa.string(), *[pa.int64()] * 7, pa.string(), *[pa.int64()] * 3, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return _pieces(spark, path).mapInArrow(run, CANDIDATE)


def _candidate(file: str, split: int, file_size: int, at: int, raw: bytes) -> tuple:
    fields = _parse(raw)
    length = _number(fields.get("content-length")) if fields else None
    if length is None or length < 0:
        return (file, split, file_size, at, len(raw), *[None] * 9)
    body = int(fields[""])
    whole = len(raw) >= body + length
    kind = fields.get("warc-type")
    seen = _digest(raw[body : body + length]) if whole and kind == "response" else None
    return (
        file, split, file_size, at, len(raw), at + len(MAGIC) + body + length + len(END), at + len(MAGIC) + body, length, kind, _number(fields.get("warc-record-id")),
        _number(fields.get("warc-refers-to")), _number(fields.get("x-payload-length")), (fields.get("warc-payload-digest") or "").removeprefix("sha1:"), seen,
    )


def _exits(found: DataFrame) -> DataFrame:
    """(file, at, leaves): each candidate's chain followed to its first offset outside its split."""

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ascending=False)
        leaves: dict[int, int] = {}
        inside = set(pdf["at"])
        for at, after in zip(pdf["at"], pdf["next_at"]):
            leaves[at] = leaves[after] if after in inside else after
        return pd.DataFrame({"file": pdf["file"], "split": pdf["split"], "at": pdf["at"], "leaves": [leaves[a] for a in pdf["at"]]})

    return found.select("file", "split", "at", "next_at").groupBy("file", "split").applyInPandas(follow, "file string, split long, at long, leaves long")


def reachable(found: DataFrame) -> DataFrame:
    """The candidates (file, split, at, next_at and more) on the chain from offset 0 of their file."""
    exits = c.stored(_exits(found.where("next_at IS NOT NULL")), "warc-exits")
    # pointer jumping among the entries: offset 0 and what chains of other splits lead to
    entry = exits.select("file", F.col("leaves").alias("at")).distinct().join(exits, ["file", "at"]).unionByName(exits.where("at = 0").select("file", "at", "split", "leaves")).distinct()
    jump = c.stored(entry.select("file", "at", F.col("leaves").alias("to")), "warc-jump")
    reached = jump.where("at = 0").select("file", "at")
    while True:
        further = c.stored(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reached")
        jump = c.stored(jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at"))).select("a.file", "a.at", "b.to"), "warc-jump")
        reached = further
        if jump.isEmpty():
            break
    started = reached.join(exits.select("file", "split", "at"), ["file", "at"])

    def walk(key: tuple, chain: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        after = dict(zip(chain["at"], chain["next_at"]))
        on: set[int] = set()
        for at in entries["at"]:
            while at in after and at not in on:
                on.add(at)
                at = after[at]
        return chain[chain["at"].isin(on)][["file", "split", "at"]]

    slim = found.where("next_at IS NOT NULL").select("file", "split", "at", "next_at")
    on = slim.groupBy("file", "split").cogroup(started.groupBy("file", "split")).applyInPandas(walk, "file string, split long, at long")
    return found.join(on, ["file", "split", "at"], "left_semi")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and verified (a response's digest as
    read equals the one declared) of each record."""
    local = c.stored(candidates(spark, path), "warc-candidates")
    # a split's pieces begin where the bytes of the splits before it end
    spans = local.groupBy("file", "split").agg(F.sum(F.col("size") + F.when(F.col("at") < 0, 0).otherwise(len(MAGIC))).alias("n"))
    from pyspark.sql.window import Window

    starts = spans.select("file", "split", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    found = local.where("at >= 0").join(starts, ["file", "split"])
    found = found.withColumns({x: F.col(x) + F.col("start") for x in ("at", "next_at", "body_at")}).drop("start")
    records = c.stored(reachable(found), "warc-records")
    _whole_chains(local, records)
    whole = records.where("record_type <> 'response' OR digest_seen IS NOT NULL")
    broken = records.where("record_type = 'response' AND digest_seen IS NULL")
    if not broken.isEmpty():
        whole = whole.unionByName(_mended(spark, path, local, starts, broken))
    return whole.select("page_id", F.coalesce("payload_bytes", "body_size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", (F.coalesce("digest_seen", "payload_digest") == F.col("payload_digest")).alias("verified"))


def _whole_chains(local: DataFrame, records: DataFrame) -> None:
    """Raises if the chain of a file does not end where the file does."""
    sizes = local.groupBy("file").agg(F.max("file_size").alias("file_size"))
    ends = records.groupBy("file").agg(F.max("next_at").alias("end"))
    short = sizes.where("file_size > 0").join(ends, "file", "left").where("end IS NULL OR end <> file_size").select("file", "file_size", F.coalesce("end", F.lit(0)).alias("end")).take(3)
    if short:
        raise ValueError("record chains do not end at the file's size: " + "; ".join(f"{r.file} ends at {r.end} of {r.file_size}" for r in short))


def _mended(spark: SparkSession, path: str, local: DataFrame, starts: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload contains magic: their pieces are read again, gathered and digested."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = None, 0
        for batch in batches:
            ats = []
            for piece, file, split in zip(batch.column("piece"), batch.column("file").to_pylist(), batch.column("split").to_pylist()):
                if (file, split) != where:
                    where, at, lead = (file, split), 0, split == 0
                else:
                    lead = False
                ats.append(-1 if lead else at)
                at += len(piece.as_py()) + (0 if lead else len(MAGIC))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("split"), pa.array(ats, pa.int64()), batch.column("piece")], names=["file", "split", "at", "piece"])

    pieces = _pieces(spark, path).select("piece", "file", "split").mapInArrow(place, "file string, split long, at long, piece binary").where("at >= 0")
    pieces = pieces.join(starts, ["file", "split"]).select("file", (F.col("at") + F.col("start")).alias("piece_at"), "piece")
    slim = local.where("at >= 0").join(starts, ["file", "split"]).select("file", (F.col("at") + F.col("start")).alias("piece_at"), "size")
    # pieces and records of a file meet in the stretches of CELL bytes that they touch
    cell = lambda x: F.floor(F.col(x) / CELL)
    own = broken.select("file", "at", "body_at", "body_size", "next_at").withColumn("cell", F.explode(F.sequence(cell("at"), F.floor((F.col("body_at") + F.col("body_size")) / CELL))))
    needed = slim.withColumn("cell", cell("piece_at")).join(own, ["file", "cell"]).where("piece_at >= at AND piece_at < body_at + body_size").drop("size", "cell")
    parts = needed.join(pieces, ["file", "piece_at"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece_at")
        first = pdf.iloc[0]
        raw = b"".join(MAGIC + bytes(p) for p in pdf["piece"])
        lo = int(first["body_at"] - first["at"])
        return pd.DataFrame({"file": [first["file"]], "at": [first["at"]], "seen": [_digest(raw[lo : lo + int(first["body_size"])])]})

    seen = parts.groupBy("file", "at").applyInPandas(gather, "file string, at long, seen string")
    return broken.join(seen, ["file", "at"], "left").withColumn("digest_seen", F.col("seen")).drop("seen").select(*broken.columns)
