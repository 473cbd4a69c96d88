"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, id, a random number stored with the row), so equal texts are neighbours and rows
equal in text and id are apart all the same. Shard boundaries are keys below
which stand k/S of all bytes. They are found by counting: each round splits the intervals that still hold
a boundary into BINS equal bins of the key, sums the exact bytes of each bin over all partitions, and goes
on in the bins where the targets fall, first along the hash and, inside one hash (a large group of
copies), along the id, until the nearest bin edge is within `tolerance` of the target. Then rows are
exchanged once, into cells (a shard's part of a hash range, small enough for one task) whose row offsets
come from the same counts, and numbered in each cell: slots are gapless though no task holds a shard.

Edge cases: a null text has no bytes, hashes as null and sorts with its kind; a null id sorts first; which of rows
equal in text and id has which place is open; an empty table gives no rows; texts of any
length are hashed whole; columns to be carried along must not be named as the results are (ValueError).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.llm import common as c

BINS = 256
#: Rows of a cell, more only where there would be over MOST_LARGE cells for single hashes.
CELL_ROWS, MOST_LARGE = 20_000, 50_000
SALTS = 1 << 20
WIDE, NO_ID = "decimal(30,0)", "-99999999999999999999"
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return df.withColumns(
        {
            "size": F.length(text).cast("long") + 16,
            "text_crc32": F.crc32(text),
            "_h": F.shiftrightunsigned(F.xxhash64(text_col), 2),
            "_d": (F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(NO_ID).cast("decimal(20,0)")) * F.lit(SALTS).cast("decimal(8,0)")).cast(WIDE) + F.floor(F.rand() * SALTS).cast("decimal(8,0)"),
        }
    )


def _bin(key: Column, lo: Column, hi: Column) -> Column:
    """Which of BINS equal parts of [lo, hi] a key is in; exact in decimals."""
    wide = lambda x: x.cast("decimal(32,0)")
    return F.floor((wide(key) - wide(lo)) * F.lit(BINS).cast("decimal(4,0)") / (wide(hi) - wide(lo) + F.lit(1))).cast("int")


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int | None]]:
    """The shards - 1 boundary keys (hash, id or None): a row is past one if its key is at or over it."""
    spark = keys.sparkSession
    whole = keys.agg(F.sum("size").alias("bytes"), F.min("_h").alias("lo"), F.max("_h").alias("hi")).first()
    if not whole.bytes:
        return []
    allowed = tolerance * whole.bytes / shards
    found: dict[int, tuple[int, int | None]] = {}
    # intervals that hold targets: hash (None: along the hash), first and last key, bytes before, targets
    todo = [(None, whole.lo, whole.hi, 0, {k: whole.bytes * k / shards for k in range(1, shards)})]
    while todo:
        rows = [(i, h, None if h is not None else int(lo), None if h is not None else int(hi), None if h is None else str(lo), None if h is None else str(hi)) for i, (h, lo, hi, _, _) in enumerate(todo)]
        at = spark.createDataFrame(rows, "i int, ih long, lo long, hi long, dlo string, dhi string")  # at most shards - 1 intervals
        along_h = at.where("ih IS NULL")
        parts = keys.join(F.broadcast(along_h), (F.col("_h") >= F.col("lo")) & (F.col("_h") <= F.col("hi"))).select("i", "size", "_h", "_d", _bin(F.col("_h"), F.col("lo"), F.col("hi")).alias("bin"), F.col("_h").cast(WIDE).alias("key"))
        if any(h is not None for h, *_ in todo):
            d = at.where("ih IS NOT NULL").select("i", "ih", F.col("dlo").cast(WIDE).alias("dlo"), F.col("dhi").cast(WIDE).alias("dhi"))
            inside = keys.join(F.broadcast(d), F.col("_h") == F.col("ih")).where("_d >= dlo AND _d <= dhi")
            parts = parts.unionByName(inside.select("i", "size", "_h", "_d", _bin(F.col("_d"), F.col("dlo"), F.col("dhi")).alias("bin"), F.col("_d").alias("key")))
        bins = parts.groupBy("i", "bin").agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("_d").alias("dlo"), F.max("_d").alias("dhi"))
        counts: dict[int, list] = {}
        for r in sorted(bins.collect(), key=lambda r: (r.i, r.bin)):  # at most (shards - 1) * BINS rows
            counts.setdefault(r.i, []).append(r)
        following = []
        for i, (h, _, _, before, targets) in enumerate(todo):
            below, open_targets = before, dict(targets)
            for r in counts[i]:
                mine = {k: t for k, t in open_targets.items() if t <= below + r.bytes}
                open_targets = {k: t for k, t in open_targets.items() if k not in mine}
                start = (int(r.lo), None) if h is None else (h, int(r.lo))
                end = (int(r.hi) + 1, None) if h is None else (h, int(r.hi) + 1)
                left = {}
                for k, t in mine.items():
                    if min(t - below, below + r.bytes - t) <= allowed or (r.lo == r.hi and h is not None):
                        found[k] = start if t - below <= below + r.bytes - t else end
                    else:
                        left[k] = t
                if left and r.lo == r.hi:
                    following.append((int(r.lo), int(r.dlo), int(r.dhi), below, left))
                elif left:
                    following.append((h, int(r.lo), int(r.hi), below, left))
                below += r.bytes
        todo = following
    return [found[k] for k in sorted(found)]


def histogram_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), tolerance: float = 0.0005) -> DataFrame:
    """df's id with size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), and the columns `carry`."""
    if clash := {*carry, id_col} & {*RESULTS}:
        raise ValueError(f"columns named as results: {sorted(clash)}")
    rows = c.stored(_key(df, id_col, text_col).select(id_col, *carry, "size", "text_crc32", "_h", "_d"), "shard-rows")
    keys = rows.select("_h", "_d", "size")
    bounds = splitters(keys, shards, tolerance)

    def shard_of(h: Column, d: Column) -> Column:
        past = [((h > bh) | ((h == bh) & (d >= F.lit(str(bd)).cast(WIDE)))) if bd is not None else (h >= bh) for bh, bd in bounds]
        return sum((p.cast("int") for p in past), F.lit(0))

    n = keys.count()
    bits = min(40, max(0, math.ceil(math.log2(max(n, 1) / CELL_ROWS))))
    cell = F.shiftrightunsigned("_h", 62 - bits) if bits else F.lit(0).cast("long")
    tally = keys.select(shard_of(F.col("_h"), F.col("_d")).alias("shard"), cell.alias("_cell"), "_h", "_d").groupBy("shard", "_cell", "_h").agg(F.count("*").alias("n"), F.min("_d").alias("lo"), F.max("_d").alias("hi"))
    # a hash with more rows than a cell takes is a cell of its own, in equal steps of the id and its random number
    most = max(CELL_ROWS, math.ceil(n / MOST_LARGE))
    large = c.stored(tally.where(F.col("n") > most).select("shard", F.col("_h").alias("_lh"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.ceil(F.col("n") / most).alias("_steps")), "shard-cells")

    def celled(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("shard", shard_of(F.col("_h"), F.col("_d"))).withColumn("_cell", cell)
        many = F.broadcast(large.withColumnRenamed("shard", "_ls"))  # at most MOST_LARGE rows of 80 bytes
        wide = lambda x: F.col(x).cast("decimal(32,0)")
        step = F.floor((wide("_d") - wide("_lo")) * F.col("_steps").cast("decimal(6,0)") / (wide("_hi") - wide("_lo") + 1)).cast("long")
        return rows.join(many, (F.col("shard") == F.col("_ls")) & (F.col("_h") == F.col("_lh")), "left").withColumn("_part", F.when(F.col("_lh").isNull(), F.lit(-1).cast("long")).otherwise(step)).withColumn("_hot", F.coalesce("_lh", F.lit(-1).cast("long")))

    at = ["shard", "_cell", "_hot", "_part"]
    # in a cell the ordinary rows come first, then each large hash by id: gapless is all that a slot promises
    sizes = celled(keys).groupBy(*at).agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("_cell", "_hot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*at, F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_before"))
    placed = celled(rows).join(offsets, at)
    slot = F.col("_before") + F.row_number().over(Window.partitionBy(*at).orderBy("_h", "_d")) - 1
    return placed.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry)
