"""Line dedup by content-defined line chunks, in DataFrame operations only.

A text is a list of lines. A hash that rolls over the hashes of two adjacent lines marks a line as a
chunk's end where it is 0 modulo `divisor` and did not mark the line before, so a boundary depends on three
lines only: an insertion shifts no boundary but those next to it. Chunks of two lines or more and of at
least `min_bytes` bytes that occur again anywhere are removed, all but the first occurrence (by id, text
hash and position), once their bytes have been compared with the first's. Chunks meet by hash alone; bytes
move only for chunks whose hash repeats, and the comparison is a join whose skewed side can be split.

Such chunks catch only passages that hold a whole one. With `windows`, as the query and the pipeline have it,
each line also starts a window of the fewest lines, two at least, that have `min_bytes`, and ends one. A
window depends on its own lines only, and the windows inside a passage of two lines and `min_bytes` or more
cover all of it; so exactly the lines go that lie in such a passage with an earlier occurrence. Passages
may overlap, and what is left of an earlier one may be its lines without their neighbours.

Edge cases: a null text stays null, an empty one empty; a text of one line has no multi-line chunk; rows
equal in id and text count as one document and get the same result; a null id sorts first; an empty table
gives no rows; other columns pass through, except that n_lines and n_removed_lines of the input are
replaced. Lines are what stands between "\\n"; what is removed takes its line ends along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm import common as c

KEY = ["_cl_id", "_cl_text"]


def _bound(value: Column, use) -> Column:
    """use(value), the value computed once: a lambda's variable isn't computed again where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _packed(s: Column, n: Column) -> Column:
    """First line and number of lines as one long, for which Spark's set functions hash."""
    return F.shiftleft(s.cast("long"), 32).bitwiseOR(n.cast("long"))


def _start(w: Column) -> Column:
    return F.shiftright(w, 32).cast("int")


def _count(w: Column) -> Column:
    return w.bitwiseAND(F.lit(2**32 - 1)).cast("int")


def _windows(sizes: Column, min_bytes: int) -> Column:
    """From each line on the fewest lines, two at least, that have min_bytes; packed."""

    def fewest(i: Column) -> Column:
        def within(k: Column) -> Column:
            full = lambda a: (a["n"] >= 2) & (a["b"] >= min_bytes)
            grow = lambda a, b: F.when(full(a), a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["b"] + b).alias("b")))
            return F.aggregate(F.slice(sizes, i + 1, k), F.struct(F.lit(0).alias("n"), F.lit(0).alias("b")), grow, lambda a: F.when(full(a), a["n"]))

        # nearly always two lines do; the wider looks are taken only where the narrower ones fail
        return F.coalesce(F.when(F.get(sizes, i) + F.get(sizes, i + 1) >= min_bytes, 2), *map(within, (F.lit(8), F.lit(64), F.size(sizes))))

    return F.filter(F.transform(sizes, lambda _, i: _packed(i + 1, fewest(i))), lambda w: w.isNotNull())


def _chunks(lines: Column, divisor: int, min_bytes: int, windows: bool) -> Column:
    """array<struct<s, n, ch>>: first line (from 1), number of lines and hash of what is looked for again."""

    def of_lines(ls: Column) -> Column:
        return _bound(F.transform(ls, lambda x: F.xxhash64(x)), lambda hs: _bound(F.transform(ls, lambda x: F.octet_length(x)), lambda bs: of_hashes(hs, bs)))

    def of_hashes(hs: Column, bs: Column) -> Column:
        # marks[i] speaks of line i + 1 (from 0); the first line has no mark
        marks = F.transform(F.slice(hs, 2, F.greatest(F.size(hs) - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(F.get(hs, i), h), F.lit(divisor)) == 0)
        return _bound(marks, lambda ms: of_marks(hs, bs, ms))

    def of_marks(hs: Column, bs: Column, ms: Column) -> Column:
        # a chunk starts after a marked line whose predecessor isn't marked
        later = F.filter(F.transform(ms, lambda m, i: F.when(m & ~F.coalesce(F.get(ms, i - 1), F.lit(False)), i + 3)), lambda s: s.isNotNull())
        starts = F.filter(F.concat(F.array(F.lit(1)), later), lambda s: s <= F.size(hs))
        return _bound(starts, lambda ss: of_starts(hs, bs, ss))

    def of_starts(hs: Column, bs: Column, ss: Column) -> Column:
        cut = F.transform(ss, lambda s, i: _packed(s, F.coalesce(F.get(ss, i + 1), F.size(hs) + 1) - s))
        found = F.filter(cut, lambda w: (_count(w) >= 2) & (F.aggregate(F.slice(bs, _start(w), _count(w)), F.lit(0), lambda a, x: a + x) >= min_bytes))
        if windows:
            back = lambda rs: F.transform(_windows(rs, min_bytes), lambda w: _packed(F.size(rs) + 2 - _start(w) - _count(w), _count(w)))
            found = F.array_union(found, F.array_union(_windows(bs, min_bytes), _bound(F.reverse(bs), back)))
        return F.transform(found, lambda w: F.struct(_start(w).alias("s"), _count(w).alias("n"), F.xxhash64(F.slice(hs, _start(w), _count(w))).alias("ch")))

    return _bound(lines, of_lines)


def dedup_line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 2, min_bytes: int = 40, windows: bool = False) -> DataFrame:
    """docs with the text without repeated chunks (with `windows`, repeated passages), n_lines and n_removed_lines."""
    columns = [x for x in docs.columns if x not in ("n_lines", "n_removed_lines")]
    text = F.col("_cl_t")
    # the input's other columns travel in a struct, so no name of theirs meets one of these
    keyed = docs.select(F.struct(F.lit(True).alias("_"), *[F.col(x).alias(f"_{x}") for x in columns if x != text_col]).alias("_cl_row"), F.col(text_col).alias("_cl_t"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_cl_id"), F.xxhash64(text_col).alias("_cl_text"))
    slim = keyed.where(text.isNotNull()).select(*KEY, F.explode(_chunks(F.split(text, "\n"), divisor, min_bytes, windows)).alias("c"))
    slim = c.stored(slim.select(*KEY, "c.*"), "line-chunks")

    at = F.struct(*KEY, "s")
    again = slim.groupBy("ch").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("ch", "first")
    # of an occurrence that overlaps the first, only what lies behind the first goes
    behind = F.when((F.struct(*KEY) == F.struct("first._cl_id", "first._cl_text")) & (F.col("s") < F.col("first.s") + F.col("n")), F.col("first.s") + F.col("n")).otherwise(F.col("s"))
    wanted = slim.join(again, "ch").groupBy(*KEY).agg(F.collect_set(F.struct("s", "n", "ch", behind.alias("lo"), (at == F.col("first")).alias("is_first"))).alias("_cl_w"))
    wanted = c.stored(wanted, "line-wanted")
    c.release(slim)
    # the texts move once: with what is asked of them, null for most
    held = c.stored(keyed.join(wanted, KEY, "left"), "line-texts")
    c.release(wanted)
    asked = held.where("_cl_w IS NOT NULL")

    ask = lambda ls: F.transform("_cl_w", lambda w: F.struct(w["s"].alias("s"), w["n"].alias("n"), w["ch"].alias("ch"), w["lo"].alias("lo"), w["is_first"].alias("is_first"), F.array_join(F.slice(ls, w["s"], w["n"]), "\n").alias("bytes")))
    found = asked.select(*KEY, F.explode(_bound(F.split(text, "\n"), ask)).alias("w")).select(*KEY, "w.*")
    first = found.where("is_first").select("ch", F.col("bytes").alias("first_bytes")).dropDuplicates(["ch"])
    same = found.where("NOT is_first").join(first, "ch").where("bytes = first_bytes")
    gone = c.stored(same.groupBy(*KEY).agg(F.collect_set(F.struct("lo", (F.col("s") + F.col("n") - 1).alias("hi"))).alias("_cl_gone")), "line-chunks-gone")

    gone_lines = F.array_distinct(F.flatten(F.transform("_cl_gone", lambda g: F.sequence(g["lo"], g["hi"]))))
    rest = _bound(F.split(text, "\n"), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(ls)), gone_lines), lambda i: F.get(ls, i - 1)), "\n"))
    left = F.when(F.col("_cl_gone").isNull(), text).otherwise(rest)
    removed = F.when(F.col("_cl_gone").isNull(), 0).otherwise(F.size(gone_lines))
    n_lines = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    own = lambda x: text.alias(x) if x == text_col else F.col("_cl_row")[f"_{x}"].alias(x)
    kept = held.where("_cl_w IS NULL").select(*map(own, columns), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed_lines"))
    cut = asked.join(gone, KEY, "left").select(*[left.alias(x) if x == text_col else own(x) for x in columns], n_lines.alias("n_lines"), removed.cast("long").alias("n_removed_lines"))
    return kept.unionByName(cut)
