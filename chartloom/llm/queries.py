"""The llm queries: thin calls of the operators with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.sources.session import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == 0


def _file(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.suffixtree import suffix_tree_scores

    return suffix_tree_scores(table(spark, sf_dir, "documents"), depth=3)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.linededup import dedup_line_chunks

    return dedup_line_chunks(table(spark, sf_dir, "documents"), windows=True).select("doc_id", "n_lines", "n_removed_lines", "text")


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.sharding import histogram_shards

    return histogram_shards(table(spark, sf_dir, "documents"), 40)


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.fertility import fertility_verdicts

    return fertility_verdicts(table(spark, sf_dir, "documents"), _file("piece_bpe_32k.model"), _file("byte_bpe_multi_50k.tiktoken"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm import common, warc

    path = common.fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.contamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    index = fit(docs, table(spark, sf_dir, "labels").where(~held_out(5)))
    return score(docs, index).select("doc_id", F.coalesce(held_out(5), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.bpe import encode_documents, vocabulary_bytes

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_bytes())


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.jaccardjoin import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chartloom.llm.suffixdedup import repeated_strings

    return repeated_strings(table(spark, sf_dir, "documents"), length=200, keep="none")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_line_dedup": op2_line_dedup,
    "op3_histogram_shards": op3_histogram_shards,
    "op4_fertility": op4_fertility,
    "op5_warc": op5_warc,
    "op6_contamination": op6_contamination,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
}
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
_FIVE = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))"

ORACLES: dict[str, str] = {
    # lines of passages of two lines and 40 bytes that an earlier text or place has, by windows from and to each line
    "op2_line_dedup": """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l),
        c AS (SELECT doc_id, i, ls[i] AS line, sum(strlen(ls[i])) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM x), d AS (SELECT doc_id, i, b, b - strlen(line) AS a FROM c),
        f AS (SELECT p.doc_id, p.i AS s, greatest(p.i + 1, min(q.i)) AS e FROM d p JOIN d q ON p.doc_id = q.doc_id AND q.i >= p.i AND q.b - p.a >= 40 GROUP BY p.doc_id, p.i),
        g AS (SELECT q.doc_id, least(q.i - 1, max(p.i)) AS s, q.i AS e FROM d p JOIN d q ON p.doc_id = q.doc_id AND q.i >= p.i AND q.b - p.a >= 40 GROUP BY q.doc_id, q.i),
        w AS (SELECT DISTINCT doc_id, s, e, array_to_string(ls[s:e], chr(10)) AS t FROM (SELECT * FROM f UNION SELECT * FROM g) JOIN l USING (doc_id) WHERE s >= 1 AND e <= len(ls)),
        h AS (SELECT t, min((doc_id, s)) AS k FROM w GROUP BY t), r AS (SELECT doc_id, CASE WHEN doc_id = k[1] AND s < k[2] + e - s + 1 THEN k[2] + e - s + 1 ELSE s END AS lo, e AS hi FROM w JOIN h USING (t) WHERE (doc_id, s) <> k),
        gone AS (SELECT doc_id, list(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(lo, hi + 1)) AS i FROM r) GROUP BY 1)
        SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines, CAST(coalesce(len(n), 0) AS BIGINT) AS n_removed_lines,
          CASE WHEN n IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(n, i)), lambda i: ls[i]), chr(10)) END AS text FROM l LEFT JOIN gone USING (doc_id)""",
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
        h AS (SELECT page_id, b, max(page_id) OVER (PARTITION BY b) AS head, sha1(b) || '0' AS d FROM p)
        SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes,
          array_to_string(list_transform(range(32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((((instr('0123456789abcdef', substring(d, (5 * k) // 4 + 1, 1)) - 1) * 16
            + instr('0123456789abcdef', substring(d, (5 * k) // 4 + 2, 1)) - 1)) >> CAST(3 - (5 * k) % 4 AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
          CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to, TRUE AS verified FROM h""",
    # 200-byte strings are compared by MD5 here
    "op10_suffix_dedup": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), k AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
        r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
        s AS (SELECT doc_id, min(i) AS lo, max(i) + 199 AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r) GROUP BY doc_id, g),
        t AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s),
        u AS (SELECT doc_id, CAST(sum(hi - lo + 1) AS BIGINT) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(CASE WHEN lo > before + 1 THEN hex(b[before + 1:lo - 1]) ELSE '' END, '' ORDER BY lo) AS x FROM t JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN x IS NULL THEN b ELSE unhex(x || CASE WHEN last < octet_length(b) THEN hex(b[last + 1:octet_length(b)]) ELSE '' END) END) AS kept_sha256 FROM d LEFT JOIN u USING (doc_id)""",
    "op6_contamination": f"""WITH d AS (SELECT DISTINCT doc_id, unnest({_FIVE}) AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 4),
        q AS (SELECT DISTINCT item_id, unnest({_FIVE}) AS g FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 4), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1)
        SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_item, CAST(count(*) AS DOUBLE) / any_value(n) AS containment
        FROM d JOIN q USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n) - 1e-9""",
    "op9_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 4 THEN {_FIVE} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE k >= 0.8 * (a.n + b.n - k) - 1e-6),
        c AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
        SELECT doc_id, least(doc_id, coalesce((SELECT min(y) FROM c WHERE x = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM e WHERE x = doc_id) AS n_links FROM documents""",
}
