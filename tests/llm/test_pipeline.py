"""The pipeline's stages, each on what the one before kept, against SQL and the tokenizers library."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chartloom.llm import common, queries, toxicity

SF = "/root/testdata/sf0.001"


def _run(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(common.stored(stage(spark, out[-1], SF), "test-stage"))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    return _run(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def _sql(docs, name):
    """The rows that the SQL of a query gives for a stage's input."""
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    cursor = con.execute(queries.ORACLES[name])
    return [dict(zip([d[0] for d in cursor.description], r)) for r in cursor.fetchall()]


def test_toxicity(spark, stages):
    raw, clean = stages[:2]
    index = toxicity.fit(raw, spark.read.parquet(f"{SF}/labels.parquet").where(~queries.held_out(5)))
    want = {r.doc_id for r in toxicity.score(raw, index).where("score < 0.5").collect()}
    assert {r.doc_id for r in clean.collect()} == want and 0 < len(want) < raw.count()
    assert clean.schema == raw.schema and clean.exceptAll(raw).count() == 0


def test_line_dedup(stages):
    want = {r["doc_id"]: r["text"] for r in _sql(stages[1], "op2_line_dedup")}
    got = {r.doc_id: r for r in stages[2].collect()}
    assert {i: r.text for i, r in got.items()} == want and any(len(want[r.doc_id]) < len(r.text) for r in stages[1].collect())
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_jaccard_join(stages):
    classes = {}
    for r in _sql(stages[2], "op9_jaccard_join"):
        classes.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(map(min, classes.values())) and any(len(v) > 1 for v in classes.values())
    assert stages[3].exceptAll(stages[2]).count() == 0


def test_decontamination(stages):
    leaky = {r["doc_id"] for r in _sql(stages[3], "op6_contamination")}
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()} - leaky and leaky
    assert stages[4].exceptAll(stages[3]).count() == 0


def test_encoding(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    got = {r.doc_id: r for r in stages[5].collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_equals_the_stages(spark, stages):
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).drop("ids").collect()}
    assert got == {tuple(r) for r in stages[-1].drop("ids").collect()}


def test_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (1, words + " more"), (None, words + " end"), (2, None), (2, None), (3, ""), (None, None), (4, "a\n" * 200_000 + "z"), (5, words.upper()), (6, "one two"), (6, "one two")]
    docs = spark.createDataFrame([(*r, None, "x", None) for r in rows], "doc_id long, text string, lang string, key string, n_chars long")
    out = _run(spark, docs)
    assert [o.count() for o in out[:3]] == [len(rows)] * 3
    kept = {(r.doc_id, r.text) for r in out[3].collect()}
    # one of a class, of the least id; texts without a word all stay
    assert out[3].count() == 7 and {(2, None), (3, ""), (None, None), (6, "one two")} <= kept and len({(1, words), (1, words + " more")} & kept) == 1
    assert out[5].count() == out[4].count() == 7 and out[4].columns == docs.columns
    empty = _run(spark, docs.limit(0))
    assert [o.count() for o in empty] == [0] * 6


def test_clashing_columns(spark):
    names = ["bytes", "ch", "w", "s", "n", "score", "n_lines", "n_removed_lines", "_cl_w", "root", "class_id", "n_links", "ids"]
    docs = spark.createDataFrame([(i, f"text number {i} has some words of its own") for i in range(4)], "doc_id long, text string")
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    try:
        out = _run(spark, docs)
    except Exception as e:  # noqa: BLE001
        pytest.fail(str(e)[:500])
    assert out[4].columns == docs.columns and out[4].count() == 4
