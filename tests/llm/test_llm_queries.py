"""Registered queries beside their SQL, and the pipeline's stages beside the operators' rules."""

import pytest

import corpus_pipeline
from skyledger.llm.queries import ORACLE, QUERIES
from skyledger.session import run_dir
from tests.compare import differences, duck
from tests.llm.test_ngram_join import wide_grams


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    text, n = differences(spark, duck(sf_dir), QUERIES[name], ORACLE[name], sf_dir)
    assert not text, text
    assert n


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_covers_its_table(spark, sf_dir, name):
    table = "pages" if name.startswith("op4") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    ids = {r[0] for r in QUERIES[name](spark, sf_dir).select(key).collect()}
    assert ids == {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()}


def test_queries_are_registered():
    import __spark_entry__ as contract

    names = set(contract.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert set(ORACLE) <= set(contract.oracle_sql())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    outs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = run_dir(spark, "stage-test")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        outs.append([r.asDict() for r in docs.collect()])
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    quality, lines, near, mixed, packed = outs
    assert all(len(r["text"].encode().split()) >= 50 for r in quality)
    # No run of lines with 50 words stands twice any more, unless inside the first document that has it.
    seen = {}
    for r in sorted(lines, key=lambda r: r["doc_id"]):
        own = [x for x in r["text"].split("\n") if x.split()]
        for x in own:
            if len(x.split()) >= 50:
                assert seen.setdefault(x, r["doc_id"]) == r["doc_id"]
    sets = [wide_grams(r["text"]) for r in near]
    for a in range(len(sets)):
        for b in range(a):
            assert not sets[a] or not sets[b] or 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}


def test_pipeline_on_odd_tables(spark, sf_dir, tmp_path):
    """Null, empty, repeated and very long texts, null ids and sources; and an empty table; only the result stays."""
    import os
    import random

    from skyledger.session import shared_dir
    from tests.llm.helpers import words

    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(120_000))
    texts = [None, "", "few words", long, words(rng, 300, 4000), words(rng, 300, 4000)]
    rows = [(i, t, "en", None if i % 2 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[4], (None, words(rng, 200, 4000), None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, part in (("odd", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        before = set(os.listdir(shared_dir(spark)))
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        left = set(os.listdir(shared_dir(spark))) - before
        assert len(left) == 1 and next(iter(left)).startswith("stage-4")
        assert {r.doc_id for r in got} <= {3, 4, 5, None} if part else not got
        if part:
            assert 3 in {r.doc_id for r in got} and sum(r.doc_id == 3 for r in got) > 40
