"""The registered queries on the given tables: against SQL, brute force and each other."""

import hashlib

import brute
import duckdb
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from seqtrail.llm import bpe, langid, line_crf

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


@pytest.fixture(scope="module")
def result(spark):
    found = {}

    def get(name):
        if name not in found:
            found[name] = __spark_entry__.queries()[name](spark, FOLDER).collect()
        return found[name]

    return get


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_query_equals_sql(result, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations", "benchmark"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    expected = con.sql(__spark_entry__.oracle_sql()[name])
    rows = result(name)
    assert set(rows[0].__fields__) == set(expected.columns)
    assert sorted([tuple(r[c] for c in expected.columns) for r in rows], key=repr) == sorted(expected.fetchall(), key=repr)


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_shingle_join(result, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in result("op2_shingle_join")}
    assert got == brute.components(texts)


def test_quality_rules(result, texts):
    for r in result("op3_quality_rules"):
        expected = brute.quality_counts(texts[r.doc_id])
        assert {k: r[k] for k in expected} == expected
        assert not (r.base_failed and r.kept)


def test_merkle(result, texts):
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in result("op4_merkle")} == brute.edited(texts)


def test_bpe(result, texts):
    import numpy as np
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    one = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = result("op7_bpe")
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(one.encode_ordinary(texts[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_packing_counts_bpe_tokens(result, texts):
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    one = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens, bins = {}, {}
    for r in result("op6_packing"):
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        if r.sequence_id is not None:
            bins.setdefault((r.sequence_id, r.capacity), []).append(r.n_tokens)
    assert tokens == {i: len(one.encode_ordinary(t or "")) for i, t in texts.items()}
    assert all(sum(lengths) <= capacity for (_, capacity), lengths in bins.items())


def test_training_order(result):
    rows = result("op8_training_order")
    slots = {r.slot for r in rows}
    assert slots == set(range(len(slots)))


def test_pipeline_equals_its_stages_by_brute_force(spark, result, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    from pyspark.sql import functions as F

    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"), 4, 2)))
    near = {r.doc_id for r in langid.predict(docs, model).filter("not rejected").collect()}
    left = docs.filter(F.col("doc_id").isin(*near))
    crf = line_crf.fit(left, labels.filter(~langid.held_out(F.col("doc_id"), 5, 0)))
    good = {r.doc_id for r in line_crf.score(left, crf).filter("predicted = 1").collect()}
    kept = {i for i, (_, root) in brute.components({i: texts[i] for i in good}).items() if i == root}
    rows = result("pipeline")
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    one = bpe.encoding(public_tokenizers.PATTERN, frozenset(ranks.items()))
    assert tokens == {i: len(one.encode_ordinary(texts[i])) for i in kept}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns, name


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_one_row_of_each_component_stays(spark):
    first, second, third = (" ".join(f"{c}{i}" for i in range(90)) for c in "abc")
    rows = [
        (1, first), (1, second), (2, first + " x"), (1, first), (None, second), (9, second + " x"),
        (None, third), (None, third + " x"), (None, third), (None, ""), (None, ""), (None, None), (4, ""), (5, ""), (6, "alone"), (7, "alone"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _row", "2 AS Component_ID", "3 AS __ROW")
    assert corpus_pipeline.deduplicated(spark, docs, FOLDER).columns == docs.columns
    docs = docs.select("doc_id", "text")
    got = [tuple(r) for r in corpus_pipeline.deduplicated(spark, docs, FOLDER).collect()]
    thirds = [r for r in got if r[1] and r[1].startswith("c0")]
    assert len(thirds) == 1 and thirds[0][0] is None
    rest = [(1, first), (1, second), (None, ""), (None, ""), (None, None), (4, ""), (5, ""), (6, "alone")]
    assert sorted([r for r in got if r not in thirds], key=repr) == sorted(rest, key=repr)
