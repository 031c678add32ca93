"""The search for nearest texts: exact, and few pairs are added up to the end."""

import math
import random
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
import pytest
from conftest import FOLDER
from helpers import plan, rows
from pyspark.sql import functions as F

from seqtrail.functions import storage, text
from seqtrail.operators import retrieval


def grams(t):
    return Counter(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1))


def brute(texts, queries, k):
    texts = sorted(set(texts))
    df = Counter(g for t in texts for g in grams(t))
    idf = {g: math.log((1 + len(texts)) / (1 + d)) + 1 for g, d in df.items()}

    def vector(t):
        v = {g: c * idf[g] for g, c in grams(t).items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()} if norm else {}

    vectors = {t: vector(t) for t in texts}
    want = {}
    for q in set(queries):
        v = vector(q)
        sims = [(-round(sum(x * vectors[t].get(g, 0.0) for g, x in v.items()), 6), t) for t in texts]
        want[q] = [(t, -s) for s, t in sorted(sims)[:k]]
    return want


def frame(spark, texts, name):
    return spark.createDataFrame([(t,) for t in texts], f"{name} string").repartition(3)


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("rest", [0.0, 0.05, 0.6, 1.0])
def test_search_equals_brute_force_whatever_is_left_to_the_bounds(spark, monkeypatch, k, rest):
    rng = random.Random(k)
    words = ["".join(rng.choices("abcde", k=rng.randint(2, 6))) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(60)] + ["q", "", "aaa"]
    queries = [" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(30)] + texts[:5] + ["zzzz", "", "aaaa"]
    monkeypatch.setattr(retrieval, "REST", rest)
    found = retrieval.nearest(frame(spark, queries, "query"), retrieval.fit_catalogue(frame(spark, texts, "text")), k=k)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.slot):
        got.setdefault(r["query"], []).append((r.match, r.similarity))
    want = brute(texts, queries, k)
    assert set(got) == set(want)
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)
        assert [t for t, _ in got[q]] == [t for t, _ in want[q]], q


def test_few_pairs_are_added_up_to_the_end(spark):
    known = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select(text.normalise(F.col("text")).alias("text"))
    asked = spark.read.parquet(f"{FOLDER}/conversations.parquet").select(text.normalise(F.col("text")).alias("query"))
    catalogue = retrieval.fit_catalogue(known)
    wanted = retrieval.with_ids(asked, "query")
    found = retrieval.search(wanted, catalogue, 1)
    names = {r.id: r.text for r in catalogue.texts.select("id", "text").collect()}
    sharing = sum(len(grams(q.query).keys() & grams(t).keys()) > 0 for q in wanted.collect() for t in names.values())
    open_pairs = found.plans.filter("not safe").count() * len(names)
    assert found.survivors().count() + open_pairs < 0.1 * sharing


def test_filling_joins_no_ranks(spark):
    catalogue = retrieval.fit_catalogue(frame(spark, ["aaa", "bbb", "ccc", "ddd"], "text"))
    found = retrieval.nearest(frame(spark, ["zzz"] * 50 + ["bbb", None], "query"), catalogue, k=3)
    assert rows(found, "query", "slot", "match") == [
        ("bbb", 0, "bbb"), ("bbb", 1, "aaa"), ("bbb", 2, "ccc"), ("zzz", 0, "aaa"), ("zzz", 1, "bbb"), ("zzz", 2, "ccc"),
    ]
    assert "rank" not in plan(found).replace("_rank", "")


def test_grams_of_long_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab 𝒳é", k=n)) for n in (0, 1, 2, 3, 5, 63, 64, 65, 66, 67, 68, 69, 128, 129, 1000)]
    found = frame(spark, texts, "t").select("t", text.char_ngrams(F.col("t")).alias("g")).collect()
    assert all(Counter(r.g) == grams(r.t) for r in found) and len(found) == len(texts)


def test_empty_catalogue_and_no_queries(spark):
    empty = spark.createDataFrame([], "text string")
    assert retrieval.nearest(frame(spark, ["a"], "query"), retrieval.fit_catalogue(empty), k=2).count() == 0
    none = spark.createDataFrame([], "query string")
    assert retrieval.nearest(none, retrieval.fit_catalogue(frame(spark, ["abc"], "text")), k=2).count() == 0


@pytest.mark.parametrize("tile_rows", [40, 10**6])
def test_tiles_hand_on_the_best_of_each_block_alone(spark, tile_rows):
    rng = random.Random(3)
    texts = sorted({"".join(rng.choices("abc", k=rng.randint(4, 12))) for _ in range(40)})
    queries = sorted({"".join(rng.choices("abc", k=rng.randint(4, 12))) for _ in range(25)})
    catalogue = retrieval.fit_catalogue(frame(spark, texts, "text"))
    wanted = retrieval.with_ids(frame(spark, queries, "query"), "query")
    vectors = retrieval.unit_vectors(retrieval.gram_counts(wanted, "query", "id"), catalogue.idf, "id").withColumnRenamed("id", "query")
    named = catalogue.texts.select(F.col("id").alias("match"), "text")
    tiled = retrieval.best_of_tiles(vectors, catalogue, 2, tile_rows=tile_rows)
    assert "_rank" not in plan(tiled) and tiled.count() < len(queries) * len(texts) * (1 if tile_rows == 40 else 0.2)
    names = {r.id: r.query for r in wanted.collect()}
    got = {}
    for r in tiled.join(named, "match").collect():
        got.setdefault(names[r["query"]], []).append((-r.similarity, r.text))
    for q, want in brute(texts, queries, 2).items():
        want = [(t, s) for t, s in want if s > 0]
        assert [(t, pytest.approx(-s, abs=2e-6)) for s, t in sorted(got.get(q, []))[: len(want)]] == want


def test_nearest_stores_and_shuffles_no_row_per_gram(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcd ", k=200)) for _ in range(10)]
    queries = ["".join(rng.choices("abcd ", k=400)) for _ in range(30)]
    catalogue = retrieval.fit_catalogue(frame(spark, texts, "text"))
    stored = []

    def cut(table, **options):
        stored.append(storage.cut(table, **options))
        return stored[-1]

    monkeypatch.setattr(retrieval, "cut", cut)
    found = retrieval.nearest(frame(spark, queries * 2, "query"), catalogue, k=2)
    assert [(t.columns, t.count()) for t in stored] == [(["query"], len(queries))]
    assert "hashpartitioning" not in plan(found) and "Group" not in plan(found) and "gram" not in plan(found)
    assert {(r["query"], r.slot): r.match for r in found.collect()} == {
        (q, i): t for q, best in brute(texts, queries, 2).items() for i, (t, _) in enumerate(best)
    }


@pytest.mark.parametrize("k", [1, 4])
def test_blocks_of_the_catalogue_met_one_by_one_equal_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(retrieval, "PORTION", 50)
    rng = random.Random(10 + k)
    words = ["".join(rng.choices("abcé𝒳", k=rng.randint(2, 6))) for _ in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(40)] + ["q", "", "aaa"]
    queries = [" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(25)] + texts[:5] + ["zzzz", "", "aaaa", "日本語"]
    catalogue = retrieval.fit_catalogue(frame(spark, texts, "text"))
    folder = Path(urlparse(storage.ensure_checkpoint_dir(spark)).path)
    before = len([*folder.iterdir()])
    found = retrieval.nearest(frame(spark, queries, "query"), catalogue, k=k, tile_rows=400)
    # The queries, the catalogue's rows by block and the last block but one; what earlier blocks found is deleted.
    assert catalogue.vectors.count() > 3 * 400 and len([*folder.iterdir()]) == before + 3
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.slot):
        got.setdefault(r["query"], []).append((r.match, r.similarity))
    want = brute(texts, queries, k)
    assert set(got) == set(want)
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)
        assert [t for t, _ in got[q]] == [t for t, _ in want[q]], q


@pytest.mark.parametrize("table", [0, 10**6])
@pytest.mark.parametrize("portion", [3, 10**5])
def test_grams_of_a_block_are_counted_in_texts(monkeypatch, table, portion):
    monkeypatch.setattr(retrieval, "TABLE", table)
    monkeypatch.setattr(retrieval, "PORTION", portion)
    rng = random.Random(6)
    known = sorted(set().union(*(grams("".join(rng.choices("abc\U0001d4b3é", k=30))) for _ in range(4))) | {"日本語"})
    held = pa.table({"id": pa.array([7] * len(known)), "gram": known, "w": [1.0] * len(known), "idf": [1.0] * len(known), "first": [0] * len(known)})
    texts = ["".join(rng.choices("abc\U0001d4b3éx", k=n)) for n in (0, 2, 3, 4, 5, 80)] + ["日本語日本語", "", "aaaaaaaaaaaa"]
    block = retrieval.Block(held, pa.table({"id": [7], "text": ["t"]}), 0, None)
    got = [{} for _ in texts]
    for row, gram, tf in zip(*block.counts(pa.array(texts)), strict=True):
        got[row][block.grams[int(gram)].as_py()] = tf
    assert got == [{g: n for g, n in grams(t).items() if g in known} for t in texts]
    three = retrieval.Block(held.filter(pa.array([len(g) == 3 for g in known])), pa.table({"id": [7], "text": ["t"]}), 0, None)
    assert sum(three.counts(pa.array(texts))[2]) == sum(n for t in texts for g, n in grams(t).items() if g in known and len(g) == 3)
