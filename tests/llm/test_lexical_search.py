"""Lexical search against a plain version that scores everything, and its defined edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqtrail.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k=20):
    """Sorted (item_id, rank, doc_id, score) rows."""
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, counts, n in held:
            m = 75 + 25 * n * n_docs // total
            score = 0
            for t in terms(text):
                if tf := counts[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def result(spark, docs, items, k=20, parts=3):
    frame = spark.createDataFrame(docs, DOCS).repartition(parts)
    found = search.search(frame, spark.createDataFrame(items, ITEMS), k)
    return sorted([tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()], key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "ünï", "Über-Maß", "A1b2", "日本", "x\x7fy", "a_b", "É"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 10, 40, 200])))) for i in range(400)]
    docs += [(500 + i, docs[7][1]) for i in range(50)]  # copies: ties at every rank
    docs += [(600, None), (601, ""), (602, " ,.;"), (603, " ".join(rng.choices(words, k=20_000))), (None, docs[7][1]), (None, docs[9][1]), (12, docs[12][1])]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "unheard of"), (23, "w0 w0 w0 W1"), (None, "w3 w4"), (24, docs[7][1]), (3, items[3][1])]
    return docs, items


def test_search_equals_scoring_everything(spark, corpus):
    assert result(spark, *corpus) == plain(*corpus)


def test_portions_partitions_and_blocks_do_not_matter(spark, corpus, monkeypatch):
    docs, items = corpus
    want = plain(docs, items, 5)
    assert result(spark, docs, items, 5, parts=1) == want
    monkeypatch.setattr(search, "BLOCK_TERMS", 20)
    assert result(spark, docs, items, 5, parts=7) == want


def test_terms_equal_the_pattern():
    text = "".join(map(chr, range(0x250))) + " Straße ÀB cİd 日本語x1_2"
    assert [t.decode() for t in search.terms_of(text.encode())] == terms(text)


def portion_of(docs, vocabulary):
    counts = [Counter(terms(t)) for _, t in docs]
    total = sum(sum(c.values()) for c in counts)
    df = Counter(vocabulary[t] for c in counts for t in c)
    weight = search.weights(df, len(docs), len(vocabulary))
    flat = [(vocabulary[t], tf) for c in counts for t, tf in c.items()]
    ends = np.cumsum([0] + [len(c) for c in counts])
    n = np.array([sum(c.values()) for c in counts])
    return search.Portion(
        pa.array([i for i, _ in docs], pa.int64()), n, ends, np.array([c for c, _ in flat], np.int32), np.array([tf for _, tf in flat]), weight, len(docs), total
    )


def test_reading_stops_early_and_never_too_early():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(5, 60)))) for i in range(3000)]
    # Documents with a rare pair of words: the rest cannot beat them.
    docs[:25] = [(i, "rare pair " + " ".join(rng.choices(words, k=3))) for i in range(25)]
    vocabulary = {t: i for i, t in enumerate(["rare", "pair", *words])}
    portion = portion_of(docs, vocabulary)
    slots = np.full(len(vocabulary), -1, np.int64)
    asked = search.Asked(0, np.array([vocabulary[t] for t in ("rare", "pair", "w1", "w2")]), np.array([1, 1, 1, 2]))
    found, scores = portion.search(asked, slots, 10, 0)
    holders = sum(any(t in ("rare", "pair", "w1", "w2") for t in terms(text)) for _, text in docs)
    assert len(found) < holders / 2 and (slots == -1).all()
    best = search.Leaders(10)
    best.add(scores, portion.ids[found], portion.given[found])
    assert sorted((0, r, int(i), int(s)) for r, (i, s) in enumerate(zip(best.ids, best.scores, strict=True), 1)) == sorted(plain(docs, [(0, "rare pair w1 w2 w2")], 10))
    # A floor that nothing here reaches ends the reading at once; an equal one must not.
    assert len(portion.search(asked, slots, 10, int(scores.max()) * 9)[0]) <= 4 * search.FIRST_STEP
    again, values = portion.search(asked, slots, 10, best.floor)
    assert set(again[values >= best.floor]) == set(found[scores >= best.floor])


def test_empty_tables_and_clashing_columns(spark, corpus):
    docs, items = corpus
    assert result(spark, [], items) == result(spark, docs[:5], []) == result(spark, [(1, None)], items) == []
    clash = ["n", "columns", "tf", "item", "score", "rank", "block", "terms"]
    frame = spark.createDataFrame(docs[:40], DOCS).select("*", *[F.lit("x").alias(c) for c in [*clash, "item_id"]])
    asked = spark.createDataFrame(items, ITEMS).select("*", *[F.lit("x").alias(c) for c in [*clash, "doc_id"]])
    found = search.search(frame, asked)
    assert sorted([tuple(r) for r in found.collect()], key=repr) == plain(docs[:40], items)
