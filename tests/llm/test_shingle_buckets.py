"""Buckets of equal nodes, and the texts read for them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tests.helpers import rows

from seqtrail.functions.storage import CLEANUP_CONF, cut
from seqtrail.llm import shingle_join


def test_buckets_of_the_same_nodes_are_searched_once(spark):
    sets = {1: [7, 8], 2: [7, 8], 3: [7, 8, 9], 4: [8, 9], 5: [7, -8], 6: [7, 8, 8]}
    frame = spark.createDataFrame([(k, n, min(found)) for k, found in sets.items() for n in found], "key long, node long, first long")
    got = shingle_join._single(frame)
    assert sorted({r[0] for r in rows(got, "key")}) == [1, 3, 4, 5, 6]
    assert rows(got.filter("key = 3"), "node", "first") == [(7, 7), (8, 7), (9, 7)]


def test_bitmap_holds_every_wanted_digest(spark):
    digests = [0, 1, -1, 5, 32767, 32768, 32769, -(2**63), 2**63 - 1, shingle_join.PLACES - 1]
    bits = shingle_join._bitmap(spark.createDataFrame([(d,) for d in digests], "digest long"))
    held = lambda d: bool(bits[(d % shingle_join.PLACES) >> 3] >> (d & 7) & 1)
    assert len(bits) * 8 == shingle_join.PLACES
    assert all(held(d) for d in digests) and not held(2) and not held(40000)


def test_setting_is_as_before_after_a_table_is_stored(spark):
    before = spark.conf.get(CLEANUP_CONF, None)
    stored = cut(spark.range(100).repartition("id"), free_shuffles=True)
    assert stored.count() == 100 and spark.conf.get(CLEANUP_CONF, None) == before


def test_sketches_bound_the_overlap_of_sets_of_different_slots():
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 3, 63, 70, 120, 129, 300, 510, 515, 2000, 20000):
        whole = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets += [np.unique(whole), np.unique(whole[n // 8 :]), np.unique(np.concatenate((whole[n // 2 :], rng.integers(0, 2**64, n // 2, dtype=np.uint64))))]
    size = np.array([len(s) for s in sets])
    sketches = shingle_join.Sketches(pa.array([shingle_join.sketch(s) for s in sets], pa.binary()))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if size[i] and 100 * min(size[i], size[j]) >= 80 * max(size[i], size[j])]
    x, y = np.array(pairs).T
    shared = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in pairs])
    may, inside = sketches.within(x, y, size[x], size[y], np.minimum(size[x], size[y]))
    assert (inside >= shared).all() and may[180 * shared >= 80 * (size[x] + size[y])].all()
    # Sets of a hundred and more that share half of each are left out by the sketch alone.
    assert not may[(size[x] >= 100) & (3 * shared <= 2 * np.minimum(size[x], size[y]))].any()


def test_points_of_any_width_are_read_back():
    points = np.array([[0] * 64, [255] * 64, [256] * 64, [70000] + [1] * 63], np.int32)
    assert (shingle_join._points(pa.array([shingle_join.packed(p) for p in points], pa.binary())) == points).all()


def test_search_leaves_out_texts_that_share_half(spark):
    """Texts with a common half are in one bucket each, but no pair of them is handed on."""
    rng = np.random.default_rng(7)
    common = [f"c{i}" for i in range(130)]
    texts = [" ".join(common + [f"w{v}" for v in rng.integers(0, 10**9, 130)]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("digest", F.xxhash64("text"))
    buckets = cut(shingle_join._single(shingle_join._buckets(shingle_join._keyed(docs))))
    points = cut(shingle_join._texts(docs, cut(shingle_join._members(docs)), buckets.select("node").distinct()))
    roots = spark.createDataFrame([], "node long, root long")
    assert buckets.select("node").distinct().count() == 60
    assert shingle_join._searched(buckets, roots, points, nearest=False).count() == 0


def test_near_copies_that_share_many_buckets_are_handed_on_once(spark):
    """A pair of a large group is told by one of its buckets; the nearest ones are no more rows than nodes."""
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(50):
        found = [f"c{i}" for i in range(400)]
        for at in rng.integers(0, 400, 4):
            found[at] = f"w{rng.integers(0, 10**9)}"
        texts.append(" ".join(found))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("digest", F.xxhash64("text"))
    buckets = cut(shingle_join._single(shingle_join._buckets(shingle_join._keyed(docs))))
    points = cut(shingle_join._texts(docs, cut(shingle_join._members(docs)), buckets.select("node").distinct()))
    roots = spark.createDataFrame([], "node long, root long")
    sets = {shingle_join.identity(s): s for s in map(shingle_join.set_of, texts)}
    nodes = sorted(sets)
    shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for i, a in enumerate(nodes) for b in nodes[i + 1 :]}
    linked = {p for p, n in shared.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    found = rows(shingle_join._searched(buckets, roots, points, nearest=False), "a", "b")
    assert buckets.count() > 1000 and len(linked) > 1000
    assert linked <= set(found) and len(found) == len(set(found))
    near = rows(shingle_join._searched(buckets, roots, points, nearest=True), "a", "b")
    assert {n for p in near for n in p} == set(nodes) and len(near) <= 3 * len(nodes)


def test_rows_meet_before_by_any_of_many_keys():
    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(0, 9000, n)).tolist() for n in (0, 0, 1, 1, *[40] * 60, *[3000] * 4)]
    met = shingle_join.Met(pa.array(lists, pa.list_(pa.int64())))
    x, y = np.triu_indices(len(lists), 1)
    assert met.before(x, y).tolist() == [bool(set(lists[i]) & set(lists[j])) for i, j in zip(x, y, strict=True)]
    assert met.before(x[:0], y[:0]).tolist() == []
    assert shingle_join.Met(pa.array([[], []], pa.list_(pa.int64()))).before(np.array([0]), np.array([1])).tolist() == [False]
