import random

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from seqtrail.functions import ordered
from seqtrail.operators.metrics import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = [("hot", rng.randrange(10**6), i) for i in range(400)]
    data += [(f"k{i % 50}", rng.randrange(10**6), i) for i in range(400, 700)]
    return spark.createDataFrame(data, "k string, us long, id long").repartition(5)


def expected(skewed):
    groups = {}
    for k, us, i in (tuple(r) for r in skewed.collect()):
        groups.setdefault(k, []).append((us, i))
    out = []
    for k, items in groups.items():
        items.sort()
        for pos, (us, i) in enumerate(items):
            before = items[pos - 1][0] if pos else None
            after = items[pos + 1][0] if pos + 1 < len(items) else None
            out.append((k, i, pos, before, after))
    return sorted(out, key=repr)


@pytest.fixture(params=["1", "2", "5", "40"])
def slices(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_order_rows_does_not_depend_on_the_slices(skewed, slices):
    got = ordered.order_rows(skewed, ["k"], ["us", "id"], previous={"p": "us"}, following={"n": "us"})
    assert rows(got, "k", "id", "pos", "p", "n") == expected(skewed)


def test_null_keys_are_a_group(spark, slices):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(30)], "k string, id long")
    got = ordered.order_rows(df, ["k"], ["id"], previous={"p": "id"})
    assert all(r["pos"] == r["id"] and r["p"] == (r["id"] - 1 if r["id"] else None) for r in got.collect())


def test_running_total(skewed, slices):
    got = ordered.running_total(skewed, ["k"], ["us", "id"], F.col("id"), "total")
    totals = {}
    for k, _, i, total in sorted(rows(got, "k", "us", "id", "total"), key=lambda r: (r[0], r[1], r[2])):
        totals[k] = totals.get(k, 0) + i
        assert total == totals[k]


def test_global_order_is_not_one_partition(skewed):
    got = ordered.order_rows(skewed, [], ["us", "id"])
    assert [r[0] for r in sorted(rows(got, "pos"))] == list(range(700))
    in_order = [r["pos"] for r in got.orderBy("us", "id").collect()]
    assert in_order == list(range(700))


def test_rank_by_hash(skewed):
    got = ordered.rank_by_hash(skewed, "id", F.md5(F.col("id").cast("string")), "r").collect()
    by_hash = sorted(got, key=lambda r: r["r"])
    assert [r["r"] for r in by_hash] == list(range(700))
    import hashlib

    texts = [hashlib.md5(str(r["id"]).encode()).hexdigest() for r in by_hash]
    assert texts == sorted(texts)


def test_lookup_equals_join(spark, skewed):
    small = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    got = ordered.lookup(skewed, small, ["k"])
    want = skewed.join(small, "k", "left")
    assert rows(got, "k", "id", "v") == rows(want, "k", "id", "v")


def test_exact_quantiles(spark):
    import numpy as np

    values = [1.0, 1.0, 2.5, 7.0, 7.0, 9.0, 11.5]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 4.0)], "g string, v double")
    got = {(r["g"], r["probability"]): r["value"] for r in exact_quantiles(df, "v", [0.25, 0.5, 0.75, 1.0], ["g"]).collect()}
    for p in (0.25, 0.5, 0.75, 1.0):
        assert got[("a", p)] == pytest.approx(np.percentile(values, p * 100))
        assert got[("b", p)] == 4.0


def test_quantiles_without_groups(spark):
    df = spark.range(101).withColumn("v", F.col("id").cast("double"))
    got = exact_quantiles(df, "v", [0.5, 0.333])
    assert rows(got, "probability", "value")[1][1] == 50.0


def test_partition_count_does_not_matter(spark, skewed):
    want = expected(skewed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = ordered.order_rows(skewed, ["k"], ["us", "id"], previous={"p": "us"}, following={"n": "us"})
            assert rows(got, "k", "id", "pos", "p", "n") == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_top_k_is_limited_before_the_shuffle(spark, skewed):
    from seqtrail.operators.encode import suffix

    text = plan(suffix(skewed.withColumnRenamed("id", "pos"), ["k"], 5))
    assert text.count("WindowGroupLimit") == 2
