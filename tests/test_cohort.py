import random
from collections import Counter

import pytest
from helpers import plan, rows

from seqtrail.functions.timing import HOUR, MINUTE, SECOND
from seqtrail.operators import cohort, split
from pyspark.sql import functions as F

W = 30 * MINUTE
T0 = 1_704_067_200_000_000 + 10 * HOUR


def orders_of(spark, data):
    return spark.createDataFrame(data, "idx long, user_id long, order_us long, prov_type string")


def log_of(spark, data):
    return spark.createDataFrame(data, "event_id long, user_id long, us long, metric string, action string")


def test_window_is_half_open(spark):
    orders = orders_of(spark, [(1, 7, T0, "APP")])
    edges = [T0 - W - 1, T0 - W, T0 - W + 1, T0 - 1, T0, T0 + 1]
    log = log_of(spark, [(i, 7, us, "m", "a") for i, us in enumerate(edges)] + [(99, 8, T0 - 1, "m", "a")])
    for block in (1, 3, 4, 50):
        found = cohort.case_windows(orders, log, look_back=W, block_rows=block)
        assert rows(found, "event_id") == [(1,), (2,), (3,)]


def anchors_of(spark, orders, log):
    found = cohort.control_anchors(
        orders_of(spark, orders), log_of(spark, log), anchor_metric="order", look_back=W
    )
    return rows(found, "idx", "anchor_id", "has_rows")


def test_anchor_must_precede_the_buffer(spark):
    edge = T0 - 60 * MINUTE
    log = [(i, 7, us, "order", "a") for i, us in enumerate([edge - 1, edge, edge + 1])]
    log.append((9, 7, edge - 10, "view", "a"))
    assert anchors_of(spark, [(1, 7, T0, "APP")], log) == [(1, 0, True)]


def test_anchor_near_another_order_is_dropped(spark):
    at = T0 - 5 * HOUR
    log = [(0, 7, at, "order", "a"), (1, 7, at - 10 * MINUTE, "view", "a")]
    for gap, kept in ((60 * SECOND, []), (60 * SECOND + 1, [(1, 0, True)])):
        orders = [(1, 7, T0, "APP"), (2, 7, at + gap, "APP"), (3, 8, at, "APP")]
        found = [r for r in anchors_of(spark, orders, log) if r[0] == 1]
        assert found == kept


def test_anchor_near_only_its_own_order_is_kept(spark):
    log = [(0, 7, T0 - 30 * SECOND, "order", "a"), (1, 7, T0 - 40 * SECOND, "view", "a")]
    found = cohort.control_anchors(
        orders_of(spark, [(1, 7, T0, "APP")]), log_of(spark, log), anchor_metric="order", look_back=W, buffer=0
    )
    assert rows(found, "anchor_id") == [(0,)]


def test_numbering_skips_empty_windows(spark):
    a, b, c = T0 - 9 * HOUR, T0 - 6 * HOUR, T0 - 3 * HOUR
    log = [
        (0, 7, a, "order", "x"),
        (1, 7, a - W, "view", "x"),  # just inside the first window
        (2, 7, b, "order", "x"),
        (3, 7, b - W - 1, "view", "x"),  # just outside the second
        (4, 7, c, "order", "x"),
        (5, 7, c - 1, "view", "x"),
    ]
    orders, events = orders_of(spark, [(1, 7, T0, "APP")]), log_of(spark, log)
    windows, controls = cohort.extract_cohort(orders, events, anchor_metric="order", look_back=W)
    assert rows(controls, "control_idx", "anchor_id") == [(1, 0), (2, 4)]
    assert rows(windows.filter("kind = 'control'"), "control_idx", "event_id") == [(1, 1), (2, 5)]
    assert rows(cohort.recent_controls(controls, 1), "control_idx") == [(2,)]


def test_overlapping_controls_repeat_rows(spark):
    a, b = T0 - 3 * HOUR, T0 - 3 * HOUR + 5 * MINUTE
    log = [(0, 7, a, "order", "x"), (1, 7, b, "order", "x"), (2, 7, a - MINUTE, "view", "x")]
    windows, _ = cohort.extract_cohort(
        orders_of(spark, [(1, 7, T0, "APP")]), log_of(spark, log), anchor_metric="order", look_back=W
    )
    assert rows(windows, "control_idx", "event_id") == [(1, 2), (2, 0), (2, 2)]


def test_sampling_keeps_n_and_numbers_in_time(spark):
    log = [(i, 7, T0 - (20 - i) * HOUR, "order", "x") for i in range(15)]
    log += [(100 + i, 7, T0 - (20 - i) * HOUR - 1, "view", "x") for i in range(15)]
    anchors = cohort.control_anchors(
        orders_of(spark, [(1, 7, T0, "APP")]), log_of(spark, log), anchor_metric="order", look_back=W
    )
    sampled = cohort.sample_anchors(anchors, 4, seed=1)
    numbered = [r for r in rows(cohort.number_controls(sampled), "control_idx", "anchor_us")]
    assert [r[0] for r in numbered] == [1, 2, 3, 4]
    assert [r[1] for r in numbered] == sorted(r[1] for r in numbered)


def test_filters(spark):
    orders = orders_of(spark, [(1, 7, T0, "APP"), (2, 7, T0, "Attending"), (3, 8, T0, "APP")])
    assert cohort.keep_provider_type(orders, "All").count() == 3
    assert rows(cohort.keep_provider_type(orders, "APP"), "idx") == [(1,), (3,)]
    assert rows(cohort.exclude_orders(orders, [1]), "idx") == [(2,), (3,)]


def test_split_is_exact_disjoint_and_stable(spark):
    ids = spark.range(103).withColumnRenamed("id", "idx")
    parts = split.fixed_split(ids, seed=5)
    counts = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert counts == {"train": 72, "val": 10, "test": 21}
    assert parts.select("idx").distinct().count() == 103
    again = split.fixed_split(ids.repartition(17), seed=5)
    assert parts.exceptAll(again).isEmpty()


def test_grouped_split_keeps_groups_whole(spark):
    ids = spark.range(100).select(F.col("id").alias("idx"), (F.col("id") % 9).alias("user_id"))
    parts = split.fixed_split(ids, seed=5, group_cols=["user_id"]).join(ids, "idx")
    assert parts.groupBy("user_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()


def test_window_join_has_no_cross_product(spark):
    orders = orders_of(spark, [(1, 7, T0, "APP")])
    log = log_of(spark, [(1, 7, T0 - 1, "m", "a")])
    text = plan(cohort.case_windows(orders, log, look_back=W))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "SinglePartition" not in text


def test_busy_instants_are_split_and_nothing_is_salted(spark):
    rng = random.Random(6)
    times = [T0 - 10 * MINUTE] * 700 + [T0 - rng.randint(0, 3 * W) for _ in range(400)]
    log = log_of(spark, [(i, 7 if i % 10 else 8, us, "m", "a") for i, us in enumerate(times)]).repartition(5)
    orders = [(i, rng.choice([7, 8, 9]), T0 - rng.randint(-W, 2 * W), "APP") for i in range(40)]
    orders += [(100, 7, T0 - 10 * MINUTE, "APP"), (101, 7, T0 - 10 * MINUTE + 1, "APP"), (102, 7, T0 - 10 * MINUTE, "APP")]
    found = cohort.case_windows(orders_of(spark, orders), log, look_back=W, block_rows=16)
    want = [
        (idx, e) for idx, user, end, _ in orders for e, us in enumerate(times) if user == (7 if e % 10 else 8) and end - W <= us < end
    ]
    assert rows(found, "idx", "event_id") == sorted(want, key=repr)
    ends = orders_of(spark, orders).select("user_id", "idx", F.col("order_us").alias("end_us"))
    placed, held = cohort.sweep(ends, log, W)
    per_block = placed.groupBy("user_id", F.floor(F.col("_at") / 16)).count().agg(F.max("count"), F.sum("count")).first()
    assert tuple(per_block) == (16, len(times))
    assert rows(held.select("idx", (F.col("_high") - F.col("_low")).alias("n")), "idx", "n") == sorted(Counter(i for i, _ in want).items(), key=repr)


def test_existence_of_rows_needs_no_rows(spark):
    rng = random.Random(7)
    log = [(i, rng.choice([7, 8]), T0 - rng.randint(0, 40 * W), "m", "a") for i in range(60)]
    orders = [(i, rng.choice([7, 8, 9]), T0 - rng.randint(-2 * W, 42 * W), "APP") for i in range(80)]
    want = [(idx,) for idx, user, end, _ in orders if any(u == user and end - W <= us < end for _, u, us, *_ in log)]
    found = cohort.orders_with_rows(orders_of(spark, orders), log_of(spark, log), look_back=W)
    assert rows(found, "idx") == sorted(want, key=repr) and 0 < len(want) < 80


def busy_users(spark):
    """Two users with many anchors, ties among them, and orders all along."""
    rng = random.Random(3)
    events, index, at = [], [], 0
    for user, n in ((1, 900), (2, 60), (3, 1)):
        for _ in range(n):
            us = rng.randrange(0, 400) * MINUTE
            events.append((at, user, us, "x" if rng.random() < 0.7 else "a", "act"))
            at += 1
        index += [(100 * user + k, user, rng.randrange(0, 420) * MINUTE + rng.choice([0, 1]), "APP") for k in range(12)]
    return orders_of(spark, index), log_of(spark, events)


@pytest.mark.parametrize(("buffer", "tolerance"), [(60 * MINUTE, MINUTE), (MINUTE, 3 * MINUTE)])
def test_drawn_and_latest_controls_equal_those_of_all_pairs(spark, buffer, tolerance):
    orders, log = busy_users(spark)
    matching = {"anchor_metric": "a", "look_back": 2 * MINUTE, "buffer": buffer, "tolerance": tolerance}
    pairs = cohort.control_anchors(orders, log, **matching).cache()
    columns = ["idx", "user_id", "anchor_id", "anchor_us", "has_rows"]
    for n, block in ((1, 4), (3, 8), (3, 4096), (500, 16)):
        drawn = cohort.sampled_anchors(orders, log, n, seed=5, block_rows=block, **matching)
        assert rows(drawn, *columns) == rows(cohort.sample_anchors(pairs, n, seed=5), *columns)
    numbered = cohort.number_controls(pairs).cache()
    columns = ["idx", "user_id", "anchor_id", "anchor_us", "control_idx"]
    for n in (1, 3, 500):
        latest = cohort.latest_controls(orders, log, n, **matching)
        assert rows(latest, *columns) == rows(cohort.recent_controls(numbered, n), *columns)


def test_few_anchors_can_be_drawn(spark):
    anchors = spark.range(20_000).select(
        F.lit(1).alias("user_id"), F.col("id").alias("anchor_id"), F.col("id").alias("anchor_us"), F.lit(True).alias("has_rows")
    ).withColumn("_draw", cohort.anchor_draw(1))
    kept = cohort.drawable(anchors, 3, block_rows=64)
    # About 3 (1 + ln(20000 / 3)) = 29 are to be expected.
    assert 10 < kept.count() < 80
    assert cohort.drawable(anchors.limit(0), 3).count() == 0


def test_orders_that_share_anchors_draw_for_themselves(spark):
    log = [(i, 7, T0 - (60 - i) * HOUR, "order", "x") for i in range(40)]
    log += [(100 + i, 7, T0 - (60 - i) * HOUR - 1, "view", "x") for i in range(40)]
    orders, events = orders_of(spark, [(i, 7, T0 + i, "APP") for i in range(12)]), log_of(spark, log)
    _, controls = cohort.extract_cohort(orders, events, anchor_metric="order", look_back=W, sample_n=3, seed=1)
    drawn = controls.groupBy("idx").agg(F.array_sort(F.collect_list("anchor_id")).alias("ids")).collect()
    assert len(drawn) == 12 and {len(r.ids) for r in drawn} == {3}
    # Chances of two equal samples of 3 of 40 among 12 are below 0.7%; shared draws would all be equal.
    assert len({tuple(r.ids) for r in drawn}) == 12
