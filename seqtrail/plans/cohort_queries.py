"""Queries over cohorts, windows, splits and order lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtrail.functions.timing import DAY
from seqtrail.operators import cohort, split
from seqtrail.operators.metrics import exact_quantiles
from seqtrail.plans import inputs as I
from seqtrail.plans.registry import query
from seqtrail.plans.sql import LOG, SEED, SPLITS, WINDOWS, r6
from seqtrail.sources.readers import first_rows, log_presence

JAN_1 = 1_704_067_200_000_000  # 2024-01-01 in epoch microseconds
PERIODS = {
    "in_sample": (JAN_1, JAN_1 + 14 * DAY),
    "test1": (JAN_1 + 14 * DAY, JAN_1 + 22 * DAY),
    "test2": (JAN_1 + 22 * DAY, JAN_1 + 30 * DAY),
}
PERIODS_SQL = " ".join(f"when {{c}} >= {a} and {{c}} < {b} then '{n}'" for n, (a, b) in PERIODS.items())
EXCLUDED = [321, 653, 1204]


@query("case_windows", f"with {WINDOWS} select idx, event_id, us, action from cases")
def case_windows(spark, folder):
    orders, log = I.orders_and_log(spark, folder)
    rows = cohort.case_windows(orders, log, look_back=I.LOOK_BACK)
    return rows.select("idx", "event_id", "us", "action")


@query("control_anchors", f"with {WINDOWS} select idx, anchor_id, anchor_us from anchors")
def control_anchors(spark, folder):
    return I.anchors(spark, folder).select("idx", "anchor_id", "anchor_us")


@query(
    "control_numbers",
    f"with {WINDOWS} select idx, control_idx, anchor_id from controls",
)
def control_numbers(spark, folder):
    return I.numbered_controls(spark, folder).select("idx", "control_idx", "anchor_id")


@query("control_windows", f"with {WINDOWS} select idx, control_idx, event_id, us, action from control_rows")
def control_windows(spark, folder):
    _, log = I.orders_and_log(spark, folder)
    rows = cohort.control_windows(I.numbered_controls(spark, folder), log, look_back=I.LOOK_BACK)
    return rows.select("idx", "control_idx", "event_id", "us", "action")


@query(
    "all_windows",
    f"with {WINDOWS} select kind, control_idx, count(*) as n_rows, count(distinct idx) as n_orders,"
    " cast(sum(event_id) as bigint) as id_sum from windows group by kind, control_idx",
)
def all_windows(spark, folder):
    return (
        I.all_windows(spark, folder)
        .groupBy("kind", "control_idx")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.countDistinct("idx").alias("n_orders"),
            F.sum("event_id").alias("id_sum"),
        )
    )


@query(
    "recent_controls",
    f"with {WINDOWS} select idx, control_idx, anchor_id from controls"
    " qualify row_number() over (partition by idx order by control_idx desc) <= 2",
)
def recent_controls(spark, folder):
    orders, log = I.orders_and_log(spark, folder)
    return cohort.latest_controls(orders, log, 2, **I.MATCHING).select("idx", "control_idx", "anchor_id")


@query(
    "sampled_controls",
    f"""with {WINDOWS}, sampled as (
      select * from anchors qualify row_number() over (
        partition by idx order by md5('{SEED}|' || idx || '|' || anchor_id), anchor_id) <= 3)
    select idx, anchor_id, row_number() over (partition by idx order by anchor_us, anchor_id) as control_idx
    from sampled join filled using (idx, user_id, anchor_id, anchor_us)""",
)
def sampled_controls(spark, folder):
    sampled = cohort.sample_anchors(I.anchors(spark, folder), 3, seed=I.SEED, apart=True)
    return cohort.number_controls(sampled).select("idx", "anchor_id", "control_idx")


@query(
    "cohort_report",
    f"""with {WINDOWS}
    select count(*) as n_orders, count(*) filter (found) as n_with_logs,
      count(*) filter (not found) as n_without_logs, count(*) filter (has_case) as n_with_case_rows,
      count(*) filter (n_user > 1) as n_of_repeat_users, cast(sum(n_controls) as bigint) as n_controls
    from (select o.idx, o.user_id in (select user_id from ev) as found,
      o.idx in (select idx from cases) as has_case, count(*) over (partition by o.user_id) as n_user,
      (select count(*) from controls c where c.idx = o.idx) as n_controls from ord o)""",
)
def cohort_report(spark, folder):
    orders, log = I.orders_and_log(spark, folder)
    cases = cohort.orders_with_rows(orders, log, look_back=I.LOOK_BACK)
    return cohort.cohort_report(orders, log, cases, I.numbered_controls(spark, folder))


@query(
    "log_presence",
    """select o_orderkey as idx, coalesce(n, 0) as n_logs, n is not null as found
    from orders left join (select user_id, count(*) as n from events group by user_id) e
      on e.user_id = o_custkey""",
)
def found_logs(spark, folder):
    orders = I.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("user_id")
    )
    return log_presence(orders, I.table(spark, folder, "events"), "user_id").drop("user_id")


@query(
    "oos_cohort",
    f"with {LOG} select idx, period from (select idx, case {PERIODS_SQL.format(c='order_us')} end as period"
    " from ord) where period is not null",
)
def oos_cohort(spark, folder):
    orders, _ = I.orders_and_log(spark, folder)
    return split.period_orders(orders, PERIODS).select("idx", "period")


@query(
    "provider_filter",
    f"with {LOG} select idx, user_id from ord where prov_type = 'APP'"
    f" and idx not in ({', '.join(map(str, EXCLUDED))})",
)
def provider_filter(spark, folder):
    orders, _ = I.orders_and_log(spark, folder)
    kept = cohort.exclude_orders(cohort.keep_provider_type(orders, "APP"), EXCLUDED)
    return kept.select("idx", "user_id")


@query("paired_orders", f"with {WINDOWS} select idx from cases intersect select idx from control_rows")
def paired_orders(spark, folder):
    orders, log = I.orders_and_log(spark, folder)
    controls = I.anchors(spark, folder).filter("has_rows")
    return cohort.paired_orders(cohort.orders_with_rows(orders, log, look_back=I.LOOK_BACK), controls)


@query("mini_sample", f"with {LOG} select idx, order_us from ord order by order_us, idx limit 15")
def mini_sample(spark, folder):
    orders, _ = I.orders_and_log(spark, folder)
    return first_rows(orders, 15, ["order_us", "idx"]).select("idx", "order_us")


@query(
    "rounded_seconds",
    f"""with {WINDOWS} select idx, event_id, round_even((us - order_us) / 1e6 + 0.5 * (event_id % 3), 0) as s_diff
    from cases join ord using (idx, user_id)""",
)
def rounded_seconds(spark, folder):
    orders, log = I.orders_and_log(spark, folder)
    rows = cohort.case_windows(orders, log.select("user_id", "us", "event_id"), look_back=I.LOOK_BACK)
    seconds = (F.col("us") - F.col("end_us")) / 1e6 + 0.5 * F.pmod("event_id", F.lit(3))
    return rows.select("idx", "event_id", F.bround(seconds, 0).alias("s_diff"))


@query("fixed_split", f"with {LOG}, {SPLITS} select idx, split from splits")
def fixed_split(spark, folder):
    return I.order_splits(spark, folder)


@query(
    "grouped_split",
    f"""with {LOG}, units as (select distinct user_id, order_us // {DAY} as day from ord),
    ranked as (select *, row_number() over (order by md5('{SEED}|' || user_id || '|' || day),
        user_id || '|' || day) - 1 as rnk, count(*) over () as total from units)
    select o.idx, case when rnk < floor(total * cast(0.7 as double)) then 'train'
      when rnk < floor(total * cast(0.7 as double)) + floor(total * cast(0.1 as double)) then 'val'
      else 'test' end as split
    from ord o join ranked r on r.user_id = o.user_id and r.day = o.order_us // {DAY}""",
)
def grouped_split(spark, folder):
    orders, _ = I.orders_and_log(spark, folder)
    dated = orders.withColumn("day", F.call_function("div", "order_us", F.lit(DAY)))
    return split.fixed_split(dated, seed=I.SEED, group_cols=["user_id", "day"])


@query(
    "holdout_split",
    f"""select doc_id, case when rnk < floor(total * cast(0.7 as double)) then 'train' else 'test' end as split
    from (select doc_id, row_number() over (order by md5('{SEED}|' || doc_id), cast(doc_id as varchar)) - 1 as rnk,
      count(*) over () as total from documents)""",
)
def holdout_split(spark, folder):
    docs = I.table(spark, folder, "documents").select("doc_id")
    return split.fixed_split(docs, seed=I.SEED, key="doc_id", fractions={"train": 0.7, "test": None})


@query(
    "split_report",
    f"""with {WINDOWS}, {SPLITS},
    seqs as (select distinct idx, kind, control_idx from windows)
    select split, count(*) filter (kind = 'case') as n_cases, count(*) filter (kind = 'control') as n_controls,
      {r6("count(*) filter (kind = 'control') / greatest(count(*) filter (kind = 'case'), 1)")} as controls_per_case
    from seqs join splits using (idx) group by split""",
)
def split_report(spark, folder):
    sequences = I.all_windows(spark, folder).select("idx", "kind", "control_idx").distinct()
    report = split.split_report(split.route(sequences, I.order_splits(spark, folder)))
    return report.withColumn("controls_per_case", F.round("controls_per_case", 6))


@query(
    "distinct_counts",
    f"""with {WINDOWS} select count(distinct idx) as n_orders, count(distinct user_id) as n_users,
      count(distinct action) as n_actions, max(control_idx) as max_controls from windows""",
)
def distinct_counts(spark, folder):
    return I.all_windows(spark, folder).agg(
        F.countDistinct("idx").alias("n_orders"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("action").alias("n_actions"),
        F.max("control_idx").alias("max_controls"),
    )


@query(
    "label_distribution",
    f"""with {WINDOWS}, seqs as (select distinct idx, kind, control_idx from windows)
    select 'window' as source, cast(kind = 'case' as int) as label, count(*) as n from seqs group by kind
    union all select 'quality', quality, count(*) from labels group by quality""",
)
def label_distribution(spark, folder):
    sequences = I.all_windows(spark, folder).select("idx", "kind", "control_idx").distinct()
    windows = sequences.select(
        F.lit("window").alias("source"), (F.col("kind") == "case").cast("int").alias("label")
    )
    quality = I.table(spark, folder, "labels").select(
        F.lit("quality").alias("source"), F.col("quality").alias("label")
    )
    return windows.unionByName(quality).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "order_batches",
    f"""with {LOG} select idx, rnk // 16 as batch_id, rnk % 16 as batch_pos from (
      select idx, row_number() over (order by md5('{SEED}|' || idx), idx) - 1 as rnk from ord)""",
)
def order_batches(spark, folder):
    orders, _ = I.orders_and_log(spark, folder)
    return split.assign_batches(orders.select("idx"), "idx", batch_size=16, seed=I.SEED)


@query(
    "window_length_quartiles",
    f"""with {WINDOWS} select kind, p as probability, {r6("v")} as value from (
      select kind, unnest([0.25, 0.5, 0.75]) as p, unnest(quantile_cont(n, [0.25, 0.5, 0.75])) as v
      from (select kind, idx, control_idx, count(*) as n from windows group by all) group by kind)""",
)
def window_length_quartiles(spark, folder):
    lengths = I.all_windows(spark, folder).groupBy("idx", "kind", "control_idx").agg(
        F.count(F.lit(1)).alias("n")
    )
    return exact_quantiles(lengths, "n", [0.25, 0.5, 0.75], ["kind"]).withColumn(
        "value", F.round("value", 6)
    )
