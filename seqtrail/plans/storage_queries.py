"""Queries that write through the session's shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqtrail.functions.storage import cut, ensure_checkpoint_dir
from seqtrail.operators import vocab
from seqtrail.plans import inputs as I
from seqtrail.plans.registry import query
from seqtrail.plans.sql import LOG, WINDOWS, r6, tokens_sql
from seqtrail.sources import readers, writers


def _place(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "order_list_file",
    f"with {LOG} select idx, cast(user_id as varchar) as user_id, order_us, prov_type from ord",
)
def order_list_file(spark, folder):
    """The index orders as a CSV list and back."""
    orders, _ = I.orders_and_log(spark, folder)
    path = _place(spark, "orders")
    when = F.date_format(F.timestamp_micros("order_us"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    orders.select(
        "idx",
        when.alias("ORDER_DTTM_raw"),
        F.col("user_id").cast("string").alias("ORDERING_USER_ID"),
        F.col("prov_type").alias("PROV_TYPE"),
    ).write.option("header", True).csv(path)
    return readers.read_order_list(spark, path, timestamp_format="yyyy-MM-dd HH:mm:ss.SSSSSS")


@query(
    "log_columns",
    f"with {LOG} select event_id, user_id, us from ev",
)
def log_columns(spark, folder):
    """The log, after a check that it has the columns asked for."""
    wanted = ["event_id", "user_id", "us"]
    return readers.require_columns(I.audit_log(spark, folder), wanted).select(*wanted)


@query(
    "windows_file",
    f"with {WINDOWS} select kind, idx, control_idx, count(*) as n_rows, min(us) as first_us from windows group by all",
)
def windows_file(spark, folder):
    """All windows written by kind and read back."""
    path = _place(spark, "windows")
    writers.write_windows(I.all_windows(spark, folder), path)
    return (
        readers.read_windows(spark, path)
        .groupBy("kind", "idx", "control_idx")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("us").alias("first_us"))
    )


@query(
    "provider_windows_file",
    f"""with {WINDOWS} select w.kind, w.idx, w.control_idx, count(*) as n_rows, min(w.us) as first_us
    from windows w where w.idx in (select idx from ord where prov_type = 'Attending') group by all""",
)
def provider_windows_file(spark, folder):
    """The stored windows of the orders of one kind of provider."""
    path = _place(spark, "windows")
    writers.write_windows(I.all_windows(spark, folder), path)
    orders, _ = I.orders_and_log(spark, folder)
    return (
        readers.read_windows(spark, path, orders.filter("prov_type = 'Attending'"))
        .groupBy("kind", "idx", "control_idx")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("us").alias("first_us"))
    )


@query(
    "token_map_file",
    f"with {tokens_sql()} select action, '[ACT_' || rank || ']' as token from vocab",
)
def token_map_file(spark, folder):
    """The action map as one JSON file and back."""
    path = _place(spark, "token-map")
    writers.write_token_map(vocab.action_tokens(vocab.action_counts(I.all_windows(spark, folder)), I.TOP_K), path)
    return writers.read_token_map(spark, path)


REPORT_SQL = "select event_type as metric, count(*) as n, {} as mean_value from events group by event_type"


def _report(spark, folder):
    return (
        I.audit_log(spark, folder)
        .groupBy("metric")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    )


@query("report_file", REPORT_SQL.format(r6("avg(value)")))
def report_file(spark, folder):
    """A small report as one CSV file and back."""
    path = _place(spark, "report")
    writers.write_report(_report(spark, folder), path)
    return spark.read.schema("metric string, n long, mean_value double").option("header", True).csv(path)


@query(
    "combined_report_file",
    f"""with {LOG}, a as ({REPORT_SQL.format(r6("avg(value)"))})
    select 'all' as period, 'metrics' as "table", metric as name, n from a
    union all select 'all', 'providers', prov_type, count(*) from ord group by prov_type""",
)
def combined_report_file(spark, folder):
    """Two reports in one JSON file per period and back."""
    orders, _ = I.orders_and_log(spark, folder)
    path = _place(spark, "combined")
    tables = {
        "metrics": _report(spark, folder),
        "providers": orders.groupBy(F.col("prov_type").alias("provider")).agg(F.count(F.lit(1)).alias("n")),
    }
    writers.write_combined_json(tables, path, period="all")
    record = lambda field: F.get_json_object("record", f"$.{field}")
    return spark.read.schema("table string, record string, period string").json(path).select(
        "period",
        "table",
        F.coalesce(record("metric"), record("provider")).alias("name"),
        record("n").cast("long").alias("n"),
    )


@query(
    "cache_files",
    f"with {LOG} select user_id, count(*) as n, sum(us % 1000003) as us_mark, true as again_equal from ev group by user_id",
)
def cache_files(spark, folder):
    """The log as a cache of files of bounded rows, made once and then only read."""
    path = _place(spark, "cache")
    log = I.audit_log(spark, folder).select("event_id", "user_id", "us")
    first = writers.materialize(log, path, rows_per_file=1000)
    # The second call finds the cache and must not write the filtered rows.
    again = writers.materialize(log.filter("event_id < 0"), path, rows_per_file=1000)
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.pmod("us", F.lit(1000003))).alias("us_mark")]
    one, two = (cut(df.groupBy("user_id").agg(*sums)) for df in (first, again))
    same = two.select("user_id", F.col("n").alias("n2"), F.col("us_mark").alias("us2"))
    return one.join(same, "user_id", "left").select(
        "user_id",
        "n",
        "us_mark",
        (F.col("n").eqNullSafe(F.col("n2")) & F.col("us_mark").eqNullSafe(F.col("us2"))).alias("again_equal"),
    )
