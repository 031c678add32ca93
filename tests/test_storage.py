import os

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from seqtrail.functions.storage import cut, ensure_checkpoint_dir
from seqtrail.sources import readers, writers


def test_order_list_and_sample(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(
        "idx,ORDER_DTTM_raw,ORDERING_USER_ID,PROV_TYPE\n"
        "2,2024-01-01 00:00:02,u1,APP\n1,2024-01-01 00:00:02,u2,Attending\n3,2024-01-01 00:00:01,u1,APP\n"
    )
    orders = readers.read_order_list(spark, str(path))
    first = readers.first_rows(orders, 2, ["order_us", "idx"])
    assert rows(first, "idx", "order_us") == [(1, 1704067202000000), (3, 1704067201000000)]
    assert readers.first_rows(orders, None, ["idx"]).count() == 3


def test_required_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "METRIC_ID int, METRIC_NAME string")
    df.write.parquet(str(tmp_path / "log"))
    with pytest.raises(readers.MissingColumns, match="ACCESS_TIME"):
        readers.read_audit_log(spark, str(tmp_path / "log"))
    got = readers.read_audit_log(spark, str(tmp_path / "log"), columns=["METRIC_NAME"])
    assert got.columns == ["METRIC_NAME"]
    assert "METRIC_ID" not in got._jdf.queryExecution().executedPlan().toString()


def test_log_presence(spark):
    orders = spark.createDataFrame([(1, 7), (2, 8)], "idx long, user_id long")
    log = spark.createDataFrame([(7,), (7,)], "user_id long")
    assert rows(readers.log_presence(orders, log, "user_id"), "idx", "n_logs", "found") == [(1, 2, True), (2, 0, False)]


def test_windows_and_token_map_round_trip(spark, tmp_path):
    windows = spark.createDataFrame([(1, "case", "a"), (1, "control", "b")], "idx long, kind string, action string")
    writers.write_windows(windows, str(tmp_path / "w"))
    assert rows(spark.read.parquet(str(tmp_path / "w")), "idx", "kind", "action") == rows(windows, "idx", "kind", "action")
    tokens = spark.createDataFrame([("a", "[ACT_0]", 3)], "action string, token string, n long")
    writers.write_token_map(tokens, str(tmp_path / "t"))
    assert rows(writers.read_token_map(spark, str(tmp_path / "t")), "action", "token") == [("a", "[ACT_0]")]


def test_windows_of_few_orders_come_from_their_folders(spark, tmp_path):
    kinds = F.when(F.col("id") < 300, "case").otherwise("control")
    windows = spark.range(600).select((F.col("id") % 200).alias("idx"), kinds.alias("kind"), F.col("id").alias("event_id"))
    path = str(tmp_path / "w")
    writers.write_windows(windows, path, buckets=32)
    assert len(list((tmp_path / "w" / "kind=case").glob("idx_of_32=*"))) > 24
    assert rows(readers.read_windows(spark, path), "idx", "kind", "event_id") == rows(windows, "idx", "kind", "event_id")
    # A stored table, whose size Spark knows.
    asked = cut(spark.createDataFrame([(7,), (8,), (7,), (10_000,)], "idx long"))
    few = readers.read_windows(spark, path, asked.filter("idx < 1000"))
    assert rows(few, "idx", "event_id") == rows(windows.filter("idx in (7, 8)"), "idx", "event_id")
    assert "dynamicpruning" in plan(few).lower()
    buckets = {r[0] for r in windows.filter("idx in (7, 8)").select(readers.bucket_of(F.col("idx"), 32)).distinct().collect()}
    few.collect()
    nodes, read = [few._jdf.queryExecution().executedPlan().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.metrics().contains("numPartitions"):
            read.append(node.metrics().apply("numPartitions").value())
        inner = node.plan() if "QueryStage" in node.nodeName() else None
        nodes += [inner] if inner else [node.children().apply(i) for i in range(node.children().size())]
    # A folder for each of the two kinds.
    assert max(read) == 2 * len(buckets)
    assert readers.read_windows(spark, path, asked.filter("idx < 0")).count() == 0


def test_reports(spark, tmp_path):
    report = spark.createDataFrame([("accuracy", 0.5)], "metric string, value double")
    writers.write_report(report, str(tmp_path / "r"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "r")), "metric", "value") == [("accuracy", "0.5")]
    writers.write_combined_json({"a": report, "b": report}, str(tmp_path / "c"), period="test1")
    got = spark.read.json(str(tmp_path / "c"))
    assert rows(got, "period", "table", "record")[0] == ("test1", "a", '{"metric":"accuracy","value":0.5}')


def test_materialize_builds_once_in_chunks(spark, tmp_path):
    path = str(tmp_path / "m")
    first = writers.materialize(spark.range(10), path, rows_per_file=2)
    assert first.count() == 10 and len(first.inputFiles()) >= 5
    assert writers.materialize(spark.range(3), path).count() == 10
    assert writers.materialize(spark.range(3), path, overwrite=True).count() == 3


def test_cut_writes_to_the_named_folder(spark):
    folder = ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") in folder
    df = cut(spark.range(5))
    assert df.count() == 5 and all(os.path.basename(folder) in f for f in df.inputFiles())
