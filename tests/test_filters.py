"""Filters that act, and checks that fail when they should."""

import pytest
from conftest import FOLDER
from helpers import rows

from seqtrail.operators import posthoc, sequences
from seqtrail.plans import filter_queries as queries
from seqtrail.plans import inputs as I


def test_blank_sequences_are_left_out(spark):
    texts = ["a", " ", "", None, "\n\t ", " b\n", "\n\nc"]
    found = sequences.non_blank(spark.createDataFrame([(t,) for t in texts], "sequence string"))
    assert rows(found, "sequence") == sorted([("a",), (" b\n",), ("\n\nc",)], key=repr)


def test_the_made_inputs_do_change_rows(spark):
    orders, log = I.orders_and_log(spark, FOLDER)
    windows = queries.cohort.case_windows(orders, log, look_back=I.LOOK_BACK).select("idx").distinct().count()
    assert 0 < queries.nonblank_sequences(spark, FOLDER).count() < windows
    stream = queries.mixed_stream(spark, FOLDER)
    assert stream.count() == 5 * sum(r.n_valid for r in queries.mixed_valid_actions(spark, FOLDER).collect())
    wb = I.line_models(spark, FOLDER).wb
    kept = queries.chunks.number_chunks(wb.filter(queries.KEPT_WORDS), ["seq_id"])
    told = kept.groupBy("seq_id", "chunk_id").agg({"is_row": "max", "label": "count"}).collect()
    assert any(r["max(is_row)"] == 0 for r in told) and any(r["max(is_row)"] == 1 and r["count(label)"] == 1 for r in told)


SCORED = [(1, 1), (1, 0), (2, 1)]


@pytest.mark.parametrize("counts", [[(1, 2), (2, 2)], [(1, 2), (2, 1), (3, 1)], [(1, 2)], [(1, 1), (2, 2)]])
def test_counts_that_do_not_fit_the_rows_are_refused(spark, counts):
    scored = spark.createDataFrame(SCORED, "seq_id long, correct int")
    told = spark.createDataFrame(counts, "seq_id long, n long")
    with pytest.raises(Exception, match="counted"):
        posthoc.checked_sums(scored, told, ["correct"]).collect()


def test_counts_that_fit(spark):
    scored = spark.createDataFrame(SCORED, "seq_id long, correct int")
    told = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "seq_id long, n long")
    assert rows(posthoc.checked_sums(scored, told, ["correct"]), "seq_id", "n", "correct") == [(1, 2, 1), (2, 1, 1), (3, 0, 0)]


def test_strict_matching_is_refused_where_it_is_impossible(spark):
    wb = spark.createDataFrame([(1, 3), (2, 2)], "seq_id long, n long")
    fb = spark.createDataFrame([(1, 2), (2, 2)], "seq_id long, n long")
    counts = posthoc.match_counts(wb, fb, policy="strict_wb")
    assert rows(posthoc.strict_failures(counts), "seq_id", "excess") == [(1, 1)]
    with pytest.raises(posthoc.CountMismatch):
        posthoc.require_strict(counts)
    assert posthoc.require_strict(posthoc.match_counts(fb, fb, policy="strict_wb")) is None
