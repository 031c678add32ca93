"""Every registered query against its SQL on the smallest tables.

All of them take some minutes, so by default one query per area is compared; set
``ALL_QUERIES=1`` for the rest.
"""

import os

import duckdb
import pytest
from conftest import FOLDER

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()
SAMPLE = [
    "case_sequences",
    "control_windows",
    "cohort_report",
    "fixed_split",
    "encode_pad_labels",
    "pack_blocks",
    "markov_positions_fine",
    "entropy_rate",
    "nearest_action",
    "chunk_summary",
    "bootstrap_ci",
    "wilcoxon",
    "posthoc_ci",
    "nonblank_sequences",
    "ragged_chunks",
    "strict_tail",
]
ORACLES = entry_points.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    return float(value) if isinstance(value, float) or float(value) != int(value) else int(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    want = sorted([tuple(plain(r[i]) for i in order) for r in result.fetchall()], key=repr)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    assert got == want


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry_points.queries())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["idx", "part", "n_actions", "sequence"] and df.count() == 17
