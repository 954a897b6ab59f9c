"""Registered queries against DuckDB on the smallest tables.

A sample of each family runs by default; FULL=1 runs every query that has a checking SQL.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from featherloom.catalog.registry import CHECKS, QUERIES, TABLES
from tools.check import normal

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "prj_4_minmax_signed", "prj_9_bin_label", "prj_16_region31", "prj_27_keyed_json", "prj_31_declared_flow", "flt_7_blank_unknown",
    "agg_1_column_stats", "agg_7_target_encode_auc", "agg_8_impute", "agg_10_nested_records", "agg_20_script_census", "win_2_tied_rank",
    "win_3_normalized_gini", "win_5_stratified_folds", "win_7_grouped_fold", "set_6_quota_fill", "src_1_scan_csv", "src_10_sparse_rows",
    "str_1_clean_comment", "str_14_count_features", "str_19_sections", "str_20_topic_ranges", "str_22_join_to_previous",
    "mlf_1_tfidf_word", "mlf_1_tfidf_char", "evl_4_best_f1", "ens_6_vote_signature", "jon_6_contained_in_any", "jon_9_category_cascade",
    "jon_11_common_neighbours", "arr_3_circular_shift", "stm_1_flow_on_chunks", "stm_2_counts_on_chunks",
]
NAMES = sorted(CHECKS) if os.environ.get("FULL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(row) for row in df.collect()]
    cur = duck.execute(CHECKS[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(got, df.columns) == normal(cur.fetchall(), names)


def test_entry_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
