"""Registered queries against their DuckDB oracles on the smallest stand-in tables."""

import pytest

from oracle_compare import compare

SMALL = "/root/testdata/sf0.001"

QUICK = ["basket_items", "item_dict", "encode_unknown", "positives", "stop_words", "vocab",
         "basket_features", "negatives", "libsvm_lines", "fm_step_1", "recommend", "auc_raw"]


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, name):
    report = compare(spark, SMALL, [name], verbose=True)
    assert report[name].get("ok") is True, report[name]


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
