"""Registered queries do not depend on how many partitions a shuffle has, or on broadcasts."""

import pytest

from oracle_compare import compare

SMALL = "/root/testdata/sf0.001"
CASES = [("8", "-1", n) for n in ("encode_items", "positives", "vocab", "basket_features", "negatives", "fm_step_1", "recommend", "auc_threshold")] \
    + [("2", "10485760", "recommend"), ("32", "-1", "submission_lines")]


@pytest.mark.parametrize("partitions,broadcast,name", CASES)
def test_query_is_right_without_coalescing(spark, partitions, broadcast, name):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": partitions,
                "spark.sql.autoBroadcastJoinThreshold": broadcast}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        report = compare(spark, SMALL, [name], verbose=True)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert report[name].get("ok") is True, report[name]
