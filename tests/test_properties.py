"""Properties on the smallest stand-in tables: negatives avoid positives, split is stable."""

from pyspark.sql import functions as F

from trolley.operators.features import basket_item_pairs
from trolley.operators.negatives import sample_negatives
from trolley.operators.split import split_instances
from trolley.plans import context as ctx

SMALL = "/root/testdata/sf0.001"


def test_negatives_never_hit_a_positive(spark):
    e = ctx.encoded(spark, SMALL)
    d, n = ctx.item_dict(spark, SMALL)
    inst, pairs = sample_negatives(e, n)
    pos = basket_item_pairs(e)
    assert pairs.count() > 0
    assert pairs.join(pos, ["pid", "item_id"]).count() == 0
    # each negative basket keeps its own (lower-cased) name
    names = e.select("pid", "pname").distinct()
    assert inst.join(names, ["pid", "pname"], "left_anti").count() == 0


def test_split_is_deterministic_and_near_share(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "instance_id")
    a = split_instances(df, 0.1, 5)
    b = split_instances(df.repartition(7), 0.1, 5)
    share = a.where(F.col("split") == "test").count() / 20000
    assert 0.09 < share < 0.11
    diff = a.join(b, "instance_id").where(a["split"] != b["split"]).count()
    assert diff == 0
