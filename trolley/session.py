"""Session settings and lineage helpers shared by every job."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: adaptive execution re-plans joins from measured sizes
# (runtime broadcast, skew splitting, partition coalescing).
_ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "trolley",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session for local runs and tests; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_ADAPTIVE)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; only when the cluster names none, make one.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage and is used as is;
    without it a cluster job stops. The local fallback is for local masters only.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="trolley-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_CODEC = "zstd"  # of the tables written here


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    Cuts lineage and fixes anything nondeterministic upstream (partition layouts, sampled
    range bounds). Unlike ``checkpoint()``, which computes the plan once to count and again to
    write, this computes it once. The folder is the cluster's shared one, so a lost executor
    never loses the table.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", _CODEC).parquet(path)
    out = spark.read.parquet(path)
    out._trolley_table = path
    return out


def materialize_bucketed(df: DataFrame, buckets: int, *cols: str, placed: bool = False) -> DataFrame:
    """``materialize`` as a table bucketed and sorted by ``cols``, one file a bucket.

    Joins and groupings on ``cols`` with tables of as many buckets read it without a shuffle. ``placed``: the rows
    come out of a join or grouping on ``cols``, so those of a bucket are in one task as they are and do not move again.
    """
    spark = df.sparkSession
    name = f"trolley_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    rows = df if placed else df.repartition(buckets, *cols)
    rows.write.format("parquet").option("path", path).option("compression", _CODEC).bucketBy(buckets, *cols).sortBy(*cols).saveAsTable(name)
    out = spark.table(name)
    out._trolley_table, out._trolley_name = path, name
    return out


_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def materialize_together(df: DataFrame) -> DataFrame:
    """``materialize`` where a join on several columns may use tables that lie together by some of them.

    A table bucketed by one key of the join is then read as it lies, and only the other side moves.
    """
    spark = df.sparkSession
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        return materialize(df)
    finally:
        spark.conf.set(_ALL_KEYS, before)


def release(df: DataFrame) -> None:
    """Delete a table written by ``materialize`` once nothing will read it again.

    Loops call this for superseded parameter tables, so a long training run keeps only the
    latest step on shared storage. DataFrames not created by ``materialize`` are left alone.
    """
    path = getattr(df, "_trolley_table", None)
    if not path:
        return
    spark = df.sparkSession
    if getattr(df, "_trolley_name", None):
        spark.sql(f"DROP TABLE IF EXISTS {df._trolley_name}")
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
