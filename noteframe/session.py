"""Session helpers: sane defaults for local runs, shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # small shuffles can still carry CPU-heavy rows (token explodes, vector
    # distances): do not let AQE fold them below ~64 KB per task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "noteframe", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's session instead."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    ``spark.checkpoint.dir`` names it, or ``setCheckpointDir`` if a user
    called that; neither is changed. Where both are unset, a session with one
    machine (``local[...]``) gets a scratch folder; on a cluster that is an
    error, because executors could not read it.
    """
    sc = spark.sparkContext
    set_by_user = sc.getCheckpointDir()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and set_by_user:
        # Spark adds a folder of its own below the one that was set
        d = set_by_user.rstrip("/").rpartition("/")[0]
    if not d:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="noteframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not set_by_user:
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_shared(df, name: str):
    """Write to the shared folder and read back: cuts the lineage durably, and
    the size is known, so that Spark can tell whether a join may broadcast it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
