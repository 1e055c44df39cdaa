"""A10 on a stream: newly exported annotation rows keep the register of
annotated notes up to date.

The register is a folder of Parquet files by stream run, micro-batch and bucket
of the note id. A micro-batch reads only the buckets that its ids fall in, and
writes one folder of its own. A replayed batch, after a failure in the middle
of writing too, looks only at the folders before it and overwrites its own, so
it adds nothing twice and leaves no half of itself.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteframe.operators.clean import dedup_on_keys
from noteframe.sources.register import REGISTER_COLS

BUCKETS = 256
_PLACE = "reg_run string, reg_batch long, reg_bucket int"


def read_stream_register(spark: SparkSession, path: str) -> DataFrame:
    """The register's rows with the run, batch and bucket that they are filed under."""
    columns = ", ".join(f"`{c}` string" for c in REGISTER_COLS)
    return spark.read.schema(f"{columns}, {_PLACE}").parquet(path)


def append_batch(batch: DataFrame, batch_id: int, path: str, run: str) -> None:
    """File the notes of a micro-batch that no earlier batch has, the first row of each in the order of the batch form.

    Buckets that the batch touches are at most ``BUCKETS`` numbers; only their
    files of the register are read."""
    spark = batch.sparkSession
    new = batch.select(*[F.col(c).cast("string") if c in batch.columns else F.lit(None).cast("string").alias(c) for c in REGISTER_COLS])
    new = dedup_on_keys(new, ["NotitieID"], order=["batch", "institution", "MDN", "year", "legacy_rawfile"])
    new = new.withColumn("reg_bucket", F.pmod(F.xxhash64("NotitieID"), F.lit(BUCKETS)).cast("int"))
    touched = [r["reg_bucket"] for r in new.select("reg_bucket").distinct().collect()]
    before = (read_stream_register(spark, path).where(F.col("reg_bucket").isin(touched))
              .where(~((F.col("reg_run") == run) & (F.col("reg_batch") >= batch_id))).select(F.col("NotitieID").alias("_known")))
    unseen = new.join(before, F.col("NotitieID").eqNullSafe(F.col("_known")), "left_anti")
    unseen.write.mode("overwrite").partitionBy("reg_bucket").parquet(f"{path.rstrip('/')}/reg_run={run}/reg_batch={batch_id}")


def _append_new(register_path: str, checkpoint: str):
    seen = {}

    def run(batch: DataFrame, batch_id: int) -> None:
        if "id" not in seen:  # the checkpoint names the stream, whose batch numbers mean something only within it
            line = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
            seen["id"] = json.loads(line)["id"]
        append_batch(batch, batch_id, register_path, seen["id"])
    return run


def start_register_stream(spark: SparkSession, source_dir: str, schema: str, register_path: str,
                          checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Watch ``source_dir`` (parquet files of token/metadata rows) and
    append unseen note ids to the register at ``register_path``, which is
    created empty before the stream starts; a storage error surfaces."""
    read_columns = ", ".join(f"`{c}` string" for c in REGISTER_COLS)
    spark.createDataFrame([], f"{read_columns}, {_PLACE}").write.mode("append").partitionBy("reg_run", "reg_batch", "reg_bucket").parquet(register_path)
    stream = spark.readStream.schema(schema).parquet(source_dir)
    w = stream.writeStream.foreachBatch(_append_new(register_path, checkpoint)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
