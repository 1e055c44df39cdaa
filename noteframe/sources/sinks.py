"""Exports and stage persistence.

Writers take a layout DataFrame (built by the ``*_layout`` functions, which
are lazy and testable) and write it with Spark's partitioned writers, or, where
files are very many, as :mod:`noteframe.sources.small_files` does; no rows pass
through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from noteframe.functions.text import year_from_date
from noteframe.operators.nlp import conll_text
from noteframe.sources.small_files import local_path, write_folders


def folder_writer(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrameWriter:
    """A writer of one folder per value of ``keys``, a file each, its rows in ``order``.

    Files of a few rows cost the same whatever their size, so the writing tasks
    are the session's shuffle partitions and are not merged by bytes.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).write.partitionBy(*keys)


def text_folders(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One folder per value of ``keys``, a text file in each: the column beside the keys, a line a row."""
    if (root := local_path(df.sparkSession, path)) is None:
        folder_writer(df, keys).mode("overwrite").text(path)
    else:
        write_folders(df, root, keys, F.col(next(c for c in df.columns if c not in keys)))


def csv_folders(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> None:
    """One folder per value of ``keys``, in it a CSV file of the other columns with a header, its rows in ``order``."""
    spark = df.sparkSession
    if (root := local_path(spark, path)) is None:
        folder_writer(df, keys, order).mode("overwrite").option("header", True).csv(path)
        return
    rest = [c for c in df.columns if c not in keys]
    header = spark.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(rest)]))).first()[0]
    write_folders(df, root, keys, F.to_csv(F.struct(*rest)), order, header, ".csv")


def conll_layout(batch: DataFrame, batch_name: str, text: str = "all_text") -> DataFrame:
    """A13 layout: one row per (annotator, file): file name from metadata,
    CoNLL body (token + dummy tag per line, blank line between sentences)."""
    name = F.concat_ws("--", "institution", year_from_date("Notitiedatum"), "MDN", "NotitieID", F.lit(batch_name))
    return batch.select("annotator", F.concat(name, F.lit(".conll")).alias("file_name"),
                        conll_text(F.trim(F.col(text))).alias("conll"))


def export_conll(batch: DataFrame, path: str, batch_name: str, text: str = "all_text") -> None:
    """A folder per annotator, a file per note."""
    text_folders(conll_layout(batch, batch_name, text), path, ["annotator", "file_name"])


def per_patient_layout(df: DataFrame, n_cols: int = 7, empty_cols: Sequence[str] = (),
                       id_col: str = "MDN", date: str = "Notitiedatum") -> DataFrame:
    """A14 layout: first ``n_cols`` columns plus empty level columns."""
    keep = df.columns[:n_cols]
    return df.select(*keep, *[F.lit(None).cast("double").alias(c) for c in empty_cols])


def export_per_patient(df: DataFrame, path: str, n_cols: int = 7, empty_cols: Sequence[str] = (),
                       id_col: str = "MDN", date: str | Sequence[str] = "Notitiedatum") -> None:
    """Chronological notes of each patient, one folder per patient."""
    csv_folders(per_patient_layout(df, n_cols, empty_cols, id_col), path, [id_col], [date] if isinstance(date, str) else date)


def chunk_layout(df: DataFrame, order: Sequence[str], size: int = 200000, out: str = "chunk") -> DataFrame:
    """Global row number in ``order`` and chunk = row_no div size
    (every chunk kept, quirk Q2 fixed)."""
    from noteframe.operators.sampling import global_rank
    r = global_rank(df, list(order), "row_no")
    return r.withColumn(out, (F.col("row_no") / F.lit(size)).cast("long"))


def export_chunks(df: DataFrame, path: str, order: Sequence[str], size: int = 200000) -> None:
    """One folder of files per chunk."""
    chunk_layout(df, order, size).write.mode("overwrite").partitionBy("chunk").parquet(path)


def export_flat(df: DataFrame, path: str, sep: str = "\t", drop: Sequence[str] = ()) -> None:
    """Delimited text with a header, optionally without text columns."""
    df.drop(*drop).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def persist_stage(df: DataFrame, path: str) -> DataFrame:
    """Write a pipeline stage as parquet and read it back (cuts the
    lineage through a table in shared storage)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
