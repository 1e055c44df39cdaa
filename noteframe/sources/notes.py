"""Raw note scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.operators.clean import combine_text_columns, drop_exact_duplicates
from noteframe.sources.quoted_csv import read_quoted_csv

NOTE_KEYS = ["MDN", "NotitieID", "Typenotitie", "Notitiedatum"]


def scan_positional_projection(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """A2: keep the chosen column positions (pruned at the CSV scan)."""
    return df.select(*[df.columns[i] for i in positions])


def scan_notes_csv(spark: SparkSession, path: str, institution: str, sep: str = ";",
                   positions: Sequence[int] | None = None, encoding: str = "UTF-8",
                   quote: str = '"', escape: str | None = None, source_pattern: str | None = None) -> DataFrame:
    """A1: headerless delimited note files of one source -> M1.

    Every column is read as a string (ids keep leading zeros, quirk Q3). Line
    breaks may stand in quotes, and large files are still read in ranges
    (``read_quoted_csv``); without ``escape`` a doubled quote is a quote. Exact
    duplicate rows of a source are dropped before the text parts (columns 5..)
    are merged (B1, B2). With ``source_pattern`` the source is taken from each
    file's path first (A4), so equal rows of two sources stay two rows."""
    raw = read_quoted_csv(spark, path, sep, quote, escape, encoding)
    names = [c for c in raw.columns if c.startswith("_c")]
    cols = names if positions is None else [names[i] for i in positions]
    if source_pattern:
        raw = raw.withColumn("institution", F.lower(F.regexp_extract(decoded_path(F.col("file")), source_pattern, 1)))
    else:
        raw = raw.withColumn("institution", F.lit(institution))
    raw = drop_exact_duplicates(raw.select(*cols, "institution"))
    keyed = raw.select(*[F.col(c).alias(n) for c, n in zip(cols[:4], NOTE_KEYS)], *cols[4:], "institution")
    return combine_text_columns(keyed, cols[4:], "all_text").select(*NOTE_KEYS, "all_text", "institution")


def decoded_path(path):
    """A file path as it is on disk: Spark reports it URI-encoded. A plus sign stays one."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


DIAG_COLS = ["MDN", "CSN", "typecontact", "DBC-id", "specialisme", "episodenaam", "DBC_diagnose", "ICD10_diagnose"]


def scan_diagnoses(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A3: headerless diagnosis CSV with fixed names, all strings."""
    schema = ", ".join(f"`{c}` string" for c in DIAG_COLS)
    return spark.read.schema(schema).option("header", False).option("sep", sep).csv(path)


def source_from_filename(df: DataFrame, pattern: str = r"([^/_]+)_[^/]*$", out: str = "institution",
                         group: int = 1, full_path: bool = False) -> DataFrame:
    """A4: take the source from the scanned file's name (or, with
    ``full_path``, from its whole path), lower-cased."""
    name = F.col("_metadata.file_path" if full_path else "_metadata.file_name")
    return df.withColumn(out, F.lower(F.regexp_extract(decoded_path(name), pattern, group)))


def concat_sources_labelled(frames: Mapping[str, DataFrame], out: str = "source") -> DataFrame:
    """Named frames -> one frame with a source column."""
    from noteframe.operators.sets import union_all
    return union_all([df.withColumn(out, F.lit(name)) for name, df in frames.items()])
