"""Annotation exports (A5-A9): token TSV files plus metadata from paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.functions.domains import LEGACY8_DEFAULTS, LEGACY_ROWREF_DEFAULTS
from noteframe.operators.clean import drop_comment_blank_lines
from noteframe.sources.notes import decoded_path  # noqa: F401
from noteframe.sources.small_files import read_lines

TSV_COLS = ["sen_tok", "char", "token", "label", "relation"]
META_COLS = ["annotator", "institution", "year", "MDN", "NotitieID", "batch", "legacy_rawfile"]


def _file_stem(path: Column) -> Column:
    # the last part first: over a whole path the pattern's time grows with the square of its length
    return F.regexp_extract(F.substring_index(path, "/", -1), r"([^/]+?)(\.[^./]*)?$", 1)


def _parent_stem(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -2), r"([^/]+?)(\.[^./]*)?/[^/]+$", 1)


def parse_filename_default(path: Column) -> Column:
    """``.../institution--year--MDN--NotitieID--batch.conll/annotator.tsv``."""
    p = F.split(_parent_stem(path), "--")
    return F.struct(F.lower(_file_stem(path)).alias("annotator"), F.lower(F.get(p, 0)).alias("institution"),
                    F.get(p, 1).alias("year"), F.get(p, 2).alias("MDN"), F.get(p, 3).alias("NotitieID"),
                    F.get(p, 4).alias("batch"), F.lit(None).cast("string").alias("legacy_rawfile"))


def parse_filename_legacy8(path: Column) -> Column:
    """Eight-part legacy name; year fixed 2020, batch 'pilot'."""
    p = F.split(_parent_stem(path), "--")
    return F.struct(F.lower(_file_stem(path)).alias("annotator"), F.lower(F.get(p, 0)).alias("institution"),
                    F.lit(LEGACY8_DEFAULTS["year"]).alias("year"), F.get(p, 2).alias("MDN"), F.get(p, 3).alias("NotitieID"),
                    F.lit(LEGACY8_DEFAULTS["batch"]).alias("batch"), F.lit(None).cast("string").alias("legacy_rawfile"))


def parse_filename_legacy_rowref(df: DataFrame, raw: DataFrame, path: str = "path",
                                 rawfile: str = "rawfile", row_no: str = "row_no",
                                 note: str = "notitieID") -> DataFrame:
    """``rawfile---idx+1`` names; the note id is the value at row idx of
    the raw file, found by an equi-join on (rawfile, row number) - the row
    number must be a stored column of the raw table."""
    stem = _parent_stem(F.col(path))
    parts = F.split(stem, "---")
    d = df.withColumns({"_raw": F.get(parts, 0), "_idx": F.get(parts, 1).cast("long") - 1})
    r = raw.select(F.col(rawfile).alias("_raw"), F.col(row_no).cast("long").alias("_idx"),
                   F.col(note).cast("string").alias("NotitieID"))
    j = d.join(r, ["_raw", "_idx"], "left")
    fixed = {k: F.lit(v) for k, v in LEGACY_ROWREF_DEFAULTS.items()}
    return j.withColumns({"annotator": F.lower(_file_stem(F.col(path))), **fixed,
                          "legacy_rawfile": F.col("_raw")}).drop("_raw", "_idx")


def scan_annotation_tsv(spark: SparkSession, path: str,
                        parser: Callable[[Column], Column] | None = parse_filename_default,
                        glob: str = "*.tsv") -> DataFrame:
    """A5: every ``*.tsv`` under ``path`` (recursive) -> one row per token.

    Header, '#' comment and blank lines are dropped by content (not by line
    number); fields are tab-split without quote handling, so a quote
    character is an ordinary token; token text such as 'NA' stays text
    (quirk Q3b). Metadata columns come from the file path via ``parser``."""
    lines = drop_comment_blank_lines(read_lines(spark, path, glob).select("value", "path"))
    parts = F.split(F.col("value"), "\t")
    out = lines.select(*[F.get(parts, i).alias(c) for i, c in enumerate(TSV_COLS)], "path")
    if parser is None:
        return out
    # behind a generator, so that the path is parsed once a line, not once a column
    return out.withColumn("_m", F.explode(F.array(parser(F.col("path"))))).select(*TSV_COLS, "_m.*", "path")


def concat_core_external(core: DataFrame, external: DataFrame, key: str = "NotitieID") -> DataFrame:
    """All core annotations plus external annotations of notes that the
    core team did not annotate."""
    extra = external.join(core.select(key).distinct(), key, "left_anti")
    return core.unionByName(extra, allowMissingColumns=True)
