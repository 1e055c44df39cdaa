"""Annotated-note register (A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTER_COLS = ["institution", "year", "MDN", "NotitieID", "batch", "legacy_rawfile"]


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Register CSV with header, every column a string (quirk Q1 fixed)."""
    schema = ", ".join(f"{c} string" for c in REGISTER_COLS)
    return spark.read.schema(schema).option("header", True).csv(path)


def update_register(register: DataFrame, new: DataFrame, key: str = "NotitieID") -> DataFrame:
    """A10: distinct ids of ``new`` appended to the register; the first row
    per id wins (existing rows before new ones, then the smallest batch)."""
    from noteframe.operators.sets import union_distinct
    n = new.select(*[F.col(c).cast("string") if c in new.columns else F.lit(None).cast("string").alias(c)
                     for c in REGISTER_COLS])
    return union_distinct(register.select(*REGISTER_COLS), n, [key], order=["batch", "institution", "MDN"])
