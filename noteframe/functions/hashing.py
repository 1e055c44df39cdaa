"""Deterministic md5 buckets shared by every sampling and binding step.

``md5_bucket(a, b, ...)`` is the first 32 bits of md5 over the ':'-joined
string forms of its arguments, as a non-negative bigint. It is a pure JVM
expression (codegen'd) and has an exact DuckDB twin (``sql_md5_bucket``),
so sampled or hashed results can be checked against SQL by value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def md5_bucket(*cols) -> Column:
    parts = [_col(c).cast("string") for c in cols]
    key = parts[0] if len(parts) == 1 else F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def sql_md5_bucket(*exprs: str) -> str:
    """DuckDB expression equal to :func:`md5_bucket` over SQL expressions."""
    parts = [f"CAST({e} AS VARCHAR)" for e in exprs]
    key = parts[0] if len(parts) == 1 else "concat_ws(':', " + ", ".join(parts) + ")"
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"

