"""Set operations, sorts and positional projections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Append frames aligned by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_distinct(a: DataFrame, b: DataFrame, keys: Sequence[str],
                   order: Sequence[str] | None = None) -> DataFrame:
    """Append ``b`` to ``a``, the first row per key wins (rows of ``a``
    before rows of ``b``; within ``b`` the first in ``order``)."""
    from noteframe.operators.clean import dedup_on_keys
    new = b.join(a.select(*keys).distinct(), list(keys), "left_anti")
    new = dedup_on_keys(new, keys, order) if order else new.dropDuplicates(list(keys))
    return a.unionByName(new, allowMissingColumns=True)


def except_rows(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``a`` not in ``b`` (by key, or whole rows with bag
    semantics when no key is given)."""
    if keys:
        return a.join(b.select(*keys).distinct(), list(keys), "left_anti")
    return a.exceptAll(b)


def intersect_all_annotators(df: DataFrame, key: str = "pad_sen_id", annotator: str = "annotator",
                             n_annotators: int | None = None) -> DataFrame:
    """U4: rows whose item was seen by every annotator."""
    if n_annotators is None:
        n_annotators = df.select(annotator).distinct().count()
    full = (df.groupBy(key).agg(F.countDistinct(annotator).alias("_n"))
              .filter(F.col("_n") == n_annotators).select(key))
    return df.join(full, key, "left_semi")


def sort_dates(df: DataFrame, keys: Sequence[str] = ("MDN", "Notitiedatum")) -> DataFrame:
    """L1: sort by patient and date (range-partitioned global sort)."""
    return df.orderBy(*keys)


def sort_index_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L2: order report rows (apply to the small output only)."""
    return df.orderBy(*keys)


def head_columns(df: DataFrame, k: int) -> DataFrame:
    """L3: first ``k`` columns by position."""
    return df.select(*df.columns[:k])
