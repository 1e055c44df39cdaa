"""Token -> sentence -> note assembly.

All group keys are functions of the note id. Grouping on (NotitieID, ...)
lets one hash partitioning on NotitieID serve every step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS

INFO_COLS = ["institution", "year", "MDN", "NotitieID", "batch", "annotator"]


def flag_group_any(df: DataFrame, group: str | Sequence[str], flag: str, out: str) -> DataFrame:
    """D1: 'any row of the group flagged' on every row (NULL-only -> False)."""
    keys = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.coalesce(F.bool_or(F.col(flag)).over(w), F.lit(False)))


def _first(c: str, order):
    """pandas ``first()``: first non-NULL value in row order."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)


def _order_key(cols):
    """Single order column as is (cheap comparisons), several as a struct."""
    return F.col(cols[0]) if len(cols) == 1 else F.struct(*[F.col(c) for c in cols])


def _ordered_text(order_cols: Sequence[str], token: str = "token"):
    s = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_cols)],
                 F.coalesce(F.col(token), F.lit("")).alias("v"))
    return F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(s)), lambda x: x["v"]))


def first_info_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str],
                         cols: Sequence[str]) -> DataFrame:
    """First non-NULL value of each column in row order, per group.
    ``min_by`` on an explicit order (bare ``first`` after a shuffle is not
    deterministic)."""
    o = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*group).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in cols])


def build_sentences(tokens: DataFrame, domains: Sequence[str] = DOMAINS,
                    info: Sequence[str] = INFO_COLS,
                    bg: str = "background_sent", tgt: str = "target_sent",
                    keys: Sequence[str] = ("NotitieID", "pad_sen_id")) -> DataFrame:
    """One row per sentence (pad_sen_id): first info values in token
    order, tokens joined by one space in token order, any() per domain as a
    0/1 vector in canonical order. Expects B8/D1 applied (flags non-NULL).
    The note id is part of the key (a sentence id determines its note), so
    a partitioning by note serves this aggregation without a new shuffle."""
    order = _order_key(["tok"])
    aggs = [_first(c, order) for c in list(info) + [bg, tgt] if c not in keys]
    aggs.append(_ordered_text(["tok"]).alias("text_raw"))
    aggs.append(F.array(*[F.max(F.col(d).cast("int")) for d in domains]).alias("labels"))
    return tokens.groupBy(*keys).agg(*aggs)


def sentence_mean_levels(tokens: DataFrame, domains: Sequence[str] = DOMAINS,
                         info: Sequence[str] = INFO_COLS,
                         keys: Sequence[str] = ("NotitieID", "pad_sen_id")) -> DataFrame:
    """D3: mean of non-NULL levels per sentence, text in token order."""
    order = _order_key(["tok"])
    return tokens.groupBy(*keys).agg(
        *[_first(c, order) for c in info if c not in keys],
        _ordered_text(["tok"]).alias("text_raw"),
        *[F.avg(f"{d}_lvl").alias(f"{d}_lvl") for d in domains])


def note_mean_levels(tokens: DataFrame, domains: Sequence[str] = DOMAINS,
                     info: Sequence[str] = INFO_COLS, sen_no: str = "sen_no") -> DataFrame:
    """The same per note; tokens ordered by integer sentence, then token
    (string order would put sentence 10 before 2)."""
    order = F.struct(F.col(sen_no), F.col("tok"))
    keep = [c for c in info if c != "NotitieID"]
    return tokens.groupBy("NotitieID").agg(
        *[_first(c, order) for c in keep],
        _ordered_text([sen_no, "tok"]).alias("text_raw"),
        *[F.avg(f"{d}_lvl").alias(f"{d}_lvl") for d in domains])


def note_any_labels(long: DataFrame, note: str = "NotitieID", domain: str = "domains",
                    labels: str = "labels", preds: str = "preds") -> DataFrame:
    """Sentence gold/pred (long form) -> note-level any() per domain."""
    return (long.groupBy(note, domain)
                .agg(F.max(labels).cast("int").alias(labels), F.max(preds).cast("int").alias(preds))
                .withColumn("correct", F.col(labels) == F.col(preds)))


def mean_preds_per_note(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Mean prediction per source row id."""
    return df.groupBy(id_col).agg(*[F.avg(c).alias(c) for c in cols])
