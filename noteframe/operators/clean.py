"""Projections, filters and cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteframe.functions.domains import DOMAINS
from noteframe.functions.text import normalize_whitespace, pad_sentence_id


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """B1: drop rows identical over all columns (run before text merging)."""
    return df.dropDuplicates()


def combine_text_columns(df: DataFrame, cols: Sequence[str], out: str = "all_text",
                         drop: bool = True) -> DataFrame:
    """B2: join text parts with one space, skipping NULL parts; every part is
    whitespace-normalised and stripped first."""
    res = df.withColumn(out, F.concat_ws(" ", *[normalize_whitespace(c) for c in cols]))
    return res.drop(*[c for c in cols if c != out]) if drop else res


def cast_ids(df: DataFrame, cols: Iterable[str] = ("MDN", "NotitieID")) -> DataFrame:
    """Ids as strings (read them as strings at the scan when possible)."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def dedup_on_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None,
                  hashed: Sequence[str] = ()) -> DataFrame:
    """Keep one row per key; with ``order`` the first in that order.
    Key columns in ``hashed`` (long texts) are grouped by their 256-bit hash,
    so whole texts are neither compared nor sorted as keys."""
    if not order:
        return df.dropDuplicates(list(keys))
    if hashed:
        short = {c: f"_h_{c}" for c in hashed}
        d = df.withColumns({h: F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("")) for c, h in short.items()})
        d = d.withColumns({f"{h}n": F.col(c).isNull() for c, h in short.items()})
        by = [short.get(c, c) for c in keys] + [f"{h}n" for h in short.values()]
        return dedup_on_keys(d, by, order).select(*df.columns)
    # min_by aggregates partially before the shuffle, so a key with very
    # many copies (one text repeated everywhere) is reduced map-side instead
    # of landing whole in one window partition
    others = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in others]),
                                          F.struct(*[F.col(c) for c in order])).alias("_row"))
    return kept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*df.columns)


def drop_disregard(df: DataFrame, note: str = "NotitieID", flag: str = "disregard",
                   keep_flag_col: bool = False, clustered: bool = False) -> DataFrame:
    """Drop every note in which any token is flagged; drop the flag.

    Default: anti-join against the distinct flagged note ids (only the id
    set is aggregated; AQE broadcasts it when its runtime size allows).
    ``clustered=True`` (input already partitioned by note): a per-note
    window instead, so the input is not read a second time."""
    if clustered:
        w = Window.partitionBy(note)
        out = (df.withColumn("_dn", F.coalesce(F.bool_or(F.col(flag)).over(w), F.lit(False)))
                 .filter(~F.col("_dn")).drop("_dn"))
    else:
        flagged = df.filter(F.col(flag)).select(note).distinct()
        out = df.join(flagged, note, "left_anti")
    return out if keep_flag_col else out.drop(flag)


def disregard_note_flag(df: DataFrame, note: str = "NotitieID", flag: str = "disregard",
                        out: str = "disregard_note") -> DataFrame:
    """B6 companion (quirk Q4 made explicit): per-note 'any token flagged'."""
    flagged = df.filter(F.col(flag)).select(note).distinct().withColumn(out, F.lit(True))
    return df.join(flagged, note, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def mask_domain_for_batch(df: DataFrame, domain: str = "MBW", batch: str = "week_14",
                          batch_col: str = "batch") -> DataFrame:
    """For one batch set the domain flag False and its level NULL."""
    hit = F.col(batch_col) == batch
    return df.withColumns({
        domain: F.when(hit, F.lit(False)).otherwise(F.col(domain)),
        f"{domain}_lvl": F.when(hit, F.lit(None)).otherwise(F.col(f"{domain}_lvl")),
    })


def standardize_nulls(df: DataFrame, flags: Iterable[str], text_cols=("label", "relation"),
                      token: str = "token") -> DataFrame:
    """Flags NULL -> False, label/relation NULL -> '_', token NULL -> ''."""
    fill = {c: False for c in flags}
    fill.update({c: "_" for c in text_cols})
    fill[token] = ""
    return df.fillna(fill)


def filter_note_type(df: DataFrame, types: Sequence[str], negate: bool = False,
                     col: str = "Typenotitie") -> DataFrame:
    """Keep notes whose type is (not) in ``types``; NULL type counts as
    'not in the list', as with pandas ``isin``."""
    m = F.coalesce(F.col(col).isin(list(types)), F.lit(False))
    return df.filter(~m if negate else m)


def drop_comment_blank_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Remove blank lines and lines starting with '#'."""
    c = F.col(col)
    return lines.filter(c.isNotNull() & (F.trim(c) != "") & ~c.startswith("#"))


def _no_label(labels: str):
    return ~F.exists(F.col(labels), lambda x: x != 0)


def exclude_background_negatives(df: DataFrame, labels: str = "labels",
                                 background: str = "background_sent",
                                 target: str = "target_sent") -> DataFrame:
    """Drop background/target sentences with an all-zero label vector."""
    bad = (F.coalesce(F.col(background), F.lit(False)) | F.coalesce(F.col(target), F.lit(False))) & _no_label(labels)
    return df.filter(~bad)


def positive_only(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Keep rows with a non-zero label vector."""
    return df.filter(~_no_label(labels))


def domain_gold_slice(df: DataFrame, dom: str, out: str = "labels") -> DataFrame:
    """Rows with a level for ``dom``; other level columns dropped."""
    lvl = f"{dom}_lvl"
    others = [c for c in df.columns if c.endswith("_lvl") and c != lvl]
    return df.filter(F.col(lvl).isNotNull()).drop(*others).withColumnRenamed(lvl, out)


def annotator_alias(df: DataFrame, col: str = "annotator", out: str | None = None) -> DataFrame:
    """Annotator -> first letter, but only when that initial is unique
    among all annotators (else the full name is kept; quirk Q5).

    The alias table has one row per distinct annotator; its join is left to
    AQE (broadcast once its runtime size is known to be small)."""
    out = out or col
    names = df.select(col).distinct().withColumn("_ini", F.substring(col, 1, 1))
    uniq = names.groupBy("_ini").agg(F.count("*").alias("_n"))
    alias = (names.join(uniq, "_ini")
                  .select(col, F.when(F.col("_n") == 1, F.col("_ini")).otherwise(F.col(col)).alias("_alias")))
    return df.join(alias, col, "left").withColumn(out, F.col("_alias")).drop("_alias")


def flatten_nested_preds(df: DataFrame, marker: str = "pred") -> DataFrame:
    """Columns named like ``pred*`` holding list-in-list lose one level
    (first inner list kept), decided from the schema, not the data."""
    fix = {}
    for f in df.schema.fields:
        if marker in f.name and isinstance(f.dataType, T.ArrayType) and \
                isinstance(f.dataType.elementType, T.ArrayType):
            fix[f.name] = F.get(F.col(f.name), 0)
    return df.withColumns(fix) if fix else df


def split_sen_tok(df: DataFrame, col: str = "sen_tok", note: str = "NotitieID") -> DataFrame:
    """``s-t`` -> sen_id = <note>_<s>, tok = int(t)."""
    parts = F.split(F.col(col), "-")
    return df.withColumns({
        "sen_id": F.concat(F.col(note), F.lit("_"), F.get(parts, 0)),
        "tok": F.get(parts, 1).cast("int"),
    })


def add_pad_sen_id(df: DataFrame, sen_id: str = "sen_id", out: str = "pad_sen_id") -> DataFrame:
    """B17 applied: zero-padded sentence id (never truncating)."""
    return df.withColumn(out, pad_sentence_id(sen_id))


def split_date_parts(df: DataFrame, date: str = "Notitiedatum") -> DataFrame:
    """``YYYY-MM-DD`` -> year, month, day strings."""
    p = F.split(F.col(date).cast("string"), "-")
    return df.withColumns({"year": F.get(p, 0), "month": F.get(p, 1), "day": F.get(p, 2)})


def drop_incomplete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any NULL (or NaN) in ``cols`` (default: all)."""
    return df.na.drop(how="any", subset=list(cols) if cols else None)


def multi_hot_partial(df: DataFrame, present: Sequence[str], all_domains: Sequence[str] = DOMAINS,
                      out: str = "labels") -> DataFrame:
    """Map the annotated domains onto the full slot vector, others 0."""
    return df.withColumn(out, F.array(*[
        F.coalesce(F.col(d).cast("int"), F.lit(0)) if d in present else F.lit(0) for d in all_domains]))


def pivot_array_to_columns(df: DataFrame, arr: str = "labels", names: Sequence[str] = DOMAINS) -> DataFrame:
    """Slot vector -> one named column per slot."""
    return df.withColumns({n: F.get(F.col(arr), i) for i, n in enumerate(names)})


def rename_pred_column(df: DataFrame, model: str, out: str = "preds") -> DataFrame:
    """Pick one model's prediction column as ``preds``."""
    return df.withColumnRenamed(f"pred_{model}", out)
