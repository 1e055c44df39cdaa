"""Classifier evaluation (H1-H12) on long-form (sentence x domain) rows.

One grouped query replaces the reference's per-domain Python loops; the
confusion analysis joins false negatives to false positives on the
sentence key (at most 9 x 9 pairs per sentence, never a cross join).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS

NONE = "none"


def explode_multilabel(df: DataFrame, domains: Sequence[str] = DOMAINS, labels: str = "labels",
                       pred: str = "preds", keep: Sequence[str] = ("pad_sen_id", "NotitieID", "annotator")) -> DataFrame:
    """H1: three parallel arrays -> one row per (sentence, domain)."""
    z = F.arrays_zip(F.array(*[F.lit(d) for d in domains]).alias("domains"),
                     F.col(labels).alias("labels"), F.col(pred).alias("preds"))
    return df.select(*keep, F.inline(z))


def _safe_div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def prf(long: DataFrame, by: Sequence[str] = ("domains",), labels: str = "labels", preds: str = "preds",
        digits: int | None = 2) -> DataFrame:
    """H2 core: precision, recall, F1 (0 when undefined) and support."""
    l, p = F.col(labels) == 1, F.col(preds) == 1
    g = long.groupBy(*by).agg(F.count(F.when(l & p, 1)).alias("tp"), F.count(F.when(~l & p, 1)).alias("fp"),
                              F.count(F.when(l & ~p, 1)).alias("fn"))
    prec = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = _safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    rnd = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    return g.select(*by, rnd(prec).alias("precision"), rnd(rec).alias("recall"), rnd(f1).alias("f1"),
                    (F.col("tp") + F.col("fn")).alias("support"))


def prf_sentence(long: DataFrame, **kw) -> DataFrame:
    """H2: per domain on sentence rows."""
    return prf(long, **kw)


def prf_note(long: DataFrame, **kw) -> DataFrame:
    """H3: per domain after note-level any()."""
    from noteframe.operators.assemble import note_any_labels
    return prf(note_any_labels(long), **kw)


def error_rows(long: DataFrame, kind: str, key: str = "pad_sen_id") -> DataFrame:
    """H4: 'incorrect' rows, 'fp' rows, 'fn' rows, or 'both': rows of
    sentences that have a false positive and a false negative."""
    l, p = F.col("labels") == 1, F.col("preds") == 1
    if kind == "incorrect":
        return long.filter(F.col("labels") != F.col("preds"))
    if kind == "fp":
        return long.filter(~l & p)
    if kind == "fn":
        return long.filter(l & ~p)
    if kind == "both":
        fp = long.filter(~l & p).select(key).distinct()
        fn = long.filter(l & ~p).select(key).distinct()
        return long.join(fp, key, "left_semi").join(fn, key, "left_semi")
    raise ValueError(kind)


def error_kinds(long: DataFrame, key: str = "pad_sen_id") -> DataFrame:
    """H4, all kinds in one pass: (kind, *columns) with a row per kind that a
    row is of. One aggregation per sentence, bounded by the domains."""
    others = [c for c in long.columns if c != key]
    l, p = F.col("labels") == 1, F.col("preds") == 1
    g = long.groupBy(key).agg(F.collect_list(F.struct(*others)).alias("_rows"),
                              (F.bool_or(~l & p) & F.bool_or(l & ~p)).alias("_both"))
    kinds = F.array_compact(F.array(F.when(F.col("labels") != F.col("preds"), "incorrect"), F.when(~l & p, "fp"),
                                    F.when(l & ~p, "fn"), F.when(F.col("_both"), "both")))
    return g.select(key, "_both", F.inline("_rows")).select(F.explode(kinds).alias("kind"), key, *others)


def sentence_outcomes(long: DataFrame, key: str = "pad_sen_id") -> DataFrame:
    """Per sentence, the domains that are false negatives, false positives,
    true positives and correct: one aggregation (one shuffle of the long
    rows); every confusion cell below is derived from these short arrays."""
    l, p, d = F.col("labels"), F.col("preds"), F.col("domains")
    return long.groupBy(key).agg(
        F.collect_set(F.when((l == 1) & (p == 0), d)).alias("fn"),
        F.collect_set(F.when((l == 0) & (p == 1), d)).alias("fp"),
        F.collect_set(F.when((l == 1) & (p == 1), d)).alias("tp"),
        F.collect_set(F.when(l == p, d)).alias("ok"))


def _cells_counts(o):
    return F.flatten(F.transform("fn", lambda g: F.transform(F.filter("fp", lambda e: e != g),
                                                              lambda e: F.struct(e.alias("predicted"), g.alias("gold")))))


def _cells_true_pos(o):
    return F.transform("tp", lambda g: F.struct(g.alias("predicted"), g.alias("gold")))


def _cells_missed(o):
    alone = F.filter("fn", lambda g: F.size(F.filter("fp", lambda e: e != g)) == 0)
    return F.transform(alone, lambda g: F.struct(F.lit(NONE).alias("predicted"), g.alias("gold")))


def _cells_spurious(o, strict: bool = False):
    if strict:
        sel = F.when(F.size("fn") == 0, F.col("fp")).otherwise(F.array().cast("array<string>"))
    else:
        sel = F.filter("fp", lambda e: F.exists("ok", lambda x: x != e))
    return F.transform(sel, lambda e: F.struct(e.alias("predicted"), F.lit(NONE).alias("gold")))


def _count_cells(o: DataFrame, cells) -> DataFrame:
    return o.select(F.inline(cells)).groupBy("predicted", "gold").agg(F.count("*").alias("n"))


def confusion_counts(long: DataFrame, key: str = "pad_sen_id") -> DataFrame:
    """H5: gold d missed and e wrongly predicted in the same sentence."""
    o = sentence_outcomes(long, key)
    return _count_cells(o, _cells_counts(o)).select("gold", "predicted", "n")


def confusion_true_pos(long: DataFrame) -> DataFrame:
    """H6: correct positives per domain (the diagonal)."""
    return long.filter((F.col("labels") == 1) & (F.col("preds") == 1)).groupBy(F.col("domains").alias("gold")) \
               .agg(F.count("*").alias("n")).withColumn("predicted", F.col("gold"))


def confusion_missed(long: DataFrame, key: str = "pad_sen_id") -> DataFrame:
    """H7: sentences where d is missed and no other domain is wrongly
    predicted (the 'none' row)."""
    o = sentence_outcomes(long, key)
    return _count_cells(o, _cells_missed(o))


def confusion_spurious(long: DataFrame, key: str = "pad_sen_id", strict: bool = False) -> DataFrame:
    """H8: sentences where d is predicted spuriously and some other domain
    is correct (literal, quirk Q16); ``strict`` instead requires that no
    domain was missed in the sentence."""
    o = sentence_outcomes(long, key)
    return _count_cells(o, _cells_spurious(o, strict))


def confusion_matrix(long: DataFrame, domains: Sequence[str] = DOMAINS, key: str = "pad_sen_id") -> DataFrame:
    """H9: H5-H8 in one long matrix (rows = predicted, columns = gold) with
    the 'none' row and column; missing cells are 0. Single pass: every
    sentence emits its cells, one aggregation counts them."""
    o = sentence_outcomes(long, key)
    cells = F.concat(_cells_counts(o), _cells_true_pos(o), _cells_missed(o), _cells_spurious(o))
    counted = _count_cells(o, cells)
    names = list(domains) + [NONE]
    spark = long.sparkSession
    grid = spark.createDataFrame([(r, c) for r in names for c in names if not (r == NONE and c == NONE)],
                                 "predicted string, gold string")
    return grid.join(F.broadcast(counted), ["predicted", "gold"], "left") \
               .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("bigint"))


def domain_rows(df: DataFrame, columns: Mapping[str, tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    """(*keep, domain, gold, pred): a row per domain of each row, from ``columns`` = domain -> (gold column, prediction column)."""
    pairs = [F.struct(F.lit(dm).alias("domain"), F.col(g).cast("double").alias("gold"), F.col(p).cast("double").alias("pred"))
             for dm, (g, p) in columns.items()]
    return df.select(*keep, F.inline(F.array(*pairs)))


def regression_metrics(df: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE over rows with both values, one row per ``by``."""
    d = df.filter(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    e = F.col(gold) - F.col(pred)
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                 F.sqrt(F.avg(e * e)).alias("rmse"))


def regression_note_metrics(df: DataFrame, note: str, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Note means of gold and prediction, NULL gold dropped, metrics,
    with note counts before and after dropping, one row per ``by``."""
    per = df.groupBy(*by, note).agg(F.avg(gold).alias("_g"), F.avg(pred).alias("_p"))
    ok = F.col("_g").isNotNull() & F.col("_p").isNotNull()
    e = F.when(ok, F.col("_g") - F.col("_p"))
    return per.groupBy(*by).agg(F.count("*").alias("n_notes"), F.count(e).alias("n_with_gold"), F.avg(F.abs(e)).alias("mae"),
                   F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"))


def lrap(df: DataFrame, labels: str = "labels", scores: str = "scores") -> DataFrame:
    """Label ranking average precision, per row with higher-order
    array functions (no shuffle), then averaged. Rows with no or only true
    labels score 1."""
    z = F.arrays_zip(F.col(labels).alias("l"), F.col(scores).alias("s"))
    true = F.filter(z, lambda x: x["l"] == 1)

    def prec_at(x):
        ge = F.filter(z, lambda y: y["s"] >= x["s"])
        return F.size(F.filter(ge, lambda y: y["l"] == 1)) / F.size(ge)

    n_true = F.size(true)
    row = F.when((n_true == 0) | (n_true == F.size(z)), F.lit(1.0)).otherwise(
        F.aggregate(F.transform(true, prec_at), F.lit(0.0), lambda a, b: a + b) / n_true)
    return df.select(row.alias("_r")).agg(F.avg("_r").alias("lrap"), F.count("*").alias("n_rows"))
