"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS, LEVEL_COLS
from noteframe.functions.hashing import md5_bucket, sql_md5_bucket as H
from noteframe.operators import assemble as A
from noteframe.operators import cohort as CO
from noteframe.operators import evaluate as EV
from noteframe.operators import sampling as S
from noteframe.plans import tokens as TK
from noteframe.plans.registry import register
from noteframe.session import write_shared

_L = TK.LONG_SQL


def _prf_sql(base: str, by: str = "domains", digits: int | None = 2) -> str:
    r = (lambda x: f"round_even({x}, {digits})") if digits is not None else (lambda x: x)
    return f"""SELECT {by}, {r('coalesce(tp / NULLIF(tp + fp, 0), 0)')} AS precision, {r('coalesce(tp / NULLIF(tp + fn, 0), 0)')} AS recall,
  {r('coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0)')} AS f1, tp + fn AS support FROM (
  SELECT {by}, count(*) FILTER (WHERE labels = 1 AND preds = 1) AS tp, count(*) FILTER (WHERE labels = 0 AND preds = 1) AS fp,
         count(*) FILTER (WHERE labels = 1 AND preds = 0) AS fn FROM ({base}) GROUP BY {by})"""


@register("explode_multilabel", _L)
def explode_multilabel_q(spark, d):
    """H1 (+B15 flatten nested predictions, B25 pick the model column)."""
    return TK.long_preds(spark, d)


@register("prf_sentence", _prf_sql(_L))
def prf_sentence_q(spark, d):
    """H2: precision/recall/F1/support per domain, sentence level."""
    return EV.prf_sentence(TK.long_preds(spark, d))


_NOTE_ANY = ("SELECT NotitieID, domains, CAST(max(labels) AS INTEGER) AS labels, CAST(max(preds) AS INTEGER) AS preds, "
             f"max(labels) = max(preds) AS correct FROM ({_L}) GROUP BY NotitieID, domains")


@register("note_any_labels", _NOTE_ANY)
def note_any_labels_q(spark, d):
    """Note-level any() of gold and predictions per domain."""
    return A.note_any_labels(TK.long_preds(spark, d))


@register("prf_note", _prf_sql(_NOTE_ANY))
def prf_note_q(spark, d):
    """H3: the same after D5."""
    return EV.prf_note(TK.long_preds(spark, d))


@register("error_rows", f"""SELECT 'incorrect' AS kind, pad_sen_id, domains FROM ({_L}) WHERE labels <> preds
UNION ALL SELECT 'fp', pad_sen_id, domains FROM ({_L}) WHERE labels = 0 AND preds = 1
UNION ALL SELECT 'fn', pad_sen_id, domains FROM ({_L}) WHERE labels = 1 AND preds = 0
UNION ALL SELECT 'both', pad_sen_id, domains FROM ({_L}) WHERE pad_sen_id IN (SELECT pad_sen_id FROM ({_L}) WHERE labels = 0 AND preds = 1)
  AND pad_sen_id IN (SELECT pad_sen_id FROM ({_L}) WHERE labels = 1 AND preds = 0)""")
def error_rows_q(spark, d):
    """H4: incorrect rows, false positives, false negatives, both-kinds."""
    return EV.error_kinds(TK.long_preds(spark, d)).select("kind", "pad_sen_id", "domains")


_FN = f"SELECT pad_sen_id, domains AS gold FROM ({_L}) WHERE labels = 1 AND preds = 0"
_FP = f"SELECT pad_sen_id, domains AS predicted FROM ({_L}) WHERE labels = 0 AND preds = 1"
_H5 = f"SELECT gold, predicted, count(*) AS n FROM ({_FN}) JOIN ({_FP}) USING (pad_sen_id) WHERE gold <> predicted GROUP BY ALL"
_H6 = f"SELECT domains AS gold, domains AS predicted, count(*) AS n FROM ({_L}) WHERE labels = 1 AND preds = 1 GROUP BY ALL"
_H7 = (f"SELECT gold, 'none' AS predicted, count(DISTINCT pad_sen_id) AS n FROM ({_FN}) f WHERE NOT EXISTS ("
       f"SELECT 1 FROM ({_FP}) p WHERE p.pad_sen_id = f.pad_sen_id AND p.predicted <> f.gold) GROUP BY gold")
_H8 = (f"SELECT 'none' AS gold, predicted, count(DISTINCT pad_sen_id) AS n FROM ({_FP}) p WHERE EXISTS ("
       f"SELECT 1 FROM ({_L}) c WHERE c.pad_sen_id = p.pad_sen_id AND c.labels = c.preds AND c.domains <> p.predicted) GROUP BY predicted")


@register("confusion_counts", _H5)
def confusion_counts_q(spark, d):
    """H5: (gold missed, other predicted) pairs per sentence."""
    return EV.confusion_counts(TK.long_preds(spark, d))


@register("confusion_true_pos", _H6)
def confusion_true_pos_q(spark, d):
    """H6: diagonal."""
    return EV.confusion_true_pos(TK.long_preds(spark, d))


@register("confusion_missed", _H7)
def confusion_missed_q(spark, d):
    """H7: missed with nothing else wrongly predicted."""
    return EV.confusion_missed(TK.long_preds(spark, d))


@register("confusion_spurious", _H8)
def confusion_spurious_q(spark, d):
    """H8: spurious with some other domain correct (literal Q16)."""
    return EV.confusion_spurious(TK.long_preds(spark, d))


_NAMES = DOMAINS + ["none"]


@register("confusion_matrix", "WITH cells AS (" + " UNION ALL ".join(
    f"SELECT predicted, gold, n FROM ({q})" for q in (_H5, _H6, _H7, _H8)) + "), grid AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{r}', '{c}')" for r in _NAMES for c in _NAMES if not (r == "none" and c == "none"))
    + ") g(predicted, gold)) SELECT predicted, gold, CAST(coalesce(n, 0) AS BIGINT) AS n FROM grid LEFT JOIN cells USING (predicted, gold)")
def confusion_matrix_q(spark, d):
    """H9: the full matrix with 'none' row/column, zeros filled."""
    return EV.confusion_matrix(TK.long_preds(spark, d))


def _lvl_preds(spark, d):
    """Sentences with the nine gold levels and a prediction of each."""
    lv = A.sentence_mean_levels(TK.clean(spark, d))
    noise = lambda dm: (md5_bucket("pad_sen_id", F.lit("lvl"), F.lit(dm)) % 5 - 2).cast("double") * 0.25
    return lv.withColumns({f"pred_levels_{dm}_sents": F.coalesce(F.col(f"{dm}_lvl"), F.lit(2.0)) + noise(dm) for dm in DOMAINS})


_LEVEL_PAIRS = {dm: (f"{dm}_lvl", f"pred_levels_{dm}_sents") for dm in DOMAINS}
_LV_SQL = f"SELECT pad_sen_id, NotitieID, {', '.join(f'avg({c}) AS {c}' for c in LEVEL_COLS)} FROM ({TK.CLEAN_SQL}) GROUP BY ALL"
_LVLP_SQL = " UNION ALL ".join(
    f"SELECT pad_sen_id, NotitieID, '{dm}' AS domain, {dm}_lvl AS gold, "
    f"coalesce({dm}_lvl, 2.0) + CAST({H('pad_sen_id', chr(39) + 'lvl' + chr(39), chr(39) + dm + chr(39))} % 5 - 2 AS DOUBLE) * 0.25 AS pred FROM lv"
    for dm in DOMAINS)
_LVLP_CTE = f"lv AS ({_LV_SQL}), lp AS ({_LVLP_SQL})"


def _level_rows(spark, d):
    """(pad_sen_id, NotitieID, domain, gold, pred) of all nine domains."""
    return EV.domain_rows(_lvl_preds(spark, d), _LEVEL_PAIRS, ["pad_sen_id", "NotitieID"])


@register("regression_note_metrics", f"""WITH {_LVLP_CTE}, per AS (SELECT domain, NotitieID, avg(gold) AS g, avg(pred) AS p FROM lp GROUP BY ALL),
e AS (SELECT domain, CASE WHEN g IS NOT NULL AND p IS NOT NULL THEN g - p END AS e FROM per)
SELECT domain, count(*) AS n_notes, count(e) AS n_with_gold, avg(abs(e)) AS mae, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse FROM e GROUP BY domain""")
def regression_note_metrics_q(spark, d):
    """H10 (+D6): note means of gold and predicted level, MAE/MSE/RMSE of each of the nine domains."""
    return EV.regression_note_metrics(_level_rows(spark, d), "NotitieID", "gold", "pred", by=["domain"])


@register("regression_sentence_metrics", f"""WITH {_LVLP_CTE} SELECT domain, count(*) AS n, avg(abs(gold - pred)) AS mae,
  avg((gold - pred) ^ 2) AS mse, sqrt(avg((gold - pred) ^ 2)) AS rmse FROM lp WHERE gold IS NOT NULL GROUP BY domain""")
def regression_sentence_metrics_q(spark, d):
    """MAE/MSE/RMSE on sentence rows, per domain."""
    return EV.regression_metrics(_level_rows(spark, d), "gold", "pred", by=["domain"])


@register("mean_preds_per_note", f"WITH {_LVLP_CTE} SELECT NotitieID, " + ", ".join(
    f"avg(pred) FILTER (domain = '{dm}') AS pred_levels_{dm}_sents" for dm in DOMAINS) + " FROM lp GROUP BY NotitieID")
def mean_preds_per_note_q(spark, d):
    """Mean level prediction per note, nine domains."""
    return A.mean_preds_per_note(_lvl_preds(spark, d), "NotitieID", [p for _, p in _LEVEL_PAIRS.values()])


_LRAP_LONG = ("SELECT pad_sen_id, unnest(range(1, 10)) AS j, unnest(labels) AS l, unnest(scores) AS s FROM (" + TK.PRED_SQL + ")")


@register("lrap", f"""WITH z AS ({_LRAP_LONG}),
row_stats AS (SELECT pad_sen_id, count(*) FILTER (WHERE l = 1) AS n_true, count(*) AS n_all FROM z GROUP BY 1),
per_true AS (SELECT a.pad_sen_id, count(*) FILTER (WHERE b.s >= a.s AND b.l = 1) / count(*) FILTER (WHERE b.s >= a.s) AS prec
  FROM z a JOIN z b USING (pad_sen_id) WHERE a.l = 1 GROUP BY a.pad_sen_id, a.j),
per_row AS (SELECT r.pad_sen_id, CASE WHEN n_true = 0 OR n_true = n_all THEN 1.0 ELSE avg(prec) END AS v
  FROM row_stats r LEFT JOIN per_true USING (pad_sen_id) GROUP BY r.pad_sen_id, n_true, n_all)
SELECT avg(v) AS lrap, count(*) AS n_rows FROM per_row""")
def lrap_q(spark, d):
    """Label ranking average precision of the scores."""
    return EV.lrap(TK.predictions(spark, d), "labels", "scores")


@register("join_sentence_context", f"""SELECT l.pad_sen_id, domains, coalesce(background_sent, false) OR coalesce(target_sent, false) AS background,
  labels = preds AS correct FROM ({_L}) l LEFT JOIN (SELECT pad_sen_id, background_sent, target_sent FROM ({TK.SENT_SQL})) USING (pad_sen_id)""")
def join_sentence_context_q(spark, d):
    """C11: background flag and correctness on long predictions."""
    j = CO.join_sentence_context(TK.long_preds(spark, d), TK.sentences(spark, d))
    return j.select("pad_sen_id", "domains", "background", "correct")


@register("slice_by_predicted_domain", f"""WITH {_LVLP_CTE}, pos AS (SELECT DISTINCT pad_sen_id, NotitieID, domains FROM ({_L}) WHERE preds = 1)
SELECT 'sent' AS unit, pad_sen_id, domain AS domains, gold FROM lp WHERE (pad_sen_id, domain) IN (SELECT (pad_sen_id, domains) FROM pos)
UNION ALL SELECT 'note', pad_sen_id, domain, gold FROM lp WHERE (NotitieID, domain) IN (SELECT (NotitieID, domains) FROM pos)""")
def slice_by_predicted_domain_q(spark, d):
    """Level rows of each domain whose sentence / note was predicted to be of it."""
    # both are written, without the text: they are read once per unit
    lv = write_shared(_level_rows(spark, d).select("pad_sen_id", "NotitieID", F.col("domain").alias("domains"), "gold"), "level-rows")
    lp = write_shared(TK.long_preds(spark, d).select("pad_sen_id", "NotitieID", "domains", "preds"), "long-preds")
    cut = [CO.slice_by_predicted_domain(lv, lp, None, unit).select(F.lit(unit).alias("unit"), "pad_sen_id", "domains", "gold")
           for unit in ("sent", "note")]
    return cut[0].unionByName(cut[1])


@register("route_by_domain", f"SELECT domains, count(*) AS n_sentences FROM ({_L}) WHERE preds = 1 GROUP BY 1")
def route_by_domain_q(spark, d):
    """Sentences routed to each domain's level model (counted)."""
    from noteframe.operators.model import route_by_domain
    return route_by_domain(TK.long_preds(spark, d)).groupBy("domains").agg(F.count("*").alias("n_sentences"))


@register("example_sample", f"""SELECT kind, domains, pad_sen_id FROM (SELECT 'fp' AS kind, domains, pad_sen_id, row_number() OVER (
  PARTITION BY domains ORDER BY {H('7', 'pad_sen_id')}, pad_sen_id) AS r FROM ({_L}) WHERE labels = 0 AND preds = 1) WHERE r = 1
UNION ALL SELECT kind, domains, pad_sen_id FROM (SELECT 'fn' AS kind, domains, pad_sen_id, row_number() OVER (
  PARTITION BY domains ORDER BY {H('7', 'pad_sen_id')}, pad_sen_id) AS r FROM ({_L}) WHERE labels = 1 AND preds = 0) WHERE r = 1""")
def example_sample_q(spark, d):
    """One seeded false positive and false negative per domain."""
    lp = TK.long_preds(spark, d)
    fp = S.example_sample(lp, None, "fp", 1, 7).select(F.lit("fp").alias("kind"), "domains", "pad_sen_id")
    fn = S.example_sample(lp, None, "fn", 1, 7).select(F.lit("fn").alias("kind"), "domains", "pad_sen_id")
    return fp.unionByName(fn)
