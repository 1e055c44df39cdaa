"""Model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import LEVEL_COLS
from noteframe.functions.hashing import sql_md5_bucket as H
from noteframe.operators import clean as C
from noteframe.operators import model as M
from noteframe.operators import sampling as S
from noteframe.operators import timeline as E
from noteframe.plans import bindings as b
from noteframe.plans import q_timeline as QT
from noteframe.plans import tokens as TK
from noteframe.plans.registry import register

_SEED = TK.SPLIT_SEED


def _split_sql(base: str, group: str, test: float = 0.2) -> str:
    return f"""SELECT t.*, s.split FROM ({base}) t JOIN (
  SELECT {group}, CASE WHEN r < n_test THEN 'test' ELSE 'train' END AS split FROM (
    SELECT {group}, row_number() OVER (ORDER BY {H(str(_SEED), group)}, {group}) - 1 AS r, ceil({test} * count(*) OVER ()) AS n_test
    FROM (SELECT DISTINCT {group} FROM ({base})))) s USING ({group})"""


_TL_SPLIT = _split_sql(b.TIMELINE_SQL, "MDN")


@register("standard_scale", f"""WITH t AS ({_TL_SPLIT}), st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in LEVEL_COLS)}
  FROM t WHERE split = 'train')
SELECT NotitieID, split, {', '.join(f'CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE {c} - m_{c} END AS {c}' for c in LEVEL_COLS)} FROM t, st""")
def standard_scale_q(spark, d):
    """H27 (+S9): scaler of all nine levels, fitted on the training patients, applied to both."""
    t = S.group_split_2way(b.timeline(spark, d), "MDN", 0.2, _SEED)
    tr, te = M.standard_scale(t.filter("split = 'train'"), t.filter("split = 'test'"), LEVEL_COLS)
    return tr.unionByName(te).select("NotitieID", "split", *LEVEL_COLS)


def _emb_split(spark, d):
    e = b.table(spark, d, "embeddings")
    return S.group_split_2way(e, "vec_id", 0.2, _SEED)


def _knn(spark, d):
    e = _emb_split(spark, d)
    return M.knn_classify(e.filter("split = 'train'"), e.filter("split = 'test'"), k=7, id_col="vec_id",
                          vec="embedding", label="label", max_fit_rows=M.MAX_FIT_ROWS)  # as in the SQL


_E_SPLIT = _split_sql("SELECT * FROM embeddings", "vec_id")
_KNN_SQL = f"""WITH e AS ({_E_SPLIT}), q AS (SELECT vec_id AS qid, embedding AS qv, label FROM e WHERE split = 'test'),
tr AS (SELECT vec_id AS tid, embedding AS tv, label AS tl FROM e WHERE split = 'train'
  QUALIFY row_number() OVER (ORDER BY {H('0', 'vec_id')}, vec_id) <= {M.MAX_FIT_ROWS}),
dd AS (SELECT qid, tid, tl, sqrt(list_sum(list_transform(range(1, len(qv) + 1), lambda i: (CAST(qv[i] AS DOUBLE) - CAST(tv[i] AS DOUBLE)) ^ 2))) AS d FROM q, tr),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS r FROM dd) WHERE r <= 7),
v AS (SELECT qid, tl, count(*) AS n FROM nn GROUP BY ALL),
best AS (SELECT qid AS vec_id, tl AS pred FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, tl) AS r FROM v) WHERE r = 1)
SELECT q.qid AS vec_id, q.label, best.pred FROM q JOIN best ON q.qid = best.vec_id"""


@register("knn_classify", _KNN_SQL)
def knn_classify_q(spark, d):
    """H29 (+S9): exact 7-NN majority vote on the embeddings."""
    return _knn(spark, d).select("vec_id", "label", "pred")


@register("classifier_metrics", f"""WITH k AS ({_KNN_SQL}), c AS (SELECT label AS c FROM k UNION SELECT pred FROM k),
per AS (SELECT c, (SELECT count(*) FROM k WHERE label = c AND pred = c) AS tp, (SELECT count(*) FROM k WHERE label = c) AS ng,
  (SELECT count(*) FROM k WHERE pred = c) AS np FROM c)
SELECT (SELECT avg(CAST(label = pred AS DOUBLE)) FROM k) AS accuracy, (SELECT count(*) FROM k) AS n,
  avg(coalesce(2 * tp / NULLIF(ng + np, 0), 0)) AS macro_f1 FROM per""")
def classifier_metrics_q(spark, d):
    """Accuracy and macro F1 of the k-NN predictions."""
    summary, _ = M.classifier_metrics(_knn(spark, d), "label", "pred")
    return summary


@register("classifier_confusion", f"SELECT label, pred, count(*) AS n FROM ({_KNN_SQL}) GROUP BY ALL")
def classifier_confusion_q(spark, d):
    """Confusion counts (label, pred)."""
    _, cm = M.classifier_metrics(_knn(spark, d), "label", "pred")
    return cm


# ---- the feature table's models: drop incomplete, round, split by patient, scale, fit, score
_TARGET = "CAST(CASE WHEN ADM_lvl - floor(ADM_lvl) = 0.5 THEN 2 * round(ADM_lvl / 2) ELSE round(ADM_lvl) END AS INTEGER)"
_COMPLETE_SQL = (f"SELECT MDN, NotitieID, {_TARGET} AS label, {', '.join(E.FEATURES)} FROM ({QT.FEATURE_SQL}) WHERE "
                 + " AND ".join(f"{c} IS NOT NULL" for c in ["ADM_lvl", *E.FEATURES]))
_SET_SQL = _split_sql(_COMPLETE_SQL, "MDN")


def _model_sets(spark, d):
    """(NotitieID, label, split, scaled features): one table for all models of a query, written once."""
    from noteframe.session import cut_lineage
    t = C.drop_incomplete_rows(QT.features(spark, d), ["ADM_lvl", *E.FEATURES])
    t = cut_lineage(t.select("MDN", "NotitieID", F.bround("ADM_lvl").cast("int").alias("label"), *E.FEATURES))
    t = S.group_split_2way(t, "MDN", 0.2, _SEED)
    tr, te = M.standard_scale(t.filter("split = 'train'"), t.filter("split = 'test'"), E.FEATURES)
    return cut_lineage(tr.unionByName(te).select("NotitieID", "label", "split", *E.FEATURES))


def _predictions(sets):
    """(model, NotitieID, split, label, pred) of the five models on training and test rows."""
    feat = M.model_features(sets.withColumn("gold", F.col("label")), "label", E.FEATURES)
    out = [m.transform(feat).select(F.lit(name).alias("model"), "NotitieID", "split", F.col("gold").alias("label"),
                                    F.col("prediction").cast("int").alias("pred"))
           for name, m in M.fit_classifiers(feat.filter("split = 'train'")).items()]
    rows = sets.select("NotitieID", "split", "label", F.array(*E.FEATURES).alias("vec"))
    knn = M.knn_classify(rows.filter("split = 'train'"), rows, id_col="NotitieID", max_fit_rows=None)  # all rows are fitted
    out.append(knn.select(F.lit("knn").alias("model"), "NotitieID", "split", "label", "pred"))
    for p in out[1:]:
        out[0] = out[0].unionByName(p)
    return out[0]


@register("model_features", f"""WITH t AS ({_SET_SQL}), st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in E.FEATURES)}
  FROM t WHERE split = 'train')
SELECT NotitieID, label, split, {', '.join(f'CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE {c} - m_{c} END AS {c}' for c in E.FEATURES)} FROM t, st""")
def model_features_q(spark, d):
    """H31 (+B22, B21, S9, H27): complete rows, rounded target, split by patient, scaled features."""
    return _model_sets(spark, d)


_MODELS = ("logistic", "naive_bayes", "decision_tree", "random_forest", "knn")


@register("fit_classifiers", f"""SELECT model, split, count(*) AS n, true AS known_class, true AS beats_majority
FROM ({_SET_SQL}), (SELECT unnest({list(_MODELS)}) AS model) GROUP BY model, split""")
def fit_classifiers_q(spark, d):
    """Per model and split the rows scored, whether every prediction is a class seen in
    training, and whether the accuracy exceeds the share of the most frequent class."""
    sets = _model_sets(spark, d)
    p = _predictions(sets)
    classes = F.broadcast(sets.filter("split = 'train'").groupBy("label").count()  # one row per level
                          .agg(F.collect_set("label").alias("classes")))
    flags = (p.join(classes, F.lit(True)).groupBy("model", "split")
             .agg(F.count("*").alias("n"), F.bool_and(F.array_contains("classes", F.col("pred"))).alias("known_class"),
                  F.avg((F.col("label") == F.col("pred")).cast("int")).alias("acc")))
    most = (p.filter("model = 'knn'").groupBy("split", "label").count()
            .groupBy("split").agg((F.max("count") / F.sum("count")).alias("top")))
    return (flags.join(most, "split").select("model", "split", "n", "known_class", (F.col("acc") > F.col("top")).alias("beats_majority")))


@register("model_predictions")
def model_predictions_q(spark, d):
    """The five models' prediction of every row (model, NotitieID, split, label, pred). SQL cannot fit them; tested on the rows."""
    return _predictions(_model_sets(spark, d))


_BAYES_SQL = f"""WITH t AS ({_SET_SQL}), raw AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in E.FEATURES)}
  FROM t WHERE split = 'train'),
x AS (SELECT NotitieID, split, label, {', '.join(f'CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE {c} - m_{c} END AS {c}' for c in E.FEATURES)} FROM t, raw),
eps AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({c})' for c in E.FEATURES)}) AS e FROM x WHERE split = 'train'),
cl AS (SELECT label AS c, ln(count(*)) AS prior, {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) + any_value(e) AS v_{c}' for c in E.FEATURES)}
  FROM x, eps WHERE split = 'train' GROUP BY label),
s AS (SELECT NotitieID, split, label, c, prior - 0.5 * ({' + '.join(f'(ln(v_{c}) + (x.{c} - m_{c}) ^ 2 / v_{c})' for c in E.FEATURES)}) AS score FROM x, cl)
SELECT NotitieID, split, label, arg_max(c, score) AS pred FROM s GROUP BY NotitieID, split, label"""


@register("naive_bayes_predictions", _BAYES_SQL)
def naive_bayes_predictions_q(spark, d):
    """Predictions of the Gaussian naive Bayes model on all rows."""
    from pyspark.ml.classification import NaiveBayes
    feat = M.model_features(_model_sets(spark, d).withColumn("gold", F.col("label")), "label", E.FEATURES)
    nb = NaiveBayes(modelType="gaussian").fit(feat.filter("split = 'train'"))
    return nb.transform(feat).select("NotitieID", "split", F.col("gold").alias("label"), F.col("prediction").cast("int").alias("pred"))


@register("model_metrics", f"""WITH p AS ({_BAYES_SQL}), c AS (SELECT split, label AS c FROM p UNION SELECT split, pred FROM p),
per AS (SELECT split, c, (SELECT count(*) FROM p WHERE p.split = c.split AND label = c AND pred = c) AS tp,
  (SELECT count(*) FROM p WHERE p.split = c.split AND label = c) AS ng, (SELECT count(*) FROM p WHERE p.split = c.split AND pred = c) AS np FROM c),
nb AS (SELECT 'naive_bayes' AS model, split, sum(tp) / sum(ng) AS accuracy, avg(coalesce(2 * tp / NULLIF(ng + np, 0), 0)) AS macro_f1 FROM per GROUP BY split),
every AS (SELECT model, split, count(*) AS n FROM ({_SET_SQL}), (SELECT unnest({list(_MODELS)}) AS model) GROUP BY model, split)
SELECT model, split, n, true AS valid, accuracy AS bayes_accuracy, macro_f1 AS bayes_macro_f1 FROM every LEFT JOIN nb USING (model, split)""")
def model_metrics_q(spark, d):
    """Metrics of all five models on training and test rows: rows scored, whether accuracy and macro F1 are
    in range, and both numbers of the model that SQL can fit (all numbers: fitted_model_metrics)."""
    summary, _ = M.classifier_metrics(_predictions(_model_sets(spark, d)), by=("model", "split"))
    bayes = F.col("model") == "naive_bayes"
    return summary.select("model", "split", "n", (F.col("accuracy").between(0, 1) & F.col("macro_f1").between(0, 1)).alias("valid"),
                          F.when(bayes, F.col("accuracy")).alias("bayes_accuracy"), F.when(bayes, F.col("macro_f1")).alias("bayes_macro_f1"))


@register("fitted_model_metrics")
def fitted_model_metrics_q(spark, d):
    """Accuracy and macro F1 of all five models on training and test rows. SQL cannot fit them; tested against the predictions."""
    summary, _ = M.classifier_metrics(_predictions(_model_sets(spark, d)), by=("model", "split"))
    return summary.select("model", "split", "n", "accuracy", "macro_f1")
