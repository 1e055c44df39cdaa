"""Routing, scaling and classical models.

Models use ``pyspark.ml``; k-NN finds the neighbours among all labelled rows,
cell by cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route_by_domain(long: DataFrame, dom_col: str = "domains", pred: str = "preds") -> DataFrame:
    """Sentences predicted positive for a domain, tagged with it (write
    with ``partitionBy(dom_col)`` to hand each domain's model its input)."""
    return long.filter(F.col(pred) == 1)


def standard_scale(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Zero mean / unit variance with the population deviation (as
    sklearn), fitted on the training rows only (quirk Q18 fixed)."""
    # one row of 2 x len(cols) numbers: fetched once and inlined as literals
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()

    def apply(df):
        scaled = {}
        for c in cols:
            m, sd = row[f"m_{c}"], row[f"s_{c}"]
            if m is None:
                continue
            centred = F.col(c) - F.lit(float(m))
            scaled[c] = centred / F.lit(float(sd)) if sd else centred
        return df.withColumns(scaled)
    return apply(train), apply(test)


def model_features(df: DataFrame, target: str, feature_cols: Sequence[str], out: str = "features") -> DataFrame:
    """Target first as ``label``, features assembled into a vector.
    Incomplete rows are an error: drop them first (B22), in plain sight."""
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(feature_cols), outputCol=out, handleInvalid="error")
    return va.transform(df.withColumn("label", F.col(target).cast("double"))).select("label", out, *[
        c for c in df.columns if c not in feature_cols and c != target])


def fit_classifiers(train: DataFrame, features: str = "features", label: str = "label", seed: int = 0,
                    max_depth: int = 30, max_bins: int = 256, penalty: float = 1.0) -> dict:
    """Multinomial logistic regression, Gaussian naive Bayes, entropy
    decision tree and 10-tree entropy random forest.

    ``max_depth`` is the deepest tree that Spark grows and ``max_bins`` the
    split points it tries per feature; ``penalty`` is the L2 weight of the
    whole log-likelihood sum (Spark's own parameter is per row). Rows keep the
    node they have reached, so that a pass over deep trees does not walk them
    from the root; the fits run side by side, because many of their jobs are
    too short to fill the cores. Neither changes a model."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression, NaiveBayes,
                                           RandomForestClassifier)
    n = max(train.count(), 1)
    trees = dict(featuresCol=features, labelCol=label, impurity="entropy", seed=seed, maxDepth=max_depth, maxBins=max_bins,
                 cacheNodeIds=True)
    est = {
        "logistic": LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", maxIter=100,
                                       regParam=penalty / n, standardization=False),
        "naive_bayes": NaiveBayes(featuresCol=features, labelCol=label, modelType="gaussian"),
        "decision_tree": DecisionTreeClassifier(**trees),
        "random_forest": RandomForestClassifier(numTrees=10, **trees),
    }
    fit = inheritable_thread_target(train.sparkSession)(lambda e: e.fit(train))
    with ThreadPool(len(est)) as pool:
        return dict(zip(est, pool.map(fit, est.values())))


#: Labelled rows of a k-NN model that is asked to be bounded: a seeded draw where there are more.
MAX_FIT_ROWS = 20_000


def knn_classify(train: DataFrame, test: DataFrame, k: int = 7, id_col: str = "id", vec: str = "vec",
                 label: str = "label", max_fit_rows: int | None = None, seed: int = 0) -> DataFrame:
    """K nearest neighbours (Euclidean) and majority vote (ties:
    smallest label; neighbour ties: smallest train id).

    All labelled rows are fitted, in cells of bounded size that queries meet by
    a shuffle (:mod:`noteframe.operators.knn`). Only a caller that sets
    ``max_fit_rows`` gets a bounded model: the matrix of a seeded draw of so
    many rows, which goes to the workers once. Queries stream past it: each
    Arrow batch takes matrix products to find candidates, whose distances are
    then taken exactly (:class:`noteframe.operators.knn.nearest_rows`)."""
    from noteframe.operators.knn import nearest_rows
    from noteframe.operators.sampling import cap_sample
    if max_fit_rows is None:
        from noteframe.operators.knn import classify_exact
        return classify_exact(train, test, k, id_col, vec, label)
    fitted = cap_sample(train.select(F.col(id_col).alias("i"), F.col(vec).cast("array<double>").alias("v"), F.col(label).alias("l")),
                        "i", max_fit_rows, seed).orderBy("i").collect()
    points = np.array([r["v"] for r in fitted], dtype="float64").reshape(len(fitted), -1)
    names = sorted({r["l"] for r in fitted} - {None}) + [None]
    code = {name: i for i, name in enumerate(names)}
    model = train.sparkSession.sparkContext.broadcast((points, np.array([code[r["l"]] for r in fitted], dtype="int64")))
    kind = train.schema[label].dataType
    fit = nearest_rows(k)

    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p, codes = model.value
        near = fit(p)
        for vectors in batches:
            votes = codes[near(np.vstack(vectors.to_numpy()).astype("float64"))] if len(vectors) else np.zeros((0, 1), np.int64)
            n = (votes[:, :, None] == votes[:, None, :]).sum(axis=2)
            best = np.where(n == n.max(axis=1, keepdims=True), votes, len(names)).min(axis=1)  # names are in order
            yield pd.Series([names[c] for c in best], dtype="object")
    if not len(points):
        return test.withColumn("pred", F.lit(None).cast(kind))
    return test.withColumn("pred", F.pandas_udf(vote, kind)(F.col(vec).cast("array<double>")))


def classifier_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                       by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(accuracy + macro F1 over the union of classes seen in gold or
    predictions, one row per ``by``) and the confusion counts (label, pred,
    n). Everything derives from the confusion counts, grouped once."""
    cm = df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("label").alias("c"), hit.alias("tp"), F.col("n").alias("ng"), zero.alias("np")),
                    F.struct(F.col("pred").alias("c"), zero.alias("tp"), zero.alias("ng"), F.col("n").alias("np")))
    per = cm.select(*by, F.inline(sides)).groupBy(*by, "c").agg(F.sum("tp").alias("tp"), F.sum("ng").alias("ng"), F.sum("np").alias("np"))
    f1 = F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"), F.col("ng") + F.col("np")), F.lit(0.0))
    summary = per.groupBy(*by).agg((F.sum("tp") / F.sum("ng")).alias("accuracy"), F.sum("ng").alias("n"), F.avg(f1).alias("macro_f1"))
    return summary, cm
