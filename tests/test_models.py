"""The five models' predictions and metrics against plain Python."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import DoubleType, StructField, StructType

import __spark_entry__ as E
from noteframe.operators import model as M

SF = "/root/testdata/sf0.001"
MODELS = {"logistic", "naive_bayes", "decision_tree", "random_forest", "knn"}


def test_metrics_are_those_of_the_predictions(spark):
    by = defaultdict(list)
    for r in E.queries()["model_predictions"](spark, SF).collect():
        by[r["model"], r["split"]].append((r["label"], r["pred"]))
    assert {m for m, _ in by} == MODELS
    seen = {y for y, _ in by["knn", "train"]}
    got = {(r["model"], r["split"]): (r["n"], r["accuracy"], r["macro_f1"]) for r in E.queries()["fitted_model_metrics"](spark, SF).collect()}
    assert set(got) == set(by)
    for key, pairs in by.items():
        classes = {c for p in pairs for c in p}
        f1 = [2 * sum(y == p == c for y, p in pairs) / (sum(y == c for y, _ in pairs) + sum(p == c for _, p in pairs)) for c in classes]
        accuracy = sum(y == p for y, p in pairs) / len(pairs)
        assert got[key][0] == len(pairs) and abs(got[key][1] - accuracy) < 1e-12 and abs(got[key][2] - sum(f1) / len(f1)) < 1e-12
        assert {p for _, p in pairs} <= seen
        assert accuracy > Counter(y for y, _ in pairs).most_common(1)[0][1] / len(pairs)
    valid = {(r["model"], r["split"]): (r["n"], r["valid"], r["bayes_accuracy"]) for r in E.queries()["model_metrics"](spark, SF).collect()}
    assert valid == {k: (v[0], True, v[1] if k[0] == "naive_bayes" else None) for k, v in got.items()}  # all five models
    assert all(got[m, "train"][1] > 0.9 for m in ("decision_tree", "random_forest"))


def test_trees_keep_the_node_of_a_row_and_are_the_same(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4)).round(1)
    rows = [(float(int(v[0] + v[1] > 0) + int(v[2] > 1)), Vectors.dense(v.tolist())) for v in x]
    train = spark.createDataFrame(rows, StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])).repartition(3).cache()
    models = M.fit_classifiers(train)
    assert list(models) == ["logistic", "naive_bayes", "decision_tree", "random_forest"]
    how = dict(impurity="entropy", seed=0, maxDepth=30, maxBins=256)
    for name, plain in (("decision_tree", DecisionTreeClassifier(**how)), ("random_forest", RandomForestClassifier(numTrees=10, **how))):
        assert models[name].getCacheNodeIds()
        assert models[name].toDebugString.split("\n", 1)[1] == plain.fit(train).toDebugString.split("\n", 1)[1]
    train.unpersist()


def test_neighbours_come_from_all_training_rows(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(M, "MAX_FIT_ROWS", 5)
    monkeypatch.setattr(M.knn_classify, "__defaults__", tuple(5 if v == 20_000 else v for v in M.knn_classify.__defaults__))
    from noteframe.plans import q_model
    sets = q_model._model_sets(spark, SF).cache()
    monkeypatch.setattr(M, "fit_classifiers", lambda train: asked.append(train.count()) or {})
    got = {(r["NotitieID"]): r["pred"] for r in q_model._predictions(sets).collect()}
    from noteframe.operators import timeline
    rows = sorted((r["NotitieID"], r["split"], r["label"], np.array([r[c] for c in timeline.FEATURES])) for r in sets.collect())
    train = [r for r in rows if r[1] == "train"]
    p = np.array([r[3] for r in train])
    for i, _, _, v in rows:
        votes = [train[j][2] for j in np.argsort(np.sqrt(((v - p) ** 2).sum(axis=1)), kind="stable")[:7]]
        assert got[i] == min(set(votes), key=lambda x: (-votes.count(x), x))
    assert asked == [len(train)] and len(train) > 5
    sets.unpersist()
