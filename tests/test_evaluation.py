"""H-rows against hand-computed / brute-force results."""

import numpy as np

from pyspark.sql import functions as F

from noteframe.operators import agreement as AG
from noteframe.operators import evaluate as EV
from noteframe.operators import model as M


def test_prf_zero_when_undefined(spark):
    long = spark.createDataFrame([("s1", "A", 1, 1), ("s2", "A", 0, 1), ("s1", "B", 0, 0)],
                                 "pad_sen_id string, domains string, labels int, preds int")
    r = {x["domains"]: x for x in EV.prf_sentence(long).collect()}
    assert r["A"]["precision"] == 0.5 and r["A"]["recall"] == 1.0 and r["B"]["f1"] == 0.0


def test_confusion_matrix_cells(spark):
    rows = [("s1", "A", 1, 0), ("s1", "B", 0, 1), ("s1", "C", 1, 1), ("s2", "A", 1, 0), ("s2", "B", 0, 0)]
    long = spark.createDataFrame(rows, "pad_sen_id string, domains string, labels int, preds int")
    m = {(r["predicted"], r["gold"]): r["n"] for r in EV.confusion_matrix(long, ["A", "B", "C"]).collect()}
    assert m[("B", "A")] == 1 and m[("C", "C")] == 1 and m[("none", "A")] == 1 and m[("B", "none")] == 1


def test_lrap_brute_force(spark):
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, (30, 5))
    scores = rng.random((30, 5))
    df = spark.createDataFrame([(l.tolist(), s.tolist()) for l, s in zip(labels, scores)], "labels array<int>, scores array<double>")
    got = EV.lrap(df).first()["lrap"]
    tot = 0.0
    for l, s in zip(labels, scores):
        t = np.flatnonzero(l)
        if len(t) in (0, len(l)):
            tot += 1
            continue
        tot += np.mean([((s >= s[j]) & (l == 1)).sum() / (s >= s[j]).sum() for j in t])
    assert abs(got - tot / len(labels)) < 1e-9


def test_fleiss_kappa_hand_example(spark):
    # 3 raters, 4 notes; domain flags per rater
    votes = {"n1": [1, 1, 1], "n2": [0, 0, 0], "n3": [1, 0, 0], "n4": [1, 1, 0]}
    rows = [(n, f"r{i}", bool(v)) for n, vs in votes.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "NotitieID string, annotator string, ADM boolean")
    got = AG.fleiss_kappa(df, ["ADM"]).first()["kappa"]
    n, N = 3, 4
    t = np.array([sum(v) for v in votes.values()])
    tab = np.stack([n - t, t], 1)
    P = ((tab ** 2).sum(1) - n) / (n * (n - 1))
    p = tab.sum(0) / (N * n)
    pe = (p ** 2).sum()
    assert abs(got - (P.mean() - pe) / (1 - pe)) < 1e-12


def test_pair_outcome_rules(spark):
    ml = spark.createDataFrame([("s", "a", [1, 0, 1]), ("s", "b", [1, 1, 0])],
                               "pad_sen_id string, annotator string, labels array<int>")
    o = {r["domain"]: r["outcome"] for r in AG.pair_outcome(ml, ["X", "Y", "Z"]).collect()}
    assert o == {"X": "true positive", "Y": "false positive", "Z": "confusion"}


def test_knn_exact_vs_brute_force(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(120, 4))
    y = rng.integers(0, 3, 120)
    df = spark.createDataFrame([(i, X[i].tolist(), int(y[i])) for i in range(120)], "id int, vec array<double>, label int")
    tr, te = df.filter("id < 90"), df.filter("id >= 90")
    got = {r["id"]: r["pred"] for r in M.knn_classify(tr, te, k=7).collect()}
    for q in range(90, 120):
        d = np.sqrt(((X[:90] - X[q]) ** 2).sum(1))
        nn = np.lexsort((np.arange(90), d))[:7]
        cnt = np.bincount(y[nn], minlength=3)
        assert got[q] == int(np.flatnonzero(cnt == cnt.max())[0])


def test_classifier_metrics_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, pred int")
    s, cm = M.classifier_metrics(df)
    r = s.first()
    assert r["accuracy"] == 0.5 and abs(r["macro_f1"] - (2 / 3 + 0.5 + 0.0) / 3) < 1e-12
    assert cm.filter(F.col("n") > 0).count() == 4
