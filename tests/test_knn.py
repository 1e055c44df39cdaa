"""Exact neighbours in blocks against brute force."""

import numpy as np
import pytest

from noteframe.operators import knn as K
from noteframe.operators import model as M


def frames(spark, seed, n=300, m=80, dim=5, unit=False, grid=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n + m, dim)) * rng.lognormal(0, 1, size=(n + m, 1))
    if grid:
        x = np.round(x)  # many equal distances and copies
    if unit:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    labels = rng.integers(0, 4, n + m)
    rows = [(int(i), [float(f) for f in v], int(c), "x") for i, (v, c) in enumerate(zip(x, labels))]
    make = lambda r: spark.createDataFrame(r, "id long, vec array<double>, label int, block string").repartition(3)
    return make(rows[:n]), make(rows[n:]), x[:n], labels[:n], x[n:]


def by_hand(p, labels, q, k):
    d = np.sqrt(((q[:, None, :] - p[None]) ** 2).sum(axis=2))
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("kind", [{}, {"unit": True}, {"grid": True}])
def test_nearest_equals_brute_force(spark, kind):
    train, test, p, labels, q = frames(spark, 4 + len(kind), **kind)
    got = {}
    for r in K.nearest(train, test, 7, "id", "vec", "label", fit_rows=29, query_rows=16).collect():
        got[r["query"], r["rank"]] = (r["id"], r["distance"], r["label"])
    ids, d = by_hand(p, labels, q, 7)
    assert len(got) == 7 * len(q)
    for i in range(len(q)):
        for j in range(7):
            near, far, label = got[300 + i, j + 1]
            assert near == ids[i, j] and abs(far - d[i, j]) < 1e-9 and label == labels[near]


def test_classify_without_bound_equals_the_matrix_form(spark):
    train, test, *_ = frames(spark, 9)
    want = {r["id"]: r["pred"] for r in M.knn_classify(train, test).collect()}
    got = M.knn_classify(train, test, max_fit_rows=None)
    assert got.columns == [*test.columns, "pred"]
    assert {r["id"]: r["pred"] for r in got.collect()} == want


def test_few_rows_nulls_and_nothing(spark):
    train = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, None, "c")], "id long, vec array<double>, label string")
    test = spark.createDataFrame([(10, [1.0, 0.1], "z"), (11, None, "z"), (12, [0.0, float("nan")], "z")], "id long, vec array<double>, label string")
    assert {r["id"]: r["pred"] for r in K.classify_exact(train, test, 7).collect()} == {10: "a", 11: None, 12: None}
    assert {r["id"]: r["pred"] for r in K.classify_exact(train, test, 1).collect()} == {10: "a", 11: None, 12: None}
    assert {r["pred"] for r in K.classify_exact(train.limit(0), test).collect()} == {None}
    assert K.classify_exact(train, test.limit(0)).count() == 0


def test_groups_of_different_norms(spark):
    """Groups of very different norms, where a first block already holds the neighbours."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(f) for f in rng.normal(size=3) + 100 * (i % 5)], i % 5) for i in range(500)]
    train = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    test = spark.createDataFrame([(1000 + i, v, 0) for i, v, _ in rows[:50]], "id long, vec array<double>, label int")
    assert {r["id"]: r["pred"] for r in K.classify_exact(train, test, 3, fit_rows=50, query_rows=10).collect()} == {1000 + i: i % 5 for i in range(50)}


def test_bounded_neighbours_keep_ties_to_the_smaller_id(spark):
    """200 copies of a point, more than the candidates that were measured: the 7 of smallest id vote."""
    rng = np.random.default_rng(7)
    p = np.vstack([rng.normal(size=(1500, 4)), np.zeros((200, 4)), rng.normal(size=(1500, 4))])
    q = np.vstack([np.zeros((1, 4)), p[:40], rng.normal(size=(40, 4)), 1e6 * rng.normal(size=(3, 4))])
    labels = rng.permutation(len(p)) % 5
    labels[1500:1700] = 0
    labels[1500:1504] = 3
    ids, _ = by_hand(p, labels, q, 7)
    assert (K.nearest_rows(7)(p)(q) == ids).all()
    make = lambda v, lab, at: spark.createDataFrame([(at + i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(v, lab))], "id long, vec array<double>, label int")
    got = {r["id"]: r["pred"] for r in M.knn_classify(make(p, labels, 0), make(q, [0] * len(q), 10_000)).collect()}
    assert got == {10_000 + i: int(np.bincount(labels[near]).argmax()) for i, near in enumerate(ids)}
    assert got[10_000] == 3


@pytest.mark.parametrize("n", [1, 5, 33, 700])
def test_bounded_neighbours_of_few_points(n):
    rng = np.random.default_rng(n)
    p, q = rng.normal(size=(n, 3)).round(), rng.normal(size=(70, 3)).round()
    assert (K.nearest_rows(7)(p)(q) == by_hand(p, None, q, 7)[0]).all()


def test_all_fitted_rows_are_neighbours(spark):
    """More rows than the bound of a bounded model, on purpose: each row is its own nearest one."""
    n = M.MAX_FIT_ROWS + 500
    rows = spark.range(n).selectExpr("id", "array(double(id % 151), double(id div 151)) AS vec", "int(id % 7) AS label")
    got = M.knn_classify(rows, rows.where("id % 4 = 0"), k=1)
    assert got.where("pred = label").count() == (n + 3) // 4
    assert M.knn_classify(rows, rows, k=1, max_fit_rows=M.MAX_FIT_ROWS).where("pred <> label").count() > 0


@pytest.mark.parametrize("how", [{}, {"fit_rows": 40, "query_rows": 50}])
def test_repeated_and_missing_ids_labels_and_equal_points(spark, how):
    rows = [(i % 40 if i % 9 else None, [float(i % 3), 1.0], "abc"[i % 3] if i % 5 else None) for i in range(300)]
    rows += [(7, [50.0, 50.0], "z"), (8, None, "z"), (9, [float("inf"), 0.0], "z")]
    train = spark.createDataFrame(rows, "id int, vec array<double>, label string").repartition(5)
    fitted = sorted((r for r in rows if r[1] and r[1][0] < 100), key=lambda r: (r[0] is not None, r[0] or 0, r[2] is not None, r[2] or ""))
    asked = [(None, [0.0, 1.0], "x"), (1, [1.0, 1.0], "x"), (1, [1.0, 1.0], "x"), (1, [2.0, 1.1], "x"), (2, [49.0, 49.0], "x"), (3, [-900.0, 3.0], "x")]
    want = []
    for i, v, c in asked:
        near = sorted(fitted, key=lambda r: np.sqrt(((np.array(v) - np.array(r[1])) ** 2).sum()))[:7]
        votes = [r[2] for r in near]
        want.append((i, v, c, min(set(votes), key=lambda x: (-votes.count(x), x is None, x or ""))))
    test = spark.createDataFrame(asked, "id int, vec array<double>, label string")
    got = [tuple(r) for r in K.classify_exact(train, test, 7, **how).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_search_within_a_cell_equals_brute_force():
    rng = np.random.default_rng(11)
    p, q = rng.normal(size=(5000, 6)).round(1), rng.normal(size=(900, 6)).round(1)
    ids, d = by_hand(p, None, q, 7)
    answer = K._tools()[3](p, p, 7)
    for bound in (np.full(len(q), np.inf), d[:, -1].copy()):
        got = np.full(ids.shape, -1)
        for some, a, b, far, _ in answer(q, q, bound):
            assert len(a) == 7 * len(some)
            got[some] = b.reshape(-1, 7)
            assert np.allclose(far.reshape(-1, 7), d[some])
        assert (got == ids).all()
