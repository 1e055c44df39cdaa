"""Operators on embeddings against brute force, and their defined results for odd rows."""
import numpy as np
import pytest

from noteframe.llm import neardup, queries, topk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1),
            (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [1.0, None], 1), (10, [inf, 1.0], 1), (11, [1.0], 1),
            (None, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (12, [-1.0, 0.0], 1)]
    rows = [r + ("x", 3) for r in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string, filter int")


def test_top_k_equals_brute_force(spark):
    got = {(r[0], r[1]): (r[2], r[3]) for r in queries.QUERIES["op1_top_k"](spark, SF).collect()}
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    v = np.floor(1024 * np.stack([np.asarray(e, float) for e in t.embedding])).astype(np.int64)
    want = {}
    for i in np.flatnonzero(t.vec_id % 100 == 0):
        s = v @ v[i]
        order = [j for j in np.lexsort((t.vec_id, -s)) if j != i][:10]
        want |= {(t.vec_id[i], r + 1): (t.vec_id[j], s[j]) for r, j in enumerate(order)}
    assert got == want


@pytest.mark.parametrize("lists", [1, 2, 5])
def test_top_k_with_ties_and_any_number_of_lists(spark, lists):
    rng = np.random.default_rng(lists)
    v = rng.integers(-3, 4, (300, 7)).astype(float) * 3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 10 = 0"), k=7, lists=lists, scale=1).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 300, 10):
        s = (v @ v[q]).astype(int)
        order = [j for j in np.lexsort((np.arange(300), -s)) if j != q][:7]
        want += [(q, r + 1, j, s[j]) for r, j in enumerate(order)]
    assert got == want


def test_top_k_odd_rows(odd_vectors):
    rows = topk.top_k(odd_vectors, odd_vectors.where("vec_id IN (0, 5, 8)"), scale=1).collect()
    assert {r["query_id"] for r in rows} == {0}
    assert [(r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 2), (2, 1), (3, 1), (4, 1), (11, 1), (7, 0), (12, -1)]
    none = odd_vectors.where("false")
    assert topk.top_k(none, none).collect() == []


def links(ids, labels, vectors, cosine=0.98):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (u @ u.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], comp.max()).min(axis=1))
        if (new == comp).all():
            return near.sum(axis=1), comp
        comp = new


def test_near_duplicates_equal_brute_force_with_a_large_group(spark):
    rng = np.random.default_rng(12)
    spread = rng.normal(size=(1500, 64))
    hot = rng.normal(size=64) + rng.normal(size=(700, 64)) * rng.choice([0.05, 0.1, 0.14], (700, 1))
    v = np.r_[spread, hot, hot[:50], spread[:300] + rng.normal(size=(300, 64)) * 0.14]
    label = rng.integers(0, 3, len(v))
    ids = rng.permutation(len(v))
    df = spark.createDataFrame([(int(i), x.tolist(), int(b)) for i, x, b in zip(ids, v, label)], "vec_id long, embedding array<double>, label int")
    got = neardup.near_duplicates(df).toPandas().set_index("vec_id").loc[ids]
    n, comp = links(ids, label, v)
    assert (got.n_links.values == n).mean() > 0.999 and got.n_links.sum() >= 0.9999 * n.sum() and (got.n_links.values <= n).all()
    assert (got.component_id.values == comp).all() and (got.kept.values == (comp == ids)).all()


def test_near_duplicates_odd_rows(odd_vectors):
    rows = neardup.near_duplicates(odd_vectors).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == 14 and got[None] == (0, None, None)
    assert got[0] == (2, 0, True) and got[1] == (2, 0, False) and got[2] == (2, 0, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert neardup.near_duplicates(odd_vectors.where("false")).collect() == []


def test_list_decoding_is_complete():
    rng = np.random.default_rng(13)
    code = neardup.ProductCode(6, 5)
    u = rng.normal(size=(40, 6))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    (a, b, first), (c, d, second) = code.blocks
    turned = u @ code.turn
    full = (turned[:, a:b] @ first.T)[:, :, None] + (turned[:, c:d] @ second.T)[:, None, :]
    full = full.reshape(40, -1)
    best, rows, names = code.decode(u, 0.3)
    assert (best == full.argmax(axis=1)).all()
    assert set(zip(rows.tolist(), names.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(full >= full.max(axis=1, keepdims=True) - 0.3))))
