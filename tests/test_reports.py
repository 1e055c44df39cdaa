"""D-rows against numpy / hand counts."""

import numpy as np

from noteframe.operators import report as R


def test_value_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random(300) * 7.3 - 1.1, np.linspace(-1.1, 6.2, 11)])   # includes every edge
    df = spark.createDataFrame([(float(v),) for v in x], "a double")
    got = {r["bin"]: r["n"] for r in R.value_histogram(df, ["a"]).collect()}
    counts, _ = np.histogram(x, bins=10)
    assert [got.get(i, 0) for i in range(10)] == counts.tolist()


def test_notes_per_patient_hist_right_closed(spark):
    rows = [("p1",)] * 25 + [("p2",)] * 26 + [("p3",)] * 700
    df = spark.createDataFrame(rows, "MDN string")
    h = {(r["bin_lo"], r["bin_hi"]): r["n_patients"] for r in R.notes_per_patient_hist(df).collect()}
    assert h[(0, 25)] == 1 and h[(25, 50)] == 1 and h[(475, 500)] == 1 and len(h) == 20


def test_bins_reach_a_cap_that_is_no_multiple(spark):
    df = spark.createDataFrame([("p1",)] * 600 + [("p2",)] * 505, "MDN string")
    h = {(r["bin_lo"], r["bin_hi"]): r["n_patients"] for r in R.notes_per_patient_hist(df, width=25, cap=510).collect()}
    assert h[(500, 525)] == 2 and sum(h.values()) == 2 and len(h) == 21


def test_histogram_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(2.0, None)] * 3, "a double, b double")
    got = {(r["column"], r["bin"]): r["n"] for r in R.value_histogram(df, ["a", "b"]).collect()}
    assert [got["a", i] for i in range(10)] == np.histogram([2.0] * 3, bins=10)[0].tolist()
    assert [got["b", i] for i in range(10)] == [0] * 10


def test_tiers_without_patients_have_zeros(spark):
    df = spark.createDataFrame([("p", True)] * 3, "MDN string, annotated boolean")
    got = {r["tier"]: tuple(r)[1:] for r in R.activity_tier_summary(df, [2, 5]).collect()}
    assert got == {2: (1, 3, 0, 3), 5: (0, 0, 0, 0)}


def test_kappa_leaves_single_rater_notes_out(spark):
    from noteframe.operators.agreement import fleiss_kappa
    votes = [("n1", "a", True), ("n1", "b", True), ("n2", "a", False), ("n2", "b", False), ("n3", "a", True)]
    df = spark.createDataFrame(votes, "NotitieID string, annotator string, D boolean")
    assert fleiss_kappa(df, ["D"]).first()["kappa"] == 1.0


def test_wide_crosstab_equals_pandas(spark, tmp_path):
    """Patients found from the data, dealt into narrow blocks; a date without notes of a block's patients is a row of zeros."""
    import datetime as dt
    import random

    import pandas as pd

    from noteframe.operators import report as R
    rng = random.Random(3)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(12)), f"p {rng.randrange(23)}.{i % 2}") for i in range(150)] + [(None, "p"), (dt.date(2020, 1, 2), None)]
    df = spark.createDataFrame(rows, "Notitiedatum date, MDN string")
    path = str(tmp_path / "x")
    R.write_crosstab(df, path, "Notitiedatum", "MDN", 7)
    pdf = pd.DataFrame(rows, columns=df.columns).dropna()
    want = pd.crosstab(pdf.Notitiedatum, pdf.MDN)
    blocks = [R.read_crosstab_block(spark, path, i).toPandas().set_index("Notitiedatum").sort_index() for i in range(-(-want.shape[1] // 7))]
    got = pd.concat(blocks, axis=1)
    assert all(b.shape[1] <= 7 for b in blocks) and list(got.columns) == sorted(want.columns)
    assert (got[want.columns].to_numpy() == want.to_numpy()).all() and list(got.index) == list(want.index)
    long = {(r["Notitiedatum"], r["id"]): r["n"] for r in R.read_crosstab(spark, path).collect()}
    assert long == {(d, i): n for d, line in want.iterrows() for i, n in line.items() if n}
