"""E-rows against brute force on small literal timelines."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from noteframe.operators import timeline as E


def _df(spark, rows):
    return spark.createDataFrame(rows, "MDN string, Notitiedatum date, k int, v double")


def test_gaps_discharge_followups(spark):
    d0 = dt.date(2020, 1, 1)
    days = [0, 1, 2, 4, 7, 77, 80, 170]      # gaps 1,1,2,3,...; discharge after day 4 (gap 3)
    rows = [("p", d0 + dt.timedelta(x), i, None) for i, x in enumerate(days)]
    g = E.filter_max_gap(E.next_note_gap(_df(spark, rows)))
    f = E.follow_up_flags(E.discharge_date(g)).collect()
    assert {r["discharge_date"] for r in f} == {d0 + dt.timedelta(4)}
    assert all(r["first_follow_up"] and r["second_follow_up"] for r in f)


def test_row_windows_match_pandas(spark):
    vals = [None, 1.0, None, None, 4.0, 2.0, None, 3.0, None]
    rows = [("p", dt.date(2020, 1, 1) + dt.timedelta(i), i, v) for i, v in enumerate(vals)]
    df = _df(spark, rows)
    s = pd.Series(vals, dtype="float64")
    got = E.interpolate_linear(df, "MDN", ["k"], "v", "vi").orderBy("k").toPandas()["vi"]
    pd.testing.assert_series_equal(got, s.interpolate(), check_names=False)
    r = E.rolling_stats(df, "MDN", ["k"], "v", windows=[3], aggs=["mean"]).orderBy("k").toPandas()
    pd.testing.assert_series_equal(r["rolling_mean_3"], s.rolling(3).mean(), check_names=False)
    x = E.expanding_mean(df, "MDN", ["k"], "v").orderBy("k").toPandas()["expanding_mean"]
    pd.testing.assert_series_equal(x, s.expanding(2).mean(), check_names=False)
    bf = E.backfill(df, "MDN", ["k"], "v", "b").orderBy("k").toPandas()["b"]
    pd.testing.assert_series_equal(bf, s.bfill(), check_names=False)


def test_align_and_trim(spark):
    days = [0, 1, 5, 6]
    rows = [("p", dt.date(2020, 1, 1) + dt.timedelta(x), i, None) for i, x in enumerate(days)]
    t = E.day_difference(E.align_time(_df(spark, rows)), ["k"])
    assert [r["Dif"] for r in t.orderBy("k").collect()] == [0, 1, 4, 1]
    assert E.trim_first_admission(t, ["k"]).count() == 2
    assert E.trim_first_admission(t, ["k"], mode="row").count() == 3


def test_every_slicing_matches_pandas(spark):
    """A patient cut into many slices, slices with one row of a patient, and NULL runs across slices."""
    import random
    rnd = random.Random(5)
    rows = []
    for p, n in (("hot", 300), ("a", 7), ("b", 2), (None, 5), *((f"s{i}", 1) for i in range(20))):
        for i in range(n):
            v = None if rnd.random() < 0.25 or 100 < i < 160 else float(rnd.randint(0, 4))
            rows.append((p, dt.date(2020, 1, 1) + dt.timedelta(i // 3), i, v))
    df = _df(spark, rows).withColumn("Dif", F.col("k") % 11)
    order = ["Notitiedatum", "k"]
    pdf = pd.DataFrame(rows, columns=["MDN", "Notitiedatum", "k", "v"]).fillna({"MDN": "-"}).sort_values(["MDN", "k"])
    g = pdf.groupby("MDN").v
    each = lambda f: g.transform(f).values
    want = {"lag1": each(lambda x: x.shift(1)), "lag3": each(lambda x: x.shift(3)), "vi": each(lambda x: x.interpolate()),
            "vb": each(lambda x: x.bfill()), "vf": each(lambda x: x.interpolate().bfill()), "expanding_mean": each(lambda x: x.expanding(2).mean())}
    for n in (3, 7):
        for a in ("mean", "sum", "min", "max"):
            want[f"rolling_{a}_{n}"] = each(lambda x: getattr(x.rolling(n), a)())
    pdf["cut"] = (pdf.k % 11 >= 9).groupby(pdf.MDN).cummax()
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for n in (1, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert E.slices(df, "MDN", order).select("_pid").distinct().count() >= n * 0.7
            made = {"lag1": E.lag_features(df, "MDN", order, "v", [1, 3]), "lag3": E.lag_features(df, "MDN", order, "v", [1, 3]),
                    "vi": E.interpolate_linear(df, "MDN", order, "v", "vi"), "vb": E.backfill(df, "MDN", order, "v", "vb"),
                    "vf": E.fill_levels(df, "MDN", order, "v", "vf"), "expanding_mean": E.expanding_mean(df, "MDN", order, "v")}
            rolled = E.rolling_stats(df, "MDN", order, "v")
            for c, values in want.items():
                got = made.get(c, rolled).fillna({"MDN": "-"}).toPandas().sort_values(["MDN", "k"])[c].astype(float).values
                assert np.allclose(got, values.astype(float), equal_nan=True), c
            kept = E.trim_first_admission(df, order, "MDN", "Dif", 9).fillna({"MDN": "-"}).toPandas()
            assert set(zip(kept.MDN, kept.k)) == set(zip(pdf.MDN[~pdf.cut], pdf.k[~pdf.cut]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def features_by_hand(pdf, max_gap):
    """The feature table per patient with pandas; rows come in order."""
    out = []
    for _, g in pdf.groupby("MDN", sort=False):
        days = (pd.to_datetime(g.Notitiedatum) - pd.to_datetime(g.Notitiedatum).min()).dt.days
        dif = days.diff().fillna(0).clip(lower=0)
        stays = ~(dif >= max_gap).cummax()
        g = g.assign(Days_count=days, Dif=dif)[stays]
        v = g.v.interpolate().bfill()
        g = g.assign(v=v, avg_domains=pd.concat([v, g.w], axis=1).mean(axis=1), expanding_mean=v.expanding(2).mean(),
                     **{f"lag{k}": v.shift(k) for k in (1, 2, 3)},
                     **{f"rolling_{a}_{n}": getattr(v.rolling(n), a)() for n in (3, 7) for a in ("mean", "sum", "min", "max")})
        out.append(g)
    return pd.concat(out)


def test_feature_table_is_one_scan_over_any_slices(spark):
    """Long runs without values over several slices, admissions that end in another slice, patients in every slicing."""
    import random
    rnd = random.Random(11)
    rows = []
    for p, n, step, empty in (("a1", 160, 2, (0, 40)), ("a2", 160, 2, (30, 90)), ("a3", 120, 1, (60, 120)), ("b", 90, 3, (10, 20)), ("c", 60, 1, (0, 60)),
                              *((f"s{i}", 1 + i % 4, 2, (0, i % 3)) for i in range(25))):
        day = 0
        for i in range(n):
            day += rnd.choice([0, 0, 1, step]) if i != n * 2 // 3 else 9
            v = None if rnd.random() < 0.3 or empty[0] <= i < empty[1] else float(rnd.randint(0, 4))
            rows.append((p, dt.date(2020, 1, 1) + dt.timedelta(day), i, v, None if rnd.random() < 0.5 else float(i % 5)))
    rows = [(*r, "x") for r in rows]
    df = spark.createDataFrame(rows, "MDN string, Notitiedatum date, k int, v double, w double, note string")
    want = features_by_hand(pd.DataFrame(rows, columns=df.columns), 3).sort_values(["MDN", "k"])
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for n in (1, 60):
            spark.conf.set(keys[0], n)
            spark.conf.set(keys[1], "false")
            table = E.feature_table(df, ["v", "w"], ["Notitiedatum", "k"], target="v")
            got = table.toPandas().sort_values(["MDN", "k"])
            assert list(zip(got.MDN, got.k)) == list(zip(want.MDN, want.k)) and set(got.note) == {"x"}
            for c in ("v", *E.FEATURES):
                assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c
            plan = table._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") - plan.count("ReusedExchange") < 15
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
