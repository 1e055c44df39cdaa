"""Per-patient timeline operators.

Patient-level facts (first date, discharge date, follow-up flags, group
sizes) are hash aggregations joined back, not whole-partition windows, so
a very active patient is pre-aggregated map-side and the join can be split
by AQE's skew handling. Gap logic runs on *distinct* (patient, date) rows,
which a calendar bounds per patient no matter how many notes there are.
Row-order features (lag, rolling, expanding, fills) are one segmented scan
(:mod:`noteframe.operators.segments`), whatever the size of a patient.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteframe.operators.segments import (Frames, Tail, any_so_far, bring, expanding, interpolated, known, lag_of, last_of_earlier,
                                          next_known, on_line, rolling_of, segmented_scan, shifted, slices)


def next_note_gap(df: DataFrame, id_col: str = "MDN", date: str = "Notitiedatum") -> DataFrame:
    """Per patient, distinct dates in order, the next date and the gap
    in days (NULL for the last date)."""
    dd = df.select(id_col, date).distinct()
    w = Window.partitionBy(id_col).orderBy(date)
    return dd.withColumn("date_next_note", F.lead(date).over(w)).withColumn(
        "delta_note_dates", F.datediff("date_next_note", date))


def filter_max_gap(gaps: DataFrame, id_col: str = "MDN", min_dates: int = 5, gap: int = 2) -> DataFrame:
    """Patients with >= ``min_dates`` distinct dates whose largest gap
    exceeds ``gap`` days (HAVING + semi-join)."""
    ok = (gaps.groupBy(id_col).agg(F.count("*").alias("_n"), F.max("delta_note_dates").alias("_g"))
              .filter((F.col("_n") >= min_dates) & (F.col("_g") > gap)).select(id_col))
    return gaps.join(ok, id_col, "left_semi")


def discharge_date(gaps: DataFrame, id_col: str = "MDN", date: str = "Notitiedatum", gap: int = 2) -> DataFrame:
    """Earliest date followed by a gap of more than ``gap`` days; plus
    the day offset of each date from it."""
    dis = gaps.groupBy(id_col).agg(F.min(F.when(F.col("delta_note_dates") > gap, F.col(date))).alias("discharge_date"))
    return gaps.join(dis, id_col, "left").withColumn("delta_discharge_date", F.datediff(date, "discharge_date"))


def follow_up_flags(dis: DataFrame, windows: Sequence[tuple[str, int, int]] = (("first_follow_up", 70, 110),
                                                                               ("second_follow_up", 160, 200)),
                    id_col: str = "MDN") -> DataFrame:
    """Per patient, has a date within each [start, end] day window after
    discharge (inclusive)."""
    aggs = [F.coalesce(F.bool_or(F.col("delta_discharge_date").between(a, b)), F.lit(False)).alias(n)
            for n, a, b in windows]
    flags = dis.groupBy(id_col).agg(*aggs)
    return dis.join(flags, id_col, "left")


def select_follow_up_patients(df: DataFrame, id_col: str = "MDN", date: str = "Notitiedatum",
                              max_notes: int = 100, min_dates: int = 5, gap: int = 2) -> DataFrame:
    """E5: notes of patients with both follow-ups and at most ``max_notes``."""
    g = filter_max_gap(next_note_gap(df, id_col, date), id_col, min_dates, gap)
    f = follow_up_flags(discharge_date(g, id_col, date, gap), id_col=id_col)
    pts = f.filter(F.col("first_follow_up") & F.col("second_follow_up")).select(id_col).distinct()
    sizes = df.join(pts, id_col, "left_semi").groupBy(id_col).agg(F.count("*").alias("_n"))
    keep = sizes.filter(F.col("_n") <= max_notes).select(id_col)
    return df.join(keep, id_col, "left_semi")


def align_time(df: DataFrame, id_col: str = "MDN", date: str = "Notitiedatum", out: str = "Days_count") -> DataFrame:
    """Days since the patient's earliest note (aggregate + join)."""
    first = df.groupBy(id_col).agg(F.min(date).alias("_first"))
    return df.join(first, id_col).withColumn(out, F.datediff(date, "_first")).drop("_first")


def lag_features(df: DataFrame, part: str, order: Sequence[str], col: str, lags: Sequence[int] = (1, 2, 3),
                 prefix: str = "lag") -> DataFrame:
    """Lag k of a column within the patient."""
    f = Frames(part, order)
    tail = Tail(f, col, df.schema[col].dataType.simpleString(), max(lags), "lag")
    made = {f"{prefix}{k}": lag_of(f, col, tail.number, tail.before, k) for k in lags}
    return segmented_scan(df, part, order, [tail.feature(made)])


def rolling_stats(df: DataFrame, part: str | None, order: Sequence[str], col: str, windows: Sequence[int] = (3, 7),
                  aggs: Sequence[str] = ("mean", "sum", "min", "max")) -> DataFrame:
    """N-row rolling mean/sum/min/max; NULL unless all n rows in the
    window are present and non-NULL (pandas ``rolling(n)``).
    ``part=None`` reproduces quirk Q15 (rolling across patients)."""
    if part is None:
        return rolling_stats(df.withColumn("_all", F.lit(0)), "_all", order, col, windows, aggs).drop("_all")
    f = Frames(part, order)
    tail = Tail(f, col, df.schema[col].dataType.simpleString(), max(windows) - 1, "roll")
    made = {k: v for n in windows for k, v in rolling_of(f, col, tail.number, tail.before, n, aggs).items()}
    return segmented_scan(df, part, order, [tail.feature(made)])


def day_difference(df: DataFrame, order: Sequence[str], id_col: str = "MDN", days: str = "Days_count",
                   out: str = "Dif") -> DataFrame:
    """Day number minus the previous row's, within the patient; first
    row 0, negatives clipped to 0."""
    f = Frames(id_col, order)
    tail = Tail(f, days, df.schema[days].dataType.simpleString(), 1, "dif")
    step = F.col(days) - lag_of(f, days, tail.number, tail.before, 1)
    return segmented_scan(df, id_col, order, [tail.feature({out: F.greatest(F.coalesce(step, F.lit(0)), F.lit(0))})])


def trim_first_admission(df: DataFrame, order: Sequence[str], id_col: str = "MDN", dif: str = "Dif",
                         max_gap: int = 3, mode: str = "first_admission") -> DataFrame:
    """``mode='row'`` drops only rows with a gap >= max_gap (literal);
    ``mode='first_admission'`` drops everything from the first such gap."""
    if mode == "row":
        return df.filter(F.col(dif) < max_gap)
    flag = F.coalesce((F.col(dif) >= max_gap).cast("int"), F.lit(0))
    seen = segmented_scan(df, id_col, order, [any_so_far(Frames(id_col, order), flag, "gap", "_gap")])
    return seen.filter("_gap = 0").drop("_gap")


def interpolate_linear(df: DataFrame, part: str, order: Sequence[str], col: str, out: str | None = None) -> DataFrame:
    """Linear fill by row position; leading NULLs stay, trailing NULLs
    take the last value (pandas ``interpolate()``)."""
    return segmented_scan(df, part, order, [interpolated(Frames(part, order), col, "lin", out or col)])


def backfill(df: DataFrame, part: str, order: Sequence[str], col: str, out: str | None = None) -> DataFrame:
    """Next non-NULL value (current row included)."""
    return segmented_scan(df, part, order, [next_known(Frames(part, order), col, "next", out or col)])


def fill_levels(df: DataFrame, part: str, order: Sequence[str], col: str, out: str | None = None) -> DataFrame:
    """E9 then E10: linear interpolation, then the leading gap takes the first value."""
    return segmented_scan(df, part, order, [interpolated(Frames(part, order), col, "fill", out or col, leading=True)])


def expanding_mean(df: DataFrame, part: str, order: Sequence[str], col: str, min_n: int = 2,
                   out: str = "expanding_mean") -> DataFrame:
    """Mean of all rows so far, NULL until ``min_n`` non-NULL values."""
    return segmented_scan(df, part, order, [expanding(Frames(part, order), col, "exp", min_n, out)])


def daily_resample(df: DataFrame, part: str, date: str, col: str, out: str = "value") -> DataFrame:
    """One row per calendar day from the first to the last date of the
    patient, daily mean, gaps filled linearly by row (E9)."""
    daily = df.groupBy(part, F.col(date).cast("date").alias("day")).agg(F.avg(col).alias(out))
    span = daily.groupBy(part).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    days = span.select(part, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    full = days.join(daily, [part, "day"], "left")
    return interpolate_linear(full, part, ["day"], out)


def row_mean_levels(df: DataFrame, cols: Sequence[str], out: str = "avg_domains") -> DataFrame:
    """Mean over the level columns of a row, skipping NULLs."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return df.withColumn(out, F.when(F.size(arr) > 0, total / F.size(arr)))


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Value -> 0-based rank among the sorted distinct values
    (distributed sort + zipWithIndex over the distinct values)."""
    from noteframe.operators.sampling import global_rank
    out = out or f"{col}_code"
    vals = df.select(col).distinct().filter(F.col(col).isNotNull())
    codes = global_rank(vals, [col], out)
    return df.join(codes, col, "left")


def patients_by_min_notes(df: DataFrame, col: str, n: int, id_col: str = "MDN") -> DataFrame:
    """Patients with at least ``n`` non-NULL values of ``col``."""
    return df.groupBy(id_col).agg(F.count(col).alias("_n")).filter(F.col("_n") >= n).select(id_col)


def _line_sum(a, b, p, q):
    """Sum over the positions ``a`` to ``b`` of what a gap between the known places ``p`` and ``q`` is filled with."""
    n = F.greatest(b - a + 1, F.lit(0))
    slope = (q["v"] - p["v"]) / (q["p"] - p["p"])
    between = n * p["v"] + slope * ((a + b) * n / 2 - n * p["p"])
    return F.when(n == 0, F.lit(0.0)).when(p.isNull(), n * q["v"]).when(q.isNull(), n * p["v"]).otherwise(between)


def feature_table(df: DataFrame, levels: Sequence[str], order: Sequence[str], target: str = "ADM_lvl",
                  id_col: str = "MDN", date: str = "Notitiedatum", max_gap: int = 3, lags: Sequence[int] = (1, 2, 3),
                  windows: Sequence[int] = (3, 7)) -> DataFrame:
    """E6-E13 and E15 as one segmented scan: days since the first note and
    since the previous one, notes of the first admission only, the target's
    gaps filled, its lags, the mean of all levels, rolling and expanding values.

    Rows are cut into slices once. A slice hands over its dates, whether a gap
    ends the admission in it, its first and last known value, the sum of what
    it can fill itself and its last rows with the known places around them; so
    one aggregation and one join serve all features, though lags and means are
    of filled values that may depend on later slices."""
    f = Frames(id_col, order)
    keep_n = max(max(lags), max(windows) - 1)
    flag = lambda d: F.coalesce((d >= max_gap).cast("int"), F.lit(0))
    rows = slices(df, id_col, order)
    rows = rows.withColumns({"_r": F.row_number().over(f.rows), "_prev": F.lag(date).over(f.rows), "_low": F.min(date).over(f.whole)})
    rows = rows.withColumn("_dif", F.when(F.col("_r") > 1, F.greatest(F.coalesce(F.datediff(date, "_prev"), F.lit(0)), F.lit(0))))
    rows = rows.withColumn("_cut", F.max(flag(F.col("_dif"))).over(f.so_far))
    stays = F.col("_cut") == 0
    here = F.when(stays, known("_r", F.col(target)))
    rows = rows.withColumns({"_lp": F.last(here, ignorenulls=True).over(f.so_far), "_ln": F.last(here, ignorenulls=True).over(f.from_end),
                             "_size": F.sum(stays.cast("int")).over(f.whole)})
    own = F.when(F.col(target).isNotNull(), F.col(target).cast("double")).when(
        F.col("_lp").isNotNull() & F.col("_ln").isNotNull(), on_line(F.col("_r"), F.col("_lp"), F.col("_ln")))
    last_rows = F.when(stays & (F.col("_size") - F.col("_r") < keep_n),
                       F.struct(F.col("_r").cast("long").alias("r"), F.col("_lp").alias("p"), F.col("_ln").alias("q")))
    rank = F.struct(*[F.col(c) for c in order])
    per = rows.groupBy(id_col, "_pid").agg(
        F.min("_low").alias("_low1"), F.min_by(date, rank).alias("_date1"), F.max_by(date, rank).alias("_dateN"), F.max("_cut").alias("_cut1"),
        F.max("_size").cast("long").alias("_n"), F.min(here).alias("_kf"), F.max(here).alias("_kl"), F.sum(F.when(stays, own)).alias("_sum"),
        F.array_sort(F.collect_list(last_rows)).alias("_last"))
    # what the slice's first row lacked: the date before it
    per = per.withColumns({"_date0": F.lag("_dateN").over(f.slices), "_low0": F.min("_low1").over(Window.partitionBy(id_col))})
    per = per.withColumn("_gap0", flag(F.greatest(F.coalesce(F.datediff("_date1", "_date0"), F.lit(0)), F.lit(0))))
    per = per.withColumn("_dead", F.greatest("_gap0", F.coalesce(F.max(F.greatest("_gap0", "_cut1")).over(f.earlier), F.lit(0))))
    alive = F.col("_dead") == 0
    per = per.withColumns({"_n": F.when(alive, F.col("_n")).otherwise(0), "_kf": F.when(alive, F.col("_kf")), "_kl": F.when(alive, F.col("_kl")),
                           "_last": F.when(alive, F.col("_last")).otherwise(F.slice("_last", 1, 0))})
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(f.earlier), F.lit(0)))
    per = per.withColumns({"_kf": shifted(F.col("_kf"), F.col("_off")), "_kl": shifted(F.col("_kl"), F.col("_off"))})
    per = per.withColumns({"_pp": F.last("_kl", ignorenulls=True).over(f.earlier), "_nn": F.last("_kf", ignorenulls=True).over(f.later)})
    start, end = F.col("_off") + 1, F.col("_off") + F.col("_n")
    pp, nn, kf, kl = (F.col(c) for c in ("_pp", "_nn", "_kf", "_kl"))
    filled_sum = (F.when(kf.isNotNull(), F.col("_sum") + _line_sum(start, kf["p"] - 1, pp, kf) + _line_sum(kl["p"] + 1, end, kl, nn))
                  .when(pp.isNotNull() | nn.isNotNull(), _line_sum(start, end, pp, nn)))

    def value(at, p, q):
        return (F.when(p.isNull(), q["v"]).when(q.isNull() | (q["p"] == p["p"]), p["v"]).otherwise(on_line(at, p, q)))

    def tail_value(x):
        p, q = F.coalesce(shifted(x["p"], F.col("_off")), pp), F.coalesce(shifted(x["q"], F.col("_off")), nn)
        return value(x["r"] + F.col("_off"), p, q)
    empty = F.array().cast("array<double>")
    per = per.withColumns({"_fs": filled_sum, "_fc": F.when(filled_sum.isNotNull(), F.col("_n")).otherwise(0),
                           "_tail": F.transform("_last", tail_value)})
    per = per.withColumns({"_os": F.coalesce(F.sum("_fs").over(f.earlier), F.lit(0.0)), "_oc": F.coalesce(F.sum("_fc").over(f.earlier), F.lit(0)),
                           "_before": last_of_earlier(f, "_tail", keep_n, empty)})
    none = F.lit(None)
    rows = bring(rows, per, id_col, {"_low0": F.col("_low"), "_date0": none, "_dead": F.lit(0), "_off": F.lit(0), "_pp": none, "_nn": none,
                                     "_os": F.lit(0.0), "_oc": F.lit(0), "_before": empty})
    rows = rows.filter((F.col("_dead") == 0) & stays)
    p, q = F.coalesce(shifted(F.col("_lp"), F.col("_off")), pp), F.coalesce(shifted(F.col("_ln"), F.col("_off")), nn)
    rows = rows.withColumns({
        "Days_count": F.datediff(date, "_low0"),
        "Dif": F.coalesce("_dif", F.greatest(F.coalesce(F.datediff(date, "_date0"), F.lit(0)), F.lit(0))),
        target: F.when(F.col(target).isNotNull(), F.col(target).cast("double")).otherwise(value(F.col("_r") + F.col("_off"), p, q))})
    total = F.coalesce(F.sum(target).over(f.so_far), F.lit(0.0)) + F.col("_os")
    count = F.count(target).over(f.so_far) + F.col("_oc")
    made = {f"lag{k}": lag_of(f, target, "_r", "_before", k) for k in lags}
    for n in windows:
        made |= rolling_of(f, target, "_r", "_before", n, ("mean", "sum", "min", "max"))
    made["expanding_mean"] = F.when(count >= 2, total / count)
    out = row_mean_levels(rows.withColumns(made), levels)
    return out.select(*df.columns, "Days_count", "Dif", *[c for c in made if c.startswith("lag")], "avg_domains",
                      *[c for c in made if not c.startswith("lag")])


FEATURES = (["Days_count", "Dif", "lag1", "lag2", "lag3", "avg_domains"]
            + [f"rolling_{a}_{n}" for n in (3, 7) for a in ("mean", "sum", "min", "max")] + ["expanding_mean"])
