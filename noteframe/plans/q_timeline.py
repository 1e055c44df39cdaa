"""Timeline queries (E1-E17) on visits (orders: long gaps) and the dense
events timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import LEVEL_COLS
from noteframe.operators import timeline as E
from noteframe.plans import bindings as b
from noteframe.plans.registry import register

_V = b.VISITS_SQL
_T = b.TIMELINE_SQL
_ORD = ["ts", "event_id"]
_W = "PARTITION BY MDN ORDER BY ts, event_id"

_GAPS_SQL = f"""SELECT MDN, Notitiedatum, lead(Notitiedatum) OVER (PARTITION BY MDN ORDER BY Notitiedatum) AS date_next_note,
  date_diff('day', Notitiedatum, lead(Notitiedatum) OVER (PARTITION BY MDN ORDER BY Notitiedatum)) AS delta_note_dates
FROM (SELECT DISTINCT MDN, Notitiedatum FROM ({_V}))"""
_FMG_SQL = (f"SELECT * FROM ({_GAPS_SQL}) WHERE MDN IN (SELECT MDN FROM ({_GAPS_SQL}) GROUP BY MDN "
            "HAVING count(*) >= 5 AND max(delta_note_dates) > 2)")
_DIS_SQL = f"""SELECT g.*, discharge_date, date_diff('day', discharge_date, Notitiedatum) AS delta_discharge_date FROM ({_FMG_SQL}) g
LEFT JOIN (SELECT MDN, min(Notitiedatum) FILTER (WHERE delta_note_dates > 2) AS discharge_date FROM ({_FMG_SQL}) GROUP BY MDN) USING (MDN)"""
_FU_SQL = f"""SELECT d.*, first_follow_up, second_follow_up FROM ({_DIS_SQL}) d LEFT JOIN (
  SELECT MDN, coalesce(bool_or(delta_discharge_date BETWEEN 70 AND 110), false) AS first_follow_up,
              coalesce(bool_or(delta_discharge_date BETWEEN 160 AND 200), false) AS second_follow_up
  FROM ({_DIS_SQL}) GROUP BY MDN) USING (MDN)"""


def _gaps(spark, d):
    return E.next_note_gap(b.visits(spark, d))


@register("next_note_gap", _GAPS_SQL)
def next_note_gap_q(spark, d):
    """Next visit date and gap per patient."""
    return _gaps(spark, d)


@register("filter_max_gap", _FMG_SQL)
def filter_max_gap_q(spark, d):
    """Patients with >= 5 dates and a gap of more than 2 days."""
    return E.filter_max_gap(_gaps(spark, d))


@register("follow_up_flags", _FU_SQL)
def follow_up_flags_q(spark, d):
    """E3 + E4: discharge date, days since it, follow-up flags."""
    return E.follow_up_flags(E.discharge_date(E.filter_max_gap(_gaps(spark, d))))


@register("select_follow_up_patients", f"""SELECT MDN, NotitieID FROM ({_V}) WHERE MDN IN (
  SELECT MDN FROM ({_V}) WHERE MDN IN (SELECT MDN FROM ({_FU_SQL}) WHERE first_follow_up AND second_follow_up)
  GROUP BY MDN HAVING count(*) <= 100)""")
def select_follow_up_patients_q(spark, d):
    """E5: visits of patients with both follow-ups and <= 100 visits."""
    return E.select_follow_up_patients(b.visits(spark, d)).select("MDN", "NotitieID")


_ALIGN_SQL = f"SELECT *, date_diff('day', min(Notitiedatum) OVER (PARTITION BY MDN), Notitiedatum) AS Days_count FROM ({_T})"
_DIF_SQL = (f"SELECT *, greatest(coalesce(Days_count - lag(Days_count) OVER ({_W}), 0), 0) AS Dif FROM ({_ALIGN_SQL})")


def _dif(spark, d):
    return E.day_difference(E.align_time(b.timeline(spark, d)), _ORD)


@register("align_time", f"SELECT NotitieID, Days_count, Dif FROM ({_DIF_SQL})")
def align_time_q(spark, d):
    """E6 + E7: days since the first note, day difference to the previous."""
    return _dif(spark, d).select("NotitieID", "Days_count", "Dif")


@register("trim_first_admission", f"""SELECT 'first_admission' AS mode, NotitieID FROM (
  SELECT *, max(CAST(Dif >= 3 AS INTEGER)) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM ({_DIF_SQL}))
  WHERE c = 0 UNION ALL SELECT 'row', NotitieID FROM ({_DIF_SQL}) WHERE Dif < 3""")
def trim_first_admission_q(spark, d):
    """Both modes (first admission only / literal row filter)."""
    t = _dif(spark, d)
    a = E.trim_first_admission(t, _ORD).select(F.lit("first_admission").alias("mode"), "NotitieID")
    r = E.trim_first_admission(t, _ORD, mode="row").select(F.lit("row").alias("mode"), "NotitieID")
    return a.unionByName(r)


def _interp_sql(col: str, part: str = "MDN", order: str = "ts, event_id", base: str = _T, out: str | None = None) -> str:
    out = out or col
    w = f"PARTITION BY {part} ORDER BY {order}"
    return f"""SELECT * EXCLUDE (_i, _pp, _pv, _np, _nv) REPLACE (CAST(CASE WHEN {col} IS NOT NULL THEN {col} WHEN _pp IS NULL THEN NULL
  WHEN _np IS NULL THEN _pv ELSE _pv + (_nv - _pv) * (_i - _pp) / (_np - _pp) END AS DOUBLE) AS {out}) FROM (
  SELECT *, last_value(CASE WHEN {col} IS NOT NULL THEN _i END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _pp,
            last_value({col} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _pv,
            first_value(CASE WHEN {col} IS NOT NULL THEN _i END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _np,
            first_value({col} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _nv
  FROM (SELECT *, row_number() OVER ({w}) AS _i FROM ({base})))"""


@register("interpolate_linear", f"SELECT NotitieID, ADM_lvl FROM ({_interp_sql('ADM_lvl')})")
def interpolate_linear_q(spark, d):
    """ADM level filled linearly by row within the patient."""
    return E.interpolate_linear(b.timeline(spark, d), "MDN", _ORD, "ADM_lvl").select("NotitieID", "ADM_lvl")


@register("backfill", f"SELECT NotitieID, first_value(FAC_lvl IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS FAC_lvl FROM ({_T})")
def backfill_q(spark, d):
    """Next non-NULL FAC level."""
    return E.backfill(b.timeline(spark, d), "MDN", _ORD, "FAC_lvl").select("NotitieID", "FAC_lvl")


@register("lag_features", f"SELECT NotitieID, lag(ADM_lvl, 1) OVER ({_W}) AS lag1, lag(ADM_lvl, 2) OVER ({_W}) AS lag2, "
          f"lag(ADM_lvl, 3) OVER ({_W}) AS lag3 FROM ({_T})")
def lag_features_q(spark, d):
    """Lags 1-3 of the ADM level."""
    return E.lag_features(b.timeline(spark, d), "MDN", _ORD, "ADM_lvl").select("NotitieID", "lag1", "lag2", "lag3")


def _roll_sql():
    cols = []
    for n in (3, 7):
        for a, f in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max")):
            cols.append(f"CASE WHEN count(ATT_lvl) OVER w{n} = {n} THEN {f}(ATT_lvl) OVER w{n} END AS rolling_{a}_{n}")
    return (f"SELECT NotitieID, {', '.join(cols)} FROM ({_T}) WINDOW w3 AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), "
            f"w7 AS ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")


@register("rolling_stats", _roll_sql())
def rolling_stats_q(spark, d):
    """3- and 7-row rolling mean/sum/min/max of the ATT level."""
    r = E.rolling_stats(b.timeline(spark, d), "MDN", _ORD, "ATT_lvl")
    return r.select("NotitieID", *[f"rolling_{a}_{n}" for n in (3, 7) for a in ("mean", "sum", "min", "max")])


@register("expanding_mean", f"SELECT NotitieID, CASE WHEN count(ENR_lvl) OVER w >= 2 THEN avg(ENR_lvl) OVER w END AS expanding_mean "
          f"FROM ({_T}) WINDOW w AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def expanding_mean_q(spark, d):
    """Expanding mean of the ENR level, at least 2 values."""
    return E.expanding_mean(b.timeline(spark, d), "MDN", _ORD, "ENR_lvl").select("NotitieID", "expanding_mean")


_DAILY = f"""SELECT MDN, day, value FROM (SELECT MDN, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day
  FROM (SELECT MDN, min(Notitiedatum) AS lo, max(Notitiedatum) AS hi FROM ({_T}) GROUP BY MDN))
LEFT JOIN (SELECT MDN, Notitiedatum AS day, avg(STM_lvl) AS value FROM ({_T}) GROUP BY ALL) USING (MDN, day)"""


@register("daily_resample", f"SELECT MDN, day, value FROM ({_interp_sql('value', 'MDN', 'day', _DAILY)})")
def daily_resample_q(spark, d):
    """One row per patient-day, daily mean STM level, gaps filled."""
    return E.daily_resample(b.timeline(spark, d), "MDN", "Notitiedatum", "STM_lvl").select("MDN", "day", "value")


@register("row_mean_levels", f"SELECT NotitieID, (" + " + ".join(f"coalesce({c}, 0)" for c in LEVEL_COLS) + ") / NULLIF("
          + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in LEVEL_COLS) + f", 0) AS avg_domains FROM ({_T})")
def row_mean_levels_q(spark, d):
    """Mean over the nine levels of a note, NULLs skipped."""
    return E.row_mean_levels(b.timeline(spark, d), LEVEL_COLS).select("NotitieID", "avg_domains")


@register("label_encode", "SELECT event_id, CAST(dense_rank() OVER (ORDER BY props) - 1 AS BIGINT) AS props_code FROM events")
def label_encode_q(spark, d):
    """Props value -> rank among its sorted distinct values."""
    ev = b.table(spark, d, "events").select("event_id", "props")
    return E.label_encode(ev, "props").select("event_id", "props_code")


@register("patients_by_min_notes", f"SELECT MDN FROM ({_T}) GROUP BY MDN HAVING count(ADM_lvl) >= 50")
def patients_by_min_notes_q(spark, d):
    """Patients with at least 50 ADM levels."""
    return E.patients_by_min_notes(b.timeline(spark, d), "ADM_lvl", 50)


_TRIM_SQL = (f"SELECT * EXCLUDE (c) FROM (SELECT *, max(CAST(Dif >= 3 AS INTEGER)) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING "
             f"AND CURRENT ROW) AS c FROM ({_DIF_SQL})) WHERE c = 0")
_FILL_SQL = (f"SELECT * REPLACE (first_value(ADM_lvl IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ADM_lvl) "
             f"FROM ({_interp_sql('ADM_lvl', base=_TRIM_SQL)})")


def _feature_sql():
    roll = []
    for n in (3, 7):
        for a, f in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max")):
            roll.append(f"CASE WHEN count(ADM_lvl) OVER w{n} = {n} THEN {f}(ADM_lvl) OVER w{n} END AS rolling_{a}_{n}")
    mean = ("(" + " + ".join(f"coalesce({c}, 0)" for c in LEVEL_COLS) + ") / NULLIF("
            + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in LEVEL_COLS) + ", 0)")
    return (f"SELECT MDN, NotitieID, ADM_lvl, Days_count, Dif, lag(ADM_lvl, 1) OVER ({_W}) AS lag1, lag(ADM_lvl, 2) OVER ({_W}) AS lag2, "
            f"lag(ADM_lvl, 3) OVER ({_W}) AS lag3, {mean} AS avg_domains, {', '.join(roll)}, "
            f"CASE WHEN count(ADM_lvl) OVER w >= 2 THEN avg(ADM_lvl) OVER w END AS expanding_mean FROM ({_FILL_SQL}) "
            f"WINDOW w3 AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w7 AS ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), "
            f"w AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


FEATURE_SQL = _feature_sql()


def features(spark, d):
    return E.feature_table(b.timeline(spark, d), LEVEL_COLS, _ORD).select("MDN", "NotitieID", "ADM_lvl", *E.FEATURES)


@register("feature_table", FEATURE_SQL)
def feature_table_q(spark, d):
    """E6-E13 + E15: the model's feature table of first admissions."""
    return features(spark, d)
