"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS, LEVEL_COLS
from noteframe.functions.hashing import sql_md5_bucket as H
from noteframe.operators import assemble as A
from noteframe.operators import clean as C
from noteframe.operators import report as R
from noteframe.operators import sampling as S
from noteframe.plans import bindings as b
from noteframe.plans import tokens as TK
from noteframe.plans.registry import register
from noteframe.session import write_shared

_N = b.NOTES_SQL
_T = b.TIMELINE_SQL


def diagnoses(spark, d):
    """Diagnoses binding: one contact per labelled document; the patient of
    a toxic-labelled document carries code T78."""
    lab = b.table(spark, d, "labels")
    return lab.select(F.concat(F.lit("p"), (F.col("doc_id") / 8).cast("bigint").cast("string")).alias("MDN"),
                      F.col("doc_id").cast("string").alias("CSN"),
                      F.when(F.col("toxic") == 1, "T78").otherwise("Z00").alias("ICD10_diagnose"))


DIAG_SQL = ("SELECT 'p' || CAST(doc_id // 8 AS VARCHAR) AS MDN, CAST(doc_id AS VARCHAR) AS CSN, "
            "CASE WHEN toxic = 1 THEN 'T78' ELSE 'Z00' END AS ICD10_diagnose FROM labels")


def _sum_row_sql(inner: str, key: str, cols: list[str]) -> str:
    return (f"WITH g AS ({inner}) SELECT * FROM g UNION ALL SELECT 'total' AS {key}, "
            + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in cols) + " FROM g")


@register("unique_counts_with_total", _sum_row_sql(
    f"SELECT institution, count(DISTINCT MDN) AS n_patients, count(DISTINCT NotitieID) AS n_notes FROM ({_N}) GROUP BY 1",
    "institution", ["n_patients", "n_notes"]))
def unique_counts_with_total_q(spark, d):
    """Distinct patients and notes per source; total = row sum."""
    return R.unique_counts_with_total(b.notes(spark, d))


@register("overview_all_annotated_rest", "WITH a AS (SELECT institution, count(DISTINCT NotitieID) AS n_all, "
          "count(DISTINCT NotitieID) FILTER (WHERE CAST(NotitieID AS BIGINT) IN (SELECT doc_id FROM labels)) AS n_annotated "
          f"FROM ({_N}) GROUP BY 1), g AS (SELECT institution, n_all, n_annotated, n_all - n_annotated AS n_rest FROM a) "
          "SELECT * FROM g UNION ALL SELECT 'total', CAST(sum(n_all) AS BIGINT), CAST(sum(n_annotated) AS BIGINT), "
          "CAST(sum(n_rest) AS BIGINT) FROM g")
def overview_all_annotated_rest_q(spark, d):
    """All / annotated (in the register) / rest per source + total."""
    reg = b.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("NotitieID"))
    return R.overview_all_annotated_rest(b.notes(spark, d), reg)


@register("patients_notes_diagnoses", f"SELECT institution, count(DISTINCT MDN) AS n_patients, count(DISTINCT NotitieID) AS n_notes "
          f"FROM ({_N}) WHERE MDN IN (SELECT MDN FROM ({DIAG_SQL})) GROUP BY 1")
def patients_notes_diagnoses_q(spark, d):
    """Counts for patients that have any diagnosis contact."""
    return R.patients_notes_diagnoses(b.notes(spark, d), diagnoses(spark, d))


_INFO_PARSED = TK.info_sql(TK.PARSED_SQL)


@register("notes_disregard_overview", f"""WITH t AS ({_INFO_PARSED}),
r AS (SELECT source, count(DISTINCT NotitieID) AS n_notes, count(DISTINCT NotitieID) FILTER (WHERE disregard) AS n_disregard
      FROM t GROUP BY ROLLUP (source))
SELECT coalesce(source, 'total') AS source, n_notes, n_disregard, n_notes - n_disregard AS n_annotated,
       round(n_disregard / n_notes * 100, 1) AS prc_disregard FROM r""")
def notes_disregard_overview_q(spark, d):
    """Notes, disregarded, kept, percent per source; global total."""
    return R.notes_disregard_overview(TK.with_info(TK.parsed(spark, d)))


_HASD = " OR ".join(f"coalesce({dm}, false)" for dm in DOMAINS)


@register("sentences_with_labels", f"""WITH g AS (SELECT source, count(DISTINCT sen_id) AS n_all_sents,
  count(DISTINCT sen_id) FILTER (WHERE {_HASD}) AS n_sents_with_labels FROM ({TK.ADJ_SQL}) GROUP BY source),
u AS (SELECT * FROM g UNION ALL SELECT 'total', CAST(sum(n_all_sents) AS BIGINT), CAST(sum(n_sents_with_labels) AS BIGINT) FROM g)
SELECT *, round(n_sents_with_labels / n_all_sents * 100, 1) AS prc_sents_with_labels FROM u""")
def sentences_with_labels_q(spark, d):
    """Sentences and labelled sentences per source; total = sum."""
    return R.sentences_with_labels(TK.adjusted(spark, d))


def _domain_dist_sql(prefilter: bool) -> str:
    where = f"WHERE {_HASD}" if prefilter else ""
    maxes = ", ".join(f"max(CAST(coalesce({dm}, false) AS INTEGER)) AS {dm}" for dm in DOMAINS)
    sums = ", ".join(f"sum({dm}) AS {dm}" for dm in DOMAINS)
    unions = " UNION ALL ".join(
        f"SELECT source, '{c}' AS domain, CAST({c} AS BIGINT) AS n, tot FROM w" for c in DOMAINS + ["total"])
    return f"""WITH s AS (SELECT source, sen_id, {maxes} FROM ({TK.ADJ_SQL}) {where} GROUP BY source, sen_id),
g AS (SELECT source, {sums} FROM s GROUP BY source),
g2 AS (SELECT * FROM g UNION ALL SELECT 'total', {', '.join(f'sum({dm})' for dm in DOMAINS)} FROM g),
w AS (SELECT *, {' + '.join(DOMAINS)} AS total, {' + '.join(DOMAINS)} AS tot FROM g2),
l AS ({unions})
SELECT source, domain, n, CAST(round_even(n / tot * 100, 0) AS BIGINT) AS pct FROM l"""


@register("domain_distribution", _domain_dist_sql(False))
def domain_distribution_q(spark, d):
    """Labelled sentences per source x domain with margins and pct."""
    return R.domain_distribution(TK.adjusted(spark, d))


@register("domain_distribution_labelled_rows", _domain_dist_sql(True))
def domain_distribution_labelled_rows_q(spark, d):
    """The same after keeping only token rows with a domain."""
    return R.domain_distribution(TK.adjusted(spark, d), prefilter=True)


def _level_long_sql(keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{dm}' AS domain, CAST({dm}_lvl AS INTEGER) AS level FROM ({TK.ADJ_SQL}) "
                              f"WHERE {dm}_lvl IS NOT NULL" for dm in DOMAINS)


_LD_SQL = f"""WITH lv AS (SELECT DISTINCT * FROM ({_level_long_sql('source, sen_id')})),
g AS (SELECT source, domain, level, count(*) AS n FROM lv GROUP BY ALL)
SELECT * FROM g UNION ALL SELECT 'total', domain, level, CAST(sum(n) AS BIGINT) FROM g GROUP BY domain, level"""


@register("level_distribution", _LD_SQL)
def level_distribution_q(spark, d):
    """Sentences holding each level per source x domain (+ total)."""
    return R.level_distribution(TK.adjusted(spark, d))


@register("level_distribution_pct", f"SELECT *, sum(n) OVER (PARTITION BY source, domain) AS subtotal, "
          f"round(n / sum(n) OVER (PARTITION BY source, domain) * 100, 1) AS pct FROM ({_LD_SQL})")
def level_distribution_pct_q(spark, d):
    """D15 with subtotal and percent within (source, domain)."""
    return R.level_distribution_pct(TK.adjusted(spark, d))


@register("levels_per_note_hist", f"""SELECT domain, n_levels, count(*) AS n_notes FROM (
  SELECT NotitieID, domain, count(DISTINCT level) AS n_levels FROM ({_level_long_sql('NotitieID')}) GROUP BY ALL) GROUP BY ALL""")
def levels_per_note_hist_q(spark, d):
    """Notes by number of distinct levels per domain."""
    return R.levels_per_note_hist(TK.adjusted(spark, d))


@register("level_spread_hist", f"""SELECT domain, spread, count(*) AS n_notes FROM (
  SELECT NotitieID, domain, count(DISTINCT level) AS k, max(level) - min(level) AS spread
  FROM ({_level_long_sql('NotitieID')}) GROUP BY ALL) WHERE k > 1 GROUP BY ALL""")
def level_spread_hist_q(spark, d):
    """Notes with more than one level, by max - min."""
    return R.level_spread_hist(TK.adjusted(spark, d))


_SMC_MAX = ", ".join(f"max(CAST(coalesce({dm}, false) AS INTEGER)) AS {dm}" for dm in DOMAINS)


@register("sampling_method_comparison", f"""WITH t AS (SELECT *, split_part(samp_meth, '_', 1) AS m,
    bool_or(coalesce(disregard, false)) OVER (PARTITION BY NotitieID) AS disregard_note FROM ({_INFO_PARSED})),
n AS (SELECT m, count(DISTINCT NotitieID) AS n_notes, count(DISTINCT NotitieID) FILTER (WHERE disregard_note) AS n_disregard FROM t GROUP BY m),
s AS (SELECT m, sen_id, {_SMC_MAX} FROM t WHERE NOT disregard_note GROUP BY m, sen_id),
g AS (SELECT m, count(*) AS n_sents, sum(greatest({', '.join(DOMAINS)})) AS n_labelled, {', '.join(f'sum({dm}) AS n_{dm}' for dm in DOMAINS)} FROM s GROUP BY m)
SELECT n.m AS method, n_notes, n_sents, round(n_disregard / n_notes * 100, 1) AS prc_disregard,
  round(n_labelled / n_sents * 100, 1) AS prc_labelled, {', '.join(f'round(n_{dm} / n_sents * 100, 1) AS prc_{dm}' for dm in DOMAINS)}
FROM n LEFT JOIN g USING (m)""")
def sampling_method_comparison_q(spark, d):
    """Keyword vs random notes."""
    t = C.disregard_note_flag(TK.with_info(TK.parsed(spark, d)))
    return R.sampling_method_comparison(t)


@register("patients_notes_by_annotated", f"""SELECT coalesce(institution, 'Total') AS institution,
  coalesce(CAST(annotated AS VARCHAR), 'Total') AS annotated, count(DISTINCT MDN) AS n_patients, count(NotitieID) AS n_notes
FROM ({_T}) GROUP BY CUBE (institution, annotated)""")
def patients_notes_by_annotated_q(spark, d):
    """Patients and notes by institution x annotated with margins."""
    r = R.patients_notes_by_annotated(b.timeline(spark, d))
    return r.withColumn("annotated", F.lower("annotated").alias("annotated")) \
            .withColumn("annotated", F.when(F.col("annotated") == "total", "Total").otherwise(F.col("annotated")))


@register("notes_per_patient_hist", f"""WITH n AS (SELECT MDN, count(*) AS n FROM ({_T}) GROUP BY MDN),
h AS (SELECT CAST(ceil(least(n, 500) / 25) AS INTEGER) AS bin, count(*) AS n_patients FROM n GROUP BY 1)
SELECT (bin - 1) * 25 AS bin_lo, bin * 25 AS bin_hi, CAST(coalesce(n_patients, 0) AS BIGINT) AS n_patients
FROM range(1, 21) r(bin) LEFT JOIN h USING (bin)""")
def notes_per_patient_hist_q(spark, d):
    """D21 (+B20): notes per patient capped at 500, 25-wide right-closed bins."""
    return R.notes_per_patient_hist(b.timeline(spark, d))


@register("labelled_notes_overview", f"""WITH g AS (SELECT CAST(annotated AS VARCHAR) AS annotated, {', '.join(f'count({c}) AS {c}' for c in LEVEL_COLS)},
  count(*) FILTER (WHERE {' OR '.join(f'{c} IS NOT NULL' for c in LEVEL_COLS)}) AS notes_with_label FROM ({_T}) GROUP BY 1),
u AS (SELECT * FROM g UNION ALL SELECT 'Total', {', '.join(f'sum({c})' for c in LEVEL_COLS + ['notes_with_label'])} FROM g)
""" + " UNION ALL ".join(f"SELECT annotated, '{c}' AS item, CAST({c} AS BIGINT) AS n FROM u" for c in LEVEL_COLS + ["notes_with_label"]))
def labelled_notes_overview_q(spark, d):
    """Non-NULL levels by annotated, totals, notes with any label."""
    return R.labelled_notes_overview(b.timeline(spark, d), LEVEL_COLS)


@register("value_histogram", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM ({_T}) WHERE {c} IS NOT NULL" for c in LEVEL_COLS)
    + "), r AS (SELECT \"column\", CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, "
    "CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM l GROUP BY 1), "
    "h AS (SELECT \"column\", CAST(CASE WHEN v < lo + i * ((hi - lo) / 10.0) THEN i - 1 "
    "WHEN v >= lo + (i + 1) * ((hi - lo) / 10.0) AND i <> 9 THEN i + 1 ELSE i END AS INTEGER) AS bin, "
    "count(*) AS n FROM (SELECT *, CAST(least(floor((v - lo) * (10.0 / (hi - lo))), 9) AS INTEGER) AS i "
    "FROM l JOIN r USING (\"column\")) GROUP BY ALL) "
    "SELECT \"column\", bin, coalesce(n, 0) AS n FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in LEVEL_COLS)
    + "]) AS \"column\") CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) LEFT JOIN h USING (\"column\", bin)")
def value_histogram_q(spark, d):
    """10 equal-width bins per level column."""
    return R.value_histogram(b.timeline(spark, d), LEVEL_COLS)


@register("date_summary", f"""SELECT count(Notitiedatum) AS n, min(Notitiedatum) AS min_date, max(Notitiedatum) AS max_date,
  avg(date_diff('day', DATE '1970-01-01', Notitiedatum)) AS mean_days,
  quantile_cont(date_diff('day', DATE '1970-01-01', Notitiedatum), 0.25) AS q25_days,
  quantile_cont(date_diff('day', DATE '1970-01-01', Notitiedatum), 0.5) AS q50_days,
  quantile_cont(date_diff('day', DATE '1970-01-01', Notitiedatum), 0.75) AS q75_days FROM ({b.VISITS_SQL})""")
def date_summary_q(spark, d):
    """describe() of the visit dates."""
    return R.date_summary(b.visits(spark, d), "Notitiedatum")


@register("distinct_counts", f"SELECT count(DISTINCT MDN) AS n_MDN, count(DISTINCT NotitieID) AS n_NotitieID FROM ({_T})")
def distinct_counts_q(spark, d):
    """Unique patients and notes."""
    return R.distinct_counts(b.timeline(spark, d), ["MDN", "NotitieID"])


_SENT_SPLIT = TK.split_sql(TK.SENT_SQL)


def _sentences_split(spark, d):
    # written, without the text: the limits of the split are found in it, and it is read once per use
    s = write_shared(TK.sentences(spark, d).select("MDN", "NotitieID", "labels"), "sentence-labels")
    return S.group_split_3way(s, "NotitieID", 0.8, TK.SPLIT_SEED)


def _balance_sql(base: str) -> str:
    cols = ", ".join(f"CAST(sum(labels[{i + 1}]) AS BIGINT) AS {dm}" for i, dm in enumerate(DOMAINS))
    return _sum_row_sql(f"SELECT split, {cols}, count(*) AS n_rows FROM ({base}) GROUP BY split", "split", DOMAINS + ["n_rows"])


@register("dataset_balance_sentences", _balance_sql(_SENT_SPLIT))
def dataset_balance_sentences_q(spark, d):
    """D26 (+S8): positives per domain and sentences per split."""
    return R.dataset_balance_sentences(_sentences_split(spark, d))


@register("dataset_balance_notes", _balance_sql(
    "SELECT split, NotitieID, [" + ", ".join(f"max(labels[{i + 1}])" for i in range(9)) + f"] AS labels FROM ({_SENT_SPLIT}) GROUP BY ALL"))
def dataset_balance_notes_q(spark, d):
    """The same per note (any sentence positive)."""
    return R.dataset_balance_notes(_sentences_split(spark, d))


_LVL_SPLIT = TK.split_sql(f"SELECT NotitieID, pad_sen_id, {', '.join(f'avg({c}) AS {c}' for c in LEVEL_COLS)} "
                          f"FROM ({TK.CLEAN_SQL}) GROUP BY NotitieID, pad_sen_id")


@register("level_dataset_sizes", "SELECT split, domain, count(*) AS n_rows, count(DISTINCT NotitieID) AS n_notes FROM ("
          + " UNION ALL ".join(f"SELECT split, NotitieID, '{dm}' AS domain FROM ({_LVL_SPLIT}) WHERE {dm}_lvl IS NOT NULL" for dm in DOMAINS)
          + ") GROUP BY ALL")
def level_dataset_sizes_q(spark, d):
    """Rows with a level and distinct notes per split x domain."""
    lv = A.sentence_mean_levels(TK.clean(spark, d))
    return R.level_dataset_sizes(S.group_split_3way(lv, "NotitieID", 0.8, TK.SPLIT_SEED))


@register("split_leakage_check", f"""WITH s AS (SELECT MDN, NotitieID, split FROM ({_SENT_SPLIT})),
ns AS (SELECT DISTINCT 'NotitieID' AS unit, NotitieID AS id, split FROM s UNION SELECT DISTINCT 'MDN', MDN, split FROM s),
p AS (SELECT unit, a.split AS split_a, b.split AS split_b, count(*) AS n FROM ns a JOIN ns b USING (unit, id) WHERE a.split < b.split GROUP BY ALL),
g AS (SELECT * FROM (VALUES ('NotitieID'), ('MDN')) u(unit), (VALUES ('dev', 'test'), ('dev', 'train'), ('test', 'train')) v(split_a, split_b))
SELECT unit, split_a, split_b, coalesce(n, 0) AS shared_notes FROM g LEFT JOIN p USING (unit, split_a, split_b)""")
def split_leakage_check_q(spark, d):
    """A split by note shares no note between its parts (zeros are rows), but it does share patients."""
    split = _sentences_split(spark, d)
    found = [R.split_leakage_check(split, "split", unit).withColumn("unit", F.lit(unit)) for unit in ("NotitieID", "MDN")]
    pairs = spark.createDataFrame([(u, a, z) for u in ("NotitieID", "MDN") for a, z in (("dev", "test"), ("dev", "train"), ("test", "train"))],
                                  "unit string, split_a string, split_b string")
    return (pairs.join(found[0].unionByName(found[1]), ["unit", "split_a", "split_b"], "left")
            .withColumn("shared_notes", F.coalesce("shared_notes", F.lit(0))))


@register("patient_nonnull_counts", f"SELECT MDN, count(institution) AS institution, count(NotitieID) AS NotitieID, "
          f"count(Typenotitie) AS Typenotitie, count(Notitiedatum) AS Notitiedatum, count(annotated) AS annotated, "
          + ", ".join(f"count({c}) AS {c}" for c in LEVEL_COLS) + f" FROM ({_T}) GROUP BY MDN")
def patient_nonnull_counts_q(spark, d):
    """Non-NULL count of every column per patient."""
    t = b.timeline(spark, d).drop("ts", "event_id")
    return R.patient_nonnull_counts(t, "MDN")


@register("filter_groups_by_size", f"SELECT MDN, count(*) AS n FROM ({_T}) GROUP BY MDN HAVING count(*) > 66")
def filter_groups_by_size_q(spark, d):
    """Patients with more than 66 notes (rows kept, counted)."""
    return R.filter_groups_by_size(b.timeline(spark, d), "MDN", 66).groupBy("MDN").agg(F.count("*").alias("n"))


@register("notes_per_patient_day", f"SELECT MDN, Notitiedatum, count(*) AS n FROM ({_T}) GROUP BY ALL")
def notes_per_patient_day_q(spark, d):
    """D33 (= D32 in long form): notes per (patient, date)."""
    return R.notes_per_patient_day(b.timeline(spark, d))


@register("activity_tier_summary", f"""WITH p AS (SELECT MDN, count(*) AS n, count(*) FILTER (WHERE annotated) AS a FROM ({_T}) GROUP BY MDN)
SELECT tier, count(n) AS unique_ids, CAST(coalesce(sum(a), 0) AS BIGINT) AS annotated,
  CAST(coalesce(sum(n) - sum(a), 0) AS BIGINT) AS not_annotated, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_notes
FROM (VALUES (60), (70), (80), (100000)) t(tier) LEFT JOIN p ON n > tier GROUP BY tier""")
def activity_tier_summary_q(spark, d):
    """Per activity tier (> 60/70/80 notes, and one that nobody reaches)."""
    r = R.activity_tier_summary(b.timeline(spark, d), [60, 70, 80, 100000])
    return r.select("tier", "unique_ids", F.col("annotated").cast("bigint"), F.col("not_annotated").cast("bigint"),
                    F.col("total_notes").cast("bigint"))


@register("value_counts", f"SELECT Typenotitie, count(*) AS n FROM ({_N}) GROUP BY 1")
def value_counts_q(spark, d):
    """Frequency of note types."""
    return R.value_counts(b.notes(spark, d), "Typenotitie")


@register("raters_per_note", f"SELECT annotator, count(DISTINCT NotitieID) AS n_notes FROM ({b.TOKENS_RAW_SQL}) GROUP BY 1")
def raters_per_note_q(spark, d):
    """Distinct notes per annotator."""
    return R.raters_per_note(b.tokens_raw(spark, d))


@register("notes_crosstab", f"SELECT Notitiedatum, MDN, count(*) AS n FROM ({_T}) GROUP BY ALL")
def notes_crosstab_q(spark, d):
    """D32 (long form): notes per date and patient."""
    return R.notes_crosstab(b.timeline(spark, d), "Notitiedatum", "MDN")


@register("notes_crosstab_wide", f"SELECT Notitiedatum, MDN AS id, count(*) AS n FROM ({_T}) GROUP BY ALL")
def notes_crosstab_wide_q(spark, d):
    """D32 (wide): dates by patients in blocks of 64 columns, written and read back cell by cell."""
    from noteframe.plans.q_sources import _scratch
    path = _scratch(spark, "crosstab")
    R.write_crosstab(b.timeline(spark, d), path, "Notitiedatum", "MDN", 64)
    return R.read_crosstab(spark, path)
