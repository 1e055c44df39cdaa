"""Sampling and splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS, PILOT_DOMAINS, TAGSET_PILOT
from noteframe.functions.hashing import sql_md5_bucket as H
from noteframe.functions.text import normalize_whitespace
from noteframe.operators import clean as C
from noteframe.operators import keywords as KW
from noteframe.operators import labels as P
from noteframe.operators import report as R
from noteframe.operators import sampling as S
from noteframe.plans import bindings as b
from noteframe.plans import tokens as TK
from noteframe.plans.q_text import _MATCH_CTE
from noteframe.plans.q_tokens import _LEG_SQL, _pilot_label_spark
from noteframe.plans.registry import register

# Batch parameters (shape of one weekly batch configuration).
BATCH = dict(annotators=list(b.ANNOTATORS), sources_other=["2017", "2018", "non_cov_2020"], source_covid="cov_2020",
             n_files=60, pct_covid=0.5, pct_kwd=0.8, domains=list(DOMAINS), matched_domains=list(DOMAINS),
             min_matched_domains=4, n_iaa=5, iaa_sources=["cov_2020"])
SEED = 0


def _searched_notes(spark, d):
    n = b.notes(spark, d).select("institution", "MDN", "NotitieID", normalize_whitespace("all_text").alias("all_text"))
    n = TK.with_info(n).drop("samp_meth")
    return KW.find_keywords(n, KW.domain_regex(b.KEYWORDS))


def _batch(spark, d):
    # the smaller test folders cannot fill every quota: batch_shortfall reports by how much
    return S.select_notes(_searched_notes(spark, d), seed=SEED, allow_short=True, **BATCH)


def select_sql(notes: str | None = None) -> str:
    """The draw as SQL, over all notes or over those that ``notes`` selects."""
    q = S.batch_quotas(BATCH["sources_other"], BATCH["source_covid"], BATCH["n_files"], BATCH["pct_covid"],
                       BATCH["pct_kwd"], BATCH["n_iaa"], BATCH["iaa_sources"])

    def case(field):
        return "CASE source " + " ".join(f"WHEN '{x['source']}' THEN {x[field]}" for x in q) + " ELSE 0 END"
    anns = "[" + ", ".join(f"'{a}'" for a in BATCH["annotators"]) + "]"
    k = len(BATCH["annotators"])
    nm = " + ".join(f"CAST(len({dm}) > 0 AS INTEGER)" for dm in DOMAINS)
    anym = " OR ".join(f"len({dm}) > 0" for dm in BATCH["matched_domains"])
    src = "[" + ", ".join(f"'{s}'" for s in TK.SOURCES) + "]"
    return (_MATCH_CTE.replace(b.NOTES_SQL, notes) if notes else _MATCH_CTE) + f""", ms AS (SELECT *, {src}[CAST({H('NotitieID', chr(39) + 'src' + chr(39))} % 4 AS INTEGER) + 1] AS source,
    {nm} AS n_matched_domains FROM m),
el AS (SELECT * FROM ms WHERE ({anym}) AND n_matched_domains >= {BATCH['min_matched_domains']}),
iaa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {H(str(SEED), 'NotitieID')}, NotitieID) - 1 AS r FROM el)
        WHERE r < {case('n_iaa')}),
kwd AS (SELECT *, {anns}[CAST(floor(r / q) AS INTEGER) + 1] AS annotator FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY {H(str(SEED + 1), 'NotitieID')}, NotitieID) - 1 AS r, {case('n_kwd')} AS q
        FROM el WHERE NotitieID NOT IN (SELECT NotitieID FROM iaa)) WHERE r < q * {k}),
rnd AS (SELECT *, {anns}[CAST(floor(r / q) AS INTEGER) + 1] AS annotator FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY {H(str(SEED + 2), 'NotitieID')}, NotitieID) - 1 AS r, {case('n_rndm')} AS q
        FROM ms WHERE NotitieID NOT IN (SELECT NotitieID FROM iaa UNION ALL SELECT NotitieID FROM kwd)) WHERE r < q * {k}),
batch AS (SELECT NotitieID, source, unnest({anns}) AS annotator, 'kwd_iaa' AS samp_meth FROM iaa
          UNION ALL SELECT NotitieID, source, annotator, 'kwd' FROM kwd UNION ALL SELECT NotitieID, source, annotator, 'rndm' FROM rnd)"""


_SEL = select_sql()


@register("select_notes", _SEL + " SELECT * FROM batch")
def select_notes_q(spark, d):
    """Seeded batch (shared IAA notes, keyword and random draws)."""
    return _batch(spark, d).select("NotitieID", "source", "annotator", "samp_meth")


@register("batch_overview", _SEL + """ SELECT coalesce(annotator, 'total') AS annotator, coalesce(sm, 'total') AS source_samp_meth,
  count(*) AS n FROM (SELECT annotator, source || '/' || samp_meth AS sm FROM batch) GROUP BY CUBE (annotator, sm)""")
def batch_overview_q(spark, d):
    """Notes by annotator x (source, samp_meth) with all totals."""
    return R.batch_overview(_batch(spark, d))


@register("batch_shortfall", _SEL + """, need AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{a}', '{q['source']}', '{m}', {q[f]})" for a in BATCH["annotators"] for q in S.batch_quotas(
        BATCH["sources_other"], BATCH["source_covid"], BATCH["n_files"], BATCH["pct_covid"], BATCH["pct_kwd"],
        BATCH["n_iaa"], BATCH["iaa_sources"]) for m, f in (("kwd_iaa", "n_iaa"), ("kwd", "n_kwd"), ("rndm", "n_rndm")))
    + """) t(annotator, source, samp_meth, required))
SELECT annotator, source, samp_meth, required, coalesce(drawn, 0) AS drawn, greatest(required - coalesce(drawn, 0), 0) AS missing
FROM need LEFT JOIN (SELECT annotator, source, samp_meth, count(*) AS drawn FROM batch GROUP BY ALL) USING (annotator, source, samp_meth)""")
def batch_shortfall_q(spark, d):
    """S6 check: required vs drawn per annotator x source x method."""
    quotas = S.batch_quotas(BATCH["sources_other"], BATCH["source_covid"], BATCH["n_files"], BATCH["pct_covid"],
                            BATCH["pct_kwd"], BATCH["n_iaa"], BATCH["iaa_sources"])
    out = S.batch_shortfall(_batch(spark, d), quotas, BATCH["annotators"])
    return out.select("annotator", "source", "samp_meth", "required", F.col("drawn").cast("bigint"), "missing")


@register("cap_sample", f"SELECT NotitieID, institution FROM ({b.NOTES_SQL}) "
          f"QUALIFY row_number() OVER (PARTITION BY institution ORDER BY {H('45', 'NotitieID')}, NotitieID) <= 30")
def cap_sample_q(spark, d):
    """Seeded uniform draw of at most 30 notes of each source."""
    return S.cap_sample(b.notes(spark, d), "NotitieID", 30, 45, source="institution").select("NotitieID", "institution")


@register("group_split_2way", f"""SELECT MDN, CASE WHEN r < n_test THEN 'test' ELSE 'train' END AS split FROM (
  SELECT MDN, row_number() OVER (ORDER BY {H(str(TK.SPLIT_SEED), 'MDN')}, MDN) - 1 AS r, ceil(0.2 * count(*) OVER ()) AS n_test
  FROM (SELECT DISTINCT MDN FROM ({b.TIMELINE_SQL})))""")
def group_split_2way_q(spark, d):
    """80/20 train/test by patient."""
    t = b.timeline(spark, d).select("MDN").distinct()
    return S.group_split_2way(t, "MDN", 0.2, TK.SPLIT_SEED).select("MDN", "split")


@register("group_split_3way", f"SELECT DISTINCT NotitieID, split FROM ({TK.split_sql(TK.SENT_SQL)})")
def group_split_3way_q(spark, d):
    """80/10/10 train/dev/test by note."""
    return S.group_split_3way(TK.sentences(spark, d), "NotitieID", 0.8, TK.SPLIT_SEED).select("NotitieID", "split").distinct()


def _pilot_sentences(spark, d):
    t = b.tokens_by_note(spark, d).select("NotitieID", "sen_tok").distinct().withColumn("label", _pilot_label_spark())
    p = C.add_pad_sen_id(C.split_sen_tok(P.parse_labels_legacy(t, TAGSET_PILOT)))
    s = p.groupBy("pad_sen_id").agg(*[F.max(F.col(x).cast("int")).alias(x) for x in PILOT_DOMAINS])
    s = C.multi_hot_partial(s, PILOT_DOMAINS)
    return C.positive_only(s).select(F.concat(F.lit("pilot_"), "pad_sen_id").alias("pad_sen_id"), "labels")


_PILOT_SQL = (f"SELECT 'pilot_' || NotitieID || '_' || CASE WHEN length(split_part(sen_tok, '-', 1)) >= 4 THEN split_part(sen_tok, '-', 1) "
              "ELSE lpad(split_part(sen_tok, '-', 1), 4, '0') END AS pad_sen_id, "
              "[0, 0, coalesce(max(CAST(BER AS INTEGER)), 0), 0, 0, coalesce(max(CAST(FAC AS INTEGER)), 0), "
              "coalesce(max(CAST(INS AS INTEGER)), 0), 0, coalesce(max(CAST(STM AS INTEGER)), 0)] AS labels "
              f"FROM ({_LEG_SQL}) GROUP BY 1")


@register("seeded_annotation_mix", f"""SELECT pad_sen_id, array_to_string(labels, ',') AS labels FROM ({TK.split_sql(TK.SENT_SQL)}) WHERE split = 'train'
UNION ALL SELECT pad_sen_id, array_to_string(labels, ',') FROM ({_PILOT_SQL}) WHERE list_max(labels) > 0""")
def seeded_annotation_mix_q(spark, d):
    """Train sentences plus positive pilot sentences (P4 -> D2 -> B12)."""
    train = S.group_split_3way(TK.sentences(spark, d), "NotitieID", 0.8, TK.SPLIT_SEED).filter("split = 'train'")
    mix = S.seeded_annotation_mix(train.select("pad_sen_id", "labels"), _pilot_sentences(spark, d))
    return mix.select("pad_sen_id", F.array_join("labels", ",").alias("labels"))
