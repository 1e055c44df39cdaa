"""Cohort / join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS, LEVEL_COLS
from noteframe.functions.hashing import md5_bucket, sql_md5_bucket as H
from noteframe.operators import assemble as A
from noteframe.operators import cohort as CO
from noteframe.plans import bindings as b
from noteframe.plans import tokens as TK
from noteframe.plans.q_reports import DIAG_SQL, diagnoses
from noteframe.plans.registry import register
from noteframe.session import write_shared

_N = b.NOTES_SQL
_T = b.TIMELINE_SQL


@register("select_by_diagnosis", f"SELECT NotitieID, MDN FROM ({_N}) WHERE MDN IN (SELECT MDN FROM ({DIAG_SQL}) WHERE ICD10_diagnose = 'T78')")
def select_by_diagnosis_q(spark, d):
    """Notes of patients with the diagnosis on any contact."""
    return CO.select_by_diagnosis(b.notes(spark, d), diagnoses(spark, d), "T78").select("NotitieID", "MDN")


@register("anti_multikey", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey "
          "AND c.c_mktsegment = 'BUILDING' AND c.c_nationkey = CAST(o.o_custkey % 25 AS INTEGER))")
def anti_multikey_q(spark, d):
    """Orders minus those matching (customer, nation) of BUILDING customers."""
    o = b.table(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey")) \
         .withColumn("c_nationkey", (F.col("o_custkey") % 25).cast("int"))
    c = b.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return CO.anti_multikey(o, c, ["c_custkey", "c_nationkey"]).select("o_orderkey")


@register("exclude_annotated", f"SELECT NotitieID FROM ({_N}) WHERE NotitieID NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) "
          f"AND NotitieID NOT IN (SELECT NotitieID FROM ({_N}) WHERE {H('NotitieID', chr(39) + 'batch' + chr(39))} % 10 = 0)")
def exclude_annotated_q(spark, d):
    """Notes not in the register nor in a batch still out (bucket 0)."""
    n = b.notes(spark, d)
    reg = b.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("NotitieID"))
    out = n.filter(md5_bucket("NotitieID", F.lit("batch")) % 10 == 0)
    return CO.exclude_annotated(n, reg, out).select("NotitieID")


@register("flag_membership", f"SELECT NotitieID, CAST(NotitieID AS BIGINT) IN (SELECT doc_id FROM labels) AS annotated FROM ({_N})")
def flag_membership_q(spark, d):
    """C4: boolean 'in the register' column."""
    reg = b.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("NotitieID"))
    return CO.flag_membership(b.notes(spark, d), reg, ["NotitieID"], "annotated").select("NotitieID", "annotated")


@register("split_by_reference", f"SELECT NotitieID, CASE WHEN l.quality = 1 THEN 'test' WHEN l.quality = 0 THEN 'dev' ELSE 'train' END AS split "
          f"FROM ({_N}) n LEFT JOIN labels l ON CAST(n.NotitieID AS BIGINT) = l.doc_id")
def split_by_reference_q(spark, d):
    """test/dev from a reference id table, train = the rest."""
    ref = b.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("NotitieID"),
                                             F.when(F.col("quality") == 1, "test").otherwise("dev").alias("split"))
    return CO.split_by_reference(b.notes(spark, d), ref).select("NotitieID", "split")


_NOTE_LVL = (f"SELECT NotitieID, MDN, institution, {', '.join(f'avg({c}) AS {c}' for c in LEVEL_COLS)} FROM ({TK.CLEAN_SQL}) GROUP BY ALL")


@register("join_gold_levels", f"""SELECT t.NotitieID, t.MDN, t.institution, g.ADM_lvl, g.FAC_lvl FROM (
  SELECT DISTINCT NotitieID, MDN, institution FROM ({TK.PARSED_SQL})) t LEFT JOIN ({_NOTE_LVL}) g USING (NotitieID, MDN, institution)""")
def join_gold_levels_q(spark, d):
    """Note rows + note-level gold levels (left join on 3 keys)."""
    notes = TK.parsed(spark, d).select("NotitieID", "MDN", "institution").distinct()
    lv = TK.clean(spark, d).groupBy("NotitieID", "MDN", "institution").agg(*[F.avg(c).alias(c) for c in LEVEL_COLS])
    return CO.join_gold_levels(notes, lv).select("NotitieID", "MDN", "institution", "ADM_lvl", "FAC_lvl")


@register("join_batch_info", f"""SELECT t.NotitieID, t.n_tokens, i.source, i.samp_meth FROM (
  SELECT NotitieID, MDN, count(*) AS n_tokens FROM ({b.TOKENS_RAW_SQL}) GROUP BY ALL) t LEFT JOIN (
  SELECT NotitieID, MDN, min(struct_pack(s := source, m := samp_meth)).s AS source, min(struct_pack(s := source, m := samp_meth)).m AS samp_meth
  FROM ({TK.info_sql('SELECT DISTINCT NotitieID, MDN, annotator FROM (' + b.TOKENS_RAW_SQL + ')')}) GROUP BY ALL) i USING (NotitieID, MDN)""")
def join_batch_info_q(spark, d):
    """Batch info (one row per annotator) deduplicated, then joined."""
    t = b.tokens_raw(spark, d).groupBy("NotitieID", "MDN").agg(F.count("*").alias("n_tokens"))
    info = TK.with_info(b.tokens_raw(spark, d).select("NotitieID", "MDN", "annotator").distinct())
    return CO.join_batch_info(t, info).select("NotitieID", "n_tokens", "source", "samp_meth")


_SL = f"SELECT NotitieID, pad_sen_id, {', '.join(f'avg({c}) AS {c}' for c in LEVEL_COLS)} FROM ({TK.CLEAN_SQL}) GROUP BY ALL"


@register("assemble_domain_levels", f"""SELECT s.pad_sen_id, {', '.join(f'p.{dm}_lvl' for dm in DOMAINS)} FROM ({TK.SENT_SQL}) s LEFT JOIN (
  SELECT pad_sen_id AS row_id, {', '.join(f'{dm}_lvl + 0.5 AS {dm}_lvl' for dm in DOMAINS)} FROM ({_SL})) p ON s.pad_sen_id = p.row_id""")
def assemble_domain_levels_q(spark, d):
    """One level-prediction frame per domain back onto the sentences."""
    s = TK.sentences(spark, d).withColumn("row_id", F.col("pad_sen_id"))
    # written: nine frames come of it
    lv = write_shared(A.sentence_mean_levels(TK.clean(spark, d)).select("pad_sen_id", *LEVEL_COLS), "sentence-levels")
    preds = {dm: lv.select(F.col("pad_sen_id").alias("row_id"), (F.col(f"{dm}_lvl") + 0.5).alias("pred")) for dm in DOMAINS}
    return CO.assemble_domain_levels(s, preds).select("pad_sen_id", *[f"{dm}_lvl" for dm in DOMAINS])


@register("backfill_predictions", f"""SELECT t.NotitieID, {', '.join(f'CASE WHEN annotated THEN t.{c} ELSE p.{c} END AS {c}' for c in LEVEL_COLS)}
FROM ({_T}) t LEFT JOIN (SELECT NotitieID, {', '.join(f'coalesce({c}, 2.0) + 0.25 AS {c}' for c in LEVEL_COLS)} FROM ({_T})) p USING (NotitieID)""")
def backfill_predictions_q(spark, d):
    """Annotated notes keep gold levels, the rest take predictions."""
    t = b.timeline(spark, d)
    preds = t.select("NotitieID", *[(F.coalesce(F.col(c), F.lit(2.0)) + 0.25).alias(c) for c in LEVEL_COLS])
    return CO.backfill_predictions(t, preds, LEVEL_COLS).select("NotitieID", *LEVEL_COLS)


@register("align_two_series", f"""SELECT coalesce(a.d, b.d) AS Notitiedatum, a.v AS gold, b.v AS predicted FROM
  (SELECT Notitiedatum AS d, avg(ADM_lvl) AS v FROM ({_T}) WHERE annotated AND Typenotitie <> 'error' GROUP BY 1) a FULL OUTER JOIN
  (SELECT Notitiedatum AS d, avg(ADM_lvl) AS v FROM ({_T}) WHERE NOT annotated AND Typenotitie <> 'error' GROUP BY 1) b ON a.d = b.d""")
def align_two_series_q(spark, d):
    """Gold vs predicted daily means, outer-aligned, one type excluded."""
    from noteframe.operators.clean import filter_note_type
    t = filter_note_type(b.timeline(spark, d), ["error"], negate=True)
    return CO.align_two_series(t.filter("annotated"), t.filter("NOT annotated"), "Notitiedatum", "ADM_lvl",
                               ("gold", "predicted"))


@register("restrict_to_patient_set", f"SELECT MDN, count(*) AS n FROM ({_T}) WHERE MDN IN (SELECT CAST(user_id AS VARCHAR) FROM events "
          "WHERE event_type = 'purchase') GROUP BY 1")
def restrict_to_patient_set_q(spark, d):
    """Rows of patients present in another table (purchasers)."""
    pats = b.table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("MDN"))
    return CO.restrict_to_patient_set(b.timeline(spark, d), pats).groupBy("MDN").agg(F.count("*").alias("n"))
