"""Agreement queries (H13-H23, C12, C14, U4) on multi-annotator tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS
from noteframe.operators import agreement as AG
from noteframe.operators import cohort as CO
from noteframe.operators import sets as U
from noteframe.plans import bindings as b
from noteframe.plans import tokens as TK
from noteframe.plans.registry import register

_A = TK.AGR_SQL
_NA = len(b.ANNOTATORS)
_DOM_LIST = "[" + ", ".join(f"'{d}'" for d in DOMAINS) + "]"

_ML_SQL = f"""WITH a AS ({_A}), g AS (SELECT annotator, pad_sen_id, [{', '.join(f'max(CAST({d} AS INTEGER))' for d in DOMAINS)}] AS labels
  FROM a GROUP BY ALL), fullset AS (SELECT pad_sen_id FROM g GROUP BY 1 HAVING count(DISTINCT annotator) = (SELECT count(DISTINCT annotator) FROM g))
SELECT g.* FROM g SEMI JOIN fullset USING (pad_sen_id)"""


def _ml(spark, d):
    return AG.sentence_multilabel_by_annotator(TK.agreement_tokens(spark, d), n_annotators=_NA)


@register("sentence_multilabel_by_annotator", f"SELECT annotator, pad_sen_id, array_to_string(labels, ',') AS labels FROM ({_ML_SQL})")
def sentence_multilabel_by_annotator_q(spark, d):
    """H13 (+U4): domain vector per annotator x sentence seen by everyone."""
    return _ml(spark, d).select("annotator", "pad_sen_id", F.array_join("labels", ",").alias("labels"))


@register("intersect_all_annotators", f"SELECT DISTINCT pad_sen_id FROM ({_ML_SQL})")
def intersect_all_annotators_q(spark, d):
    """U4: sentences that every annotator saw."""
    t = TK.agreement_tokens(spark, d).select("pad_sen_id", "annotator")
    return U.intersect_all_annotators(t, "pad_sen_id", "annotator", _NA).select("pad_sen_id").distinct()


def _pairs_sql(op: str) -> str:
    return (f"SELECT a.pad_sen_id, a.annotator AS annotator1, b.annotator AS annotator2, a.labels AS l1, b.labels AS l2 "
            f"FROM ({_ML_SQL}) a JOIN ({_ML_SQL}) b USING (pad_sen_id) WHERE a.annotator {op} b.annotator")


_PRF_PAIR_SQL = f"""SELECT annotator1, annotator2, domain, coalesce(tp / NULLIF(tp + fp, 0), 0) AS precision,
  coalesce(tp / NULLIF(tp + fn, 0), 0) AS recall, coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM (
  SELECT annotator1, annotator2, domain, count(*) FILTER (WHERE x = 1 AND y = 1) AS tp, count(*) FILTER (WHERE x = 0 AND y = 1) AS fp,
         count(*) FILTER (WHERE x = 1 AND y = 0) AS fn
  FROM (SELECT annotator1, annotator2, unnest({_DOM_LIST}) AS domain, unnest(l1) AS x, unnest(l2) AS y FROM ({_pairs_sql('<>')}))
  GROUP BY ALL)"""


def _pr(spark, d):
    return AG.pairwise_prf(_ml(spark, d))


@register("pairwise_prf", _PRF_PAIR_SQL)
def pairwise_prf_q(spark, d):
    """P/R/F1/support per ordered annotator pair x domain."""
    return _pr(spark, d)


@register("mean_f1_per_domain", f"SELECT domain, round_even(avg(f1), 2) AS f1, min(support) AS min_support, max(support) AS max_support "
          f"FROM ({_PRF_PAIR_SQL}) GROUP BY domain")
def mean_f1_per_domain_q(spark, d):
    """Mean F1 and support range per domain."""
    return AG.mean_f1_per_domain(_pr(spark, d))


@register("f1_pair_matrix", f"""WITH w AS (SELECT annotator1, annotator2, {', '.join(f"max(f1) FILTER (WHERE domain = '{dm}') AS {dm}" for dm in DOMAINS)}
  FROM ({_PRF_PAIR_SQL}) WHERE annotator1 < annotator2 GROUP BY ALL)
SELECT * FROM w UNION ALL SELECT 'mean', '', {', '.join(f'avg({dm})' for dm in DOMAINS)} FROM w""")
def f1_pair_matrix_q(spark, d):
    """Unordered pair x domain F1 with a mean row."""
    return AG.f1_pair_matrix(_pr(spark, d))


@register("pair_outcome", f"""SELECT pad_sen_id, annotator1, annotator2, {_DOM_LIST}[i] AS domain,
  CASE WHEN l1[i] = l2[i] AND l1[i] = 1 THEN 'true positive' WHEN l1[i] = l2[i] AND l1[i] = 0 THEN 'true negative'
       WHEN l1[i] <> l2[i] AND l1[i] = 0 THEN 'false positive' WHEN s2 = 0 THEN 'false negative'
       WHEN n_diff = 1 THEN 'false negative' ELSE 'confusion' END AS outcome
FROM (SELECT *, unnest(range(1, 10)) AS i, list_sum(l2) AS s2,
        len(list_filter(range(1, 10), lambda k: l1[k] <> l2[k])) AS n_diff FROM ({_pairs_sql('<')}))""")
def pair_outcome_q(spark, d):
    """Per sentence, unordered pair and domain, the outcome class."""
    return AG.pair_outcome(_ml(spark, d)).select("pad_sen_id", "annotator1", "annotator2", "domain", "outcome")


_LV_SQL = ("SELECT pad_sen_id, domain, annotator, avg(v) AS level FROM (" + " UNION ALL ".join(
    f"SELECT pad_sen_id, annotator, '{dm}' AS domain, CAST({dm}_lvl AS DOUBLE) AS v FROM ({_A})" for dm in DOMAINS)
    + ") GROUP BY ALL HAVING avg(v) IS NOT NULL")


@register("sentence_levels_by_annotator", _LV_SQL)
def sentence_levels_by_annotator_q(spark, d):
    """Mean level per sentence x domain x annotator."""
    return AG.sentence_levels_by_annotator(TK.agreement_tokens(spark, d)).select("pad_sen_id", "domain", "annotator", "level")


_MAE_SQL = f"""SELECT a.annotator AS annotator1, b.annotator AS annotator2, domain, avg(abs(a.level - b.level)) AS mae, count(*) AS support
FROM ({_LV_SQL}) a JOIN ({_LV_SQL}) b USING (pad_sen_id, domain) WHERE a.annotator < b.annotator GROUP BY ALL"""


@register("pairwise_mae", _MAE_SQL)
def pairwise_mae_q(spark, d):
    """Mean absolute level difference per unordered pair x domain."""
    return AG.pairwise_mae(AG.sentence_levels_by_annotator(TK.agreement_tokens(spark, d)))


@register("mean_mae_per_level", f"SELECT domain, avg(mae) AS mae, min(support) AS min_support, max(support) AS max_support FROM ({_MAE_SQL}) GROUP BY 1")
def mean_mae_per_level_q(spark, d):
    """Mean MAE and support range per domain."""
    # unrounded: sums in another order may fall on the other side of a rounding edge
    return AG.mean_mae_per_level(AG.pairwise_mae(AG.sentence_levels_by_annotator(TK.agreement_tokens(spark, d))), digits=None)


@register("mae_pair_matrix", f"""WITH w AS (SELECT annotator1, annotator2, {', '.join(f"max(mae) FILTER (WHERE domain = '{dm}') AS {dm}" for dm in DOMAINS)}
  FROM ({_MAE_SQL}) GROUP BY ALL)
SELECT * FROM w UNION ALL SELECT 'mean', '', {', '.join(f'avg({dm})' for dm in DOMAINS)} FROM w""")
def mae_pair_matrix_q(spark, d):
    """Unordered pair x domain MAE with a mean row."""
    return AG.mae_pair_matrix(AG.pairwise_mae(AG.sentence_levels_by_annotator(TK.agreement_tokens(spark, d))))


def _iaa_tokens(spark, d):
    t = TK.agreement_tokens(spark, d)
    batch = TK.with_info(t.select("NotitieID").distinct())
    return CO.select_iaa_notes(t, batch)


_IAA_SQL = f"SELECT * FROM ({_A}) WHERE NotitieID IN (SELECT NotitieID FROM ({TK.info_sql(f'SELECT DISTINCT NotitieID FROM ({_A})')}) WHERE samp_meth = 'kwd_iaa')"


@register("select_iaa_notes", f"SELECT NotitieID, count(*) AS n_tokens, count(DISTINCT annotator) AS n_annotators FROM ({_IAA_SQL}) GROUP BY 1")
def select_iaa_notes_q(spark, d):
    """Tokens of the notes sampled for agreement."""
    return _iaa_tokens(spark, d).groupBy("NotitieID").agg(F.count("*").alias("n_tokens"),
                                                          F.countDistinct("annotator").alias("n_annotators"))


@register("fleiss_kappa", f"""WITH per AS (SELECT NotitieID, domain, annotator, bool_or(v) AS v FROM (""" + " UNION ALL ".join(
    f"SELECT NotitieID, annotator, '{dm}' AS domain, coalesce({dm}, false) AS v FROM ({_IAA_SQL})" for dm in DOMAINS) + """) GROUP BY ALL),
cnt AS (SELECT NotitieID, domain, count(*) FILTER (WHERE v) AS t, count(*) FILTER (WHERE NOT v) AS f FROM per GROUP BY ALL),
g AS (SELECT domain, avg((t * t + f * f - (t + f)) / ((t + f) * (t + f - 1))) AS p_bar, sum(t) AS st, sum(f) AS sf FROM cnt WHERE t + f > 1 GROUP BY 1)
SELECT domain, CASE WHEN (st / (st + sf)) ^ 2 + (sf / (st + sf)) ^ 2 < 1
  THEN (p_bar - ((st / (st + sf)) ^ 2 + (sf / (st + sf)) ^ 2)) / (1 - ((st / (st + sf)) ^ 2 + (sf / (st + sf)) ^ 2)) END AS kappa FROM g""")
def fleiss_kappa_q(spark, d):
    """Fleiss' kappa per domain over the IAA notes."""
    return AG.fleiss_kappa(_iaa_tokens(spark, d))


def _overview_sql(key: str) -> str:
    items = []
    for dm in DOMAINS:
        items.append(f"CAST(bool_or({dm}) AS VARCHAR) AS {dm}")
        items.append(f"array_to_string(list_sort(list_distinct(list(CAST({dm}_lvl AS INTEGER)))), ',') AS {dm}_lvl")
    for f in ("target", "background", "plus"):
        items.append(f"CAST(bool_or({f}) AS VARCHAR) AS {f}")
    names = [c for dm in DOMAINS for c in (dm, f"{dm}_lvl")] + ["target", "background", "plus"]
    unp = " UNION ALL ".join(f"SELECT {key}, annotator, '{c}' AS item, {c} AS value FROM g" for c in names)
    piv = ", ".join(f"max(value) FILTER (WHERE annotator = '{a}') AS {a}" for a in b.ANNOTATORS)
    cond = " OR ".join(f"coalesce({a} <> 'false' AND {a} <> '', false)" for a in b.ANNOTATORS)
    return f"""WITH g AS (SELECT {key}, annotator, {', '.join(items)} FROM ({_IAA_SQL}) GROUP BY ALL),
w AS (SELECT {key}, item, {piv} FROM ({unp}) GROUP BY ALL) SELECT * FROM w WHERE {cond}"""


@register("annotation_overview_doc", _overview_sql("NotitieID"))
def annotation_overview_doc_q(spark, d):
    """Per IAA note x label item, one column per annotator."""
    return AG.annotation_overview(_iaa_tokens(spark, d), "NotitieID", b.ANNOTATORS)


@register("annotation_overview_sentence", _overview_sql("pad_sen_id"))
def annotation_overview_sentence_q(spark, d):
    """The same per sentence."""
    return AG.annotation_overview(_iaa_tokens(spark, d), "pad_sen_id", b.ANNOTATORS)


@register("annotator_pairs", f"SELECT DISTINCT a.NotitieID, a.annotator AS a1, b.annotator AS a2 FROM (SELECT DISTINCT NotitieID, annotator FROM ({b.TOKENS_RAW_SQL})) a "
          f"JOIN (SELECT DISTINCT NotitieID, annotator FROM ({b.TOKENS_RAW_SQL})) b USING (NotitieID) WHERE a.annotator < b.annotator")
def annotator_pairs_q(spark, d):
    """C14: unordered annotator pairs sharing a note."""
    return CO.annotator_pairs(b.tokens_raw(spark, d), "NotitieID", ordered=False)
