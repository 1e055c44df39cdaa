"""Token/sentence relations built from the bound tables, Spark + SQL twins.

parsed (M8) -> clean (dedup annotators, drop disregarded notes, week-14
mask, sentence flags, padded ids, NULL fill) -> sentences (M9) and mean
levels (M10). Shared by several query modules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS, TAGSET_CURRENT
from noteframe.functions.hashing import sql_md5_bucket as H
from noteframe.operators import assemble as A
from noteframe.operators import clean as C
from noteframe.operators import labels as P
from noteframe.operators import sampling as S
from noteframe.plans import bindings as b
from noteframe.plans.bindings import memo

PARSE_DOMAINS = [t[-3:] for t in P.categorize_tags(TAGSET_CURRENT)["domains"]]
FLAGS4 = ["disregard", "target", "background", "plus"]
SEED = 0


def _parse(tokens):
    t = C.split_sen_tok(tokens)
    t = t.withColumn("sen_no", F.get(F.split("sen_tok", "-"), 0).cast("int"))
    return P.parse_labels(t, TAGSET_CURRENT)


@memo
def parsed(spark, d):
    """M8, a projection of the tokens."""
    return _parse(b.tokens_raw(spark, d))


@memo
def parsed_by_note(spark, d):
    """M8 on tokens that are partitioned by note, for what follows by note."""
    return _parse(b.tokens_by_note(spark, d))


@memo
def clean(spark, d):
    # per-note windows reuse the note partitioning and never re-read the input
    # one sort serves the windows by note and those by sentence
    t = parsed_by_note(spark, d).sortWithinPartitions("NotitieID", "sen_id")
    t = S.dedup_annotators(t, SEED, clustered=True)
    t = C.drop_disregard(t, clustered=True)
    t = C.mask_domain_for_batch(t, "MBW", "week_14")
    t = A.flag_group_any(t, ["NotitieID", "sen_id"], "background", "background_sent")
    t = A.flag_group_any(t, ["NotitieID", "sen_id"], "target", "target_sent")
    t = C.add_pad_sen_id(t)
    return C.standardize_nulls(t, PARSE_DOMAINS + ["target", "background", "plus"])


@memo
def sentences(spark, d):
    return A.build_sentences(clean(spark, d))


# ------------------------------------------------------------ SQL twins ----
_HAS = "(label IS NOT NULL AND label <> '_')"
PARSED_SQL = ("SELECT *, NotitieID || '_' || split_part(sen_tok, '-', 1) AS sen_id, "
              "CAST(split_part(sen_tok, '-', 2) AS INTEGER) AS tok, "
              "CAST(split_part(sen_tok, '-', 1) AS INTEGER) AS sen_no, "
              + ", ".join(f"CASE WHEN {_HAS} THEN contains(label, '{dm}') END AS {dm}" for dm in PARSE_DOMAINS) + ", "
              + ", ".join(f"CASE WHEN {_HAS} THEN CAST(NULLIF(regexp_extract(label, '{dm.lower()}(\\d)', 1), '') AS INTEGER) END AS {dm}_lvl"
                          for dm in PARSE_DOMAINS) + ", "
              + ", ".join(f"CASE WHEN {_HAS} THEN contains(label, '{f}') END AS {f}" for f in FLAGS4)
              + f" FROM ({b.TOKENS_RAW_SQL})")

_PAD = ("NotitieID || '_' || CASE WHEN length(split_part(sen_tok, '-', 1)) >= 4 THEN split_part(sen_tok, '-', 1) "
        "ELSE lpad(split_part(sen_tok, '-', 1), 4, '0') END")

DEDUP_SQL = f"""SELECT p.* FROM ({PARSED_SQL}) p SEMI JOIN (
  SELECT NotitieID, annotator FROM (
    SELECT NotitieID, annotator, row_number() OVER (PARTITION BY NotitieID
      ORDER BY {H(str(SEED), 'NotitieID', 'annotator')}, annotator) AS rn
    FROM (SELECT DISTINCT NotitieID, annotator FROM ({PARSED_SQL}))) WHERE rn = 1
) c USING (NotitieID, annotator)"""

_FILL = ", ".join(f"coalesce({c}, false) AS {c}" for c in PARSE_DOMAINS + ["target", "background", "plus"])

CLEAN_SQL = f"""SELECT * REPLACE ({_FILL}, coalesce(label, '_') AS label, coalesce(relation, '_') AS relation,
                               coalesce(token, '') AS token) FROM (
  SELECT *, coalesce(bool_or(background) OVER (PARTITION BY sen_id), false) AS background_sent,
            coalesce(bool_or(target) OVER (PARTITION BY sen_id), false) AS target_sent,
            {_PAD} AS pad_sen_id
  FROM (
    SELECT * EXCLUDE (disregard) REPLACE (CASE WHEN batch = 'week_14' THEN false ELSE MBW END AS MBW,
                                          CASE WHEN batch = 'week_14' THEN NULL ELSE MBW_lvl END AS MBW_lvl)
    FROM ({DEDUP_SQL}) x
    WHERE NOT EXISTS (SELECT 1 FROM ({DEDUP_SQL}) y WHERE y.disregard AND y.NotitieID = x.NotitieID)))"""

INFO = A.INFO_COLS + ["background_sent", "target_sent"]


def first_sql(c: str, order: str = "tok") -> str:
    return f"arg_min({c}, CASE WHEN {c} IS NOT NULL THEN {order} END) AS {c}"


SENT_SQL = ("SELECT pad_sen_id, " + ", ".join(first_sql(c) for c in INFO)
            + ", string_agg(token, ' ' ORDER BY tok) AS text_raw, ["
            + ", ".join(f"max(CAST({dm} AS INTEGER))" for dm in DOMAINS) + "] AS labels"
            + f" FROM ({CLEAN_SQL}) GROUP BY pad_sen_id")


# ------------------------------------------------- batch info per note ----
SOURCES = ["2017", "2018", "cov_2020", "non_cov_2020"]


def with_info(df, note: str = "NotitieID"):
    """Source and sampling method of each annotated note (batch info)."""
    from noteframe.functions.hashing import md5_bucket
    src = F.array(*[F.lit(s) for s in SOURCES])
    return df.withColumns({
        "source": F.get(src, (md5_bucket(note, F.lit("src")) % 4).cast("int")),
        "samp_meth": F.when(md5_bucket(note, F.lit("iaa")) % 4 == 0, F.lit("kwd_iaa"))
                      .when(md5_bucket(note, F.lit("meth")) % 2 == 0, F.lit("kwd")).otherwise(F.lit("rndm")),
    })


def info_sql(base: str) -> str:
    src = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "]"
    return (f"SELECT *, {src}[CAST({H('NotitieID', chr(39) + 'src' + chr(39))} % 4 AS INTEGER) + 1] AS source, "
            f"CASE WHEN {H('NotitieID', chr(39) + 'iaa' + chr(39))} % 4 = 0 THEN 'kwd_iaa' "
            f"WHEN {H('NotitieID', chr(39) + 'meth' + chr(39))} % 2 = 0 THEN 'kwd' ELSE 'rndm' END AS samp_meth FROM ({base})")


@memo
def adjusted(spark, d):
    """Report input: parsed tokens + batch info, disregarded notes dropped,
    week 14 masked (no annotator dedup, as in the reports)."""
    t = with_info(parsed_by_note(spark, d))
    return C.mask_domain_for_batch(C.drop_disregard(t, clustered=True), "MBW", "week_14")


ADJ_SQL = f"""SELECT * EXCLUDE (disregard) REPLACE (CASE WHEN batch = 'week_14' THEN false ELSE MBW END AS MBW,
  CASE WHEN batch = 'week_14' THEN NULL ELSE MBW_lvl END AS MBW_lvl)
FROM ({info_sql(PARSED_SQL)}) x WHERE NOT EXISTS (SELECT 1 FROM ({PARSED_SQL}) y WHERE y.disregard AND y.NotitieID = x.NotitieID)"""


# ------------------------------------------------------------- splits -----
SPLIT_SEED = 19


def split_sql(base: str, group: str = "NotitieID", train: float = 0.8) -> str:
    """DuckDB twin of group_split_3way: rank groups by (bucket, id)."""
    return f"""SELECT t.*, s.split FROM ({base}) t LEFT JOIN (
  SELECT {group}, CASE WHEN r < rest - ceil(rest * 0.5) THEN 'dev' WHEN r < rest THEN 'test' ELSE 'train' END AS split
  FROM (SELECT {group}, row_number() OVER (ORDER BY {H(str(SPLIT_SEED), group)}, {group}) - 1 AS r,
               ceil({1 - train!r} * count(*) OVER ()) AS rest
        FROM (SELECT DISTINCT {group} FROM ({base})))) s USING ({group})"""


# ----------------------------------------------------------- predictions --
@memo
def predictions(spark, d):
    """Sentences + ``pred_bert`` (the gold vector with md5-chosen slots
    flipped), a nested copy ``pred_nested`` and ``scores`` for ranking."""
    from noteframe.functions.hashing import md5_bucket
    s = sentences(spark, d)
    lab = [F.get(F.col("labels"), i) for i in range(len(DOMAINS))]
    pred = F.array(*[F.when(md5_bucket("pad_sen_id", F.lit(i)) % 10 == 0, 1 - lab[i]).otherwise(lab[i])
                     for i in range(len(DOMAINS))])
    s = s.withColumn("pred_bert", pred)
    scores = F.array(*[(md5_bucket("pad_sen_id", F.lit(i), F.lit("s")) % 1000).cast("double") / F.lit(1000.0).cast("double")
                       + F.get(F.col("pred_bert"), i).cast("double") * 0.6 for i in range(len(DOMAINS))])
    return s.withColumns({"pred_nested": F.array(F.col("pred_bert")), "scores": scores})


PRED_SQL = ("SELECT *, [" + ", ".join(
    f"CASE WHEN {H('pad_sen_id', str(i))} % 10 = 0 THEN 1 - labels[{i + 1}] ELSE labels[{i + 1}] END" for i in range(9))
    + f"] AS pred_bert FROM ({SENT_SQL})")
PRED_SQL = ("SELECT *, [" + ", ".join(
    f"CAST({H('pad_sen_id', str(i), chr(39) + 's' + chr(39))} % 1000 AS DOUBLE) / 1000.0 + CAST(pred_bert[{i + 1}] AS DOUBLE) * 0.6"
    for i in range(9)) + f"] AS scores FROM ({PRED_SQL})")

LONG_SQL = ("SELECT pad_sen_id, NotitieID, annotator, unnest([" + ", ".join(f"'{dm}'" for dm in DOMAINS)
            + f"]) AS domains, unnest(labels) AS labels, unnest(pred_bert) AS preds FROM ({PRED_SQL})")


@memo
def long_preds(spark, d):
    from noteframe.operators import evaluate as H
    p = C.rename_pred_column(C.flatten_nested_preds(predictions(spark, d).drop("pred_bert")).drop("scores"), "nested",
                             "preds")
    return H.explode_multilabel(p, DOMAINS, "labels", "preds")


# ---------------------------------------------------- agreement tokens ----
@memo
def agreement_tokens(spark, d):
    t = C.mask_domain_for_batch(C.add_pad_sen_id(parsed_by_note(spark, d)), "MBW", "week_14")
    return t.fillna({c: False for c in PARSE_DOMAINS + ["target", "background", "plus"]})


_FILL_NO_MBW = ", ".join(f"coalesce({c}, false) AS {c}" for c in PARSE_DOMAINS + ["target", "background", "plus"] if c != "MBW")
AGR_SQL = (f"SELECT * REPLACE ({_FILL_NO_MBW}, CASE WHEN batch = 'week_14' THEN false ELSE coalesce(MBW, false) END AS MBW, "
           f"CASE WHEN batch = 'week_14' THEN NULL ELSE MBW_lvl END AS MBW_lvl) FROM (SELECT *, {_PAD} AS pad_sen_id FROM ({PARSED_SQL}))")
