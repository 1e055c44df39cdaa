"""Queries over annotated tokens: label parsing (P), token cleaning (B6-B8,
B11-B17, B23-B24), assembly (D1-D4, D37), alignment (C16, G10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS, PILOT_DOMAINS, TAGSET_CURRENT, TAGSET_PILOT, TAGSET_WEEK14
from noteframe.functions.hashing import md5_bucket, sql_md5_bucket as H
from noteframe.operators import assemble as A
from noteframe.operators import clean as C
from noteframe.operators import keywords as KW
from noteframe.operators import labels as P
from noteframe.operators import sampling as S
from noteframe.plans import bindings as b
from noteframe.plans import tokens as TK
from noteframe.plans.registry import register

_PCOLS = TK.PARSE_DOMAINS + [f"{d}_lvl" for d in TK.PARSE_DOMAINS] + TK.FLAGS4


@register("parse_labels", f"SELECT NotitieID, annotator, sen_id, tok, {', '.join(_PCOLS)} FROM ({TK.PARSED_SQL})")
def parse_labels_q(spark, d):
    """P1-P3 + B16: tags -> 9 flags, 9 levels, 4 flags per token."""
    return TK.parsed(spark, d).select("NotitieID", "annotator", "sen_id", "tok", *_PCOLS)


_CAT_SQL = ("CASE WHEN regexp_matches(tag, '^\\.') THEN 'domains' WHEN regexp_matches(tag, '^[a-z]{3}\\d') THEN 'levels' "
            "WHEN starts_with(tag, 'other_disregard_file') THEN 'disregard' WHEN starts_with(tag, 'other_target') THEN 'target' "
            "WHEN starts_with(tag, 'other_background') THEN 'background' WHEN starts_with(tag, 'mbw_plus') THEN 'plus' END")


@register("categorize_tags", "SELECT category, count(*) AS n_tags, count(DISTINCT tag) AS n_distinct FROM ("
          f"SELECT tag, {_CAT_SQL} AS category FROM (SELECT unnest(string_split(label, '|')) AS tag FROM ({b.TOKENS_RAW_SQL}) "
          "WHERE label <> '_')) GROUP BY category")
def categorize_tags_q(spark, d):
    """P1 as a DataFrame over the tags actually used in the annotations."""
    tags = (b.tokens_raw(spark, d).filter(F.col("label") != "_")
            .select(F.explode(F.split("label", r"\|")).alias("tag")))
    cat = P.categorize_tags_df(tags, "tag")
    return cat.groupBy("category").agg(F.count("*").alias("n_tags"), F.countDistinct("tag").alias("n_distinct"))


# Pilot-style labels: one or two tags of the pilot tag set chosen by md5
# buckets; the export escapes '_' in the three flag tags.
def _pilot_label_spark():
    bk = md5_bucket("NotitieID", "sen_tok", F.lit("pilot"))
    tags = F.array(*[F.lit(t.split(":")[0] if t.startswith(".") else t) for t in TAGSET_PILOT])
    esc = {"disregard_file", "target", "type_Background"}
    tags = F.array(*[F.lit(t.replace("_", "\\_") if t in esc else (t.split(":")[0] if t.startswith(".") else t))
                     for t in TAGSET_PILOT])
    n = len(TAGSET_PILOT)
    t1 = F.get(tags, (bk % n).cast("int"))
    t2 = F.get(tags, ((bk / 1000).cast("bigint") % n).cast("int"))
    return F.when(bk % 10 < 6, F.lit("_")).when(bk % 10 < 8, t1).otherwise(F.concat(t1, F.lit("|"), t2))


def _pilot_label_sql():
    bk = H("NotitieID", "sen_tok", "'pilot'")
    esc = {"disregard_file", "target", "type_Background"}
    items = [(t.replace("_", "\\_") if t in esc else (t.split(":")[0] if t.startswith(".") else t)) for t in TAGSET_PILOT]
    lst = "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"
    n = len(TAGSET_PILOT)
    t1 = f"{lst}[CAST({bk} % {n} AS INTEGER) + 1]"
    t2 = f"{lst}[CAST(({bk} // 1000) % {n} AS INTEGER) + 1]"
    return f"CASE WHEN {bk} % 10 < 6 THEN '_' WHEN {bk} % 10 < 8 THEN {t1} ELSE {t1} || '|' || {t2} END"


def _other_rx():
    names = [t.split(":")[0] for t in TAGSET_PILOT]
    known = {".B152", ".B455", ".D450", ".D840-859", "disregard_file", "target", "type_Background"}
    import re
    return "|".join(n for n in names if n not in known and not re.match(r"[A-Z]{3} \d", n))


_LEG_COLS = [c for dm in ["STM", "INS", "FAC", "BER"] for c in (dm, f"{dm}_lvl")] + ["disregard", "target", "background", "other"]
_LEG_SQL = (f"SELECT NotitieID, sen_tok, label, "
            + ", ".join(f"CASE WHEN {TK._HAS} THEN contains(label, '{code}') END AS {dm}, "
                        f"CASE WHEN {TK._HAS} THEN CAST(NULLIF(regexp_extract(label, '{dm} (\\d)', 1), '') AS INTEGER) END AS {dm}_lvl"
                        for code, dm in [(".B152", "STM"), (".B455", "INS"), (".D450", "FAC"), (".D840-859", "BER")])
            + ", " + ", ".join(f"CASE WHEN {TK._HAS} THEN contains(label, '{tag}') END AS {f}"
                               for f, tag in [("disregard", "disregard\\_file"), ("target", "target"), ("background", "type\\_Background")])
            + f", CASE WHEN {TK._HAS} THEN array_to_string(regexp_extract_all(label, '{_other_rx()}'), '|') END AS other"
            + f" FROM (SELECT DISTINCT NotitieID, sen_tok, {_pilot_label_sql()} AS label FROM ({b.TOKENS_RAW_SQL}))")


@register("parse_labels_legacy", _LEG_SQL)
def parse_labels_legacy_q(spark, d):
    """Pilot tag set, domain codes mapped to STM/INS/FAC/BER, `other`."""
    t = b.tokens_raw(spark, d).select("NotitieID", "sen_tok").distinct()
    t = t.withColumn("label", _pilot_label_spark())
    p = P.parse_labels_legacy(t, TAGSET_PILOT)
    return p.withColumn("other", F.when(F.col("other").isNotNull(), F.concat_ws("|", "other"))).select(
        "NotitieID", "sen_tok", "label", *_LEG_COLS)


_W14_DOMS = [t[-3:] for t in P.categorize_tags(TAGSET_WEEK14)["domains"]]


@register("tagset_variants", "SELECT batch, count(*) AS n_tokens, count(ETN) AS n_etn_parsed, "
          "count(*) FILTER (WHERE MBW) AS n_mbw FROM (SELECT batch, "
          f"CASE WHEN batch = 'week_14' THEN NULL ELSE ETN END AS ETN, MBW FROM ({TK.PARSED_SQL})) GROUP BY batch")
def tagset_variants_q(spark, d):
    """P5: week-14 tokens parsed with the week-14 tag set (no ETN), the rest
    with the current one, aligned by name."""
    t = C.split_sen_tok(b.tokens_raw(spark, d))
    w14 = P.parse_labels(t.filter(F.col("batch") == "week_14"), TAGSET_WEEK14)
    cur = P.parse_labels(t.filter(F.col("batch") != "week_14"), TAGSET_CURRENT)
    u = P.align_tagset_variants([w14, cur])
    return u.groupBy("batch").agg(F.count("*").alias("n_tokens"), F.count("ETN").alias("n_etn_parsed"),
                                  F.count(F.when(F.col("MBW"), 1)).alias("n_mbw"))


@register("pad_sentence_id", f"SELECT DISTINCT NotitieID, sen_id, {TK._PAD} AS pad_sen_id FROM ({TK.PARSED_SQL})")
def pad_sentence_id_q(spark, d):
    """B16 + B17: sentence ids, zero-padded without truncation."""
    return C.add_pad_sen_id(TK.parsed(spark, d)).select("NotitieID", "sen_id", "pad_sen_id").distinct()


@register("dedup_annotators", f"SELECT DISTINCT NotitieID, annotator FROM ({TK.DEDUP_SQL})")
def dedup_annotators_q(spark, d):
    """One seeded annotator per note."""
    return S.dedup_annotators(TK.parsed(spark, d), TK.SEED).select("NotitieID", "annotator").distinct()


@register("drop_disregard", f"SELECT NotitieID, count(*) AS n_tokens FROM ({TK.CLEAN_SQL}) GROUP BY NotitieID")
def drop_disregard_q(spark, d):
    """B6 (+B7, B8 in the same chain): tokens per surviving note."""
    return TK.clean(spark, d).groupBy("NotitieID").agg(F.count("*").alias("n_tokens"))


@register("mask_domain_for_batch", "SELECT batch, count(*) FILTER (WHERE MBW) AS n_mbw, count(MBW_lvl) AS n_mbw_lvl, "
          f"count(*) AS n_tokens FROM ({TK.CLEAN_SQL}) GROUP BY batch")
def mask_domain_for_batch_q(spark, d):
    """MBW flag/level per batch after masking week 14."""
    t = TK.clean(spark, d)
    return t.groupBy("batch").agg(F.count(F.when(F.col("MBW"), 1)).alias("n_mbw"),
                                  F.count("MBW_lvl").alias("n_mbw_lvl"), F.count("*").alias("n_tokens"))


@register("flag_group_any", f"SELECT DISTINCT pad_sen_id, background_sent, target_sent FROM ({TK.CLEAN_SQL})")
def flag_group_any_q(spark, d):
    """D1 + B8: sentence-level background/target flags."""
    return TK.clean(spark, d).select("pad_sen_id", "background_sent", "target_sent").distinct()


_SCOLS = ["pad_sen_id"] + TK.INFO + ["text_raw"]


@register("build_sentences", f"SELECT {', '.join(_SCOLS)}, array_to_string(labels, ',') AS labels FROM ({TK.SENT_SQL})")
def build_sentences_q(spark, d):
    """Token rows -> one row per sentence with a 9-slot label vector."""
    return TK.sentences(spark, d).select(*_SCOLS, F.array_join("labels", ",").alias("labels"))


_LVL = [f"{dm}_lvl" for dm in DOMAINS]


@register("sentence_mean_levels", "SELECT pad_sen_id, " + ", ".join(TK.first_sql(c) for c in A.INFO_COLS)
          + ", string_agg(token, ' ' ORDER BY tok) AS text_raw, " + ", ".join(f"avg({c}) AS {c}" for c in _LVL)
          + f" FROM ({TK.CLEAN_SQL}) GROUP BY pad_sen_id")
def sentence_mean_levels_q(spark, d):
    """D3: mean non-NULL level per sentence."""
    return A.sentence_mean_levels(TK.clean(spark, d))


_NOTE_INFO = [c for c in A.INFO_COLS if c != "NotitieID"]


@register("note_mean_levels", "SELECT NotitieID, " + ", ".join(
    f"arg_min({c}, CASE WHEN {c} IS NOT NULL THEN (sen_no, tok) END) AS {c}" for c in _NOTE_INFO)
    + ", string_agg(token, ' ' ORDER BY sen_no, tok) AS text_raw, " + ", ".join(f"avg({c}) AS {c}" for c in _LVL)
    + f" FROM ({TK.CLEAN_SQL}) GROUP BY NotitieID")
def note_mean_levels_q(spark, d):
    """The same per note, tokens in (integer sentence, token) order."""
    return A.note_mean_levels(TK.clean(spark, d))


@register("first_info_per_group", "SELECT NotitieID, " + ", ".join(
    f"arg_min({c}, CASE WHEN {c} IS NOT NULL THEN (sen_no, tok) END) AS {c}" for c in ["MDN", "batch", "token"])
    + f" FROM ({TK.PARSED_SQL}) GROUP BY NotitieID")
def first_info_per_group_q(spark, d):
    """First non-NULL value per note in (sentence, token) order."""
    return A.first_info_per_group(TK.parsed(spark, d), ["NotitieID"], ["sen_no", "tok"], ["MDN", "batch", "token"])


@register("multi_hot_partial", "SELECT pad_sen_id, array_to_string([0, 0, max(CAST(BER AS INTEGER)), 0, 0, "
          "max(CAST(FAC AS INTEGER)), max(CAST(INS AS INTEGER)), 0, max(CAST(STM AS INTEGER))], ',') AS labels "
          f"FROM ({TK.CLEAN_SQL}) GROUP BY pad_sen_id")
def multi_hot_partial_q(spark, d):
    """4 pilot domains onto the 9-slot vector (others 0)."""
    t = TK.clean(spark, d)
    s = t.groupBy("pad_sen_id").agg(*[F.max(F.col(x).cast("int")).alias(x) for x in PILOT_DOMAINS])
    return C.multi_hot_partial(s, PILOT_DOMAINS).select("pad_sen_id", F.array_join("labels", ",").alias("labels"))


@register("pivot_array_to_columns", "SELECT pad_sen_id, " + ", ".join(f"labels[{i + 1}] AS {dm}" for i, dm in enumerate(DOMAINS))
          + f" FROM ({TK.SENT_SQL})")
def pivot_array_to_columns_q(spark, d):
    """Label vector -> nine named columns."""
    return C.pivot_array_to_columns(TK.sentences(spark, d)).select("pad_sen_id", *DOMAINS)


@register("positive_only", f"SELECT pad_sen_id FROM ({TK.SENT_SQL}) WHERE list_max(labels) > 0")
def positive_only_q(spark, d):
    """Sentences with at least one domain."""
    return C.positive_only(TK.sentences(spark, d)).select("pad_sen_id")


@register("exclude_background_negatives", f"SELECT pad_sen_id FROM ({TK.SENT_SQL}) "
          "WHERE NOT ((background_sent OR target_sent) AND list_max(labels) = 0)")
def exclude_background_negatives_q(spark, d):
    """Drop background/target sentences without any domain."""
    return C.exclude_background_negatives(TK.sentences(spark, d)).select("pad_sen_id")


@register("domain_gold_slice", "SELECT pad_sen_id, NotitieID, avg(FAC_lvl) AS labels "
          f"FROM ({TK.CLEAN_SQL}) GROUP BY pad_sen_id, NotitieID HAVING count(FAC_lvl) > 0")
def domain_gold_slice_q(spark, d):
    """Sentences with a FAC level; the level becomes `labels`."""
    lv = A.sentence_mean_levels(TK.clean(spark, d))
    return C.domain_gold_slice(lv, "FAC").select("pad_sen_id", "NotitieID", "labels")


# names of which one has an initial of its own
_NAMES = {"ann_a": "anna", "ann_b": "bert", "ann_c": "bob"}


@register("annotator_alias", "WITH a AS (SELECT DISTINCT CASE annotator " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items())
          + " END AS annotator FROM (" + b.TOKENS_RAW_SQL + ")), "
          "u AS (SELECT substr(annotator, 1, 1) AS ini, count(*) AS n FROM a GROUP BY 1) "
          "SELECT annotator, CASE WHEN n = 1 THEN ini ELSE annotator END AS alias FROM a JOIN u ON substr(annotator, 1, 1) = ini")
def annotator_alias_q(spark, d):
    """First-letter alias only when unique: one annotator has one, two share an initial."""
    t = b.tokens_raw(spark, d).select("annotator").distinct().replace(_NAMES, subset=["annotator"])
    return C.annotator_alias(t, "annotator", "alias").select("annotator", "alias")


@register("token_align_annotators", f"""WITH p AS ({TK.PARSED_SQL}),
iaa AS (SELECT NotitieID FROM p GROUP BY NotitieID HAVING count(DISTINCT annotator) > 1),
al AS (SELECT sen_id, tok, token, """ + ", ".join(
    f"max(label) FILTER (WHERE annotator = '{a}') AS label_{a}, max(relation) FILTER (WHERE annotator = '{a}') AS relation_{a}"
    for a in b.ANNOTATORS) + """ FROM p SEMI JOIN iaa USING (NotitieID) GROUP BY sen_id, tok, token)
SELECT * FROM al WHERE sen_id IN (SELECT sen_id FROM al WHERE """ + " OR ".join(f"label_{a} <> '_'" for a in b.ANNOTATORS) + ")")
def token_align_annotators_q(spark, d):
    """Labels of all annotators side by side for IAA notes; sentences
    with any label kept."""
    from noteframe.operators.cohort import token_align_annotators
    p = TK.parsed(spark, d)
    iaa = p.groupBy("NotitieID").agg(F.countDistinct("annotator").alias("n")).filter("n > 1").select("NotitieID")
    return token_align_annotators(p.join(iaa, "NotitieID", "left_semi"), b.ANNOTATORS)


@register("rebuild_sentence_text", f"""SELECT sen_id, string_agg(token, ' ' ORDER BY tok) AS text
FROM ({TK.PARSED_SQL}) WHERE annotator = 'ann_b' AND sen_id IN (SELECT sen_id FROM ({TK.PARSED_SQL}) WHERE target)
GROUP BY sen_id""")
def rebuild_sentence_text_q(spark, d):
    """Text of the target-flagged sentences, for one annotator."""
    p = TK.parsed(spark, d)
    chosen = p.filter(F.col("target")).select("sen_id")
    return KW.rebuild_sentence_text(p, chosen, "ann_b")
