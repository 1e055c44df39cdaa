"""Joins and membership tests.

All joins are equi-joins or semi/anti joins. Key sets are deduplicated
before joining so the probe side never multiplies. Broadcast decisions are
left to AQE, which converts a join to broadcast only once the runtime size
of the build side is known to be under ``autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_by_diagnosis(notes: DataFrame, diagnoses: DataFrame, code: str,
                        code_col: str = "ICD10_diagnose", key: str = "MDN") -> DataFrame:
    """Notes of patients with the diagnosis on any contact."""
    pats = diagnoses.filter(F.col(code_col) == code).select(key).distinct()
    return notes.join(pats, key, "left_semi")


def anti_multikey(df1: DataFrame, df2: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of df1 whose key tuple is not in df2."""
    right = df2.select(*keys).distinct()
    if not null_safe:
        return df1.join(right, list(keys), "left_anti")
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    cond = reduce(lambda a, b: a & b, [df1[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    return df1.join(r, cond, "left_anti")


def exclude_annotated(notes: DataFrame, register: DataFrame, in_progress: DataFrame | None = None,
                      key: str = "NotitieID") -> DataFrame:
    """Drop notes already annotated or out for annotation."""
    ids = register.select(key)
    if in_progress is not None:
        ids = ids.unionByName(in_progress.select(key))
    return notes.join(ids.distinct(), key, "left_anti")


def flag_membership(df1: DataFrame, df2: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """C4: boolean column 'key tuple present in df2' (existence join)."""
    right = df2.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return df1.join(right, list(keys), "left").withColumn(out, F.col("_hit").isNotNull()).drop("_hit")


def split_by_reference(df: DataFrame, assignment: DataFrame, key: str = "NotitieID",
                       split: str = "split", default: str = "train") -> DataFrame:
    """Split from an id -> split table; everything else is ``default``."""
    a = assignment.select(key, split).dropDuplicates([key])
    return df.join(a, key, "left").withColumn(split, F.coalesce(F.col(split), F.lit(default)))


def slice_by_predicted_domain(df: DataFrame, preds_long: DataFrame, dom: str | None, unit: str = "sent",
                              dom_col: str = "domains", pred: str = "preds") -> DataFrame:
    """Rows whose sentence (unit='sent') or note (unit='note') was
    predicted positive for ``dom``; without ``dom`` for the row's own
    domain, which ``df`` has as ``dom_col``, in one join for all domains."""
    key = "pad_sen_id" if unit == "sent" else "NotitieID"
    if dom is None:
        pos = preds_long.filter(F.col(pred) == 1).select(key, dom_col).distinct()
        return df.join(pos, [key, dom_col], "left_semi")
    pos = preds_long.filter((F.col(dom_col) == dom) & (F.col(pred) == 1)).select(key).distinct()
    return df.join(pos, key, "left_semi")


def join_gold_levels(notes: DataFrame, levels: DataFrame,
                     keys: Sequence[str] = ("NotitieID", "MDN", "institution")) -> DataFrame:
    """Left join note-level gold levels."""
    return notes.join(levels, list(keys), "left")


def join_batch_info(tokens: DataFrame, info: DataFrame, keys: Sequence[str] = ("NotitieID", "MDN"),
                    cols: Sequence[str] = ("source", "samp_meth")) -> DataFrame:
    """Left join batch info, deduplicated by key first (quirk Q8: one
    info row per annotator would multiply token rows)."""
    one = (info.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("_i"))
               .select(*keys, *[F.col(f"_i.{c}").alias(c) for c in cols]))
    return tokens.join(one, list(keys), "left")


def assemble_domain_levels(sentences: DataFrame, preds: Mapping[str, DataFrame], key: str = "row_id",
                           value: str = "pred") -> DataFrame:
    """One level prediction per domain back onto the sentences: a long
    union pivoted once (one shuffle) instead of one join per domain."""
    doms = list(preds)
    long = reduce(lambda a, b: a.unionByName(b),
                  [p.select(key, F.lit(dm).alias("_dom"), F.col(value).alias("_v")) for dm, p in preds.items()])
    return assemble_routed_levels(sentences, long, doms, key, "_v", "_dom")


def assemble_routed_levels(sentences: DataFrame, routed: DataFrame, doms: Sequence[str], key: str = "row_id",
                           value: str = "pred", dom_col: str = "domains") -> DataFrame:
    """C9 from one long frame of routed sentences (key, domain, prediction):
    read once and aggregated once, whatever the number of domains. A
    sentence has one prediction per domain (of several the largest holds)."""
    wide = routed.groupBy(key).agg(*[F.max(F.when(F.col(dom_col) == dm, F.col(value))).alias(f"{dm}_lvl") for dm in doms])
    return sentences.join(wide, key, "left")


def backfill_predictions(timeline: DataFrame, preds: DataFrame, cols: Sequence[str],
                         key: str = "NotitieID", annotated: str = "annotated") -> DataFrame:
    """Annotated notes keep gold, the rest take the predicted levels."""
    p = preds.select(key, *[F.col(c).alias(f"_p_{c}") for c in cols])
    j = timeline.join(p, key, "left")
    return j.withColumns({c: F.when(F.col(annotated), F.col(c)).otherwise(F.col(f"_p_{c}")) for c in cols}) \
            .drop(*[f"_p_{c}" for c in cols])


def join_sentence_context(long: DataFrame, sentences: DataFrame, key: str = "pad_sen_id") -> DataFrame:
    """C11: add background flags to long predictions; derive background and
    correct."""
    ctx = sentences.select(key, "background_sent", "target_sent")
    j = long.join(ctx, key, "left")
    return j.withColumns({
        "background": F.coalesce(F.col("background_sent"), F.lit(False)) | F.coalesce(F.col("target_sent"), F.lit(False)),
        "correct": F.col("labels") == F.col("preds"),
    })


def select_iaa_notes(tokens: DataFrame, batch: DataFrame, key: str = "NotitieID",
                     meth: str = "samp_meth") -> DataFrame:
    """Keep notes sampled for agreement."""
    return tokens.join(batch.filter(F.col(meth) == "kwd_iaa").select(key).distinct(), key, "left_semi")


def align_two_series(a: DataFrame, b: DataFrame, date: str, value: str,
                     names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Mean value per date of two series, outer-aligned on the date."""
    x = a.groupBy(date).agg(F.avg(value).alias(names[0]))
    y = b.groupBy(date).agg(F.avg(value).alias(names[1]))
    return x.join(y, date, "full_outer")


def annotator_pairs(df: DataFrame, key: str, annotator: str = "annotator", ordered: bool = True) -> DataFrame:
    """C14: annotator pairs that share an item (self-join on the item key,
    never a cross join); ordered (a1 <> a2) or unordered (a1 < a2)."""
    l = df.select(key, F.col(annotator).alias("a1")).distinct()
    r = df.select(key, F.col(annotator).alias("a2")).distinct()
    cond = (F.col("a1") != F.col("a2")) if ordered else (F.col("a1") < F.col("a2"))
    return l.join(r, key).filter(cond)


def restrict_to_patient_set(df: DataFrame, patients: DataFrame, key: str = "MDN") -> DataFrame:
    """Rows of patients present in another table."""
    return df.join(patients.select(key).distinct(), key, "left_semi")


def token_align_annotators(df: DataFrame, annotators: Sequence[str],
                           keys: Sequence[str] = ("sen_id", "tok", "token")) -> DataFrame:
    """label/relation of every annotator side by side per token; only
    sentences in which someone put a label are kept."""
    aggs = []
    for a in annotators:
        hit = F.col("annotator") == a
        aggs += [F.max(F.when(hit, F.col("label"))).alias(f"label_{a}"),
                 F.max(F.when(hit, F.col("relation"))).alias(f"relation_{a}")]
    # grouping by the note too (a sentence id determines its note) lets a
    # note partitioning of the tokens serve both aggregations
    note = ["NotitieID"] if "NotitieID" in df.columns and "NotitieID" not in keys else []
    al = df.groupBy(*note, *keys).agg(*aggs)
    any_lab = reduce(lambda x, y: x | y, [F.coalesce(F.col(f"label_{a}") != "_", F.lit(False)) for a in annotators])
    labelled = al.filter(any_lab).select(*note, "sen_id").distinct()
    return al.join(labelled, [*note, "sen_id"], "left_semi").drop(*note)
