"""Inter-annotator agreement.

The annotators' votes on an item (sentence) are gathered in one row, bounded
by the annotator list, and pairs are formed inside the row: the work grows
with annotators^2 per item and nothing is joined. Where the note id is at
hand it is part of every key, so tokens that are partitioned by note are not
shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS
from noteframe.operators.evaluate import prf


def sentence_multilabel_by_annotator(tokens: DataFrame, domains: Sequence[str] = DOMAINS,
                                     key: str = "pad_sen_id", n_annotators: int | None = None) -> DataFrame:
    """Domain vector per (annotator, sentence), only for sentences that
    every annotator saw."""
    keys = _item_keys(tokens, key)
    if n_annotators is None:
        n_annotators = tokens.select("annotator").distinct().count()
    g = tokens.groupBy(*keys, "annotator").agg(
        F.array(*[F.max(F.coalesce(F.col(d), F.lit(False)).cast("int")) for d in domains]).alias("labels"))
    votes = g.groupBy(*keys).agg(F.collect_list(F.struct("annotator", "labels")).alias("votes"))
    return votes.filter(F.size("votes") == n_annotators).select(*keys, F.inline("votes"))


def _item_keys(df: DataFrame, *key: str) -> list[str]:
    """An item belongs to one note: with the note id the groups are the same."""
    return [c for c in ("NotitieID",) if c in df.columns] + list(key)


def _pairs(rows: DataFrame, keys: Sequence[str], value: str, ordered: bool) -> DataFrame:
    """(*keys, annotator1, annotator2, x, y): the pairs of annotators of an item."""
    votes = rows.groupBy(*keys).agg(F.collect_list(F.struct("annotator", F.col(value).alias("v"))).alias("votes"))
    meets = (lambda a, b: a["annotator"] != b["annotator"]) if ordered else (lambda a, b: a["annotator"] < b["annotator"])
    pairs = F.flatten(F.transform("votes", lambda a: F.transform(F.filter("votes", lambda b: meets(a, b)), lambda b: F.struct(
        a["annotator"].alias("annotator1"), b["annotator"].alias("annotator2"), a["v"].alias("x"), b["v"].alias("y")))))
    return votes.select(*keys, F.inline(pairs))


def pairwise_prf(ml: DataFrame, domains: Sequence[str] = DOMAINS, key: str = "pad_sen_id") -> DataFrame:
    """precision/recall/F1/support per ordered pair x domain (first
    annotator taken as gold)."""
    p = _pairs(ml, _item_keys(ml, key), "labels", ordered=True)
    z = F.arrays_zip(F.array(*[F.lit(d) for d in domains]).alias("domain"), F.col("x").alias("labels"),
                     F.col("y").alias("preds"))
    long = p.select("annotator1", "annotator2", F.inline(z))
    return prf(long, by=("annotator1", "annotator2", "domain"), digits=None)


def mean_f1_per_domain(pr: DataFrame) -> DataFrame:
    """Mean F1 (2 decimals) and support range per domain."""
    return pr.groupBy("domain").agg(F.bround(F.avg("f1"), 2).alias("f1"), F.min("support").alias("min_support"),
                                    F.max("support").alias("max_support"))


def f1_pair_matrix(pr: DataFrame, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Unordered pair x domain F1 (pivot on the fixed domain list) plus
    a mean row."""
    u = pr.filter(F.col("annotator1") < F.col("annotator2"))
    wide = u.groupBy("annotator1", "annotator2").pivot("domain", list(domains)).agg(F.first("f1"))
    mean = wide.agg(*[F.avg(d).alias(d) for d in domains]).select(
        F.lit("mean").alias("annotator1"), F.lit("").alias("annotator2"), *domains)
    return wide.unionByName(mean)


def pair_outcome(ml: DataFrame, domains: Sequence[str] = DOMAINS, key: str = "pad_sen_id") -> DataFrame:
    """Per sentence, unordered pair and domain: true positive / true
    negative / false positive / false negative / confusion. 'Annotator 2
    labelled nothing' is ``sum = 0`` (the docstring's intent; quirk Q17)."""
    p = _pairs(ml, _item_keys(ml, key), "labels", ordered=False).withColumnsRenamed({"x": "l1", "y": "l2"})
    n_diff = F.aggregate(F.zip_with("l1", "l2", lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, b: a + b)
    s2 = F.aggregate(F.col("l2"), F.lit(0), lambda a, b: a + b)
    p = p.select(key, "annotator1", "annotator2", "l1", "l2", n_diff.alias("n_diff"), s2.alias("s2"),
                 F.posexplode(F.array(*[F.lit(d) for d in domains])).alias("i", "domain"))
    a1, a2 = F.get(F.col("l1"), F.col("i")), F.get(F.col("l2"), F.col("i"))
    eq = a1 == a2
    out = (F.when(eq & (a1 == 1), "true positive").when(eq & (a1 == 0), "true negative")
            .when(~eq & (a1 == 0), "false positive").when(F.col("s2") == 0, "false negative")
            .when(F.col("n_diff") == 1, "false negative").otherwise("confusion"))
    return p.select(key, "annotator1", "annotator2", "domain", out.alias("outcome"))


def sentence_levels_by_annotator(tokens: DataFrame, domains: Sequence[str] = DOMAINS,
                                 key: str = "pad_sen_id") -> DataFrame:
    """Mean level per (sentence, domain, annotator), long form: the
    columns are averaged first and unpivoted after."""
    keys = _item_keys(tokens, key)
    wide = tokens.groupBy(*keys, "annotator").agg(*[F.avg(F.col(f"{d}_lvl").cast("double")).alias(f"_{d}") for d in domains])
    arr = F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"_{d}").alias("level")) for d in domains])
    return wide.select(*keys, "annotator", F.inline(arr)).filter(F.col("level").isNotNull())


def pairwise_mae(lv: DataFrame, key: str = "pad_sen_id") -> DataFrame:
    """Mean absolute level difference per unordered pair x domain over
    items both annotators levelled; empty pairs do not appear."""
    j = _pairs(lv, _item_keys(lv, key, "domain"), "level", ordered=False)
    return j.groupBy("annotator1", "annotator2", "domain").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"),
                                                               F.count("*").alias("support"))


def mean_mae_per_level(mae: DataFrame, digits: int | None = 2) -> DataFrame:
    """Mean MAE (rounded to ``digits``) and support range per domain."""
    mean = F.avg("mae") if digits is None else F.bround(F.avg("mae"), digits)
    return mae.groupBy("domain").agg(mean.alias("mae"), F.min("support").alias("min_support"),
                                     F.max("support").alias("max_support"))


def mae_pair_matrix(mae: DataFrame, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Unordered pair x domain MAE (pivot on the fixed domain list) plus
    a mean row."""
    wide = mae.groupBy("annotator1", "annotator2").pivot("domain", list(domains)).agg(F.first("mae"))
    mean = wide.agg(*[F.avg(d).alias(d) for d in domains]).select(
        F.lit("mean").alias("annotator1"), F.lit("").alias("annotator2"), *domains)
    return wide.unionByName(mean)


def fleiss_kappa(tokens: DataFrame, domains: Sequence[str] = DOMAINS, note: str = "NotitieID") -> DataFrame:
    """Per domain, note x {False, True} rater counts, then Fleiss'
    kappa by aggregates (NULL when P_e = 1). A note with a single rater holds
    no agreement and is left out; ``raters_per_note`` shows such notes."""
    arr = F.array(*[F.struct(F.lit(d).alias("domain"), F.coalesce(F.col(d), F.lit(False)).alias("v")) for d in domains])
    per = tokens.select(note, "annotator", F.inline(arr)).groupBy(note, "domain", "annotator") \
                .agg(F.bool_or("v").alias("v"))
    cnt = per.groupBy(note, "domain").agg(F.count(F.when(F.col("v"), 1)).alias("t"),
                                          F.count(F.when(~F.col("v"), 1)).alias("f"))
    n = F.col("t") + F.col("f")
    cnt = cnt.withColumn("n", n).filter("n > 1").withColumn("p_i", (F.col("t") ** 2 + F.col("f") ** 2 - n) / (n * (n - 1)))
    g = cnt.groupBy("domain").agg(F.avg("p_i").alias("p_bar"), F.sum("t").alias("st"), F.sum("f").alias("sf"))
    tot = F.col("st") + F.col("sf")
    pe = (F.col("st") / tot) ** 2 + (F.col("sf") / tot) ** 2
    return g.select("domain", F.when(pe < 1, (F.col("p_bar") - pe) / (1 - pe)).alias("kappa"))


def annotation_overview(tokens: DataFrame, key: str, annotators: Sequence[str],
                        domains: Sequence[str] = DOMAINS,
                        flags: Sequence[str] = ("target", "background", "plus")) -> DataFrame:
    """Per item (note or sentence) x label item (domain flag, level
    set, flag), one column per annotator; only rows where someone annotated.
    Values: 'True'/'False' for flags, sorted distinct levels for levels."""
    aggs = []
    for d in domains:
        aggs.append(F.bool_or(F.coalesce(F.col(d), F.lit(False))).cast("string").alias(d))
        aggs.append(F.concat_ws(",", F.array_sort(F.collect_set(F.col(f"{d}_lvl").cast("int")).cast("array<string>")))
                    .alias(f"{d}_lvl"))
    for f in flags:
        aggs.append(F.bool_or(F.coalesce(F.col(f), F.lit(False))).cast("string").alias(f))
    items = [c for d in domains for c in (d, f"{d}_lvl")] + list(flags)
    g = tokens.groupBy(key, "annotator").agg(*aggs)
    long = g.select(key, "annotator", F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value"))
                                                         for c in items])))
    wide = long.groupBy(key, "item").agg(*[F.max(F.when(F.col("annotator") == a, F.col("value"))).alias(a)
                                           for a in annotators])
    hit = None
    for a in annotators:
        h = F.coalesce((F.col(a) != "false") & (F.col(a) != ""), F.lit(False))
        hit = h if hit is None else hit | h
    return wide.filter(hit)
