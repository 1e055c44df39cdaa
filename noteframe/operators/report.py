"""Descriptive report tables.

Reports are long-form DataFrames (key columns, never nested headers).
Margins follow the reference table by table: some totals are sums of the
rows (D7, D8, D12, D26), others are global distinct counts (D11, D20),
done with rollup/cube so distinct counts stay exact. All heavy work is
partial/final hash aggregation; totals are computed over the (small)
aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS

TOTAL = "total"


def _with_sum_row(g: DataFrame, key: str, label: str = TOTAL) -> DataFrame:
    nums = [c for c in g.columns if c != key]
    tot = g.agg(*[F.sum(c).alias(c) for c in nums]).select(F.lit(label).alias(key), *[F.col(c).cast(g.schema[c].dataType) for c in nums])
    return g.unionByName(tot)


def _pct(n, d, digits: int = 1):
    return F.round(F.try_divide(F.col(n).cast("double"), F.col(d)) * 100, digits)


def unique_counts_with_total(df: DataFrame, by: str = "institution", patient: str = "MDN",
                             note: str = "NotitieID") -> DataFrame:
    """Distinct patients and notes per group; total = sum of rows."""
    g = df.groupBy(by).agg(F.countDistinct(patient).alias("n_patients"), F.countDistinct(note).alias("n_notes"))
    return _with_sum_row(g, by)


def overview_all_annotated_rest(notes: DataFrame, annotated: DataFrame, by: str = "institution",
                                note: str = "NotitieID") -> DataFrame:
    """All / annotated / rest notes per group, total = sum over all
    groups (quirk Q9: not only two named groups)."""
    all_ = notes.groupBy(by).agg(F.countDistinct(note).alias("n_all"))
    ann = notes.join(annotated.select(note).distinct(), note, "left_semi") \
               .groupBy(by).agg(F.countDistinct(note).alias("n_annotated"))
    j = all_.join(ann, by, "full_outer").fillna(0, ["n_all", "n_annotated"])
    j = j.withColumn("n_rest", F.col("n_all") - F.col("n_annotated"))
    return _with_sum_row(j, by)


def patients_notes_diagnoses(notes: DataFrame, diagnoses: DataFrame, by: str = "institution",
                             patient: str = "MDN", note: str = "NotitieID") -> DataFrame:
    """Counts for patients that have a diagnosis."""
    pats = diagnoses.select(patient).distinct()
    sel = notes.join(pats, patient, "left_semi")
    return sel.groupBy(by).agg(F.countDistinct(patient).alias("n_patients"), F.countDistinct(note).alias("n_notes"))


def batch_overview(batch: DataFrame, annotator: str = "annotator", source: str = "source",
                   meth: str = "samp_meth") -> DataFrame:
    """Notes by annotator x (source, samp_meth), with row, column and
    grand totals (cube over the two axes)."""
    b = batch.withColumn("_sm", F.concat_ws("/", F.col(source), F.col(meth)))
    c = b.cube(annotator, "_sm").agg(F.count("*").alias("n"))
    return c.select(F.coalesce(F.col(annotator), F.lit(TOTAL)).alias(annotator),
                    F.coalesce(F.col("_sm"), F.lit(TOTAL)).alias("source_samp_meth"), "n")


def notes_disregard_overview(tokens: DataFrame, source: str = "source", note: str = "NotitieID",
                             flag: str = "disregard") -> DataFrame:
    """Per source distinct notes, disregarded notes, kept, percent; the
    total row is a global distinct count (rollup)."""
    t = tokens.filter(F.col(source).isNotNull())
    r = t.rollup(source).agg(F.countDistinct(note).alias("n_notes"),
                             F.countDistinct(F.when(F.col(flag), F.col(note))).alias("n_disregard"))
    r = r.withColumn(source, F.coalesce(F.col(source), F.lit(TOTAL)))
    return r.withColumns({"n_annotated": F.col("n_notes") - F.col("n_disregard"),
                          "prc_disregard": _pct("n_disregard", "n_notes")})


def _has_domain(domains: Sequence[str]):
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(d), F.lit(False)) for d in domains])


def sentences_with_labels(tokens: DataFrame, domains: Sequence[str] = DOMAINS, source: str = "source",
                          sen: str = "sen_id") -> DataFrame:
    """Per source distinct sentences, those with >= 1 domain, percent;
    total = sum of rows."""
    g = tokens.groupBy(source).agg(F.countDistinct(sen).alias("n_all_sents"),
                                   F.countDistinct(F.when(_has_domain(domains), F.col(sen))).alias("n_sents_with_labels"))
    g = _with_sum_row(g, source)
    return g.withColumn("prc_sents_with_labels", _pct("n_sents_with_labels", "n_all_sents"))


def domain_distribution(tokens: DataFrame, domains: Sequence[str] = DOMAINS, source: str = "source",
                        sen: str = "sen_id", prefilter: bool = False) -> DataFrame:
    """D13 (D14 with ``prefilter``): labelled sentences per source x domain,
    margins (total row and column) and percent of the row total (rounded
    half to even, as numpy). Long form: (source, domain, n, pct)."""
    t = tokens.filter(_has_domain(domains)) if prefilter else tokens
    # the note id (when present) is added to the key: a sentence belongs to
    # one note, so the groups are the same and a note partitioning is reused
    keys = ["NotitieID", source, sen] if "NotitieID" in t.columns else [source, sen]
    per_sen = t.groupBy(*keys).agg(*[F.max(F.coalesce(F.col(d), F.lit(False)).cast("int")).alias(d) for d in domains])
    g = per_sen.groupBy(source).agg(*[F.sum(d).alias(d) for d in domains])
    g = _with_sum_row(g, source)
    g = g.withColumn(TOTAL, reduce(lambda a, b: a + b, [F.col(d) for d in domains]))
    long = g.select(source, F.col(TOTAL).alias("_rowtot"),
                    F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(d).cast("bigint").alias("n"))
                                        for d in list(domains) + [TOTAL]])).alias("_x"))
    return long.select(source, "_x.domain", "_x.n",
                       F.bround(F.try_divide(F.col("_x.n").cast("double"), F.col("_rowtot")) * 100, 0).cast("bigint").alias("pct"))


def _level_long(tokens: DataFrame, domains: Sequence[str], keys: Sequence[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"{d}_lvl").cast("int").alias("level")) for d in domains])
    return tokens.select(*keys, F.inline(arr)).filter(F.col("level").isNotNull())


def _level_sets(tokens: DataFrame, domains: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(*keys, domain, levels): distinct levels per group and domain. The
    columns are aggregated first and unpivoted after, so token rows are not
    multiplied by the domains."""
    wide = tokens.groupBy(*keys).agg(*[F.collect_set(F.col(f"{d}_lvl").cast("int")).alias(f"_{d}") for d in domains])
    arr = F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"_{d}").alias("levels")) for d in domains])
    return wide.select(*keys, F.inline(arr))


def level_distribution(tokens: DataFrame, domains: Sequence[str] = DOMAINS, source: str = "source",
                       sen: str = "sen_id") -> DataFrame:
    """Per source x domain x level, sentences holding that level at
    least once; plus the total over sources."""
    keys = ["NotitieID", source, sen] if "NotitieID" in tokens.columns else [source, sen]
    lv = _level_sets(tokens, domains, keys).select(*keys, "domain", F.explode("levels").alias("level"))
    g = lv.groupBy(source, "domain", "level").agg(F.count("*").alias("n"))
    tot = g.groupBy("domain", "level").agg(F.sum("n").alias("n")).withColumn(source, F.lit(TOTAL))
    return g.unionByName(tot.select(source, "domain", "level", F.col("n").cast("bigint")))


def level_distribution_pct(tokens: DataFrame, domains: Sequence[str] = DOMAINS, source: str = "source",
                           sen: str = "sen_id") -> DataFrame:
    """D15 with percent of the (source, domain) subtotal."""
    g = level_distribution(tokens, domains, source, sen)
    w = Window.partitionBy(source, "domain")
    return g.withColumns({"subtotal": F.sum("n").over(w)}).withColumn(
        "pct", F.round(F.col("n") / F.col("subtotal") * 100, 1))


def levels_per_note_hist(tokens: DataFrame, domains: Sequence[str] = DOMAINS, note: str = "NotitieID") -> DataFrame:
    """Notes by number of distinct levels per domain (notes with >= 1)."""
    per = _level_sets(tokens, domains, [note]).select("domain", F.size("levels").cast("bigint").alias("n_levels")).filter("n_levels > 0")
    return per.groupBy("domain", "n_levels").agg(F.count("*").alias("n_notes"))


def level_spread_hist(tokens: DataFrame, domains: Sequence[str] = DOMAINS, note: str = "NotitieID") -> DataFrame:
    """Notes with more than one distinct level, by max - min."""
    per = _level_sets(tokens, domains, [note]).select("domain", F.size("levels").alias("k"),
                                                      (F.array_max("levels") - F.array_min("levels")).alias("spread"))
    return per.filter("k > 1").groupBy("domain", "spread").agg(F.count("*").alias("n_notes"))


def sampling_method_comparison(tokens: DataFrame, domains: Sequence[str] = DOMAINS,
                               meth: str = "samp_meth", note: str = "NotitieID", sen: str = "sen_id",
                               disregard_note: str = "disregard_note") -> DataFrame:
    """Keyword vs random notes: % disregarded notes, % labelled
    sentences and % of sentences per domain (first part of samp_meth)."""
    t = tokens.withColumn("_m", F.split(F.col(meth), "_").getItem(0))
    notes = t.groupBy("_m").agg(F.countDistinct(note).alias("n_notes"),
                                F.countDistinct(F.when(F.col(disregard_note), F.col(note))).alias("n_disregard"))
    kept = t.filter(~F.col(disregard_note))
    per_sen = kept.groupBy("_m", sen).agg(*[F.max(F.coalesce(F.col(d), F.lit(False)).cast("int")).alias(d) for d in domains])
    sents = per_sen.groupBy("_m").agg(F.count("*").alias("n_sents"),
                                      F.sum(F.greatest(*[F.col(d) for d in domains])).alias("n_labelled"),
                                      *[F.sum(d).alias(f"n_{d}") for d in domains])
    j = notes.join(sents, "_m", "left")
    return j.select(F.col("_m").alias("method"), "n_notes", "n_sents",
                    _pct("n_disregard", "n_notes").alias("prc_disregard"),
                    _pct("n_labelled", "n_sents").alias("prc_labelled"),
                    *[_pct(f"n_{d}", "n_sents").alias(f"prc_{d}") for d in domains])


def patients_notes_by_annotated(df: DataFrame, by: str = "institution", annotated: str = "annotated",
                                patient: str = "MDN", note: str = "NotitieID") -> DataFrame:
    """Distinct patients and note counts by institution x annotated,
    all margins (cube: margins are global distinct counts)."""
    c = df.cube(by, annotated).agg(F.countDistinct(patient).alias("n_patients"), F.count(note).alias("n_notes"))
    return c.select(F.coalesce(F.col(by), F.lit("Total")).alias(by),
                    F.coalesce(F.col(annotated).cast("string"), F.lit("Total")).alias(annotated),
                    "n_patients", "n_notes")


def notes_per_patient_hist(df: DataFrame, id_col: str = "MDN", width: int = 25, cap: int = 500) -> DataFrame:
    """Notes per patient capped at ``cap``, right-closed bins of
    ``width``, the last one reaching ``cap`` or beyond; empty bins kept (bin
    table built from the parameters)."""
    spark = df.sparkSession
    n = df.groupBy(id_col).agg(F.count("*").alias("n"))
    binned = n.select(F.ceil(F.least(F.col("n"), F.lit(cap)) / width).cast("int").alias("bin")) \
              .groupBy("bin").agg(F.count("*").alias("n_patients"))
    bins = spark.range(1, -(-cap // width) + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(binned, "bin", "left").select(
        ((F.col("bin") - 1) * width).alias("bin_lo"), (F.col("bin") * width).alias("bin_hi"),
        F.coalesce("n_patients", F.lit(0)).cast("bigint").alias("n_patients"))


def labelled_notes_overview(df: DataFrame, levels: Sequence[str], annotated: str = "annotated",
                            zero_is_label: bool = True) -> DataFrame:
    """Non-NULL count per level column by annotated, plus totals, and
    notes with any label. ``zero_is_label=False`` reproduces quirk Q10
    (a level of 0.0 does not count as a label)."""
    def lab(c):
        return F.col(c).isNotNull() if zero_is_label else (F.col(c).isNotNull() & (F.col(c) != 0))
    any_lab = reduce(lambda a, b: a | b, [lab(c) for c in levels])
    g = df.groupBy(F.col(annotated).cast("string").alias("annotated")).agg(
        *[F.count(F.col(c)).alias(c) for c in levels],
        F.count(F.when(any_lab, 1)).alias("notes_with_label"))
    g = _with_sum_row(g, "annotated", "Total")
    cols = list(levels) + ["notes_with_label"]
    return g.select("annotated", F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("bigint").alias("n"))
                                                    for c in cols])))


def value_histogram(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width histogram per column (last bin closed), as numpy: a
    column with one value gets bins of half a unit to each side, one without
    values bins over [0, 1]; every bin has a row."""
    spark = df.sparkSession
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                        for c in cols]))).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rng = long.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    half = F.when(F.col("lo") == F.col("hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    rng = rng.select("column", (F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"))
    j = long.join(F.broadcast(rng), "column")  # one row per column: bounded
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
    # numpy: index from (v - lo) * bins / (hi - lo), then corrected against
    # the bin edges lo + i * (hi - lo) / bins so edge values land as numpy puts them
    raw = F.least(F.floor((v - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1)).cast("int")
    j = j.withColumn("_i", raw)

    def edge(i):
        return lo + i.cast("double") * ((hi - lo) / F.lit(float(bins)))
    i = F.col("_i")
    fixed = (F.when(v < edge(i), i - 1)
              .when((v >= edge(i + 1)) & (i != bins - 1), i + 1).otherwise(i))
    counts = j.groupBy("column", fixed.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(c, i) for c in cols for i in range(bins)], "column string, bin int")
    return grid.join(counts, ["column", "bin"], "left").select("column", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def date_summary(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, min, quartiles, max of a date column (days since
    epoch for the interpolated statistics)."""
    d = F.unix_date(F.col(col).cast("date"))
    return df.agg(F.count(col).alias("n"), F.min(col).cast("date").alias("min_date"),
                  F.max(col).cast("date").alias("max_date"), F.avg(d).alias("mean_days"),
                  F.percentile(d, 0.25).alias("q25_days"), F.percentile(d, 0.5).alias("q50_days"),
                  F.percentile(d, 0.75).alias("q75_days"))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of distinct values per column, one row."""
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in cols])


def dataset_balance_sentences(df: DataFrame, labels: str = "labels", split: str = "split",
                              domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Per split positives per domain and sentences; total = sum."""
    g = df.groupBy(split).agg(*[F.sum(F.get(F.col(labels), i)).cast("bigint").alias(d) for i, d in enumerate(domains)],
                              F.count("*").alias("n_rows"))
    return _with_sum_row(g, split)


def dataset_balance_notes(df: DataFrame, labels: str = "labels", split: str = "split", note: str = "NotitieID",
                          domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Per split notes positive per domain and notes (per-note max)."""
    per = df.groupBy(split, note).agg(F.array(*[F.max(F.get(F.col(labels), i)) for i in range(len(domains))]).alias(labels))
    return dataset_balance_sentences(per, labels, split, domains)


def level_dataset_sizes(df: DataFrame, split: str = "split", note: str = "NotitieID",
                        domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Split x domain rows with a level and distinct notes."""
    lv = _level_long(df, domains, [split, note])
    return lv.groupBy(split, "domain").agg(F.count("*").alias("n_rows"), F.countDistinct(note).alias("n_notes"))


def split_leakage_check(df: DataFrame, split: str = "split", note: str = "NotitieID") -> DataFrame:
    """Pairs of splits sharing notes (empty when there is no leak)."""
    ns = df.select(note, split).distinct()
    a = ns.select(note, F.col(split).alias("split_a"))
    b = ns.select(note, F.col(split).alias("split_b"))
    return a.join(b, note).filter("split_a < split_b").groupBy("split_a", "split_b").agg(
        F.count("*").alias("shared_notes"))


def patient_nonnull_counts(df: DataFrame, id_col: str = "MDN", cols: Sequence[str] | None = None) -> DataFrame:
    """Non-NULL count of every column per patient."""
    cols = [c for c in (cols or df.columns) if c != id_col]
    return df.groupBy(id_col).agg(*[F.count(F.col(c)).alias(c) for c in cols])


def filter_groups_by_size(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Rows of groups with more than ``n`` rows (HAVING + semi-join)."""
    big = df.groupBy(id_col).agg(F.count("*").alias("_n")).filter(F.col("_n") > n).select(id_col)
    return df.join(big, id_col, "left_semi")


def notes_crosstab(df: DataFrame, date: str, id_col: str, values: Sequence | None = None) -> DataFrame:
    """Date x patient note counts. With ``values`` (a bounded list of
    patients) pivoted wide; otherwise long, which scales with patients."""
    if values is None:
        return df.groupBy(date, id_col).agg(F.count("*").alias("n"))
    return df.groupBy(date).pivot(id_col, list(values)).count().fillna(0)


def write_crosstab(df: DataFrame, path: str, date: str, id_col: str, width: int = 500) -> None:
    """D32 wide, without a list of patients: a block pivot.

    The patients are ranked and dealt into blocks of ``width`` columns; the
    cells are written by block, one set of files each, as columns ``c0``,
    ``c1``, ..., beside the names of the columns and the dates. No block is
    wider than ``width``, however many patients there are. Rows without date
    or patient are left out.
    """
    from noteframe.operators.sampling import global_rank
    df = df.select(F.col(date).alias("_date"), F.col(id_col).cast("string").alias("_id")).where("_date IS NOT NULL AND _id IS NOT NULL")
    ranked = global_rank(df.select("_id").distinct(), ["_id"], "_r")
    place = ranked.select("_id", F.floor(F.col("_r") / width).cast("int").alias("block"), (F.col("_r") % width).cast("int").alias("pos"))
    counts = df.groupBy("_date", "_id").agg(F.count("*").alias("n")).join(place, "_id")
    wide = (counts.groupBy("block", F.col("_date").alias(date)).pivot("pos", list(range(width))).agg(F.sum("n")).fillna(0)
            .withColumnsRenamed({str(i): f"c{i}" for i in range(width)}))
    # by block, and by date within it: a block of many dates is several files
    wide.repartition("block", date).write.mode("overwrite").partitionBy("block").parquet(f"{path}/cells")
    place.select("block", "pos", F.col("_id").alias("id")).write.mode("overwrite").parquet(f"{path}/columns")
    df.select(F.col("_date").alias(date)).distinct().write.mode("overwrite").parquet(f"{path}/dates")


def read_crosstab_block(spark, path: str, block: int) -> DataFrame:
    """One block of :func:`write_crosstab`: a row for every date, a column named for every patient of the block."""
    names = [r["id"] for r in spark.read.parquet(f"{path}/columns").where(F.col("block") == block).orderBy("pos").collect()]
    cells = spark.read.parquet(f"{path}/cells").where(F.col("block") == block)
    dates = spark.read.parquet(f"{path}/dates")
    date = dates.columns[0]
    kept = cells.select(date, *[F.col(f"c{i}") for i in range(len(names))])
    return dates.join(kept, date, "left").fillna(0).toDF(date, *names)


def read_crosstab(spark, path: str) -> DataFrame:
    """(date, patient, n): the cells of all blocks that are not zero, in long form."""
    cells = spark.read.parquet(f"{path}/cells")
    date = spark.read.parquet(f"{path}/dates").columns[0]
    counts = F.array(*[F.col(c) for c in cells.columns if c not in (date, "block")])
    long = cells.select(date, "block", F.posexplode(counts).alias("pos", "n")).where("n > 0")
    return long.join(spark.read.parquet(f"{path}/columns"), ["block", "pos"]).select(date, "id", "n")


def notes_per_patient_day(df: DataFrame, id_col: str = "MDN", date: str = "Notitiedatum") -> DataFrame:
    """Note counts per (patient, date)."""
    return df.groupBy(id_col, date).agg(F.count("*").alias("n"))


def activity_tier_summary(df: DataFrame, tiers: Sequence[int], id_col: str = "MDN",
                          annotated: str = "annotated") -> DataFrame:
    """Per size tier (> t notes per patient): unique patients,
    annotated and not annotated notes, total notes. One aggregation per
    patient, then each tier is a filter over the per-patient rows; a tier
    that no patient exceeds has zeros."""
    per = df.groupBy(id_col).agg(F.count("*").alias("n"),
                                 F.count(F.when(F.col(annotated), 1)).alias("a"))
    # each patient row is expanded to the tiers it exceeds (no join)
    tier_arr = F.array(*[F.lit(int(x)) for x in tiers])
    j = per.select("n", "a", F.explode(F.filter(tier_arr, lambda t: F.col("n") > t)).alias("tier"))
    g = j.groupBy("tier").agg(F.count("*").alias("unique_ids"), F.sum("a").alias("annotated"),
                              (F.sum("n") - F.sum("a")).alias("not_annotated"), F.sum("n").alias("total_notes"))
    every = df.sparkSession.createDataFrame([(int(x),) for x in tiers], "tier int")
    return every.join(g, "tier", "left").fillna(0)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency table of a column."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def raters_per_note(df: DataFrame, annotator: str = "annotator", note: str = "NotitieID") -> DataFrame:
    """Distinct notes per annotator (equal-rater precondition of H21)."""
    return df.groupBy(annotator).agg(F.countDistinct(note).alias("n_notes"))
