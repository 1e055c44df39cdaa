"""Seeded, deterministic sampling and splitting.

The reference draws with unseeded ``random``; no implementation can repeat
those draws, so the contract here is: exact quotas, the same eligibility
rules, disjoint draws, and the same result for the same seed. Every draw
orders by ``(md5_bucket(seed, id), id)``.

Scale notes: per-source top-k draws use ``row_number() <= k`` with a
constant k, which Spark plans as a partial WindowGroupLimit before the
shuffle (each task ships at most k rows per source). Group splits need two
order statistics, found by counting; global ranks use a distributed sort
(per-partition offsets), never a window without ``partitionBy``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteframe.functions.hashing import md5_bucket


def _key(id_col: str, seed: int):
    return md5_bucket(F.lit(seed), F.col(id_col))


def global_rank(df: DataFrame, order: Sequence, out: str = "rank") -> DataFrame:
    """0-based rank of every row in ``order`` (must be a total order).

    JVM-only, one shuffle: a range partitioning by ``order`` gives ordered,
    balanced partitions, sorted in place; the low bits of the monotonically
    increasing id number the rows of a partition, and the partition's offset
    (prefix sum of the per-partition counts, one small row per partition
    collected to the driver) makes that the global rank."""
    spark = df.sparkSession
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id())
    # materialised once in the shared checkpoint folder: the counts and the
    # final ranks must see the same partition assignment, also when a
    # lost executor forces a recomputation
    from noteframe.session import cut_lineage
    numbered = cut_lineage(ranged).withColumns({"_pid": F.shiftright("_m", 33).cast("int"),
                                                "_rn": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m")
    counts = sorted((r["_pid"], r["c"]) for r in numbered.groupBy("_pid").agg(F.count("*").alias("c")).collect())
    offsets, acc = [], 0  # one row per partition
    for pid, c in counts:
        offsets.append((pid, acc))
        acc += c
    off = spark.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    return numbered.join(F.broadcast(off), "_pid").withColumn(out, F.col("_off") + F.col("_rn")).drop("_pid", "_rn", "_off")


def cap_sample(df: DataFrame, id_col: str, n: int = 50000, seed: int = 45, source: str | None = None) -> DataFrame:
    """At most ``n`` rows of every source, a seeded uniform draw when it
    has more (partial WindowGroupLimit: a task ships ``n`` rows per source at
    most). Without ``source`` the frame is one source (TakeOrderedAndProject)."""
    if source is None:
        return (df.withColumn("_k", _key(id_col, seed))
                  .orderBy("_k", id_col).limit(n).drop("_k"))
    return _top_per_source(df, n, id_col, seed, source).drop("_r")


def batch_quotas(sources_other: Sequence[str], source_covid: str, n_files: int,
                 pct_covid: float, pct_kwd: float, n_iaa: int,
                 iaa_sources: Sequence[str]) -> list[dict]:
    """Per source the number of shared (IAA), keyword and random notes
    per annotator; truncating ``int()`` in the same order as the source."""
    out = []
    for src in list(sources_other) + [source_covid]:
        sub = n_iaa if src in iaa_sources else 0
        if src == source_covid:
            n = int(n_files * pct_covid - sub)
        else:
            n = int(n_files * (1 - pct_covid) / len(sources_other) - sub)
        n_kwd = int(n * pct_kwd)
        out.append({"source": src, "n_iaa": n_iaa if src in iaa_sources else 0,
                    "n_files": n, "n_kwd": n_kwd, "n_rndm": n - n_kwd})
    return out


def _eligible(df: DataFrame, matched_domains: Sequence[str], min_matched: int,
              n_col: str = "n_matched_domains"):
    if "_el" in df.columns:  # precomputed by select_notes
        return F.col("_el")
    anym = F.lit(False)
    for d in matched_domains:
        anym = anym | (F.size(F.col(d)) > 0)
    return anym & (F.col(n_col) >= min_matched)


def _top_per_source(df: DataFrame, limit: int, id_col: str, seed: int,
                    source: str = "source") -> DataFrame:
    """First ``limit`` rows per source in seeded order. The filter sits
    directly on ``row_number()`` with a constant, so Spark plans a partial
    WindowGroupLimit before the shuffle (a source never lands whole in one
    task); the 0-based rank is derived afterwards."""
    w = Window.partitionBy(source).orderBy(_key(id_col, seed), F.col(id_col))
    top = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    return top.withColumn("_r", F.col("_rn") - 1).drop("_rn")


def _quota_col(quotas: Sequence[Mapping], field: str, source: str = "source"):
    expr = F.lit(0)
    for q in quotas:
        expr = F.when(F.col(source) == q["source"], F.lit(q[field])).otherwise(expr)
    return expr


def sample_iaa_shared(notes: DataFrame, quotas: Sequence[Mapping], annotators: Sequence[str],
                      matched_domains: Sequence[str], min_matched: int, seed: int = 0,
                      id_col: str = "NotitieID", source: str = "source") -> DataFrame:
    """S3: the first n_iaa eligible notes of each IAA source, given to every
    annotator (expanded by the bounded annotator list)."""
    lim = max([q["n_iaa"] for q in quotas] + [0])
    el = notes.filter(_eligible(notes, matched_domains, min_matched))
    top = _top_per_source(el, lim, id_col, seed, source).filter(F.col("_r") < _quota_col(quotas, "n_iaa", source))
    return (top.drop("_r")
               .withColumn("annotator", F.explode(F.array(*[F.lit(a) for a in annotators])))
               .withColumn("samp_meth", F.lit("kwd_iaa")))


def _deal(pool: DataFrame, quotas, field: str, annotators, id_col, seed, source, meth):
    k = len(annotators)
    lim = max([q[field] for q in quotas] + [0]) * k
    top = _top_per_source(pool, lim, id_col, seed, source)
    per = _quota_col(quotas, field, source)
    top = top.filter(F.col("_r") < per * k)
    ann = F.array(*[F.lit(a) for a in annotators])
    idx = F.when(per > 0, F.floor(F.col("_r") / per).cast("int"))
    return (top.withColumn("annotator", F.get(ann, idx)).drop("_r")
               .withColumn("samp_meth", F.lit(meth)))


def sample_keyword(notes: DataFrame, used: DataFrame, quotas, annotators, matched_domains,
                   min_matched: int, seed: int = 0, id_col: str = "NotitieID",
                   source: str = "source") -> DataFrame:
    """Per annotator x source n_kwd eligible notes, none reused: rank the
    unused eligible notes once and deal consecutive blocks to annotators."""
    pool = notes.filter(_eligible(notes, matched_domains, min_matched)) \
                .join(used.select(id_col).distinct(), id_col, "left_anti")
    return _deal(pool, quotas, "n_kwd", annotators, id_col, seed + 1, source, "kwd")


def sample_random(notes: DataFrame, used: DataFrame, quotas, annotators, seed: int = 0,
                  id_col: str = "NotitieID", source: str = "source") -> DataFrame:
    """Per annotator x source n_rndm notes from all unused notes."""
    pool = notes.join(used.select(id_col).distinct(), id_col, "left_anti")
    return _deal(pool, quotas, "n_rndm", annotators, id_col, seed + 2, source, "rndm")


def select_notes(notes: DataFrame, annotators: Sequence[str], sources_other: Sequence[str],
                 source_covid: str, n_files: int, pct_covid: float, pct_kwd: float,
                 domains: Sequence[str], matched_domains: Sequence[str],
                 min_matched_domains: int, n_iaa: int, iaa_sources: Sequence[str],
                 seed: int = 0, id_col: str = "NotitieID", source: str = "source",
                 allow_short: bool = False) -> DataFrame:
    """S2-S5 composed. ``notes`` holds all sources (``source`` column)
    and one array column of keyword matches per domain.

    The keyword search runs once: the candidate table (id, source,
    eligibility) is checkpointed to the shared folder and the three draws
    re-read only that. The drawn batch is bounded by the quotas (a
    parameter), so it is broadcast to pick the full note rows; that
    semi-join sits below the keyword projection, so matches are recomputed
    only for the drawn notes.

    A pool that cannot fill its quota is an error that names the shortfall,
    unless ``allow_short``: then :func:`batch_shortfall` shows it."""
    from noteframe.operators.keywords import count_matched_domains
    from noteframe.session import cut_lineage
    quotas = batch_quotas(sources_other, source_covid, n_files, pct_covid, pct_kwd, n_iaa, iaa_sources)
    data = count_matched_domains(notes, domains)
    cand = cut_lineage(data.select(id_col, source, _eligible(data, matched_domains, min_matched_domains).alias("_el")))
    iaa = sample_iaa_shared(cand, quotas, annotators, matched_domains, min_matched_domains, seed, id_col, source)
    kwd = sample_keyword(cand, iaa, quotas, annotators, matched_domains, min_matched_domains, seed, id_col, source)
    used = iaa.select(id_col).unionByName(kwd.select(id_col))
    rnd = sample_random(cand, used, quotas, annotators, seed, id_col, source)
    drawn = iaa.unionByName(kwd).unionByName(rnd)
    if not allow_short:
        drawn = cut_lineage(drawn)  # bounded by the quotas
        short = batch_shortfall(drawn, quotas, annotators, source).filter("missing > 0").orderBy(
            "source", "samp_meth", "annotator").collect()
        if short:
            raise ValueError("too few notes for the batch: " + "; ".join(
                f"{r['source']} {r['samp_meth']} {r['annotator']}: {r['drawn']} of {r['required']}" for r in short))
    batch = drawn.select(id_col, "annotator", "samp_meth")
    chosen = data.join(F.broadcast(batch.select(id_col).distinct()), id_col, "left_semi")
    return chosen.join(F.broadcast(batch), id_col)


def batch_shortfall(batch: DataFrame, quotas: Sequence[Mapping], annotators: Sequence[str],
                    source: str = "source") -> DataFrame:
    """S6 check: drawn vs required per (annotator, source, samp_meth); a
    pool that is too small shows up as ``missing > 0``."""
    spark = batch.sparkSession
    need = [(a, q["source"], m, int(q[f])) for a in annotators for q in quotas
            for m, f in (("kwd_iaa", "n_iaa"), ("kwd", "n_kwd"), ("rndm", "n_rndm"))]
    req = spark.createDataFrame(need, "annotator string, source string, samp_meth string, required int")
    got = batch.groupBy("annotator", source, "samp_meth").agg(F.count("*").alias("drawn"))
    return (req.join(got, ["annotator", "source", "samp_meth"], "left")
               .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
               .withColumn("missing", F.greatest(F.col("required") - F.col("drawn"), F.lit(0))))


def dedup_annotators(df: DataFrame, seed: int = 0, note: str = "NotitieID",
                     annotator: str = "annotator", clustered: bool = False) -> DataFrame:
    """Keep one (seeded) annotator per note.

    ``clustered=True`` (input already hash-partitioned by note): a window
    per note picks the annotator in place, without re-reading the input.
    Otherwise the distinct (note, annotator) pairs are reduced map-side and
    semi-joined back, which avoids shuffling the full input."""
    key = F.struct(md5_bucket(F.lit(seed), F.col(note), F.col(annotator)), F.col(annotator))
    if clustered:
        w = Window.partitionBy(note)
        chosen = F.min(key).over(w)[annotator]
        return df.withColumn("_chosen", chosen).filter(F.col(annotator) == F.col("_chosen")).drop("_chosen")
    pairs = df.select(note, annotator).distinct()
    chosen = pairs.groupBy(note).agg(F.min_by(annotator, key).alias(annotator))
    return df.join(chosen, [note, annotator], "left_semi")


def _split_counts(n_groups: int, train: float) -> tuple[int, int]:
    rest = math.ceil((1 - train) * n_groups)
    test = math.ceil(rest * 0.5)
    return rest, test


def order_statistics(ids: DataFrame, id_col: str, key: Column, ranks: Callable[[int], Sequence[int]],
                     few: int = 10_000) -> list[tuple | None]:
    """The (key, id) at each 0-based rank of the distinct ids in (key, id) order; None past the end.

    ``key`` is a number of 32 bits. No id is sorted or moved: the distinct ids
    are counted by the leading half of their key (at most 65,536 numbers), then
    only those of the half that holds the rank by the whole key, unless they
    are ``few`` and are looked at themselves. ``ranks`` gives the ranks for the
    number of ids, which the first count tells.
    """
    keyed = ids.select(F.col(id_col).alias("id"), key.alias("key")).where("id IS NOT NULL").distinct()
    half = F.shiftright("key", 16)

    def counts(at: Column, held: DataFrame) -> list[tuple[int, int]]:
        return sorted((r["at"], r["n"]) for r in held.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect())

    def place(table: list[tuple[int, int]], rank: int) -> tuple[int, int, int] | None:
        """(value, its count, the rank within it)"""
        for at, n in table:
            if rank < n:
                return at, n, rank
            rank -= n
        return None

    halves = counts(half, keyed)
    found = [place(halves, r) for r in ranks(sum(n for _, n in halves))]
    full = sorted({f[0] for f in found if f and f[1] > few})
    by_key = counts(F.col("key"), keyed.where(half.isin(full))) if full else []
    # (whether by key, value) of what is looked at, the rank within it
    at = [f and ((False, f[0], f[2]) if f[1] <= few else (True, *place([k for k in by_key if k[0] >> 16 == f[0]], f[2])[::2])) for f in found]
    held = dict(by_key)
    small = {a[:2] for a in at if a and not (a[0] and held[a[1]] > few)}
    rows = []
    if small:
        wanted = half.isin([v for whole, v in small if not whole]) | F.col("key").isin([v for whole, v in small if whole])
        rows = sorted((r["key"], r["id"]) for r in keyed.where(wanted).collect())
    out = []
    for a in at:
        if a is None:
            out.append(None)
        elif a[:2] in small:
            out.append([r for r in rows if (r[0] if a[0] else r[0] >> 16) == a[1]][a[2]])
        else:  # more ids of one key than that: the least of them, which Spark takes per task
            row = keyed.where(F.col("key") == a[1]).orderBy("id").offset(a[2]).limit(1).first()
            out.append((row["key"], row["id"]))
    return out


def _below(key: Column, id_col: str, limit: tuple | None) -> Column:
    """Whether a row's (key, id) comes before ``limit``."""
    if limit is None:
        return F.lit(True)
    return (key < limit[0]) | ((key == limit[0]) & (F.col(id_col) < F.lit(limit[1])))


def group_split_3way(df: DataFrame, group: str = "NotitieID", train: float = 0.8,
                     seed: int = 19, out: str = "split") -> DataFrame:
    """train/dev/test by group; proportions are of groups. The non-train
    part is ceil(G * (1 - train)) groups, split in half with the test half
    rounded up (first part dev, second part test). Rows without group have no
    split. The two limits are order statistics that jobs find when this is
    called; a row's split then follows from its own group, without a join."""
    def ranks(n):
        rest, test = _split_counts(n, train)
        return rest - test, rest
    key = _key(group, seed)
    dev, rest = order_statistics(df, group, key, ranks)
    label = F.when(F.col(group).isNull(), None).when(_below(key, group, dev), "dev").when(_below(key, group, rest), "test").otherwise("train")
    return df.withColumn(out, label)


def group_split_2way(df: DataFrame, group: str = "MDN", test: float = 0.2,
                     seed: int = 19, out: str = "split") -> DataFrame:
    """train/test by group, ceil(G * test) test groups; found as in :func:`group_split_3way`."""
    key = _key(group, seed)
    limit, = order_statistics(df, group, key, lambda n: (math.ceil(test * n),))
    return df.withColumn(out, F.when(F.col(group).isNull(), None).when(_below(key, group, limit), "test").otherwise("train"))


def example_sample(long: DataFrame, domain: str | None, kind: str, n: int = 1, seed: int = 0,
                   id_col: str = "pad_sen_id", dom_col: str = "domains") -> DataFrame:
    """``n`` seeded false-positive (kind='fp') or false-negative
    ('fn') rows of a domain (``domain=None``: of every domain at once, as a
    per-domain top-n that Spark limits before the shuffle)."""
    cond = (F.col("labels") == 0) & (F.col("preds") == 1) if kind == "fp" else \
        (F.col("labels") == 1) & (F.col("preds") == 0)
    rows = long.filter(cond if domain is None else cond & (F.col(dom_col) == domain))
    w = Window.partitionBy(dom_col).orderBy(_key(id_col, seed), F.col(id_col))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def seeded_annotation_mix(train: DataFrame, pilot_sentences: DataFrame, labels: str = "labels") -> DataFrame:
    """Add positive pilot sentences to the train split only."""
    from noteframe.operators.clean import positive_only
    return train.unionByName(positive_only(pilot_sentences, labels), allowMissingColumns=True)
