"""Operator 11: quality rules with robust multivariate outliers.

Every whole text gives exact counts (words, signs, repeated lines, repeated
windows) and a vector of transformed statistics. Two fixed rules fail a
document outright. Of the others, each language and source has its own minimum
covariance determinant (MCD) estimate of centre and scatter, and a document
whose Mahalanobis distance is beyond the cutoff is rejected.

The estimate is FAST-MCD as published: trial subsets of a bounded draw of the
group start it, and concentration steps over all rows of the group finish it.
A step needs the rows nearest to the present centre; it sums the moments of
the group's rows by fine rings of distance in one aggregation with map-side
combine and takes rings from inside until the wanted share of rows is there.
So no group is in one task, however large: a task holds a draw of at most
``DRAW`` rows or at most a ring table of one group.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .phrases import number, word_hashes, word_ids

#: Base rules: fewest words, and the largest share, in percent, of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8

SIGN = np.zeros(256, bool)
SIGN[[*b"#*$%&|<>"]] = True
UPPER, DIGIT, OTHER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
DIGIT[48:58] = True
OTHER[[b for b in range(33, 127) if not chr(b).isalnum() and not SIGN[b]]] = True
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "log_word_length", "symbols", "upper", "other_signs", "digits", "variety", "repeated_words",
            "repeated_lines", "log_line_words", "same_next"]


def _per_document(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return C.segment_counts(mask, off)


def _number(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dense numbers of pairs of dense numbers."""
    return number(left * (int(right.max(initial=0)) + 1) + right)[0]


def repeated_words(ids: np.ndarray, doc: np.ndarray, off: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words per document that lie in a window of ``window`` (a power of two) words found again in the document."""
    n = len(ids)
    part, size = ids, 1
    while size < window and n >= 2 * size:  # numbers of windows of doubled length
        part, size = _number(part[:n - 2 * size + 1], part[size:n - size + 1]), 2 * size
    if size < window:
        return np.zeros(len(off) - 1, np.int64)
    start = np.flatnonzero(doc[:n - window + 1] == doc[window - 1:])
    part = part[start]
    again = start[np.bincount(part, minlength=1)[part] > 1]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + window, -1)
    return _per_document(np.cumsum(step[:-1]) > 0, off)


def statistics(ch: C.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """((documents, COUNTS) exact, (documents, FEATURES) transformed) of whole texts; all zero for a text without words."""
    buf, off, n = ch.buf, ch.off, ch.n
    ws, we = C.word_spans(buf, off)
    w_off = np.searchsorted(ws, off)
    words = np.diff(w_off)
    doc = np.repeat(np.arange(n), words)
    chars = _per_document(((buf & 0xC0) != 0x80) & ~GAP[buf], off)
    signs = _per_document(SIGN[buf], off)

    # words of two documents are different ones
    ids, first, _ = word_ids(buf, ws, we, word_hashes(buf, ws, we), doc)
    repeated = repeated_words(ids, doc, w_off)
    distinct = np.bincount(doc[first], minlength=n)
    next_same = np.r_[False, ids[1:] == ids[:-1]] if len(ids) else np.zeros(0, bool)

    newline = np.flatnonzero(buf == 10)
    begin = np.r_[off[:-1][np.diff(off) > 0], newline + 1]
    begin = np.unique(begin[begin < len(buf)])
    line_doc = np.searchsorted(off, begin, side="right") - 1
    end = np.minimum(np.r_[begin[1:], len(buf)], off[line_doc + 1])
    end = end - ((end > begin) & (buf[np.maximum(end - 1, 0)] == 10))
    full = np.searchsorted(ws, end) > np.searchsorted(ws, begin)
    begin, end, line_doc = begin[full], end[full], line_doc[full]
    lines = np.bincount(line_doc, minlength=n)
    _, first, _ = word_ids(buf, begin, end, word_hashes(buf, begin, end), line_doc)
    again = lines - np.bincount(line_doc[first], minlength=n)

    counts = np.stack([words, chars, signs, again, repeated], axis=1).astype(np.int64)
    w, c, some = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    root = np.sqrt
    f = np.stack([np.log(w), np.log(c / w), root(signs / c), root(_per_document(UPPER[buf], off) / c),
                  root(_per_document(OTHER[buf], off) / c), root(_per_document(DIGIT[buf], off) / c),
                  np.log1p(distinct) / np.log1p(w), root(repeated / w), root(again / some), np.log(w / some),
                  root(_per_document(next_same, w_off) / w)], axis=1)
    f[words == 0] = 0
    return counts, f


# ---------------------------------------------------------------- minimum covariance determinant

#: Share of a group's rows that the estimate rests on, and the quantiles of chi squared for re-weighting and rejection.
CORE, REWEIGHT, REJECT = 0.75, 0.975, 0.999
#: Spread that each statistic may have at least, as it has in ordinary prose: statistics that are 0 in
#: nearly all documents of a group would otherwise reject every document where they are not.
SPREAD = {"log_words": 1.0, "log_word_length": 0.1, "symbols": 0.05, "upper": 0.05, "other_signs": 0.05, "digits": 0.2,
          "variety": 0.03, "repeated_words": 0.3, "repeated_lines": 0.3, "log_line_words": 0.7, "same_next": 0.1}
#: Smaller groups are pooled: a language's small sources together, then all such.
LEAST_ROWS = 60
#: Rows of a group in the start, trial subsets of it, and steps over all rows.
DRAW, TRIALS, STEPS = 600, 100, 3
#: Rings a doubling of the squared distance, and the range of its logarithm that they cover.
RINGS, LOW, HIGH = 64, -10, 20


def chi2_cdf(x: float, d: float) -> float:
    """Share of chi squared with ``d`` degrees of freedom below ``x`` (series of the incomplete gamma function)."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


@functools.lru_cache
def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 10.0 * d + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def consistency(share: float, d: int) -> float:
    """What the scatter of the inner ``share`` of normal rows is multiplied with to be that of all."""
    return share / chi2_cdf(chi2_quantile(share, d), d + 2)


def centre_and_whitening(n: float, total: np.ndarray, square: np.ndarray, share: float, floor: np.ndarray):
    """(mean, inverse Cholesky factor, log determinant) from the moments of the rows that make the core."""
    d = len(total)
    mean = total / n
    scatter = consistency(share, d) * (square / n - np.outer(mean, mean)) + np.diag(floor ** 2)
    factor = np.linalg.cholesky(scatter)
    return mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()


def distances(x: np.ndarray, mean: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    z = (x - mean) @ whiten.T
    return (z * z).sum(axis=1)


def concentrate(x: np.ndarray, mean, whiten, steps: int, floor: np.ndarray):
    """Concentration steps over rows in memory; (log determinant, mean, whitening)."""
    h = max(1, math.ceil(CORE * len(x)))
    for _ in range(steps):
        core = x[np.argpartition(distances(x, mean, whiten), h - 1)[:h]]
        mean, whiten, det = centre_and_whitening(h, core.sum(axis=0), core.T @ core, CORE, floor)
    return det, mean, whiten


def start(x: np.ndarray, floor: np.ndarray, trials: int = TRIALS, best: int = 5, seed: int = 11):
    """FAST-MCD on a bounded draw: two steps from small random subsets and from the medians, the best ones to the end."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    middle = np.median(x, axis=0)
    spread = 1.4826 * np.median(np.abs(x - middle), axis=0)
    found = [concentrate(x, middle, np.diag(1 / np.sqrt(spread ** 2 + floor ** 2)), 2, floor)]
    for _ in range(trials):
        some = x[rng.choice(len(x), min(len(x), d + 1), replace=False)]
        mean, whiten, _ = centre_and_whitening(len(some), some.sum(axis=0), some.T @ some, 1 - 1e-9, floor)
        found.append(concentrate(x, mean, whiten, 2, floor))
    found.sort(key=lambda f: f[0])
    return min((concentrate(x, m, w, 15, floor) for _, m, w in found[:best]), key=lambda f: f[0])[1:]


def _model(g, n, mean, whiten) -> pa.Table:
    return pa.table([pa.array([g], pa.string()), pa.array([int(n)]), pa.array([mean.tolist()]), pa.array([whiten.reshape(-1).tolist()])],
                    ["g", "n", "mean", "whiten"])


MODEL = "g string, n long, mean array<double>, whiten array<double>"


def first_models(rows: DataFrame, names: DataFrame, floor: np.ndarray, draw: int = DRAW) -> DataFrame:
    """A model per group from a seeded draw of at most ``draw`` rows of it.

    The share that is drawn follows the group's size, so that twice the draw is
    expected before the limit; a group's table is bounded at any size.
    """
    def run(table: pa.Table) -> pa.Table:
        x = np.asarray(table.column("f").combine_chunks().flatten()).reshape(table.num_rows, -1)
        return _model(table.column("g")[0].as_py(), table.num_rows, *start(x, floor))

    share = F.shiftrightunsigned("u", 11) / F.lit(float(1 << 53))
    some = (rows.join(names, "k").withColumn("u", F.xxhash64("id", "f"))
            .where(share * F.col("rows") < 2.0 * draw).select("g", "u", "id", "f")
            .withColumn("i", F.expr("row_number() OVER (PARTITION BY g ORDER BY u, id)")).where(F.col("i") <= draw))
    return some.select("g", "u", "id", "f").groupBy("g").applyInArrow(C.tidy(lambda t: run(t.sort_by([("u", "ascending"), ("id", "ascending")]))), MODEL)


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)).flatten()).reshape(batch.num_rows, -1)


def batch_distances(batch: pa.RecordBatch) -> np.ndarray:
    """Squared distance of each row (g, f, mean, whiten) from its group; rows of one group share a product."""
    g = batch.column(batch.schema.get_field_index("g")).dictionary_encode()
    code = g.indices.to_numpy()
    x, mean, whiten = (_vectors(batch, c) for c in ("f", "mean", "whiten"))
    out = np.zeros(len(x))
    order = np.argsort(code, kind="stable")
    cut = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]) if len(code) else np.zeros(0, int)
    for a, z in zip(cut.tolist(), np.r_[cut[1:], len(code)].astype(int).tolist()):
        at = order[a:z]
        out[at] = distances(x[at], mean[at[0]], whiten[at[0]].reshape(x.shape[1], -1))
    return out


def ring_of(d2: np.ndarray) -> np.ndarray:
    return np.floor(RINGS * np.clip(np.log2(np.maximum(d2, 1e-300)), LOW, HIGH)).astype(np.int64)


def ring_moments(rows: DataFrame, models: DataFrame, names: DataFrame, cut: float | None) -> DataFrame:
    """(g, ring, m): count, sums and sums of products of each group's rows by ring of distance, upper triangle only.

    With ``cut`` only the rows within that squared distance count, in one ring.
    """
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d2, x = batch_distances(b), _vectors(b, "f")
            g = b.column(b.schema.get_field_index("g")).dictionary_encode()
            ring = ring_of(d2) if cut is None else np.zeros(len(d2), np.int64)
            inside = np.flatnonzero(d2 <= cut) if cut is not None else np.arange(len(d2))
            i, j = np.triu_indices(x.shape[1])
            m = np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)[inside]
            key, at = np.unique(np.stack([g.indices.to_numpy()[inside], ring[inside]]), axis=1, return_inverse=True)
            total = np.zeros((key.shape[1], m.shape[1]))
            np.add.at(total, at.reshape(-1), m)
            yield pa.RecordBatch.from_arrays(
                [g.dictionary.take(pa.array(key[0])), pa.array(key[1]),
                 pa.ListArray.from_arrays(np.arange(len(total) + 1, dtype=np.int32) * m.shape[1], total.reshape(-1))], ["g", "ring", "m"])
    width = 1 + len(SPREAD) + len(SPREAD) * (len(SPREAD) + 1) // 2
    parts = (rows.join(names, "k").join(models.select("g", "mean", "whiten"), "g").select("g", "f", "mean", "whiten")
             .mapInArrow(C.tidy(run), "g string, ring long, m array<double>"))
    return parts.groupBy("g", "ring").agg(F.array(*(F.sum(F.col("m")[c]) for c in range(width))).alias("m"))


def step(rows: DataFrame, models: DataFrame, names: DataFrame, floor: np.ndarray, reweight: bool) -> DataFrame:
    """Each group's model from the rows nearest to the present one: rings from inside up to the core's share, or all within the cut.

    A group's ring table has at most ``RINGS * (HIGH - LOW) + 1`` rows.
    """
    d = len(floor)
    cut = chi2_quantile(REWEIGHT, d) if reweight else None
    share = REWEIGHT if reweight else CORE

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ring")
        m = np.asarray(table.column("m").combine_chunks().flatten()).reshape(table.num_rows, -1)
        count = np.cumsum(m[:, 0])
        last = int(np.searchsorted(count, CORE * count[-1] - 1e-9)) if not reweight else len(count) - 1
        total = m[:last + 1].sum(axis=0)
        square = np.zeros((d, d))
        i, j = np.triu_indices(d)
        square[i, j] = square[j, i] = total[1 + d:]
        mean, whiten, _ = centre_and_whitening(total[0], total[1:1 + d], square, share, floor)
        return _model(table.column("g")[0].as_py(), count[-1], mean, whiten)
    return ring_moments(rows, models, names, cut).groupBy("g").applyInArrow(C.tidy(run), MODEL)


def group_names(rows: DataFrame, least: int) -> DataFrame:
    """(k, g, rows): the group that the rows of a language and source are of, and its size."""
    each = rows.groupBy("k", "p").agg(F.count("*").alias("n"))
    small = each.where(F.col("n") < least).groupBy("p").agg(F.sum("n").alias("pooled"))
    named = (each.join(small, "p", "left")
             .select("k", "n", F.when(F.col("n") >= least, F.col("k")).when(F.col("pooled") >= least, F.col("p")).otherwise("all").alias("g")))
    named = C.write_table(named, "groups")
    return named.join(named.groupBy("g").agg(F.sum("n").alias("rows")), "g").where(F.col("rows") >= least).select("k", "g", "rows")


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(id, k, p, counts, f) per row: k names language and source, p the pooled sources of the language."""
    def run(batches):
        for ch in C.chunks(batches, "_text"):
            counts, f = statistics(ch)
            yield pa.RecordBatch.from_arrays(
                [ch.arrow("_id"), ch.arrow("_k"), ch.arrow("_p"), *(pa.array(c) for c in counts.T),
                 pa.ListArray.from_arrays(np.arange(ch.n + 1, dtype=np.int32) * f.shape[1], f.reshape(-1))], ["id", "k", "p", *COUNTS, "f"])
    lang, source = docs[lang_col].cast("string"), docs[source_col].cast("string")
    keyed = docs.select(docs[id_col].cast("long").alias("_id"), F.to_json(F.struct(lang.alias("lang"), source.alias("source"))).alias("_k"),
                        F.to_json(F.struct(lang.alias("lang"), F.lit(True).alias("rest"))).alias("_p"),
                        F.coalesce(C.text_column(docs, text_col), F.lit("")).alias("_text"))
    return keyed.mapInArrow(C.tidy(run), "id long, k string, p string, " + ", ".join(f"{c} long" for c in COUNTS) + ", f array<double>")


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
         least_rows: int = LEAST_ROWS, steps: int = STEPS, reject: float = REJECT, spread: dict[str, float] = SPREAD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) per row of ``docs``.

    A row with fewer than ``LEAST_WORDS`` words, or more than ``MOST_REPEATED``
    percent of them in repeated windows, fails (null and empty texts do). The
    others are kept if their squared distance from their group's robust centre
    is at most the ``reject`` quantile of chi squared; the rows that failed
    take no part in the estimates. A null language or source is a value of its
    own. Groups of fewer than ``least_rows`` are pooled, first per language,
    then all; what still is smaller has no estimate, a null distance, and is
    kept. ``spread`` is the least standard deviation of each statistic. Rows
    without id are rated like others, repeated rows are rated alike.
    """
    floor = np.array([spread[f] for f in FEATURES])
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    everything = C.write_table(measured(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", failed), "statistics")
    rows = everything.where("NOT base_failed").select("id", "k", "p", "f")
    names = C.write_table(group_names(rows, least_rows), "names")
    vectors = rows.select("id", "k", "f")
    models = C.write_table(first_models(vectors, names, floor), "models")
    for i in range(steps + 1):
        models = C.write_table(step(vectors, models, names, floor, reweight=i == steps), "models")
    cut = chi2_quantile(reject, len(floor))

    def verdict(batches):
        for b in batches:
            d2 = np.full(b.num_rows, np.nan)
            known = b.column(b.schema.get_field_index("mean")).is_valid().to_numpy(zero_copy_only=False)
            if known.any():
                d2[known] = batch_distances(b.filter(pa.array(known)))
            failed = b.column(b.schema.get_field_index("base_failed")).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in ("id", *COUNTS, "base_failed")]
                + [pa.array(d2, mask=~known), pa.array(~failed & ~(d2 > cut))], ["doc_id", *COUNTS, "base_failed", "distance", "kept"])
    model = names.select("k", "g").join(models.select("g", "mean", "whiten"), "g")
    return (everything.join(model, "k", "left").select("id", *COUNTS, "base_failed", "g", "f", "mean", "whiten")
            .mapInArrow(C.tidy(verdict), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
                        + ", base_failed boolean, distance double, kept boolean"))
