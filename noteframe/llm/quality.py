"""Operator 4: quality classifier, a regularised quadratic discriminant.

Every text becomes a vector of transformed document statistics. Per class the
count, sum and second moments are summed over all labelled training rows in
Spark (numbers, no rows, reach the driver); the class covariances are shrunk
towards the pooled one and towards a multiple of the identity. A score is the
logistic of the difference of the Mahalanobis log densities and priors, from
Cholesky factors that are computed once and sent with the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import U64, mix

FEATURES = ["log_words", "word_length", "word_length_spread", "longest_word", "letters", "upper", "blanks",
            "stops", "signs", "beyond_ascii", "entropy", "distinct_words", "top_word", "distinct_pairs",
            "repeated_next", "upper_words", "sign_ends", "sign_only_words", "log_line_words", "repeated_lines"]
#: Shares of the pooled covariance and of the identity in a class covariance.
POOLED, IDENTITY = 0.1, 0.02
#: Bytes and words of ordinary prose that every text is counted with, so that short texts are not extreme;
#: shares of ordinary prose that are not near zero.
PRIOR_BYTES, PRIOR_WORDS = 80, 12
PRIOR_SHARE = {"letters": 0.8, "blanks": 0.16, "stops": 0.02}
#: A document counts as good from this score on.
THRESHOLD = 0.3

_CLASS = np.zeros((256, 6), bool)  # letter, upper, digit, blank, stop, sign
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = ((_b < 128 and _c.isalpha()) or _b >= 128, _b < 128 and _c.isupper(), _b < 128 and _c.isdigit(),
                  _c in " \t\n\r\f\v", _c in ".,;:?'\"-()", _b < 128 and 32 < _b < 127 and not _c.isalnum() and _c not in ".,;:?'\"-()")


def _mean(values: np.ndarray, off: np.ndarray, more: int = 0) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return (total[off[1:]] - total[off[:-1]]) / np.maximum(np.diff(off) + more, 1)


def statistics(ch: C.Chunk) -> np.ndarray:
    """(documents, features): transformed statistics of the whole texts; zeros for an empty one."""
    buf, off, n = ch.buf, ch.off, ch.n
    ws, we = C.word_spans(buf, off)
    size = we - ws
    w_off = np.searchsorted(ws, off)
    h = C.span_hashes(buf, ws, we, lower=True)
    share = {}
    total = np.zeros(len(buf) + 1, np.int64)
    per_byte = np.diff(off) + PRIOR_BYTES
    in_word = {}
    for i, name in enumerate(("letters", "upper", "blanks", "stops", "signs")):
        np.cumsum(_CLASS[buf, i], out=total[1:])
        share[name] = (total[off[1:]] - total[off[:-1]] + PRIOR_BYTES * PRIOR_SHARE.get(name, 0)) / per_byte
        in_word[name] = total[we] - total[ws]
    beyond = _mean((buf >= 128).astype(np.float64), off)
    entropy = np.zeros(n)
    for a in range(0, n, 512):
        z = min(n, a + 512)
        doc = np.repeat(np.arange(z - a), np.diff(off[a:z + 1]))
        p = np.bincount(doc * 256 + buf[off[a]:off[z]], minlength=(z - a) * 256).reshape(z - a, 256) / np.maximum(np.diff(off[a:z + 1]), 1)[:, None]
        entropy[a:z] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)

    words = np.diff(w_off)
    doc = np.repeat(np.arange(n), words)
    length = size.astype(np.float64)
    mean_len = _mean(length, w_off)
    spread = np.sqrt(np.maximum(_mean(length ** 2, w_off) - mean_len ** 2, 0))
    longest = C.reduce_segments(np.maximum, length, w_off, 0.0)
    same_doc = doc[1:] == doc[:-1]
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & same_doc
    pair = np.zeros(len(h), U64)
    pair[1:] = mix(h[1:] * U64(3) + h[:-1])
    pair[w_off[:-1][words > 0]] = 0
    has_sign_end = _CLASS[buf[np.maximum(we - 1, 0)], 5] if len(we) else np.zeros(0, bool)
    letters = in_word["letters"]
    capital = (letters > 1) & (in_word["upper"] == letters)

    def distinct(values):
        values = values.copy()
        first = C.sort_within(values, w_off)
        return values, first
    ordered, first = distinct(h)
    distinct_words = (C.segment_counts(first, w_off) + PRIOR_WORDS) / (words + PRIOR_WORDS)
    starts = np.flatnonzero(first)
    runs = np.diff(np.r_[starts, len(ordered)]).astype(np.float64)
    run_off = np.searchsorted(starts, w_off)
    top = C.reduce_segments(np.maximum, runs, run_off, 0.0) / (words + PRIOR_WORDS)
    _, first = distinct(pair)
    distinct_pairs = (C.segment_counts(first, w_off) + PRIOR_WORDS) / (words + PRIOR_WORDS)

    newline = np.flatnonzero(buf == 10)
    line_start = np.unique(np.r_[off[:-1][np.diff(off) > 0], (newline + 1)[newline + 1 < len(buf)]]) if len(buf) else newline
    line_doc = np.searchsorted(off, line_start, side="right") - 1
    cut = np.searchsorted(ws, line_start)
    line_words = np.diff(np.r_[cut, len(ws)])
    position = np.arange(len(h)) - np.repeat(cut, line_words) if len(line_start) else np.zeros(0, int)
    line_hash = C.reduce_segments(np.add, mix(h + position.astype(U64) * U64(0x9E3779B97F4A7C15)), np.r_[cut, len(ws)], U64(0))
    full = line_words > 0
    line_off = np.searchsorted(line_doc[full], np.arange(n + 1))
    lines = np.diff(line_off)
    kept = line_hash[full].copy()
    fresh = C.segment_counts(C.sort_within(kept, line_off), line_off)

    root = np.sqrt
    columns = [np.log1p(words), np.log1p(mean_len), np.log1p(spread), np.log1p(np.minimum(longest, 40)), share["letters"],
               root(share["upper"]), root(share["blanks"]), root(share["stops"]), root(share["signs"]),
               root(beyond), entropy / 8, distinct_words, root(top), distinct_pairs, root(_mean(again, w_off, PRIOR_WORDS)),
               root(_mean(capital.astype(np.float64), w_off, PRIOR_WORDS)), root(_mean(has_sign_end.astype(np.float64), w_off, PRIOR_WORDS)),
               root(_mean((in_word["signs"] == size).astype(np.float64), w_off, PRIOR_WORDS)), np.log1p(words / np.maximum(lines, 1)),
               1 - fresh / np.maximum(lines, 1)]
    out = np.stack(columns, axis=1)
    out[np.diff(off) == 0] = 0
    return out


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, f) per row of ``docs``."""
    def run(batches):
        for ch in C.chunks(batches, "_text"):
            f = statistics(ch)
            yield pa.RecordBatch.from_arrays(
                [ch.arrow("_id"), pa.ListArray.from_arrays(np.arange(ch.n + 1, dtype=np.int32) * f.shape[1], f.reshape(-1))],
                ["id", "f"])
    return (docs.select(docs[id_col].cast("long").alias("_id"), C.text_column(docs, text_col).alias("_text"))
            .mapInArrow(C.tidy(run), "id long, f array<double>"))


@dataclass
class Gaussians:
    """Two class densities: means, inverse Cholesky factors, log determinants and log priors."""
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    fitted: bool

    def score(self, x: np.ndarray) -> np.ndarray:
        log_odds = np.full(len(x), self.log_prior[1] - self.log_prior[0])
        if self.fitted:
            density = []
            for c in (0, 1):
                z = (x - self.mean[c]) @ self.whiten[c].T
                density.append(-0.5 * (z * z).sum(axis=1) - 0.5 * self.log_det[c])
            log_odds += density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(log_odds, -700, 700)))


def fit(labelled: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> Gaussians:
    """Fit on all rows (f, quality). The moments are summed in Spark: two classes times features squared numbers."""
    d = len(FEATURES)

    def moments(batches):
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = np.asarray(b.column(0).flatten()).reshape(-1, d)
            y = b.column(1).to_numpy()
            for c in (0, 1):
                m = x[y == c]
                total[c] += np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).reshape(-1)])
        for c in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.shape[1], c)), pa.array(np.arange(total.shape[1])),
                                              pa.array(total[c])], ["c", "i", "v"])
    rows = (labelled.select("f", F.col("quality").cast("int")).mapInArrow(C.tidy(moments), "c long, i long, v double")
            .groupBy("c", "i").agg(F.sum("v").alias("v")).collect())
    m = np.zeros((2, 1 + d + d * d))
    for r in rows:
        m[r["c"], r["i"]] = r["v"]
    n = m[:, 0]
    prior = np.log((n + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Gaussians(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), prior, False)
    mean = m[:, 1:1 + d] / n[:, None]
    cov = m[:, 1 + d:].reshape(2, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    both = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    whiten, log_det = [], []
    for c in (0, 1):
        s = (1 - pooled - identity) * cov[c] + pooled * both + identity * np.diag(np.diag(both) + 1e-6)
        factor = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Gaussians(mean, np.array(whiten), np.array(log_det), prior, True)


def held_out(id_col: str = "id"):
    """Rows that the fit never sees: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1; other values and nulls
    are left out). The score is the probability of label 1 given the text
    alone; null and empty texts have all statistics 0 and are scored like
    others. Without labels of both classes the score is the smoothed share of
    label 1. A row without id is scored, not held out and never learned from.
    Rows that repeat an id are scored alike; repeated label rows count once.
    """
    rows = C.write_table(features(docs, id_col, text_col), "features")
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), "quality").where("quality IN (0, 1)").distinct())
    model = fit(rows.where(~held_out()).join(known, "id"))

    def score(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, len(FEATURES))
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])
    return (rows.select("id", "f", held_out().alias("held_out"))
            .mapInArrow(C.tidy(score), "doc_id long, held_out boolean, score double, predicted int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` predicts as good, all columns kept.

    The texts are scored again where they are read rather than joined to their
    scores.
    """
    rows = features(docs, id_col, text_col)
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), "quality").where("quality IN (0, 1)").distinct())
    model = fit(rows.where(~held_out()).join(known, "id"))
    source = docs.withColumn(text_col, C.text_column(docs, text_col))

    def run(batches):
        for ch in C.chunks(batches, text_col):
            yield ch.batch.filter(pa.array(model.score(statistics(ch)) >= threshold))
    return source.mapInArrow(C.tidy(run), source.schema)
