"""Operator 5: language identification with a linear-chain conditional random field.

The words of a text are a sequence that the field labels with languages.
Features of a word are its affixes, its byte n-grams and its entries in
lexicons learned per language; transitions between the languages of
neighbouring words are learned too, from sequences in which pieces of several
languages follow one another, so that code-switched texts are labelled word by
word. Forward-backward gives each word's marginals over the whole text; the
text's language is the one with the largest mean, which is the score.

Long texts are no special case: a chain is cut into segments whose transfer
matrices are multiplied side by side, then joined, so the array steps are as
many as a segment has words, not as many as the longest text has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .common import U64, mix
from .quality import held_out

#: The fit's bound: documents per language, and from each so many windows of words spread over the whole text.
DOCS_PER_LANGUAGE, WINDOWS, WINDOW_WORDS = 400, 6, 16
#: Size of the hashed feature table; words per language in the lexicons.
HASHED, LEXICON = 1 << 16, 3000
SEGMENT = 128
EPOCHS, BATCH, RATE, DECAY = 4, 256, 0.3, 1e-5

_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(buf: np.ndarray, off: np.ndarray):
    """Runs of letters: (starts, ends) in bytes, never across documents."""
    letter = _LETTER[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    first, last = letter.copy(), letter.copy()
    if len(buf):
        first[1:] &= ~letter[:-1] | cut[1:len(buf)]
        last[:-1] &= ~letter[1:] | cut[1:len(buf)]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(feature numbers, offsets by word): affixes of 1-3 and n-grams of 2-3 bytes, hashed."""
    size = end - start
    off = C.offsets(size + 2)
    text = np.full(off[-1], 0x5F, np.uint8)  # each word between two marks
    inner = np.ones(off[-1], bool)
    inner[off[:-1]] = False
    inner[off[1:] - 1] = False
    plain = C.offsets(size)
    text[inner] = _LOWER[buf[np.arange(plain[-1]) + np.repeat(start - plain[:-1], size)]]
    value = text.astype(U64)
    owner = np.repeat(np.arange(len(size)), size + 2)
    left = off[1:][owner] - np.arange(off[-1])  # bytes from here to the word's end mark, itself included
    numbers, owners = [], []
    for n in (2, 3):
        at = np.flatnonzero(left >= n)
        g = np.full(len(at), n, U64)
        for i in range(n):
            g = g * U64(257) + value[at + i]
        numbers.append(mix(g))
        owners.append(owner[at])
    for n in (1, 2, 3):
        some = np.flatnonzero(size >= n)
        for tag, first in ((11, off[:-1][some] + 1), (12, off[1:][some] - 1 - n)):
            g = np.full(len(some), tag * 8 + n, U64)
            for i in range(n):
                g = g * U64(257) + value[first + i]
            numbers.append(mix(g))
            owners.append(some)
    number, who = np.concatenate(numbers), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    number = (number[order] & U64(HASHED - 1)).astype(np.int64)
    return number, C.offsets(np.bincount(who, minlength=len(size)))


@dataclass
class Field:
    """Learned weights: hashed features, lexicons (sorted word hashes per language), start and transitions."""
    langs: list[str]
    weight: np.ndarray
    lexicon: list[np.ndarray]
    lexicon_weight: np.ndarray
    start: np.ndarray
    transition: np.ndarray

    def emissions(self, buf, start, end, h) -> np.ndarray:
        """(words, languages) potentials, each row with maximum 1; equal words are scored once."""
        _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        number, off = word_features(buf, start[at], end[at])
        score = np.zeros((len(at), len(self.langs)))
        if len(at):
            score = np.add.reduceat(self.weight[number], off[:-1], axis=0)
        for i, lex in enumerate(self.lexicon):
            score += np.isin(h[at], lex)[:, None] * self.lexicon_weight[i]
        score -= score.max(axis=1, keepdims=True)
        return np.exp(np.maximum(score, -50))[inverse]

    def marginals(self, e: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(words, languages): forward-backward over each chain off[i]..off[i+1]."""
        n_lang = e.shape[1]
        pi, t = np.exp(self.start - self.start.max()), np.exp(self.transition - self.transition.max())
        n = np.diff(off)
        per = -(-n // SEGMENT)
        seg_off = C.offsets(per)
        chain = np.repeat(np.arange(len(n)), per)
        ordinal = np.arange(len(chain)) - seg_off[:-1][chain]
        begin = off[:-1][chain] + ordinal * SEGMENT
        size = np.minimum(SEGMENT, off[1:][chain] - begin)
        order = np.argsort(-size, kind="stable")  # active segments of a step are a prefix
        begin, size, ordinal, chain = begin[order], size[order], ordinal[order], chain[order]
        active = [int(np.searchsorted(-size, -s, side="left")) for s in range(SEGMENT + 1)]  # with size > s
        k = len(begin)
        if not k:
            return np.zeros_like(e)
        first = ordinal == 0
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)  # segment number -> row
        # transfer matrix of each segment
        p = np.tile(np.eye(n_lang), (k, 1, 1))
        for s in range(int(size[0])):
            a = active[s]
            step = p[:a] @ t if s else np.where(first[:a, None, None], p[:a], p[:a] @ t)
            step = step * e[begin[:a] + s][:, None, :]
            p[:a] = step / step.sum(axis=(1, 2), keepdims=True)
        # potentials at the segments' ends, chain by chain
        before, after = np.tile(pi / pi.sum(), (k, 1)), np.ones((k, n_lang))
        most = int(per.max())
        for o in range(1, most):
            here = place[seg_off[:-1][per > o] + o]
            prev = place[seg_off[:-1][per > o] + o - 1]
            v = np.einsum("ki,kij->kj", before[prev], p[prev])
            before[here] = v / v.sum(axis=1, keepdims=True)
        for o in range(most - 2, -1, -1):
            here = place[seg_off[:-1][per > o + 1] + o]
            nxt = place[seg_off[:-1][per > o + 1] + o + 1]
            v = np.einsum("kij,kj->ki", p[nxt], after[nxt])
            after[here] = v / v.sum(axis=1, keepdims=True)
        alpha = np.empty((int(size[0]), k, n_lang))
        v = before
        for s in range(int(size[0])):
            a = active[s]
            step = v[:a] @ t if s else np.where(first[:a, None], v[:a], v[:a] @ t)
            step = step * e[begin[:a] + s]
            v = v.copy()
            v[:a] = step / step.sum(axis=1, keepdims=True)
            alpha[s] = v
        out = np.empty_like(e)
        beta = after.copy()
        for s in range(int(size[0]) - 1, -1, -1):
            a = active[s]
            g = alpha[s][:a] * beta[:a]
            out[begin[:a] + s] = g / g.sum(axis=1, keepdims=True)
            b = (e[begin[:a] + s] * beta[:a]) @ t.T
            beta[:a] = b / b.sum(axis=1, keepdims=True)
        return out


def _windows(docs: DataFrame) -> dict[str, list[str]]:
    """Windows of words by language from a bounded sample of the training rows (id, text, lang)."""
    pool = (docs.where("lang IS NOT NULL AND id IS NOT NULL").where(~held_out())
            .select("id", "lang", F.xxhash64("id", "lang").alias("h")))
    first = Window.partitionBy("lang").orderBy("h", "id")
    chosen = pool.withColumn("r", F.row_number().over(first)).where(f"r <= {DOCS_PER_LANGUAGE}").select("id", "lang").collect()
    if not chosen:
        return {}

    def cut(batches):
        for ch in C.chunks(batches):
            ws, we = words(ch.buf, ch.off)
            w_off = np.searchsorted(ws, ch.off)
            raw, texts, langs = ch.buf.tobytes(), [], []
            for d, lang in enumerate(ch.arrow("lang").to_pylist()):
                n = int(w_off[d + 1] - w_off[d])
                many = min(WINDOWS, -(-n // WINDOW_WORDS))
                for a in np.linspace(0, max(n - WINDOW_WORDS, 0), many).astype(int):
                    i = w_off[d] + a
                    j = min(i + WINDOW_WORDS, w_off[d + 1])
                    texts.append(b" ".join(raw[ws[x]:we[x]] for x in range(i, j)))
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.binary())], ["lang", "piece"])
    rows = (docs.where(F.col("id").isin([r["id"] for r in chosen]) & F.col("lang").isNotNull())
            .select("id", "lang", "text").mapInArrow(C.tidy(cut), "lang string, piece binary").collect())
    out: dict[str, list[bytes]] = {}
    for r in sorted(rows):
        out.setdefault(r["lang"], []).append(bytes(r["piece"]))
    return out


def _spans(pieces: list[bytes]):
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    off = C.offsets(np.array([len(p) for p in pieces], np.int64))
    ws, we = words(buf, off)
    return buf, ws, we, np.searchsorted(ws, off)


def fit(pieces: dict[str, list[bytes]], seed: int = 7) -> Field:
    """Maximum likelihood by adaptive gradient steps over code-switched sequences of the pieces."""
    langs = sorted(pieces)
    n_lang, rng = len(langs), np.random.default_rng(seed)
    lexicon = []
    for lang in langs:
        buf, ws, we, _ = _spans(pieces[lang])
        h, n = np.unique(C.span_hashes(buf, ws, we, lower=True), return_counts=True)
        often = np.argsort(-n, kind="stable")[:LEXICON]
        lexicon.append(np.sort(h[often[n[often] > 1]]))
    field = Field(langs, np.zeros((HASHED, n_lang)), lexicon, np.zeros((n_lang, n_lang)), np.zeros(n_lang),
                  np.zeros((n_lang, n_lang)))
    every = [(i, p) for i, lang in enumerate(langs) for p in pieces[lang]]
    square = [np.full_like(x, 1e-8) for x in (field.weight, field.lexicon_weight, field.start, field.transition)]
    for _ in range(EPOCHS):
        # sequences of one to four pieces; neighbours are often of one language
        order = rng.permutation(len(every))
        by_lang = {i: [j for j in order if every[j][0] == i] for i in range(n_lang)}
        sequences = []
        for j in order:
            seq = [every[j]]
            while len(seq) < 4 and rng.random() < 0.6:
                lang = seq[-1][0] if rng.random() < 0.6 else int(rng.integers(n_lang))
                if by_lang[lang]:
                    seq.append(every[by_lang[lang][int(rng.integers(len(by_lang[lang])))]])
            sequences.append(seq)
        for a in range(0, len(sequences), BATCH):
            batch = sequences[a:a + BATCH]
            flat = [p for s in batch for p in s]
            buf, ws, we, w_off = _spans([p for _, p in flat])
            label = np.repeat([i for i, _ in flat], np.diff(w_off))
            off = w_off[np.cumsum([0] + [len(s) for s in batch])]
            if not len(ws):
                continue
            number, f_off = word_features(buf, ws, we)
            h = C.span_hashes(buf, ws, we, lower=True)
            e = field.emissions(buf, ws, we, h)
            m = field.marginals(e, off)
            target = np.zeros_like(m)
            target[np.arange(len(label)), label] = 1
            g = (target - m) / len(batch)
            owner = np.repeat(np.arange(len(ws)), np.diff(f_off))
            grad = [np.stack([np.bincount(number, g[owner, i], minlength=HASHED) for i in range(n_lang)], axis=1),
                    np.stack([(g * np.isin(h, lex)[:, None]).sum(axis=0) for lex in field.lexicon])]
            head = off[:-1][np.diff(off) > 0]
            grad.append(g[head].sum(axis=0))
            # expected transitions from the marginals' neighbours, exact pair marginals
            t = np.exp(field.transition - field.transition.max())
            inside = np.ones(len(ws), bool)
            inside[head] = False
            r = np.flatnonzero(inside)
            pair = m[r - 1][:, :, None] * _next_given(m, e, t, r)
            seen = np.zeros((n_lang, n_lang))
            np.add.at(seen, (label[r - 1], label[r]), 1)
            grad.append((seen - pair.sum(axis=0)) / len(batch))
            for x, s, d in zip((field.weight, field.lexicon_weight, field.start, field.transition), square, grad):
                d = d - DECAY * x
                s += d * d
                x += RATE * d / np.sqrt(s)
    return field


def _next_given(m: np.ndarray, e: np.ndarray, t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """P(label of r | label of r-1) under the field: from t and the ratio of marginal to forward message.

    With alpha_r ~ (alpha_{r-1} t) e_r the backward part of r is m_r / alpha_r; it is recovered here from the
    marginals by iterating the proportional fit of t e_r to the two marginals, which has the pair marginal as its
    only fixed point.
    """
    pair = t[None] * e[r][:, None, :] + 1e-300
    for _ in range(12):
        pair = pair / pair.sum(axis=2, keepdims=True) * m[r - 1][:, :, None]
        pair = pair / np.maximum(pair.sum(axis=1, keepdims=True), 1e-300) * m[r][:, None, :]
    return pair / np.maximum(pair.sum(axis=2, keepdims=True), 1e-300)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words) per row of ``docs``.

    Learns from text and language of the rows that are not held out and have
    both; ``lang`` is never an input of a prediction. ``score`` is the mean
    marginal of the predicted language over all words. A text that is null or
    has no letter is ``und`` with score 0, as is every text when there is
    nothing to learn from. Rows without id are predicted, not learned from.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[lang_col].cast("string").alias("lang"),
                       C.text_column(docs, text_col).alias("text"))
    pieces = _windows(rows)
    field = fit(pieces) if pieces else None

    def predict(batches):
        for ch in C.chunks(batches):
            ws, we = words(ch.buf, ch.off)
            w_off = np.searchsorted(ws, ch.off)
            n = np.diff(w_off)
            best, score = np.zeros(ch.n, np.int64), np.zeros(ch.n)
            if field and len(ws):
                m = field.marginals(field.emissions(ch.buf, ws, we, C.span_hashes(ch.buf, ws, we, lower=True)), w_off)
                mean = np.zeros((ch.n, m.shape[1]))
                mean[n > 0] = np.add.reduceat(m, w_off[:-1][n > 0], axis=0) / n[n > 0][:, None]
                best, score = mean.argmax(axis=1), mean.max(axis=1)
            raw, langs = ch.buf.tobytes(), []
            for d in range(ch.n):
                text = raw[ch.off[d]:ch.off[d + 1]]
                # bytes beyond ASCII may be signs only
                letters = n[d] > 0 and (any(65 <= b <= 90 or 97 <= b <= 122 for b in text[:64])
                                        or any(c.isalpha() for c in text.decode()))
                langs.append(field.langs[best[d]] if field and letters else "und")
                if langs[-1] == "und" and not (field and letters):
                    score[d] = 0
            yield pa.RecordBatch.from_arrays([ch.arrow("id"), ch.arrow("held_out"), pa.array(langs, pa.string()),
                                              pa.array(np.clip(score, 0, 1)), pa.array(n)],
                                             ["doc_id", "held_out", "lang_pred", "score", "n_words"])
    return (rows.select("id", held_out().alias("held_out"), "text")
            .mapInArrow(C.tidy(predict), "doc_id long, held_out boolean, lang_pred string, score double, n_words long"))
