"""Operator 8: personal data by weak supervision.

Base spans come from four exact patterns. Beside them a wider net collects
candidates (numbers of card length, groups of digits, spelled-out addresses,
long hexadecimal addresses). Five labelers vote on every candidate: pattern,
form (check digit, ranges, separators), gazetteer (domain endings and dialling
codes), context words in front, and whether it stands alone. Expectation
maximisation over the counts of vote patterns estimates how reliable each
labeler is, without labels; its posteriors train a logistic span classifier,
which adds the candidates it accepts. Only counts per pattern reach the
driver, and there are no more patterns than votes and shapes allow.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = 5
#: Words in front of a candidate that the context labeler reads, in characters.
CONTEXT = 40
ROUNDS = 60

# fixed values: the base patterns (anchored where a search can only succeed, which keeps long runs linear)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# the wider net
_SPELLED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\])\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\.)\s?[A-Za-z0-9-]{1,63})+")
_GROUPS = re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}(?![\w-])")
_LONG_IP = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![\w:])")

ENDINGS = frozenset("com org net edu gov int info io eu de fr es uk us it nl ch at be".split())
CUES = {EMAIL: "mail email e-mail contact write address kontakt correo courriel",
        IP: "ip host server address client login from addr",
        CARD: "card visa mastercard credit debit payment karte tarjeta carte pay",
        PHONE: "phone call tel telephone mobile fax cell telefon teléfono téléphone contact"}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
OTHER_CUES = frozenset("isbn issn version order invoice token page chapter figure sha md5 hash serial".split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, EMAIL, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), PHONE, m.end()))
    out.sort()
    return out


def _wide_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), EMAIL, m.end()) for m in _SPELLED.finditer(text)] if "at" in text and ("(at)" in text or "[at]" in text) else []
    out += [(m.start(), CARD, m.end()) for m in _CARD.finditer(text) if 12 <= len(_digits(m.group())) <= 19]
    out += [(m.start(), PHONE, m.end()) for m in _GROUPS.finditer(text) if 7 <= len(_digits(m.group())) <= 15]
    out += [(m.start(), IP, m.end()) for m in _LONG_IP.finditer(text)] if text.count(":") > 4 else []
    return out


def pattern_of(text: str, start: int, kind: int, end: int, is_base: bool) -> int:
    """Votes (0 against, 1 silent, 2 for) of the labelers with kind and shape, as one number."""
    span = text[start:end]
    d = _digits(span)
    form = 1
    if kind == CARD:
        form = 2 if luhn(d) and len(set(d)) > 2 else 1 if len(d) == 16 and len(set(d)) > 2 else 0
    elif kind == PHONE:
        seps = {c for c in span if c in " .-"}
        form = 2 if 9 <= len(d) <= 13 and len(seps) <= 2 else 0
    elif kind == IP:
        form = 2 if not span.startswith("0") else 1
    elif kind == EMAIL:
        form = 2 if len(span) <= 80 and not span.startswith(".") else 0
    gazetteer = 1
    if kind == EMAIL:
        gazetteer = 2 if re.split(r"[^A-Za-z]+", span.lower())[-1] in ENDINGS else 0
    elif kind == PHONE:
        gazetteer = 2 if span.startswith("+") else 1
    elif kind == CARD:
        gazetteer = 2 if d[0] in "3456" else 1
    elif kind == IP:
        gazetteer = 1
    near = set(w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT):start])[-4:])
    context = 0 if near & OTHER_CUES else 2 if near & CUES[kind] else 1
    before, after = text[start - 1:start], text[end:end + 1]
    alone = 2 if not (before.isalnum() or before in ("_", "=", "\"")) and not (after.isalnum() or after in ("_", "\"")) else 0
    votes = (2 if is_base else 1, form, gazetteer, context, alone)
    shape = min(len(d) // 4, 4)
    number = kind * 5 + shape
    for v in votes:
        number = number * 3 + v
    return number


def _votes(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    votes = []
    for _ in range(LABELERS):
        votes.append(pattern % 3)
        pattern = pattern // 3
    return np.stack(votes[::-1], axis=1), pattern // 5, pattern % 5


def candidates(text: str) -> list[tuple[int, int, int, int, bool]]:
    """(start, kind, end, pattern, is base) of base and wide spans; a wide one never overlaps a base one or an earlier wide one."""
    base = base_spans(text)
    out = [(a, k, z, pattern_of(text, a, k, z, True), True) for a, k, z in base]
    taken = [(a, z) for a, _, z in base]
    for a, k, z in sorted(_wide_spans(text)):
        if not any(a < y and x < z for x, y in taken):
            taken.append((a, z))
            out.append((a, k, z, pattern_of(text, a, k, z, False), False))
    out.sort()
    return out


@dataclass
class SpanModel:
    """Votes' reliabilities (class, labeler, vote) and the classifier's weights."""
    reliability: np.ndarray
    prior: float
    weight: np.ndarray

    def probability(self, pattern: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_design(pattern) @ self.weight))


def _design(pattern: np.ndarray) -> np.ndarray:
    votes, kind, shape = _votes(np.asarray(pattern, np.int64))
    columns = [np.ones(len(votes))] + [(votes[:, i] == v).astype(float) for i in range(LABELERS) for v in (0, 2)]
    columns += [(kind == k).astype(float) for k in range(len(KINDS))] + [(shape == s).astype(float) for s in range(5)]
    return np.stack(columns, axis=1)


def fit(pattern: np.ndarray, count: np.ndarray) -> SpanModel:
    """Expectation maximisation over counted vote patterns, then a logistic fit to its posteriors."""
    votes, _, _ = _votes(pattern)
    # prior knowledge as counts: a labeler that speaks is right more often than not
    belief = np.array([[0.25, 0.45, 0.30], [0.05, 0.35, 0.60]])[:, None, :].repeat(LABELERS, axis=1) * 20.0
    reliability, prior = belief / belief.sum(axis=2, keepdims=True), 0.5
    weight = count.astype(float)
    post = np.full(len(votes), 0.5)
    for _ in range(ROUNDS):
        log = np.zeros((len(votes), 2))
        for y, p in ((0, 1 - prior), (1, prior)):
            log[:, y] = np.log(p) + sum(np.log(reliability[y, i, votes[:, i]]) for i in range(LABELERS))
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        prior = float((weight @ post + 5) / (weight.sum() + 10))
        for y, p in ((0, 1 - post), (1, post)):
            for i in range(LABELERS):
                seen = np.bincount(votes[:, i], weight * p, minlength=3) + belief[y, i]
                reliability[y, i] = seen / seen.sum()
    x = _design(pattern)
    w = np.zeros(x.shape[1])
    scale = weight / max(weight.sum(), 1)
    for _ in range(100):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (scale * (post - p)) - 1e-4 * w
        h = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return SpanModel(reliability, prior, w)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, spans): candidates of each text; offsets in code points."""
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("pattern", pa.int32()), ("base", pa.bool_())])

    def run(batches):
        for ch in C.chunks(batches, "_text"):
            yield pa.RecordBatch.from_arrays(
                [ch.arrow("_id"), pa.array([[dict(zip(("start", "kind", "end", "pattern", "base"), s)) for s in c]
                                            for c in _chunk_candidates(ch)], pa.list_(span))], ["id", "spans"])
    return (docs.select(docs[id_col].cast("long").alias("_id"), C.text_column(docs, text_col).alias("_text"))
            .mapInArrow(C.tidy(run), "id long, spans array<struct<start: long, kind: int, end: long, pattern: int, base: boolean>>"))


def _chunk_candidates(ch: C.Chunk):
    """Candidates per document; texts without a digit or an at-sign, a plain or a spelled one, have none."""
    mark = ((ch.buf >= 48) & (ch.buf <= 57)) | (ch.buf == 64)
    some = C.segment_counts(mark, ch.off) > 0
    raw = ch.buf.tobytes()
    for d in range(ch.n):
        text = raw[ch.off[d]:ch.off[d + 1]]
        if some[d] or b"(at)" in text or b"[at]" in text or text.count(b":") > 4:
            yield candidates(text.decode())
        else:
            yield []


def _model(scanned: DataFrame) -> SpanModel:
    rows = (scanned.select(F.explode("spans.pattern").alias("p")).groupBy("p").count().orderBy("p").collect())
    return fit(np.array([r["p"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) per row of ``docs``: arrays of (kind, start, end), by start, then kind.

    ``spans`` are the base spans and the candidates that the classifier
    accepts. Offsets count code points, ends are exclusive. Null and empty
    texts have none. Rows that repeat an id, or have none, are scanned like
    others; other columns are ignored.
    """
    scanned = C.write_table(_scan(docs, id_col, text_col), "spans")
    model = _model(scanned)
    accepted = _accepted(scanned, model)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    plain = lambda c: F.transform(c, lambda s: F.struct(F.get(kinds, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    keep = F.array(*[F.lit(int(p)) for p in accepted]).cast("array<int>")
    return scanned.select(F.col("id").alias("doc_id"), plain(F.filter("spans", lambda s: s["base"])).alias("base"),
                          plain(F.filter("spans", lambda s: s["base"] | F.array_contains(keep, s["pattern"]))).alias("spans"))


def _accepted(scanned: DataFrame, model: SpanModel) -> list[int]:
    """The patterns that the classifier accepts: its decision for every pattern there is."""
    every = np.arange(len(KINDS) * 5 * 3 ** LABELERS)
    return every[model.probability(every) >= 0.5].tolist()


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of :func:`find` replaced by its kind, such as ``<EMAIL>``.

    Overlapping spans are replaced together, under the first one's kind. All
    columns and rows stay; the text is found again in place rather than
    joined to its spans.
    """
    accepted = frozenset(_accepted(None, _model(_scan(docs, id_col, text_col))))
    source = docs.withColumn(text_col, C.text_column(docs, text_col))
    at = source.columns.index(text_col)

    def run(batches):
        for ch in C.chunks(batches, text_col):
            column = ch.batch.column(at).to_pylist()
            for d, spans in enumerate(_chunk_candidates(ch)):
                spans = [(a, k, z) for a, k, z, p, base in spans if base or p in accepted]
                if not spans:
                    continue
                text, out, done = column[d], [], 0
                for a, k, z in spans:
                    if a >= done:
                        out += [text[done:a], f"<{KINDS[k].upper()}>"]
                    done = max(done, z)
                column[d] = "".join(out) + text[done:]
            columns = list(ch.batch.columns)
            columns[at] = pa.array(column, pa.string())
            yield pa.RecordBatch.from_arrays(columns, ch.batch.schema.names)
    return source.mapInArrow(C.tidy(run), source.schema)
