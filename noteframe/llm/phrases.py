"""Operator 12: phrase collocation mining by partitioning (SON).

Documents are dealt to a few shards by their id. A phrase with the wanted
support must, in some shard, reach the share of it that the shard has of all
words; so each shard is mined completely at that lowered support, length by
length, and the union of what is frequent somewhere holds every phrase that is
frequent at all. A last pass over the texts counts these candidates exactly.

- words: one pass counts every word of a language exactly (the scores need them).
- mining: a pass per length counts, shard by shard, phrases whose shorter parts
  were frequent in the shard. Phrases travel as 64-bit keys; two that share a
  key can only make a candidate too many.
- counting: one pass counts the candidates as text; these counts are the result.

Between the passes only filters travel: bit arrays of ``2 ** filter_bits``
bits, whatever the input, that hold the keys of frequent parts. A filter never
misses a key; when more keys than bits make it full, it lets more through, and
the counts stay exact. Give it more bits on a large corpus.

A shard is mined by all tasks together, so its size is bounded by nothing;
with more shards than the support, the local support would be one and every
phrase a candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .common import U64, mix

SUPPORT, MAX_WORDS, TOP = 10, 3, 2000
#: A candidate goes if a longer one that contains it has this share, in percent, of its occurrences.
ABSORBED = 50
SHARDS = 2
FILTER_BITS = 27
#: Text bytes whose phrases a task counts at once.
BLOCK_BYTES = 3 << 20
#: Bytes of a word from which on it is hashed on its own.
LONG_WORD = 256
#: Phrases of a block that are spelled out at once.
SPELL = 100_000
#: Parts of a language in which the best phrases are taken before they meet.
TOP_PARTS = 64

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = BREAK.copy()
BLANK[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shard_bits(shard: np.ndarray) -> np.ndarray:
    """What a key is combined with in a shard (exclusive or takes it off again)."""
    return mix(shard.astype(U64) + U64(1))


class KeyFilter:
    """A set of 64-bit keys as bits: the leading bits of a key name its bit."""

    def __init__(self, bits: np.ndarray, n_bits: int):
        self.bits, self.shift = bits, U64(64 - n_bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.bits[at >> U64(6)] >> (at & U64(63)) & U64(1)).astype(bool)


def key_filter(keys: DataFrame, n_bits: int) -> KeyFilter:
    """Filter of the long column ``key``: at most ``2 ** n_bits / 64`` words reach the driver."""
    rows = (keys.selectExpr(f"shiftrightunsigned(key, {70 - n_bits}) AS i",
                            f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - n_bits}) & 63 AS int)) AS b")
            .groupBy("i").agg(F.bit_or("b").alias("b")).toArrow())
    bits = np.zeros(1 << (n_bits - 6), U64)
    bits[rows.column("i").to_numpy()] = rows.column("b").to_numpy().astype(np.int64).view(U64)
    return KeyFilter(bits, n_bits)


# ---------------------------------------------------------------- words and phrases of a block

def same_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span equals the span numbered ``other``."""
    size = end - start
    if (size != size[other]).any():
        return False
    for a in range(0, len(size), 1 << 18):
        z = slice(a, a + (1 << 18))
        off = C.offsets(size[z])
        step = np.arange(off[-1])
        if (buf[step + np.repeat(start[z] - off[:-1], size[z])] != buf[step + np.repeat(start[other[z]] - off[:-1], size[z])]).any():
            return False
    return True


def number(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dense number of each value, a position of each number, how often it occurs)."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    ids = np.empty(len(x), np.int64)
    ids[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ids, order[first], np.diff(np.append(first, len(x)))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, eight bytes at a time; long ones by the sums of :func:`common.span_hashes`."""
    size = end - start
    out = size.astype(U64) * U64(0x9E3779B97F4A7C15)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    now, k = np.flatnonzero(size <= LONG_WORD), 0
    while len(now):
        left = size[now] - k
        bits = eight[start[now] + k] & ~U64(0) >> (np.maximum(8 - left, 0) * 8).astype(U64)
        out[now] = mix(out[now] ^ bits)
        now, k = now[left > 8], k + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        one = buf[start[i]:end[i]]
        out[i] = C.span_hashes(one, np.array([0]), np.array([len(one)]), lower=False)[0]
    return out


def word_ids(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray,
             group: np.ndarray | None = None, exact: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each span, a span of each number, count): equal numbers for equal bytes of a group, if ``exact`` only for them."""
    ids, at, count = number(h if group is None else mix(h + group.astype(U64)))
    if not exact:
        return ids, at, count
    of = at[ids]
    if not same_bytes(buf, start, end, of) or (group is not None and (group != group[of]).any()):
        raw, seen = buf.tobytes(), {}
        groups = [0] * len(start) if group is None else group.tolist()
        ids = np.array([seen.setdefault((g, raw[a:z]), len(seen)) for g, a, z in zip(groups, start.tolist(), end.tolist())], np.int64)
        ids, at, count = number(ids)
    return ids, at, count


class Phrases:
    """Phrases of one chunk by length, with counts and 64-bit keys.

    Equal phrases of different groups (language and shard) are different ones.
    Unless ``exact``, words with equal hashes may count as one.
    """

    def __init__(self, ch: C.Chunk, lang_key: np.ndarray, group: np.ndarray, exact: bool = True):
        buf, off = LOWER[ch.buf], ch.off
        n = len(buf)
        word = ~BLANK[buf]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        first, last = word.copy(), word.copy()
        if n:
            first[1:] &= ~word[:-1] | cut[1:n]
            last[:-1] &= ~word[1:] | cut[1:n]
        self.buf, self.start, self.end = buf, np.flatnonzero(first), np.flatnonzero(last) + 1
        doc = np.repeat(np.arange(ch.n), np.diff(np.searchsorted(self.start, off)))
        self.group = group[doc]
        piece = np.cumsum(BREAK[buf], dtype=np.int32)[self.start]
        #: whether a word and the next are of one piece
        self.joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        h = word_hashes(buf, self.start, self.end)
        self.ids, self.at, self.count = word_ids(buf, self.start, self.end, h, self.group, exact)
        self.pos = np.arange(len(h))
        self.key = mix(h[self.at] + lang_key[doc[self.at]])
        self.words, self.word_key, self.size = self.ids, self.key, 1

    def keep(self, mask: np.ndarray) -> None:
        """Only the phrases of ``mask`` may be parts of longer ones."""
        new = np.cumsum(mask) - 1
        stay = mask[self.ids]
        self.pos, self.ids = self.pos[stay], new[self.ids[stay]]
        self.at, self.count, self.key = self.at[mask], self.count[mask], self.key[mask]

    def longer(self) -> None:
        """Go on to phrases of one word more, whose two parts of the present length are there."""
        here = np.full(len(self.start) + 1, -1, np.int64)
        here[self.pos] = self.ids
        pos = self.pos[here[self.pos + 1] >= 0]
        pos = pos[self.joined[pos]]
        self.ids, at, self.count = number(here[pos] * len(self.word_key) + self.words[pos + self.size])
        self.pos, self.at = pos, pos[at]
        self.key = mix(self.key[here[self.at]] * U64(3) + self.word_key[self.words[self.at + self.size]])
        self.size += 1

    def spelled(self, chosen: np.ndarray) -> pa.Array:
        """The text of phrases, words joined by one blank."""
        n = self.size
        w = (self.at[chosen][:, None] + np.arange(n)).reshape(-1)
        size = self.end[w] - self.start[w] + 1
        off = C.offsets(size)
        data = self.buf[np.minimum(np.arange(off[-1]) + np.repeat(self.start[w] - off[:-1], size), len(self.buf) - 1)]
        data[off[1:] - 1] = 0x20
        inside = np.ones(len(data), bool)
        inside[off[n::n] - 1] = False
        ends = np.r_[0, off[n::n] - np.arange(1, len(chosen) + 1)].astype(np.int32)
        return pa.StringArray.from_buffers(len(chosen), pa.py_buffer(ends.tobytes()), pa.py_buffer(data[inside].tobytes()))


def blocks(batches, shards: bool, exact: bool = True):
    """(phrases, language by group, shard by group) of each chunk; one shard if not ``shards``."""
    for ch in C.chunks(batches, "_text", BLOCK_BYTES):
        langs = ch.arrow("_lang").dictionary_encode()
        shard = ch.column("_shard").astype(np.int64) if shards else np.zeros(ch.n, np.int64)
        both, group = np.unique(np.stack([langs.indices.to_numpy(), shard]), axis=1, return_inverse=True)
        yield (Phrases(ch, ch.column("_lang_key").astype(np.int64).view(U64), group.reshape(-1), exact),
               langs.dictionary.take(pa.array(both[0])), both[1])


# ---------------------------------------------------------------- passes

def prepared(docs: DataFrame, shards: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und"))
    return docs.select(F.coalesce(C.text_column(docs, text_col), F.lit("")).alias("_text"), lang.alias("_lang"),
                       F.xxhash64(lang).alias("_lang_key"), F.pmod(F.xxhash64(docs[id_col]), F.lit(shards)).cast("int").alias("_shard"))


def count_words(texts: DataFrame, support: int) -> DataFrame:
    """(lang, word, key, shard, n): words with ``support`` in their language; without word, all words of a shard."""
    def run(batches):
        for p, lang, shard in blocks(batches, True):
            g = p.group[p.at]
            total = np.bincount(p.group, minlength=len(shard))
            yield pa.RecordBatch.from_arrays(
                [lang, pa.nulls(len(shard), pa.string()), pa.nulls(len(shard), pa.int64()), pa.array(shard, pa.int32()), pa.array(total)],
                ["lang", "word", "key", "shard", "n"])
            for a in range(0, len(p.at), SPELL):
                some = np.arange(a, min(a + SPELL, len(p.at)))
                yield pa.RecordBatch.from_arrays(
                    [lang.take(pa.array(g[some])), p.spelled(some), pa.array(p.key[some].view(np.int64)),
                     pa.nulls(len(some), pa.int32()), pa.array(p.count[some])], ["lang", "word", "key", "shard", "n"])
    rows = (texts.mapInArrow(C.tidy(run), "lang string, word string, key long, shard int, n long")
            .groupBy("lang", "word", "shard").agg(F.first("key").alias("key"), F.sum("n").alias("n")))
    return C.write_table(rows.where((F.col("n") >= support) | F.col("word").isNull()), "words")


def local_support(counted: DataFrame, support: int, shards: int) -> list[int]:
    """Occurrences that a shard asks for: its share of all words of ``support``, rounded up."""
    size = {r["shard"]: r["n"] for r in counted.where("word IS NULL").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    total = max(sum(size.values()), 1)
    return [max(1, -(-support * size.get(s, 0) // total)) for s in range(shards)]


def mine(texts: DataFrame, size: int, frequent: list[KeyFilter], least: list[int]) -> DataFrame:
    """(shard, key): phrases of ``size`` words that reach their shard's support, as keys combined with the shard.

    ``frequent``: filters of the shorter lengths, words first.
    """
    def run(batches):
        for p, _, shard in blocks(batches, True, exact=False):
            p.keep(frequent[0].has(p.key))
            for n in range(2, size + 1):
                p.longer()
                if n < size:
                    p.keep(frequent[n - 1].has(p.key ^ shard_bits(shard[p.group[p.at]])))
            s = shard[p.group[p.at]]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array((p.key ^ shard_bits(s)).view(np.int64)),
                                              pa.array(p.count, pa.int32())], ["shard", "key", "n"])
    asked = F.element_at(F.array(*map(F.lit, least)), F.col("shard") + 1)
    # blocks have counted; most keys of a task are its own, so it sends them as they are
    counted = texts.mapInArrow(C.tidy(run), "shard int, key long, n int").repartition("key").groupBy("shard", "key").agg(F.sum("n").alias("n"))
    return C.write_table(counted.where(F.col("n") >= asked).select("shard", "key"), "frequent")


def count_phrases(texts: DataFrame, candidates: list[KeyFilter], support: int) -> DataFrame:
    """(lang, phrase, size, a): candidates that occur ``support`` times, counted over all texts.

    ``candidates``: filters by length, words first.
    """
    def run(batches):
        for p, lang, _ in blocks(batches, False):
            p.keep(candidates[0].has(p.key))
            for n in range(2, len(candidates) + 1):
                p.longer()
                p.keep(candidates[n - 1].has(p.key))
                g = p.group[p.at]
                for a in range(0, len(p.at), SPELL):
                    some = np.arange(a, min(a + SPELL, len(p.at)))
                    yield pa.RecordBatch.from_arrays([lang.take(pa.array(g[some])), p.spelled(some), pa.array(p.count[some])],
                                                     ["lang", "phrase", "n"])
    counted = texts.mapInArrow(C.tidy(run), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    return C.write_table(counted.where(F.col("a") >= support)
                         .select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "a"), "phrases")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS, shards: int = SHARDS,
                     filter_bits: int = FILTER_BITS, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, a) of all phrases of 2 to ``max_words`` words, (lang, word, n)) with ``support`` occurrences.

    The second frame has, under a null word, the number of all words of the
    language. Rows without id are of one shard; repeated rows count each.
    """
    texts = prepared(docs, shards, id_col, text_col, lang_col)
    counted = count_words(texts, support)
    least = local_support(counted, support, shards)
    frequent = [key_filter(counted.where("word IS NOT NULL"), filter_bits)]
    candidates = list(frequent)
    # a literal for each shard: what shard_bits combines a key with
    bits = [int(b) for b in shard_bits(np.arange(shards)).view(np.int64)]
    plain = F.col("key").bitwiseXOR(F.element_at(F.array(*map(F.lit, bits)).cast(T.ArrayType(T.LongType())), F.col("shard") + 1))
    for n in range(2, max_words + 1):
        found = mine(texts, n, frequent, least)
        candidates.append(key_filter(found.select(plain.alias("key")), filter_bits))
        if n < max_words:
            frequent.append(key_filter(found, filter_bits))
    words = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return count_phrases(texts, candidates, support), words


def ranked(found: DataFrame, words: DataFrame, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """The result of :func:`collocations` from the two frames of :func:`frequent_phrases`; exact beyond 64 bits."""
    known = (words.where("word IS NOT NULL").selectExpr("lang", "word AS part", "n AS f")
             .unionByName(found.selectExpr("lang", "phrase AS part", "a AS f")))
    parts = found.withColumn("ws", F.split("phrase", " "))
    longer = (parts.where("size > 2")
              .selectExpr("lang", "a", "ws", "size", "explode(sequence(2, size - 1)) AS m")
              .selectExpr("lang", "a", "ws", "m", "explode(sequence(1, size - m + 1)) AS i")
              .selectExpr("lang", "array_join(slice(ws, i, m), ' ') AS phrase", "a AS longer")
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    stays = (parts.join(longer, ["lang", "phrase"], "left")
             .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorbed)))
    cuts = stays.selectExpr("lang", "phrase", "a", "ws", "size", "explode(sequence(1, size - 1)) AS k")
    big = "cast({} AS decimal(19, 0))".format
    cuts = (cuts.selectExpr("lang", "phrase", "a", "k", "array_join(slice(ws, 1, k), ' ') AS head",
                            "array_join(slice(ws, k + 1, size - k), ' ') AS tail")
            .join(known.selectExpr("lang", "part AS head", "f AS l"), ["lang", "head"])
            .join(known.selectExpr("lang", "part AS tail", "f AS r"), ["lang", "tail"])
            .withColumn("score", F.expr(f"({big('a')} * {big('a')} * 1000000) div ({big('l')} * {big('r')})")))
    scored = (cuts.groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .selectExpr("lang", "phrase", "a", "cut.l", "cut.r", "cast(cut.score AS long) AS score"))
    # each part's best first: no task orders all phrases of a language
    order = "ORDER BY score DESC, a DESC, phrase"
    scored = (scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
              .withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, part {order})")).where(F.col("rank") <= top)
              .drop("part").withColumn("rank", F.expr(f"cast(row_number() OVER (PARTITION BY lang {order}) AS long)")).where(F.col("rank") <= top))
    totals = words.where("word IS NULL").select("lang", "n")
    return scored.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS, top: int = TOP, absorbed: int = ABSORBED,
                 **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by their weakest cut.

    Words are ASCII lower-cased runs without blank or tab inside pieces between
    ``.,;:!?`` and line ends; a null text is empty, a null language ``und``. A
    phrase occurs ``a`` times, its first and remaining words at a cut ``l`` and
    ``r`` times; the score is floor(1000000 a a / (l r)), the lowest of all
    cuts, ties to the first. A phrase goes if a longer one of the support that
    contains it has ``absorbed`` percent of its occurrences. Ranks go by score,
    then ``a``, descending, then by the phrase's bytes; ``n`` counts all words
    of the language. An empty table has no rows.
    """
    found, words = frequent_phrases(docs, support, max_words, **how)
    return ranked(found, words, top, absorbed)
