"""Operator 12 against plain Python counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from noteframe.llm import common as C
from noteframe.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, support=10, max_words=3, top=2000, absorbed=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    out = {}
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= absorbed * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, r) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = (p.decode(), -a, left, r, n[lang], -s)
    return out


def as_dict(df):
    rows = df.collect()
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows}
    assert len(got) == len(rows)
    return got


def made(seed, n=160):
    """Texts over few words with set phrases, odd blanks, capitals and breaks."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "né", "ÀB", "x" * 40]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randrange(0, 60)):
            out.append(rng.choice(["new york city", "New York", "ice\tcream", "a  b   c", rng.choice(words), rng.choice(words)]))
            out.append(rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".", "\x0b", " \r\n"]))
        rows.append((i if i % 9 else 3, "".join(out), rng.choice(["en", "en", "fr", None])))
    return rows + [(None, "new york city " * 30, "en"), (None, None, None), (7, "", "de"), (8, " \t ", "de"), (9, "lone", "xx")]


@pytest.mark.parametrize("how", [{}, {"support": 4, "max_words": 4, "shards": 3}, {"support": 2, "shards": 7, "filter_bits": 8},
                                 {"support": 3, "shards": 1, "top": 5, "absorbed": 20}])
def test_collocations_match_plain_counting(spark, how):
    rows = made(len(how))
    docs = spark.createDataFrame([r + ("x", 1) for r in rows], "doc_id long, text string, lang string, phrase string, n int").repartition(5)
    want = by_hand([r[1:] for r in rows], **{k: v for k, v in how.items() if k not in ("shards", "filter_bits")})
    assert want
    assert as_dict(phrases.collocations(docs, **how)) == want


def test_collocations_of_odd_documents(spark, odd_documents, no_documents):
    rows = [(r["text"], r["lang"]) for r in odd_documents.collect()]
    assert as_dict(phrases.collocations(odd_documents)) == by_hand(rows)
    assert phrases.collocations(no_documents).count() == 0


def test_small_blocks_give_the_same(spark, monkeypatch):
    """Chunks cut between any documents, and phrases spelled out in slices."""
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(made(5, 30))]
    one = phrases.Phrases
    seen = Counter()
    batch = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = phrases.prepared(batch, 2, "doc_id", "text", "lang").toArrow().to_batches()
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 100)
    for p, lang, shard in phrases.blocks(texts, True):
        assert isinstance(p, one) and len(lang) == len(shard)
        p.longer()
        for text, count, g in zip(p.spelled(np.arange(len(p.at))).to_pylist(), p.count.tolist(), p.group[p.at].tolist()):
            seen[lang[g].as_py(), text] += count
    want = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang or "und", f"{a} {b}") for a, b in zip(ws, ws[1:]))
    assert seen == want


def test_words_with_equal_hashes_stay_apart():
    buf = np.frombuffer(b"ab cd ab", np.uint8)
    start, end, h = np.array([0, 3, 6]), np.array([2, 5, 8]), np.zeros(3, np.uint64)
    ids, at, count = phrases.word_ids(buf, start, end, h)
    assert ids.tolist() == [0, 1, 0] and at[1] == 1 and count.tolist() == [2, 1]
    assert phrases.word_ids(buf, start, end, h, np.array([0, 0, 1]))[0].tolist() == [0, 1, 2]


def test_filter_holds_its_keys(spark):
    keys = np.random.default_rng(3).integers(-2 ** 63, 2 ** 63 - 1, 500)
    f = phrases.key_filter(spark.createDataFrame([(int(k),) for k in keys], "key long"), 20)
    assert f.has(keys.view(np.uint64)).all()
    assert f.has(C.mix(np.arange(10000))).mean() < 0.01


def test_scores_beyond_64_bits(spark):
    a, left, r = 3_000_000_000_007, 5_000_000_000_011, 7_000_000_000_003
    found = spark.createDataFrame([("en", "x y", 2, a)], "lang string, phrase string, size int, a long")
    words = spark.createDataFrame([("en", "x", left), ("en", "y", r), ("en", None, 10 ** 14)], "lang string, word string, n long")
    assert as_dict(phrases.ranked(found, words)) == {("en", 1): ("x y", a, left, r, 10 ** 14, 1000000 * a * a // (left * r))}


def test_local_support_misses_nothing(spark):
    """Ten occurrences in ten documents are found wherever the documents are dealt to."""
    rows = [(i, f"only here u{i} v{i}" if i < 10 else f"a{i} b{i} c{i}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for shards in (1, 4, 9):
        assert as_dict(phrases.collocations(docs, shards=shards)) == {("en", 1): ("only here", 10, 10, 10, 10 * 4 + 290 * 3, 1000000)}


def test_word_hashes_name_the_bytes():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in (*range(1, 40), 255, 256, 257, 3000) for _ in range(6)]
    text = " ".join(words).encode()
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - np.array([len(w) for w in words])
    h = phrases.word_hashes(np.frombuffer(text, np.uint8), start, end).tolist()
    assert len(dict(zip(words, h))) == len(set(h)) == len(set(words)) == len(set(zip(words, h)))
    shifted = phrases.word_hashes(np.frombuffer(b"x, " + text + b"yz", np.uint8), start + 3, end + 3)
    assert shifted.tolist() == h
