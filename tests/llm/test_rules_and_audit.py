"""Operators 11 and 13 against plain Python over the same rows."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from noteframe.llm import audit, rules
from noteframe.llm import common as C

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- operator 13

def audited(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, lang in rows:
        t = t or ""
        ws = WORDS.findall(t)
        f = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
             "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for s, letter in enumerate(order, 1):
                before = set(order[:s - 1])
                gone = [x for x in mine if letter in x[1] and not x[1] & before]
                out[part, order, s] = [sum(not x[1] & set(order[:s]) for x in mine), len(gone),
                                       sum(letter in x[1] and bool(x[1] & before) for x in mine), sum(x[1] == {letter} for x in mine),
                                       sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, letter] += len(gone)
    return {k: tuple(v + [shapley[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_dict(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in METRICS) for r in rows}
    assert len(got) == len(rows)
    return got


LABELS = [(0, 1, 0), (1, 1, 1), (1, 1, 1), (3, 0, 1), (4, None, None), (5, 1, None), (None, 1, 1), (8, 1, 0), (9, 1, 0), (9, 0, 1)]


def test_audit_matches_plain_python(spark, odd_documents):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_documents.collect()]
    varied = " ".join(f"word{i}" for i in range(250))
    rows += [(20, varied, "en"), (21, varied, "en"), (21, varied, "fr"), (22, varied + " #", "en"), (23, varied.upper(), ""),
             (24, "same " * 300, "fr"), (25, "same " * 300, "de"), (26, "SAME $ " * 300, None)]
    docs = spark.createDataFrame([r + ("x", 1) for r in rows], "doc_id long, text string, lang string, mask string, id int")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = audited(rows, LABELS)
    assert as_dict(audit.audit(docs, labels)) == want
    assert len(want) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_nothing(spark, no_documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(no_documents, labels).count() == 0


def test_audit_of_unlabelled_copies_with_one_hot_text(spark):
    rows = [(i, "a b c" if i % 3 else f"text {i}", "en") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = as_dict(audit.audit(docs, labels))
    assert got == audited(rows, [])
    assert got["en", "EABCD", 1][1] == 59


def test_more_parts_than_a_recursion_usually_holds(spark):
    """The recursion's row limit does not end the query, and the session's setting stays."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "500")
    try:
        cells = spark.range(5).selectExpr("cast(id AS string) AS part", "0 AS mask", "1L AS n", "0L AS good", "0L AS toxic")
        assert audit.filter_interactions(cells, "ABCDE").count() == 5 * 600
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "500"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_other_filters(spark):
    """Any conditions can be audited: here two, without copies."""
    docs = spark.createDataFrame([(1, "x", "p"), (2, "xy", "p"), (3, "", "p")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = audit.failure_cells(docs, labels, lambda t: {"X": t.contains("x"), "Y": t.contains("y")}, copies=None)
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"]) for r in audit.filter_interactions(cells, "XY").collect()}
    assert got == {("XY", 1): (1, 2), ("XY", 2): (1, 0), ("YX", 1): (2, 1), ("YX", 2): (1, 1)}


# ---------------------------------------------------------------- operator 11

def counted(text):
    text = text or ""
    ws = WORDS.findall(text)
    windows = Counter(tuple(ws[k:k + 8]) for k in range(len(ws) - 7))
    covered = {j for k in range(len(ws) - 7) if windows[tuple(ws[k:k + 8])] > 1 for j in range(k, k + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def odd_texts():
    rng = random.Random(4)
    out = ["", None, "\n", "a", "é\u00a0ü #|", "x y\nx y\n x y\nx y\r\nx y", "one two three four five six seven eight " * 2,
           "p " * 9, "p " * 8, "q " * 40, " \n \n", "tail\ntail", "\n\nhead\n", "a b c d e f g h\na b c d e f g h i"]
    for _ in range(60):
        out.append("".join(rng.choice(["w1", "w2", "W", "*", "é9"]) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"])
                           for _ in range(rng.randrange(60))))
    return out + [" ".join(f"v{i % 5000}" for i in range(20000))]


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_counts_match_plain_python(chunk):
    texts = odd_texts()
    batch = pa.RecordBatch.from_arrays([pa.array([t or "" for t in texts])], ["t"])
    got = [tuple(r) for ch in C.chunks([batch], "t", chunk) for r in rules.statistics(ch)[0].tolist()]
    assert got == [counted(t) for t in texts]


def test_statistics_do_not_depend_on_neighbours():
    texts = [t or "" for t in odd_texts()]
    alone = np.concatenate([rules.statistics(C.Chunk(pa.RecordBatch.from_arrays([pa.array([t])], ["t"]), "t"))[1] for t in texts])
    together = rules.statistics(C.Chunk(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), "t"))[1]
    assert np.allclose(alone, together) and not together[0].any()


def prose(rng, n=None):
    ws = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n or rng.randrange(60, 400))]
    return " ".join(w.capitalize() + "." if rng.random() < 0.08 else w for w in ws) + "."


def junk(rng, kind):
    text = prose(rng)
    return {"signs": lambda: " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in text.split()), "shout": text.upper,
            "digits": lambda: " ".join(str(rng.randrange(10 ** 6)) for _ in range(150)),
            "bangs": lambda: " ".join(w + "!!!" for w in text.split())}[kind]()


def corpus(rows_a_group=150, seed=2):
    """Prose of two languages and three sources, of which one is far larger, and a tenth of junk."""
    rng = random.Random(seed)
    rows, bad = [], set()
    for lang, source, n in (("en", "a", 5 * rows_a_group), ("en", "b", rows_a_group), ("fr", "a", rows_a_group), ("fr", None, 30), (None, "c", 30)):
        for i in range(n):
            if i % 10 == 0:
                bad.add(len(rows))
            rows.append((len(rows), junk(rng, rng.choice(["signs", "shout", "digits", "bangs"])) if i % 10 == 0 else prose(rng), lang, source))
    return rows, bad


SCHEMA = "doc_id long, text string, lang string, source string"


def test_outliers_of_every_group_are_rejected(spark):
    rows, bad = corpus()
    docs = spark.createDataFrame([r + (1.0, "x", "y") for r in rows], SCHEMA + ", distance double, k string, g string").repartition(7)
    got = {r["doc_id"]: r for r in rules.rate(docs, least_rows=60).collect()}
    assert len(got) == len(rows)
    assert all(not r["base_failed"] and r["distance"] is not None for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == bad
    assert all(tuple(r[c] for c in rules.COUNTS) == counted(rows[i][1]) for i, r in got.items())


def test_distances_match_an_estimate_in_memory(spark):
    """One group: the distributed steps against the same steps on a matrix, from the same start."""
    rows, _ = corpus(60)
    rows = [r for r in rows if r[2] == "en" and r[3] == "a"]
    got = {r["doc_id"]: r["distance"] for r in rules.rate(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    x = rules.statistics(C.Chunk(pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows])], ["t"]), "t"))[1]
    floor = np.array([rules.SPREAD[f] for f in rules.FEATURES])
    mean, whiten = rules.start(x, floor)
    for _ in range(30):
        d = rules.distances(x, mean, whiten)
        core = x[np.argsort(d)[:-(-3 * len(x) // 4)]]
        mean, whiten, _ = rules.centre_and_whitening(len(core), core.sum(axis=0), core.T @ core, rules.CORE, floor)
    core = x[rules.distances(x, mean, whiten) <= rules.chi2_quantile(rules.REWEIGHT, len(floor))]
    mean, whiten, _ = rules.centre_and_whitening(len(core), core.sum(axis=0), core.T @ core, rules.REWEIGHT, floor)
    want = rules.distances(x, mean, whiten)
    assert np.allclose([got[r[0]] for r in rows], want, rtol=0.05)
    assert ((want > rules.chi2_quantile(rules.REJECT, 11)) == [got[r[0]] > rules.chi2_quantile(rules.REJECT, 11) for r in rows]).all()


def test_ring_table_gives_the_moments_of_the_core(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 11))
    floor = np.full(11, 0.1)
    mean, whiten = np.zeros(11), np.eye(11)
    vectors = spark.createDataFrame([(i, "k", v.tolist()) for i, v in enumerate(x)], "id long, k string, f array<double>").repartition(4)
    names = spark.createDataFrame([("k", "k", 400)], "k string, g string, rows long")
    models = spark.createDataFrame([("k", 400, mean.tolist(), whiten.reshape(-1).tolist())], rules.MODEL)
    got = rules.step(vectors, models, names, floor, False).first()
    d = rules.distances(x, mean, whiten)
    ring = rules.ring_of(d)
    core = x[ring <= ring[np.argsort(d)[299]]]  # whole rings
    want = rules.centre_and_whitening(len(core), core.sum(axis=0), core.T @ core, rules.CORE, floor)
    assert np.allclose(got["mean"], want[0]) and np.allclose(got["whiten"], want[1].reshape(-1)) and got["n"] == 400


def test_chi_squared():
    assert abs(rules.chi2_cdf(3.841458820694124, 1) - 0.95) < 1e-9
    assert abs(rules.chi2_quantile(0.999, 11) - 31.264133620239985) < 1e-6
    assert abs(rules.chi2_quantile(0.5, 2) - 1.386294361119891) < 1e-9
    x = np.random.default_rng(0).normal(size=(200_000, 5))
    d = (x * x).sum(axis=1)
    core = x[d <= np.quantile(d, 0.75)]
    assert abs(rules.consistency(0.75, 5) * core.var(axis=0).mean() - 1) < 0.01


def test_start_withstands_a_fifth_of_outliers():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(400, 11)), rng.normal(8, 1, size=(100, 11))]
    mean, whiten = rules.start(x, np.full(11, 0.1))
    assert np.abs(mean).max() < 0.3
    assert (rules.distances(x, mean, whiten)[400:] > rules.chi2_quantile(0.999, 11)).all()


def test_rating_of_odd_documents(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    got = sorted(rules.rate(odd_documents).collect(), key=str)
    assert sorted(str(tuple(r[c] for c in ("doc_id", *rules.COUNTS))) for r in got) == sorted(str((i, *counted(t))) for i, t in rows)
    for r in got:
        fails = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == fails and r["distance"] is None and r["kept"] == (not fails)  # too few rows for an estimate
    assert rules.rate(no_documents).count() == 0


def test_a_group_of_copies_keeps_them(spark):
    rng = random.Random(9)
    same = prose(rng, 100)
    rows = [(i, same if i % 3 else prose(rng), "en", "a") for i in range(240)]
    assert all(r["kept"] for r in rules.rate(spark.createDataFrame(rows, SCHEMA)).collect())
