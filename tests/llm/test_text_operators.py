"""Operators on documents against brute force, and their defined results for odd rows."""
import collections
import hashlib
import re

import numpy as np
import pytest

from noteframe.llm import bpe, common, jaccard, langid, lines, packing, pii, quality, queries, suffix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in common.documents(spark, SF).select("doc_id", "text").collect()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_links(sets):
    inverted = collections.defaultdict(list)
    for d, s in sets.items():
        met = collections.Counter(e for g in s for e in inverted[g])
        for e, k in met.items():
            if 100 * k >= 80 * (len(s) + len(sets[e]) - k):
                yield d, e
        for g in s:
            inverted[g].append(d)


# ---- 10

def test_jaccard_join_equals_brute_force(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op10_jaccard_join"](spark, SF).collect()}
    sets = {d: shingles(t) for d, t in texts.items()}
    root = components(sets, jaccard_links(sets))
    assert got == {d: (len(s), root[d]) for d, s in sets.items()}


def test_jaccard_join_many_near_copies(spark):
    """Chains of copies around the threshold: links between others than the first member count too."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(90):
        w = list(base)
        for i in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            w[i] = f"n{d}x{i}"
        rows.append((d, " ".join(w[:int(rng.integers(95, 121))])))
    rows += [(200 + d, "short text number five six" + " seven" * (d % 3)) for d in range(6)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: shingles(t) for d, t in rows}
    assert got == components(sets, jaccard_links(sets))


def test_part_keys_meet_for_every_pair_within_the_bound():
    rng = np.random.default_rng(1)
    for size in (5, 9, 17, 40, 200):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2 ** 63, size).astype(np.uint64))
            drop = int(rng.integers(0, max(1, size // 9) + 1))
            b = np.unique(np.r_[a[drop:], rng.integers(0, 2 ** 63, drop).astype(np.uint64)])
            inter = len(np.intersect1d(a, b))
            if 100 * inter < 80 * (len(a) + len(b) - inter) or (len(a) == len(b) == inter):
                continue
            band = jaccard.band_of(max(len(a), len(b)))
            assert set(jaccard.part_keys(a, band, 80).tolist()) & set(jaccard.part_keys(b, band, 80).tolist())


def test_jaccard_join_odd_rows(odd_documents, no_documents):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.jaccard_components(odd_documents).collect()}
    assert len(got) == 13  # the repeated row is equal
    assert got[0, 176] == got[1, 176] == got[2, 176] == got[3, 180] == 0
    assert got[4, 0] == 4 and got[5, 0] == 5 and got[7, 0] == 7 and got[None, 176] is None and got[None, 0] is None
    assert got[6, 1] == got[10, 1] == 6
    assert jaccard.jaccard_components(no_documents).collect() == []


# ---- 7

def brute_lines(texts):
    rows = [(d, k, frozenset(words_of(t))) for d in sorted(texts) for k, t in enumerate((texts[d] or "").split("\n"))]
    rows = [r for r in rows if r[2]]
    inverted, gone = collections.defaultdict(list), set()
    for i, (d, k, s) in enumerate(rows):
        met = collections.Counter(j for w in s for j in inverted[w])
        if any(100 * c >= 80 * (len(s) + len(rows[j][2]) - c) for j, c in met.items()):
            gone.add((d, k))
        for w in s:
            inverted[w].append(i)
    return gone


def test_line_dedup_equals_brute_force(spark, texts):
    gone = brute_lines(texts)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(common.documents(spark, SF)).collect()}
    assert got == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in texts.items()}


def test_line_dedup_near_lines(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(12)]
    texts = {d: "\n".join(" ".join(rng.choice(vocabulary, int(rng.integers(4, 9)))) for _ in range(6)) for d in range(40)}
    gone = brute_lines(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert got == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in texts.items()}


def test_line_dedup_odd_rows(odd_documents, no_documents):
    got = lines.dedup_lines(odd_documents)
    assert got.columns == [*odd_documents.columns, "n_lines", "n_removed"]
    rows = {r["n_chars"]: r for r in got.collect()}
    assert rows[0]["text"] and rows[1]["text"] == rows[2]["text"] == rows[3]["text"] == ""
    assert rows[5]["n_lines"] == 0 and rows[5]["text"] == "" and rows[6]["text"] is None
    assert rows[7]["text"] and rows[7]["doc_id"] is None  # no id: stays and removes nothing
    assert rows[9]["text"] == "\n\n \n" and rows[9]["n_lines"] == 4
    assert rows[0]["data"] == b"z" and rows[0]["_text"] == "t"
    assert lines.dedup_lines(no_documents).collect() == []


def test_line_dedup_repeated_rows(spark):
    """A repeated row is no copy of itself, within a task and across tasks; other rows' copies of it go."""
    only, first, near = (" ".join(f"{w}{i}" for i in range(10)) for w in ("only", "first", "near"))
    text = {4: first, 5: f"{only}\n{near}", 8: f"{first}\n{near} more\nshort", 9: only}
    df = spark.createDataFrame([(d, text[d]) for d in (5, 5, 4, 8, 9, 8, 5, 4)], "doc_id long, text string")
    for parts in (1, 8):
        got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(df.repartition(parts)).collect())
        assert got == [(4, first, 0)] * 2 + [(5, text[5], 0)] * 3 + [(8, "short", 2)] * 2 + [(9, "", 1)]


def test_line_dedup_has_no_floor(spark):
    """Lines of one to four words and lines without blanks are removed where they repeat; four words match five."""
    block = "".join(chr(0x4E00 + i) for i in range(40))
    texts = {1: f"one\nsame four words here\n{block}\n\na b c d", 2: "one two\nsame four words here\nA B C D E\nx y z", 3: f"one\n\n{block}\nx y w\nz y x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(df).collect()}
    assert got == {1: (texts[1], 0), 2: ("one two\nx y z", 2), 3: ("\nx y w", 3)}


def test_line_dedup_of_columns_with_its_names(spark):
    df = spark.createDataFrame([(1, "a b", "seven", 7.5), (2, "a b", None, None)], "doc_id long, text string, n_removed string, n_lines double")
    got = sorted(tuple(r) for r in lines.dedup_lines(df, added=("lines", "gone")).collect())
    assert got == [(1, "a b", "seven", 7.5, 1, 0), (2, "", None, None, 1, 1)]


# ---- 6

def brute_repeats(texts):
    first, out = {}, {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        gone, own = np.zeros(len(raw), bool), []
        for p in range(len(raw) - 49):
            if raw[p:p + 50] in first:
                gone[p:p + 50] = True
            else:
                own.append(raw[p:p + 50])
        for w in own:
            first[w] = d
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[d] = (len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, texts):
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op6_suffix_dedup"](spark, SF).collect()}
    assert got == brute_repeats(texts)


def test_repeats_periodic_and_overlapping(spark):
    rng = np.random.default_rng(3)
    texts = {0: "ab" * 100, 1: "ab" * 60 + "c", 2: "a" * 49, 3: "a" * 50, 4: "a" * 200, 5: "\0" * 60, 6: "\0" * 80}
    stock = "".join(rng.choice(list("abcd "), 400))
    for d in range(7, 40):
        a, b = sorted(rng.integers(0, 400, 2).tolist())
        texts[d] = stock[a:b] + "".join(rng.choice(list("xyé"), 5)) + stock[a // 2:a // 2 + 55]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
           for r in suffix.remove_repeats(df).collect()}
    assert got == brute_repeats(texts)


def test_repeats_odd_rows(odd_documents, no_documents):
    rows = suffix.remove_repeats(odd_documents).collect()
    assert len(rows) == 14
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert by_id[0][0]["n_removed"] == 0 and by_id[5][0]["n_bytes"] == 0 and by_id[4][0]["kept"] == b""
    assert [r["kept"] for r in by_id[1]] == [b"", b""]  # both go for document 0, not for each other
    assert all(r["n_removed"] == 0 for r in by_id[None]) and by_id[8][0]["n_removed"] == 0
    assert suffix.remove_repeats(no_documents).collect() == []


# ---- 9

def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op9_bpe"](spark, SF).collect()}
    for d, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_split_equals_the_library():
    from tokenizers import Tokenizer
    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    alphabet = list("ab'sStrevml d  \n\t é1٣!.,　😀-\x1c") + ["<|endoftext|>", "'ll", " 're", "<|endof"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 14)))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    off = common.offsets(np.array([len(r) for r in raw]))
    buf = np.frombuffer(b"".join(raw), np.uint8)
    start, end, special = bpe.split(buf, off, tuple(bpe._specials(path)))
    ids = collections.defaultdict(list)
    for a, z, s in zip(start.tolist(), end.tolist(), special):
        word = buf[a:z].tobytes()
        ids[int(np.searchsorted(off, a, side="right")) - 1] += [bpe._specials(path)[word]] if s else tok.encode(word.decode(), add_special_tokens=False).ids
    for i, t in enumerate(texts):
        assert ids[i] == tok.encode(t, add_special_tokens=False).ids, t


def test_bpe_odd_rows(odd_documents, no_documents, spark):
    path = queries.tokenizer_path()
    rows = bpe.decode(bpe.encode(odd_documents, path), path).collect()
    assert len(rows) == 14 and {r["decoded"] for r in rows if r["doc_id"] in (4, 5)} == {""}
    assert sorted(r["decoded"] for r in rows) == sorted(r["text"] or "" for r in odd_documents.collect())
    assert bpe.encode(no_documents, path).collect() == []
    odd = spark.createDataFrame([(1, 2, bytearray(np.array([50256, 60000], "<u4").tobytes())), (2, 0, None)], "doc_id long, n_tokens long, ids binary")
    assert [r["decoded"] for r in bpe.decode(odd, path).orderBy("doc_id").collect()] == ["<|endoftext|>", None]


# ---- 8

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
                "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
    return sorted((m.start(), i, m.end()) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text) if good(k, m.group()))


def test_base_spans_equal_the_patterns(texts):
    rng = np.random.default_rng(6)
    alphabet = list("a1@.+- ()92_b.5@.é")
    made = ["".join(rng.choice(alphabet, int(rng.integers(0, 40)))) for _ in range(8000)]
    made += ["4111 1111-1111 1111", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "+1 (499) 555-6503", "9" * 5000, "a" * 5000 + "@", "0000.1.2.256"]
    for t in [*made, *texts.values()]:
        assert pii.base_spans(t) == brute_pii(t)


def test_pii_query(spark, texts):
    for r in queries.QUERIES["op8_pii"](spark, SF).collect():
        base = [f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in brute_pii(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]


def test_pii_learns_and_masks(spark, odd_documents, no_documents):
    rows = [(i, f"write to mail user{i}@site.com or call +1 (202) 555-{1000 + i} today") for i in range(30)]
    rows += [(100, "pay by card 5927243074273351 now"), (101, "order 1111111111111 version 10.20.30.400"), (102, None), (103, ""),
             (104, "mail joe (at) site (dot) com")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS id", "1 AS spans", "doc_id AS n_chars")
    got = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert got[3] == "write to mail <EMAIL> or call <PHONE> today"
    assert got[100] == "pay by card <CARD> now" and got[101] == rows[31][1] and got[102] is None and got[103] == ""
    found = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert found[100]["base"] == [] and found[100]["spans"][0]["kind"] == "card"
    assert len(pii.find(odd_documents).collect()) == 14
    assert pii.find(no_documents).collect() == [] and pii.mask(no_documents).collect() == []


def test_reliabilities_are_learned():
    """Two labelers that agree with a hidden truth outweigh one that votes at random."""
    rng = np.random.default_rng(8)
    truth = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 for p in (0.95, 0.95, 0.5, 0.9, 0.5)], axis=1)
    number = np.zeros(4000, np.int64)
    for i in range(5):
        number = number * 3 + votes[:, i]
    model = pii.fit(*np.unique(number, return_counts=True))
    assert ((model.probability(number) >= 0.5) == truth).mean() > 0.97
    assert abs(model.reliability[1, 2, 2] - 0.5) < 0.1 and model.reliability[1, 0, 2] > 0.9


# ---- 4

def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    score = queries.QUERIES["op4_quality"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    unseen = score[score.held_out]
    assert len(unseen) > 40 and (unseen.predicted == unseen.quality).mean() > 0.95
    assert score.score.between(0, 1).all() and ((score.score >= 0.3) == (score.predicted == 1)).all()


def test_quality_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (4, None), (6, 7), (6, 1), (7, 0)], "doc_id long, quality int")
    assert len(quality.classify(odd_documents, labels).collect()) == 14
    assert quality.keep_good(odd_documents, labels).columns == odd_documents.columns
    none = labels.where("false")
    assert {r["score"] for r in quality.classify(odd_documents, none).collect()} == {0.5}
    assert quality.classify(no_documents, labels).collect() == []


def test_discriminant_equals_the_densities():
    rng = np.random.default_rng(9)
    d = len(quality.FEATURES)
    mean, cov = rng.normal(size=(2, d)), [np.eye(d) * 2, np.eye(d)]
    model = quality.Gaussians(mean, np.array([np.linalg.inv(np.linalg.cholesky(c)) for c in cov]),
                              np.array([np.linalg.slogdet(c)[1] for c in cov]), np.log([0.3, 0.7]), True)
    x = rng.normal(size=(5, d))
    log = [np.log(p) - 0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m) - 0.5 * np.linalg.slogdet(c)[1]
           for p, m, c in zip((0.3, 0.7), mean, cov)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])))


# ---- 5

def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op5_language"](spark, sf).toPandas().merge(common.documents(spark, sf).select("doc_id", "lang").toPandas(), on="doc_id")
    unseen = got[got.held_out]
    assert len(unseen) > 100 and (unseen.lang == unseen.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(10)
    field = langid.Field(list("abc"), None, None, None, rng.normal(size=3), rng.normal(size=(3, 3)))
    lens = [0, 1, 5, 300, 129, 128, 0, 257]
    off = common.offsets(np.array(lens))
    e = rng.random((off[-1], 3)) + 1e-3
    got = field.marginals(e, off)
    start, t = np.exp(field.start), np.exp(field.transition)
    for a, b in zip(off[:-1], off[1:]):
        if a == b:
            continue
        alpha, beta = [start * e[a]], [np.ones(3)]
        for i in range(a + 1, b):
            alpha.append(alpha[-1] / alpha[-1].sum() @ t * e[i])
        for i in range(b - 1, a, -1):
            beta.append(t @ (e[i] * beta[-1]) / (t @ (e[i] * beta[-1])).sum())
        m = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[a:b], m / m.sum(axis=1, keepdims=True))


def test_language_of_switched_words():
    pieces = {"xx": [b"alba ulma elba orma"] * 30, "yy": [b"krotz shtrek blitz dresk"] * 30}
    field = langid.fit(pieces)
    raw = np.frombuffer(b"alba ulma elba krotz blitz dresk shtrek", np.uint8)
    off = np.array([0, len(raw)])
    ws, we = langid.words(raw, off)
    m = field.marginals(field.emissions(raw, ws, we, common.span_hashes(raw, ws, we, lower=True)), np.array([0, len(ws)]))
    assert m.argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1, 1]


def test_language_odd_rows(odd_documents, no_documents):
    rows = langid.identify(odd_documents).collect()
    assert len(rows) == 14
    und = [r for r in rows if r["lang_pred"] == "und"]
    assert {r["doc_id"] for r in und} == {4, 5, 7, None} and all(r["score"] == 0 for r in und)
    assert langid.identify(no_documents).collect() == []


# ---- 2

def slow_best_fit(length, source, cluster, capacity):
    bins, out = [], []
    for n, s, c in zip(length, source, cluster):
        fits = [(room, b) for b, (room, ss, cc) in enumerate(bins) if room >= n and (s < 0 or s not in ss) and (c < 0 or c not in cc)]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append((capacity, set(), set()))
        room, ss, cc = bins[b]
        bins[b] = (room - n, ss | {s}, cc | {c})
        out.append(b)
    return out


def test_best_fit_equals_the_plain_search():
    rng = np.random.default_rng(11)
    for _ in range(40):
        n = int(rng.integers(0, 120))
        length = np.sort(rng.integers(1, 101, n))[::-1].tolist()
        source, cluster = rng.integers(-1, 5, n).tolist(), rng.integers(-1, 30, n).tolist()
        assert packing.best_fit(length, source, cluster, 100) == slow_best_fit(length, source, cluster, 100)


def test_packing_query(spark, texts):
    got = queries.QUERIES["op2_packing"](spark, SF).toPandas()
    source = common.documents(spark, SF).select("doc_id", "source").toPandas()
    size = got.groupby("doc_id").n_words.sum().to_dict()
    assert size == {d: len(words_of(t)) for d, t in texts.items()}
    assert got.groupby("bin_id").n_words.sum().max() <= packing.CAPACITY
    assert not got[got.n_words < packing.CAPACITY].dropna().merge(source).duplicated(["bin_id", "source"]).any()
    clusters = {d: tuple(words_of(t)) for d, t in texts.items()}
    assert not got.dropna().assign(c=got.doc_id.map(clusters)).duplicated(["bin_id", "c"]).any()


def test_packing_odd_rows(odd_documents, no_documents):
    rows = packing.pack(odd_documents).collect()
    assert sum(r["bin_id"] is None for r in rows) == 4
    long = sorted((r["piece"], r["start"], r["n_words"]) for r in rows if r["doc_id"] == 9)
    assert long == [(i, i * 2048, 2048) for i in range(14)] + [(14, 28672, 30000 - 28672)]
    assert packing.pack(no_documents).collect() == []
