"""Sentence ends learned from counts: abbreviations, ordinals, initials; counts and scores against plain Python."""

import math
import random
import re
from collections import Counter

from noteframe.operators import nlp
from noteframe.operators import sentences as S


def corpus():
    rng = random.Random(1)
    nouns = ["patient", "nurse", "doctor", "ward", "walk", "bed", "night", "meal", "visit", "pain"]
    out = []
    for i in range(400):
        s = [f"The {rng.choice(nouns)} saw dr. {rng.choice(['Smith', 'Jones'])} on the {rng.choice(nouns)}.",
             f"He took approx. {rng.randrange(9)} pills e.g. in the {rng.choice(nouns)}.", f"She met J. Doe on {rng.randrange(30)}. {rng.choice(['may', 'june'])} again at the {rng.choice(nouns)}.",
             f"It was good for the {rng.choice(nouns)}."]
        rng.shuffle(s)
        out.append(" ".join(s))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_learned_words(spark):
    df = frame(spark, corpus())
    abbreviations, learned = S.learn(df, "text")
    found = {r["word"]: r["score"] for r in abbreviations.collect()}
    assert {"dr", "approx", "e.g"} <= set(found) and not {"patient", "ward", "again", "bed"} & set(found)
    starters = {r["word"] for r in learned.collect()}
    assert {"the", "he", "she", "it"} >= starters and {"he", "she", "it"} <= starters
    # the score of one word by hand
    words = [re.sub(r"[^\w.]+$", "", re.sub(r"^\W+", "", t)).lower() for text in corpus() for t in text.split()]
    n, stops = Counter(re.sub(r"\.$", "", w) for w in words if w), Counter(w[:-1] for w in words if w.endswith("."))
    p = sum(stops.values()) / sum(n.values())
    k, c = stops["dr"], n["dr"]
    want = 2 * (k * math.log(.99) + (c - k) * math.log(.01) - k * math.log(p) - (c - k) * math.log(1 - p)) * math.exp(-2) * 2.0 ** -(c - k)
    assert abs(found["dr"] - want) < 1e-6


def test_ends_with_abbreviations_ordinals_and_initials(spark):
    texts = corpus()
    probe = ["Then dr. Smith came. He left.", "See e.g. the ward. It was approx. He came.", "On 3. may it was good. J. Doe slept! Why? yes",
             "In 1999. The patient walked.", "First line\nsecond dr.\nSmith", "", "  \n ", None, "No end", "By A. It was so.", "Go.Now. ok dr.  X"]
    df = frame(spark, texts + probe)
    got = {}
    for r in S.split_sentences_learned(df, "id", "text").collect():
        got.setdefault(r["id"], []).append((r["sen_no"], r["sentence"]))
    got = {i: [s for _, s in sorted(v)] for i, v in got.items()}
    sents = [got.get(len(texts) + i, []) for i in range(len(probe))]
    assert sents == [["Then dr. Smith came.", "He left."], ["See e.g. the ward.", "It was approx.", "He came."],
                     ["On 3. may it was good.", "J. Doe slept!", "Why?", "yes"], ["In 1999.", "The patient walked."],
                     ["First line", "second dr.", "Smith"], [], [], [], ["No end"], ["By A.", "It was so."], ["Go.Now.", "ok dr.  X"]]
    assert all(len(got[i]) == 4 for i in range(len(texts)))


def test_without_learned_words_it_is_the_rule_form(spark):
    texts = ["One. Two! Three? Four", "ab.bc cd. Do\n\nEf . fg", None, "", "xx.  yy.\n z"]
    df = frame(spark, texts)
    none = spark.createDataFrame([], "word string, score double")
    made = S.learned_sentences(df, "text", none, none).select("id", "sentences").collect()
    rule = df.select("id", nlp.sentence_array("text").alias("sentences")).collect()
    assert sorted(map(str, made)) == sorted(map(str, rule))


def test_nothing_to_learn(spark):
    df = frame(spark, ["no stops here", None])
    assert [x.count() for x in S.learn(df, "text")] == [0, 0]
    assert S.split_sentences_learned(df.limit(0), "id", "text").count() == 0


def test_stops_with_any_blanks(spark):
    rng = random.Random(5)
    bits = ["a.", "Dr.", "x", "e.g.", "3.", "b", "Q!", ".", "..", "é.", "(c).", "z.)", "ß"]
    gaps = [" ", " ", "  ", "\t", " \t ", "\t ", "\n", " \n", ".\n ", "\x0b ", "\f", "\r\n", " ", ""]
    texts = ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    want = set()
    for i, t in enumerate(texts):
        c = [m.group(0) for m in re.finditer(r"(?s).+?(?:[.!?][ \t\n\x0b\f\r]+|\n|\Z)", t)]
        for k, (x, y) in enumerate(zip(c, c[1:])):
            if x.rstrip(" \t\x0b\f\r").endswith("."):
                token = re.split(r"[ \t\x0b\f\r\n]", x.rstrip(" \t\x0b\f\r"))[-1]
                bare = re.sub(r"[^\w.]+$", "", re.sub(r"^\W+", "", token)).lower()
                want.add((i, k, re.sub(r"\.$", "", bare), (re.findall(r"\w+", y) or [""])[0].lower()))
    found = S.stops(frame(spark, texts), "text", "id")
    assert {(r["id"], r["k"], r["word"], r["next"]) for r in found.collect()} == want and len(want) > 500
    # a stretch that ends like most is not cut sign by sign
    assert "substring_index(rtrim(" in found._jdf.queryExecution().optimizedPlan().toString()
