"""Keyword patterns on the worked examples of the keyword rules."""

import re

from pyspark.sql import functions as F

from noteframe.functions.text import keyword_regex
from noteframe.operators import keywords as KW


def test_templates_match_python_semantics():
    assert keyword_regex("vermoei", 0) == r"\bvermoei.*?\b"
    assert keyword_regex("blij", 1) == r"\bblij\b"
    rx = keyword_regex("valt af", 2)
    assert re.search(rx, "hij valt niet erg af", re.I)
    assert re.search(rx, "af en toe valt hij", re.I)
    assert not re.search(rx, "hij valt. Daarna af", re.I)


def test_find_keywords_against_python_re(spark):
    texts = ["Vermoeidheid en vermoeid, blijven blij. Valt niet af.", "ÉBLIJ blijé blij", "valt. af", ""]
    kws = [("vermoei", "ENR", 0), ("blij", "STM", 1), ("valt af", "BER", 2)]
    regs = KW.domain_regex(kws)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, all_text string")
    out = {r["id"]: r for r in KW.find_keywords(df, regs).collect()}
    for i, t in enumerate(texts):
        for dom, rx in regs.items():
            assert out[i][dom] == re.findall(rx, t, flags=re.IGNORECASE), (t, dom)


def test_count_and_hits(spark):
    kws = [("the", "ADM", 1), ("and", "ATT", 1)]
    df = spark.createDataFrame([(1, "the cat and dog", "i", "m"), (2, "nothing here", "i", "m")],
                               "NotitieID int, all_text string, institution string, MDN string")
    m = KW.count_matched_domains(KW.find_keywords(df, KW.domain_regex(kws)), ["ADM", "ATT"])
    assert {r["NotitieID"]: r["n_matched_domains"] for r in m.collect()} == {1: 2, 2: 0}
    assert [r["NotitieID"] for r in KW.keyword_hits_only(m, ["ADM", "ATT"]).collect()] == [1]
