"""P1-P4 and token assembly on literal annotation rows."""

from noteframe.functions.domains import TAGSET_CURRENT, TAGSET_PILOT, TAGSET_WEEK14
from noteframe.operators import assemble as A
from noteframe.operators import clean as C
from noteframe.operators import labels as P


def test_categorize_and_index():
    cats = P.categorize_tags(TAGSET_CURRENT)
    assert len(cats["domains"]) == 9 and cats["disregard"] == ["other_disregard_file"]
    idx = P.parse_index(cats)
    assert idx[:9] == ["ATT", "STM", "ADM", "INS", "MBW", "ETN", "ENR", "FAC", "BER"]
    assert idx[-4:] == ["disregard", "target", "background", "plus"]
    assert "ETN" not in P.parse_index(P.categorize_tags(TAGSET_WEEK14))


def test_parse_labels_cases(spark):
    rows = [("_",), (None,), (".D450: FAC[1]|fac3[2]|fac1[3]",), ("other_target",), (".B530: MBW|mbw2|mbw_plus",)]
    df = spark.createDataFrame(rows, "label string")
    out = P.parse_labels(df, TAGSET_CURRENT).collect()
    assert out[0]["FAC"] is None and out[1]["FAC_lvl"] is None          # unlabelled -> NULL
    assert out[2]["FAC"] is True and out[2]["FAC_lvl"] == 3            # first level wins
    assert out[2]["ADM"] is False
    assert out[3]["target"] is True and out[3]["FAC_lvl"] is None      # flag only
    assert out[4]["plus"] is True and out[4]["MBW_lvl"] == 2


def test_parse_labels_legacy(spark):
    df = spark.createDataFrame([(".D450|FAC 4|view_Patient|disregard\\_file",), ("_",)], "label string")
    r = P.parse_labels_legacy(df, TAGSET_PILOT).collect()
    assert r[0]["FAC"] is True and r[0]["FAC_lvl"] == 4 and r[0]["disregard"] is True
    assert r[0]["other"] == ["view_Patient"] and r[1]["other"] is None


def test_sentence_assembly_orders_tokens(spark):
    rows = [("n1", "10-2", "b"), ("n1", "10-1", "a"), ("n1", "2-1", "x"), ("n1", "12345-1", "z")]
    df = spark.createDataFrame(rows, "NotitieID string, sen_tok string, token string")
    t = C.add_pad_sen_id(C.split_sen_tok(df))
    pads = {r["sen_id"]: r["pad_sen_id"] for r in t.collect()}
    assert pads["n1_2"] == "n1_0002" and pads["n1_12345"] == "n1_12345"   # never truncated
    t = t.withColumns({"ADM": t.tok > 1, "institution": t.token, "year": t.token, "MDN": t.token, "batch": t.token,
                       "annotator": t.token, "background_sent": t.tok < 0, "target_sent": t.tok < 0})
    s = {r["pad_sen_id"]: r["text_raw"] for r in A.build_sentences(t, domains=["ADM"]).collect()}
    assert s["n1_0010"] == "a b"
