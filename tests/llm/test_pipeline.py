"""The pipeline against its brute-force twin, stage by stage and as a whole."""
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from noteframe.llm import common, pii
from test_text_operators import brute_lines, components, jaccard_links, shingles, words_of

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = common.documents(spark, SF)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "pii", "packing"]
    steps = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    good = common.write_table(steps["quality"](spark, docs, SF), "t")
    assert good.columns == columns
    kept = {r["doc_id"] for r in good.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([(d in kept) == bool(q) for d, q in labels.items()]) > 0.95

    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    gone = brute_lines(texts)
    want = {}
    for d, t in texts.items():
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        if left == t or words_of(left):
            want[d] = left
    once = common.write_table(steps["line_dedup"](spark, good, SF), "t")
    assert once.columns == columns and {r["doc_id"]: (r["text"], r["n_chars"]) for r in once.collect()} == {d: (t, len(t)) for d, t in want.items()}

    sets = {d: shingles(t) for d, t in want.items()}
    root = components(sets, jaccard_links(sets))
    single = common.write_table(steps["near_dedup"](spark, once, SF), "t")
    assert single.columns == columns
    assert {r["doc_id"]: r["text"] for r in single.collect()} == {d: want[d] for d in want if root[d] == d}

    clean = common.write_table(steps["pii"](spark, single, SF), "t")
    assert clean.columns == columns and clean.count() == single.count()
    for r in clean.collect():
        assert not pii.base_spans(r["text"])
        if not pii.candidates(want[r["doc_id"]]):
            assert r["text"] == want[r["doc_id"]]

    bins = steps["packing"](spark, clean, SF).toPandas()
    assert bins.groupby("doc_id").n_words.sum().to_dict() == {r["doc_id"]: len(words_of(r["text"])) for r in clean.collect()}
    whole = corpus_pipeline.run(spark, SF).toPandas()
    order = list(bins.columns)
    assert whole.sort_values(order).reset_index(drop=True).equals(bins.sort_values(order).reset_index(drop=True))


def test_stages_take_odd_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        out = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.write_table(stage(spark, out, SF), "t")
            assert out.columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()


def test_repeated_rows_keep_one_copy(spark):
    """A text found nowhere else stays when its row is repeated: twice after line dedup, once after near dedup."""
    only = " ".join(f"only{i}" for i in range(40))
    docs = common.documents(spark, SF).where("doc_id < 20")
    row = docs.where("doc_id = 3").withColumn("text", F.lit(only)).withColumn("doc_id", F.lit(1_000_000).cast("long"))
    docs = docs.unionByName(row).unionByName(row)
    steps = dict(corpus_pipeline.STAGES)
    once = common.write_table(steps["line_dedup"](spark, docs, SF), "t")
    assert [r["text"] for r in once.where("doc_id = 1000000").collect()] == [only, only]
    single = common.write_table(steps["near_dedup"](spark, once, SF), "t")
    assert [r["text"] for r in single.where("doc_id = 1000000").collect()] == [only]


def test_rows_that_repeat_an_id_with_other_texts_stay(spark):
    """Two texts under one id are no copies of each other; columns named like the operators' own keep their values."""
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in ("one", "two"))
    docs = spark.createDataFrame([(1, one, "7"), (1, two, "8"), (1, two, "8")], "doc_id long, text string, n_removed string")
    steps = dict(corpus_pipeline.STAGES)
    once = common.write_table(steps["line_dedup"](spark, docs, SF), "t")
    assert sorted(map(tuple, once.collect())) == [(1, one, "7"), (1, two, "8"), (1, two, "8")]
    single = common.write_table(steps["near_dedup"](spark, once, SF), "t")
    assert sorted(map(tuple, single.collect())) == [(1, one, "7"), (1, two, "8")]
