"""S-rows: quotas, disjoint draws, exact group-split counts, ranks."""

import math
import zlib

from pyspark.sql import functions as F

from noteframe.operators import sampling as S


def test_quotas_truncate_like_source():
    q = {x["source"]: x for x in S.batch_quotas(["a", "b", "c"], "cov", 60, 0.5, 0.8, 5, ["cov"])}
    assert q["cov"]["n_files"] == 25 and q["cov"]["n_kwd"] == 20 and q["cov"]["n_rndm"] == 5
    assert q["a"]["n_files"] == 10 and q["a"]["n_kwd"] == 8


def test_select_notes_disjoint_and_exact(spark):
    rows = [(str(i), ["cov", "a"][i % 2], ["x"] * (i % 3 > 0), ["y"], ["z"], ["w"]) for i in range(400)]
    df = spark.createDataFrame(rows, "NotitieID string, source string, D1 array<string>, D2 array<string>, "
                                     "D3 array<string>, D4 array<string>")
    b = S.select_notes(df, ["x1", "x2"], ["a"], "cov", 20, 0.5, 0.5, ["D1", "D2", "D3", "D4"], ["D1"], 4, 2, ["cov"], seed=3)
    rows = b.collect()
    iaa = [r for r in rows if r["samp_meth"] == "kwd_iaa"]
    others = [r["NotitieID"] for r in rows if r["samp_meth"] != "kwd_iaa"]
    assert len(iaa) == 4 and len({r["NotitieID"] for r in iaa}) == 2
    assert len(others) == len(set(others)) and not set(others) & {r["NotitieID"] for r in iaa}
    sf = S.batch_shortfall(b, S.batch_quotas(["a"], "cov", 20, 0.5, 0.5, 2, ["cov"]), ["x1", "x2"])
    assert sf.agg(F.sum("missing")).first()[0] == 0
    kwd = [r for r in rows if r["samp_meth"] == "kwd"]
    assert all(r["D1"] for r in kwd)


def test_group_split_counts(spark):
    df = spark.range(0, 1000).select((F.col("id") % 137).cast("string").alias("g"))
    s = S.group_split_3way(df, "g", 0.8, 19).select("g", "split").distinct().groupBy("split").count().collect()
    c = {r["split"]: r["count"] for r in s}
    rest = math.ceil((1 - 0.8) * 137)
    assert c["test"] == math.ceil(rest * 0.5) and c["dev"] == rest - c["test"] and c["train"] == 137 - rest


def test_global_rank_is_sorted_order(spark):
    df = spark.range(0, 500).select(((F.col("id") * 7919) % 1009).alias("k"))
    r = S.global_rank(df, ["k"], "rank").orderBy("rank").collect()
    assert [x["rank"] for x in r] == list(range(500))
    assert [x["k"] for x in r] == sorted(x["k"] for x in r)


def test_dedup_annotators_one_per_note(spark):
    df = spark.createDataFrame([("n1", "a"), ("n1", "b"), ("n1", "b"), ("n2", "c")], "NotitieID string, annotator string")
    for clustered in (False, True):
        out = S.dedup_annotators(df, 0, clustered=clustered).groupBy("NotitieID").agg(F.countDistinct("annotator").alias("k"))
        assert all(r["k"] == 1 for r in out.collect())


def test_split_has_no_note_leak_and_is_deterministic(spark):
    from noteframe.operators.report import split_leakage_check
    df = spark.range(0, 600).select((F.col("id") % 97).cast("string").alias("NotitieID"), F.col("id"))
    a = S.group_split_3way(df, "NotitieID", 0.8, 19)
    assert split_leakage_check(a, "split", "NotitieID").count() == 0          # D29 asserted empty
    b = S.group_split_3way(df, "NotitieID", 0.8, 19)
    key = lambda r: (r["NotitieID"], r["split"])
    assert sorted(map(key, a.select("NotitieID", "split").distinct().collect())) == \
        sorted(map(key, b.select("NotitieID", "split").distinct().collect()))


def test_cap_sample_is_exact_and_seeded(spark):
    df = spark.range(0, 1000).select(F.col("id").cast("string").alias("NotitieID"))
    a = [r[0] for r in S.cap_sample(df, "NotitieID", 50, 45).collect()]
    b = [r[0] for r in S.cap_sample(df, "NotitieID", 50, 45).collect()]
    assert len(a) == 50 and sorted(a) == sorted(b)
    assert S.cap_sample(df.limit(10), "NotitieID", 50, 45).count() == 10


def test_cap_is_per_source(spark):
    df = spark.range(0, 300).select(F.col("id").cast("string").alias("NotitieID"), (F.col("id") % 3).cast("string").alias("s"))
    n = {r["s"]: r["count"] for r in S.cap_sample(df, "NotitieID", 20, 45, source="s").groupBy("s").count().collect()}
    assert n == {"0": 20, "1": 20, "2": 20}


def test_batch_preparation_searches_up_to_the_cap(spark, tmp_path, monkeypatch):
    from noteframe.plans import q_pipelines as Q
    docs = spark.range(0, 1100).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit("en").alias("lang"),
                                       F.when(F.col("id") < 1000, "hot").otherwise("other").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, 1100).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(S, "select_notes", lambda found, **_: found)  # what the draw sees
    left = lambda *cap: {r["institution"]: r["count"] for r in Q._prepared(spark, str(tmp_path), *cap).groupBy("institution").count().collect()}
    out = Q.md5_bucket("doc_id", F.lit("out")) % 20 == 0
    want = {r["source"]: r["count"] for r in docs.where((F.col("doc_id") % 10 != 0) & ~out).groupBy("source").count().collect()}
    assert want["hot"] > 800 and left() == want
    assert left(10) == {"hot": 10, "other": 10}


def test_short_pool_is_an_error_unless_allowed(spark):
    import pytest
    df = spark.createDataFrame([(str(i), "cov", ["x"]) for i in range(6)], "NotitieID string, source string, D1 array<string>")
    args = (df, ["x1"], ["a"], "cov", 20, 0.5, 0.5, ["D1"], ["D1"], 1, 2, ["cov"])
    with pytest.raises(ValueError, match="too few notes"):
        S.select_notes(*args)
    assert 0 < S.select_notes(*args, allow_short=True).count() <= 6


def test_order_statistics_at_every_depth(spark):
    """Ranks found by half keys, by whole keys and among ids of one key; repeated ids count once, nulls not at all."""
    ids = [f"id{i % 300}" for i in range(900)] + [None] * 5
    df = spark.createDataFrame([(i,) for i in ids], "g string").repartition(3)
    ranks = [0, 1, 37, 150, 298, 299, 300]
    for key, number in ((F.crc32("g"), lambda g: zlib.crc32(g.encode())), (F.crc32("g") % 7, lambda g: zlib.crc32(g.encode()) % 7),
                        (F.crc32("g") % 7 * 65536, lambda g: zlib.crc32(g.encode()) % 7 * 65536)):
        want = sorted((number(g), g) for g in set(ids) - {None}) + [None]
        for few in (10_000, 20, 0):
            assert S.order_statistics(df, "g", key, lambda n: ranks, few) == [want[r] for r in ranks]
    assert S.order_statistics(df.limit(0), "g", F.crc32("g"), lambda n: (n,)) == [None]


def test_split_of_every_row_follows_its_group(spark):
    df = spark.createDataFrame([(None if i % 11 == 0 else f"n{i % 50}", i) for i in range(400)], "g string, k int")
    for made in (S.group_split_3way(df, "g", 0.7), S.group_split_2way(df, "g", 0.3)):
        rows = made.collect()
        by_group = {}
        for r in rows:
            by_group.setdefault(r["g"], set()).add(r["split"])
        assert len(rows) == 400 and by_group.pop(None) == {None} and all(len(v) == 1 for v in by_group.values())
        assert sum("test" in v for v in by_group.values()) == (8 if "dev" in {x for v in by_group.values() for x in v} else 15)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
