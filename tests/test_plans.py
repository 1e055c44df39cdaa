"""What the plans of the token queries cost: sorts, explodes and shuffles."""

import __spark_entry__ as E
from noteframe.plans import bindings as b
from noteframe.plans import tokens as TK
from noteframe.sources import annotations as AN

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_by_note_grow_with_the_input(spark, tmp_path):
    assert "REPARTITION_BY_NUM" in plan(b.tokens_by_note(spark, SF))  # Spark does not join these partitions
    few = spark.range(10).selectExpr("id", "md5(cast(id as string)) AS t")
    few.write.parquet(str(tmp_path / "few"))
    few.crossJoin(spark.range(400).select()).selectExpr("id", "uuid() AS t").write.parquet(str(tmp_path / "many"))
    few, many = (b.parts_by_size(spark.read.parquet(str(tmp_path / x)), 4 << 10) for x in ("few", "many"))
    assert few >= spark.sparkContext.defaultParallelism and many > 8 * few


def test_one_sort_for_the_windows_of_a_note(spark):
    p = plan(TK.clean(spark, SF))
    assert p.count("Window [") >= 3 and p.count("Sort [") == 1


def test_tokens_are_made_once_per_use(spark):
    for name, most in (("assemble_domain_levels", 1), ("level_datasets", 2), ("split_leakage_check", 0),
                       ("slice_by_predicted_domain", 0), ("domain_dataset", 2)):
        p = plan(E.queries()[name](spark, SF))
        assert p.count("Generate posexplode") <= most, name


def test_tokenize_shuffles_texts_not_tokens(spark):
    p = plan(E.queries()["tokenize"](spark, SF))
    assert p.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(doc_id" in p and "REPARTITION_BY_NUM" in p


def test_paths_are_parsed_once_a_line(spark, tmp_path):
    folder = tmp_path / "A--2017--p1--n.1--week_14.conll"
    folder.mkdir()
    (folder / "Ann.x.tsv").write_text("#FORMAT\n\n1-1\t0-2\tab\t_\t_\n1-2\t3-5\tcd\t_\t_\n")
    got = AN.scan_annotation_tsv(spark, str(tmp_path))
    assert "explode(array(" in plan(got)
    assert [tuple(r)[:11] for r in got.orderBy("sen_tok").collect()] == [
        (s, c, t, "_", "_", "ann.x", "a", "2017", "p1", "n.1", "week_14") for s, c, t in (("1-1", "0-2", "ab"), ("1-2", "3-5", "cd"))]


def test_stems_of_odd_paths(spark):
    rows = [("/a/b.conll/c.tsv",), ("b/c",), ("c.tsv",), ("x/y/",), ("a//b.t",), ("/a/.conll/.tsv",), ("/a.b.c/d.e.f",), ("",), (None,)]
    import re
    df = spark.createDataFrame(rows, "p string").select("p", AN._file_stem(AN.F.col("p")).alias("f"), AN._parent_stem(AN.F.col("p")).alias("d"))
    for r in df.collect():
        want = [None if r["p"] is None else (m.group(1) if (m := re.search(rx, r["p"])) else "")
                for rx in (r"([^/]+?)(\.[^./]*)?$", r"([^/]+?)(\.[^./]*)?/[^/]+$")]
        assert [r["f"], r["d"]] == want, r["p"]


def test_pair_rows_need_both_words_in_one_stretch(spark):
    from noteframe.operators import keyword_index as ki
    # 60 pairs share their first word; only one partner stands in the stretch, and the next stretch has none
    words = spark.createDataFrame([(f"the w{i}", "ADM", 2, i) for i in range(60)], "keyword string, domain string, template int, order long")
    texts = spark.createDataFrame([("the a the w7 the b. the the the. w8 w9",)], "all_text string")
    assert ki.find_indexed(texts, words, ["ADM"]).first()["ADM"] == ["the a the w7"]
    found = ki.find_indexed(texts, words, ["ADM"])._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in found and "_hits" in found and "map_values" not in found
