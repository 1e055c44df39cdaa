"""Folders of many small files, written and read by a few tasks."""

import os

import pytest
from pyspark.sql import functions as F

from noteframe.sources import annotations as AN
from noteframe.sources import sinks as SK
from noteframe.sources import small_files as SF

ODD = ["p1", "a b", "x/y", "50%", "k=v:w", "é+", "", None, "_u", "tab\there"]


def tree(root):
    return {os.path.relpath(at, root): open(os.path.join(at, f), "rb").read() for at, _, names in os.walk(root) for f in names if f.startswith("part-")}


def test_folders_are_those_of_sparks_writer(spark, tmp_path):
    rows = [(k, str(i), ' "q", ' if i % 3 else None, 1.5 if i % 2 else None, f"2020-01-{i:02d}") for i in range(1, 10) for k in ODD if not (k is None and i > 3)]
    df = spark.createDataFrame(rows, "MDN string, `n o` string, note string, level double, date string").repartition(3)
    SK.csv_folders(df, str(tmp_path / "ours"), ["MDN"], ["date"])
    # Spark makes two files of no value and an empty one where they fall in two tasks
    SK.folder_writer(df.withColumn("MDN", F.when(F.col("MDN") != "", F.col("MDN"))), ["MDN"], ["date"]).option("header", True).csv(str(tmp_path / "spark"))
    ours, spark_ = tree(tmp_path / "ours"), tree(tmp_path / "spark")
    assert set(ours) == set(spark_) and len(ours) == len(ODD) - 1
    none = f"MDN={SF.NO_VALUE}"
    assert {k: v for k, v in ours.items() if k != none} == {k: v for k, v in spark_.items() if k != none}
    assert sorted(ours[none].split(b"\n")) == sorted(spark_[none].split(b"\n"))
    got = SF.read_lines(spark, str(tmp_path / "ours"), "*.csv").select(SF.folder_value(F.col("path"), "MDN").alias("k")).distinct().collect()
    assert {r["k"] for r in got} == {k or None for k in ODD}


def test_two_keys_text_and_a_second_run(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = [(f, a, f"{f}-{a}\nend" if a != "z" else None) for f in (None, "", "f1", "f2") for a in ("a", "b", "z")]
    df = spark.createDataFrame(rows, "folder string, annotator string, value string")
    for _ in range(2):  # replaced, not added
        SK.text_folders(df, out, ["folder", "annotator"])
    # without and with an empty folder name: one folder
    assert sum(text.count(b"end") for text in tree(out).values()) == 8 and len(tree(out)) == 9
    assert sorted(r["value"] for r in SF.read_lines(spark, out).collect()) == sorted(v for _, _, t in rows for v in (t or "").split("\n"))


@pytest.mark.parametrize("many", [1, 10**6])
def test_lines_are_those_of_sparks_reader(spark, tmp_path, monkeypatch, many):
    texts = [b"", b"\n", b"a", b"a\n", b"a\r\nb\r\n\r\nc", b"a\rb\r", b"a\r\rb\n\n", "é\n".encode(), b"x\n" * 25_000]
    for i, t in enumerate(texts):
        (tmp_path / f"d {i}" / "in").mkdir(parents=True)
        (tmp_path / f"d {i}" / "in" / "f.tsv").write_bytes(t)
        (tmp_path / f"d {i}" / ".h.tsv").write_bytes(b"hidden\n")
        (tmp_path / f"d {i}" / "_h.tsv").write_bytes(b"hidden\n")
        (tmp_path / f"d {i}" / "f.txt").write_bytes(b"other\n")
    want = sorted((r["value"], r["p"]) for r in spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.tsv").text(str(tmp_path))
                  .select("value", AN.decoded_path(F.col("_metadata.file_path")).alias("p")).collect())
    monkeypatch.setattr(SF, "MANY", many)
    got = SF.read_lines(spark, str(tmp_path), "*.tsv").orderBy("path", "at").collect()
    assert sorted((r["value"], r["path"]) for r in got) == want
    assert [r["value"] for r in got if "/d 4/" in r["path"]] == ["a", "b", "", "c"]


def test_a_few_tasks_read_many_files(spark, tmp_path):
    for i in range(SF.MANY + 200):
        folder = tmp_path / f"h--2020--p{i}--n{i}--b.conll"
        folder.mkdir()
        (folder / "ann_a.tsv").write_text("#x\n\n1-1\t0-3\tabc\t_\t_\n")
    got = AN.scan_annotation_tsv(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism  # one for some thirty files before
    assert got.select("NotitieID").distinct().count() == got.count() == SF.MANY + 200
