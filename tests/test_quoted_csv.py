"""The scan of quoted files in ranges against Spark's multiLine reader and Python's csv module."""

import csv
import io
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteframe.sources import annotations as AN
from noteframe.sources import quoted_csv as Q


def folder():
    return tempfile.mkdtemp(prefix="nf-csv-")


@pytest.fixture
def small_ranges(spark):
    """Many ranges a file, cut anywhere."""
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def made(seed, n=120, quotes=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        row = [str(i)]
        for _ in range(4):
            row.append("".join(rng.choice(["a", "é", " ", ";", "\n", '"', "\n\n", "word", "", "x;y"] if quotes else ["a", "é", " ", "word"])
                               for _ in range(rng.randrange(9))))
        rows.append(row)
    return rows


def write(rows, end="\n", blanks=False):
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=";", lineterminator=end)
    for i, r in enumerate(rows):
        if blanks and i % 7 == 3:
            out.write(end * (i % 3 + 1))
        w.writerow(r)
    return out.getvalue()


def as_rows(df):
    n = sum(c.startswith("_c") for c in df.columns)
    return [tuple(r[f"_c{i}"] or "" for i in range(n)) for r in df.orderBy("file", "row").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("blanks", [False, True])
def test_equals_csv_module(spark, small_ranges, end, blanks):
    d = folder()
    rows = made(len(end) + blanks)
    with open(os.path.join(d, "a.csv"), "w", newline="", encoding="utf-8") as f:
        f.write(write(rows, end, blanks))
    df = Q.read_quoted_csv(spark, d)
    assert Q.scan_lines(spark, d, ";", '"', None, "UTF-8").select("start").distinct().count() > 20
    assert as_rows(df) == [tuple(r) for r in rows]
    assert [r["row"] for r in df.orderBy("row").collect()] == list(range(len(rows)))


def test_equals_multiline_reader(spark, small_ranges):
    d = folder()
    for i in range(3):
        with open(os.path.join(d, f"f{i}.csv"), "w", newline="", encoding="utf-8") as f:
            f.write(write(made(i, 40 + i), blanks=i == 1))
    multi = spark.read.option("sep", ";").option("multiLine", True).option("escape", '"').csv(d)
    got = Q.read_quoted_csv(spark, d).select(*multi.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, multi.collect()))


def test_literal_quotes_long_fields_and_open_end(spark, small_ranges):
    d = folder()
    text = ('1;5" pipe;b\n2;"in ""quotes""\n' + "long line; with 'sep'\n" * 60 + '";c\n3;"a"b;"c"\n4; "x;y"\n5;;\n\n6;"never closed\nto the end\n')
    with open(os.path.join(d, "a.csv"), "w", newline="") as f:
        f.write(text)
    got = as_rows(Q.read_quoted_csv(spark, d, n_columns=3))
    assert [r[0] for r in got] == ["1", "2", "3", "4", "5", "6"]
    assert got[0] == ("1", '5" pipe', "b")
    assert got[1] == ("2", 'in "quotes"\n' + "long line; with 'sep'\n" * 60, "c")
    assert got[4] == ("5", "", "")
    assert "to the end" in got[5][1]


def test_escape_sign_encoding_and_byte_order_mark(spark, small_ranges):
    d = folder()
    with open(os.path.join(d, "a.csv"), "wb") as f:
        f.write(('1;"a \\" b\nc";é\n2;x;"ü\n\n"\n' * 30).encode("latin-1"))
    got = as_rows(Q.read_quoted_csv(spark, d, escape="\\", encoding="ISO-8859-1"))
    assert got == [("1", 'a " b\nc', "é"), ("2", "x", "ü\n\n")] * 30
    d = folder()
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8-sig", newline="") as f:
        f.write('"0012\n";b\n' * 40)
    assert as_rows(Q.read_quoted_csv(spark, d)) == [("0012\n", "b")] * 40


def test_nothing(spark):
    d = folder()
    open(os.path.join(d, "a.csv"), "w").close()
    assert Q.read_quoted_csv(spark, d).collect() == []
    assert Q.read_quoted_csv(spark, d, n_columns=2).columns == ["_c0", "_c1", "file", "name", "row"]


def test_walk_composes_functions():
    rng = np.random.default_rng(0)
    for entry in (0, 1):
        code = rng.integers(0, 4, 300)
        before, after = Q.walk(code, entry)
        s = entry
        for c, b, a in zip(code, before, after):
            assert b == s
            s = (c >> s) & 1
            assert a == s


def test_row_references_of_real_files(spark, small_ranges):
    """Raw files of many ranges and parts; names hold the place of a note in its file."""
    d = folder()
    want = {}
    for name, parts in (("notes_a.csv", 3), ("notes_b.csv", 1)):
        os.makedirs(os.path.join(d, f"raw={name}"))
        k = 0
        for p in range(parts):
            rows = made(p + parts, 25)
            for r in rows:
                r[1] = f"id-{name}-{p}-{r[0]}"
                want[name, k] = r[1]
                k += 1
            with open(os.path.join(d, f"raw={name}", f"part-{p}.csv"), "w", newline="", encoding="utf-8") as f:
                f.write(write(rows, blanks=True))
    raw = Q.read_quoted_csv(spark, d, name=F.regexp_extract("file", "raw=([^/]+)/", 1)).selectExpr("name AS rawfile", "row AS row_no", "_c1 AS notitieID")
    files = spark.createDataFrame([(f"x/{n}---{i + 1}.conll/Ann.tsv", n, i) for n, i in want], "path string, n string, i int")
    got = {(r["n"], r["i"]): r["NotitieID"] for r in AN.parse_filename_legacy_rowref(files, raw).collect()}
    assert got == want
