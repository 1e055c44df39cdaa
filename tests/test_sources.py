"""A-rows: scans of literal fixture files written to a scratch folder, and
sinks written and read back."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from noteframe.functions.domains import TAGSET_CURRENT
from noteframe.operators import labels as P
from noteframe.sources import annotations as AN
from noteframe.sources import notes as SN
from noteframe.sources import register as RG
from noteframe.sources import sinks as SK
from noteframe.streaming import register_stream as RS
from noteframe.streaming.register_stream import start_register_stream


def _tmp():
    return tempfile.mkdtemp(prefix="nf-test-")


def test_scan_notes_csv(spark):
    d = _tmp()
    with open(os.path.join(d, "hospa_2020.csv"), "w", encoding="utf-8-sig") as f:
        f.write('0012;9001;Consult;2020-05-18;"moe  en\nkortademig";  extra\t part \n')
        f.write('0012;9001;Consult;2020-05-18;"moe  en\nkortademig";  extra\t part \n')   # exact duplicate
        f.write('0013;9002;Brief;2020-05-19;;\n')                                           # all parts NULL
    df = SN.scan_notes_csv(spark, d, "hospa")
    rows = {r["NotitieID"]: r for r in df.collect()}
    assert len(rows) == 2 and rows["9001"]["MDN"] == "0012"              # ids keep leading zeros
    assert rows["9001"]["all_text"] == "moe en kortademig extra part"
    assert rows["9002"]["all_text"] == ""
    src = SN.source_from_filename(spark.read.option("sep", ";").csv(d)).select("institution").distinct().collect()
    assert [r[0] for r in src] == ["hospa"]


def test_scan_annotation_tsv_and_parsers(spark):
    d = _tmp()
    note = os.path.join(d, "hospa--2020--1234567--123456789--week_14.conll")
    os.makedirs(note)
    with open(os.path.join(note, "Anna.tsv"), "w") as f:
        f.write("#FORMAT=TSV 3.3\n#T_SP=custom.Span|label\n#T_RL=x\n\n\n#Text=Hij loopt\n")
        f.write("1-1\t0-3\tHij\t_\t_\n1-2\t4-9\tloopt\t.D450: FAC|fac3\t_\n1-3\t10-11\t\"\t_\t_\n1-4\t12-14\tNA\t_\t_\n")
    df = AN.scan_annotation_tsv(spark, d)
    rows = df.collect()
    assert len(rows) == 4 and rows[0]["annotator"] == "anna" and rows[0]["NotitieID"] == "123456789"
    assert {r["token"] for r in rows} == {"Hij", "loopt", '"', "NA"}                 # quote and NA kept
    leg = spark.createDataFrame([("x/HOSPB--123--1234567--99--1--2020-05-18--q1--Search1.conll/Bert.tsv",)], "p string")
    r = leg.select(AN.parse_filename_legacy8(F.col("p")).alias("m")).select("m.*").first()
    assert (r["institution"], r["year"], r["MDN"], r["NotitieID"], r["batch"]) == ("hospb", "2020", "1234567", "99", "pilot")
    files = spark.createDataFrame([("x/notes.csv---2.conll/ann.tsv",)], "path string")
    raw = spark.createDataFrame([("notes.csv", 0, "A"), ("notes.csv", 1, "B")], "rawfile string, row_no int, notitieID string")
    assert AN.parse_filename_legacy_rowref(files, raw).first()["NotitieID"] == "B"


def test_tagset_json_and_register(spark):
    d = _tmp()
    p = os.path.join(d, "tagset.json")
    with open(p, "w") as f:
        json.dump({"name": "t", "tags": [{"tag_name": t, "tag_description": ""} for t in TAGSET_CURRENT]}, f)
    tags = P.load_tagset(spark, p).orderBy("pos")
    names = [r["tag_name"] for r in tags.collect()]
    assert names == TAGSET_CURRENT
    cats = P.categorize_tags_df(tags).groupBy("category").count().collect()
    assert {r["category"]: r["count"] for r in cats}["domains"] == 9
    reg = spark.createDataFrame([("hospa", "2020", "1", "n1", "w1", None)], ", ".join(f"{c} string" for c in RG.REGISTER_COLS))
    new = spark.createDataFrame([("hospb", "2021", "2", "n1", "w2"), ("hospb", "2021", "3", "n2", "w3"), ("hospb", "2021", "3", "n2", "w2")],
                                "institution string, year string, MDN string, NotitieID string, batch string")
    out = {r["NotitieID"]: r for r in RG.update_register(reg, new).collect()}
    assert out["n1"]["institution"] == "hospa" and out["n2"]["batch"] == "w2"


def test_sinks_roundtrip(spark):
    d = _tmp()
    batch = spark.createDataFrame([("ann", "hospa", "2020-05-18", "p1", "n1", "Hij loopt. Zij niet!")],
                                  "annotator string, institution string, Notitiedatum string, MDN string, NotitieID string, all_text string")
    lay = SK.conll_layout(batch, "week_14").first()
    assert lay["file_name"] == "hospa--2020--p1--n1--week_14.conll"
    assert lay["conll"] == "Hij O\nloopt O\n. O\n\nZij O\nniet O\n! O"
    SK.export_conll(batch, os.path.join(d, "conll"), "week_14")
    assert spark.read.text(os.path.join(d, "conll")).count() == 7
    rows = spark.range(0, 25).select(F.col("id").alias("k"))
    ch = SK.chunk_layout(rows, ["k"], 10).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in ch] == [10, 10, 5]                                      # chunk 0 kept
    back = SK.persist_stage(rows, os.path.join(d, "stage"))
    assert back.count() == 25
    SK.export_flat(batch, os.path.join(d, "flat"), drop=["all_text"])
    assert "all_text" not in spark.read.option("header", True).option("sep", "\t").csv(os.path.join(d, "flat")).columns


def test_folders_are_written_by_all_tasks_without_checksum_files(spark):
    d = _tmp()
    rows = spark.createDataFrame([(f"p{i % 40}", str(i), f"2020-01-{28 - i // 40:02d}") for i in range(200)], "MDN string, n string, Notitiedatum string")
    SK.export_per_patient(rows, d, 3)
    files = [(os.path.basename(at), f) for at, _, fs in os.walk(d) for f in fs if "MDN=" in at]
    assert len({f[:10] for _, f in files}) > 1                                          # part-00000, part-00001, ...
    assert sorted(at for at, _ in files) == sorted(f"MDN=p{i}" for i in range(40))      # one file a patient, no .crc beside it
    at, f = files[0]
    dates = [x.split(",")[1] for x in open(os.path.join(d, at, f)).read().split()[1:]]
    assert len(dates) == 5 and dates == sorted(dates)


def test_register_stream(spark):
    d = _tmp()
    src, reg = os.path.join(d, "src"), os.path.join(d, "register")
    schema = "institution string, year string, MDN string, NotitieID string, batch string"
    spark.createDataFrame([("a", "2020", "1", "n1", "w1"), ("a", "2020", "1", "n1", "w1"), ("a", "2020", "2", "n2", "w1")],
                          schema).write.parquet(os.path.join(src, "b1"))
    q = start_register_stream(spark, os.path.join(src, "*"), schema, reg, os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    spark.createDataFrame([("a", "2020", "2", "n2", "w2"), ("a", "2020", "3", "n3", "w2")], schema).write.parquet(os.path.join(src, "b2"))
    q = start_register_stream(spark, os.path.join(src, "*"), schema, reg, os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    ids = sorted(r["NotitieID"] for r in spark.read.parquet(reg).collect())
    assert ids == ["n1", "n2", "n3"]


def test_equal_rows_of_two_sources_stay_two(spark, tmp_path):
    from noteframe.sources.notes import scan_notes_csv
    for name in ("source=hosp a", "source=b%20c"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "notes.csv").write_text("1;9;x;2020-01-01;some text\n1;9;x;2020-01-01;some text\n")
    n = scan_notes_csv(spark, str(tmp_path), "any", source_pattern=r"source=([^/]+)")
    assert sorted(r["institution"] for r in n.collect()) == ["b%20c", "hosp a"]


def test_annotation_paths_are_decoded(spark, tmp_path):
    from noteframe.sources.annotations import scan_annotation_tsv
    folder = tmp_path / "hosp a--2020--p1--1%2--week_14.conll"
    folder.mkdir()
    (folder / "ann_a.tsv").write_text("#x\n\n1-1\t0-3\tabc\t_\t_\n")
    r = scan_annotation_tsv(spark, str(tmp_path)).first()
    assert (r["institution"], r["NotitieID"], r["annotator"]) == ("hosp a", "1%2", "ann_a")


def test_register_replay_and_half_written_batch(spark):
    """A replayed batch gives the same folder, whatever a failed try left; earlier batches stay first; a new stream does not touch an old one's folders."""
    d = _tmp()
    reg = os.path.join(d, "register")
    columns = ", ".join(f"`{c}` string" for c in RG.REGISTER_COLS)
    spark.createDataFrame([], f"{columns}, {RS._PLACE}").write.partitionBy("reg_run", "reg_batch", "reg_bucket").parquet(reg)
    schema = "institution string, year string, MDN string, NotitieID string, batch string"
    first = spark.createDataFrame([("a", "2020", str(i), f"n{i}", "w1") for i in range(40)] + [("b", "2020", "x", "n1", "w0")], schema)
    second = spark.createDataFrame([("a", "2021", str(i), f"n{i}", "w2") for i in range(30, 60)] + [("a", "2021", "z", None, "w2")] * 2, schema)
    rows = lambda: sorted((str(r["NotitieID"]), r["batch"], r["reg_run"], r["reg_batch"]) for r in RS.read_stream_register(spark, reg).collect())
    RS.append_batch(first, 0, reg, "r1")
    RS.append_batch(second, 1, reg, "r1")
    want = sorted([(f"n{i}", "w0" if i == 1 else "w1", "r1", 0) for i in range(40)] + [(f"n{i}", "w2", "r1", 1) for i in range(40, 60)] + [("None", "w2", "r1", 1)])
    assert rows() == want
    RS.append_batch(second, 1, reg, "r1")  # replayed whole
    assert rows() == want
    half = os.path.join(reg, "reg_run=r1", "reg_batch=1")  # a failed try had filed other buckets' rows and part of its own
    second.limit(3).selectExpr(*schema.replace(" string", "").split(", "), "cast(null AS string) AS legacy_rawfile", "7 AS reg_bucket").write.mode(
        "append").partitionBy("reg_bucket").parquet(half)
    assert rows() != want
    RS.append_batch(second, 1, reg, "r1")
    assert rows() == want
    RS.append_batch(second, 0, reg, "r2")  # another stream begins its batches at 0 again and finds all notes filed
    assert rows() == want


def test_micro_batch_reads_only_its_buckets(spark):
    d = _tmp()
    reg = os.path.join(d, "register")
    columns = ", ".join(f"`{c}` string" for c in RG.REGISTER_COLS)
    spark.createDataFrame([], f"{columns}, {RS._PLACE}").write.partitionBy("reg_run", "reg_batch", "reg_bucket").parquet(reg)
    many = spark.range(2000).selectExpr("concat('n', id) AS NotitieID", "'w' AS batch")
    RS.append_batch(many, 0, reg, "r")
    assert RS.read_stream_register(spark, reg).select("reg_bucket").distinct().count() == RS.BUCKETS
    part = RS.read_stream_register(spark, reg).where(F.col("reg_bucket").isin([3]))
    assert len(part.inputFiles()) > len(set(part.select(F.input_file_name()).distinct().collect())) == 1
