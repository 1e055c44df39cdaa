"""Source/sink queries (A6-A10, A12-A16) and rule-based text units."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import LEGACY_ROWREF_DEFAULTS, LEVEL_COLS
from noteframe.operators import nlp as NL
from noteframe.plans import bindings as b
from noteframe.plans import tokens as TK
from noteframe.plans.registry import register
from noteframe.sources import annotations as AN
from noteframe.sources import notes as SN
from noteframe.sources import register as RG
from noteframe.sources import sinks as SK

_N = b.NOTES_SQL
_W = r"\p{L}\p{M}\p{Nd}_"
_TOK_SQL_RX = f"[{_W}]+|[^{_W}\\s]"
_SENTS_SQL = ("list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), "
              "lambda s: trim(s)), lambda s: s <> '')")


def _sents(t: str) -> str:
    return _SENTS_SQL.format(t=t)


# the path a default export would have, rebuilt from the token metadata
def _paths(spark, d):
    t = b.tokens_raw(spark, d).select(*AN.META_COLS[1:], "annotator").distinct()
    return t.select(F.concat(F.lit("/data/annotated/"), F.concat_ws("--", "institution", "year", "MDN", "NotitieID", "batch"),
                             F.lit(".conll/"), F.upper("annotator"), F.lit(".tsv")).alias("path"))


_PATH_SQL = ("SELECT DISTINCT '/data/annotated/' || concat_ws('--', institution, year, MDN, NotitieID, batch) || '.conll/' || "
             f"upper(annotator) || '.tsv' AS path, annotator, institution, year, MDN, NotitieID, batch FROM ({b.TOKENS_RAW_SQL})")


@register("parse_filename_default", f"SELECT path, annotator, institution, year, MDN, NotitieID, batch FROM ({_PATH_SQL})")
def parse_filename_default_q(spark, d):
    """Metadata back from default export paths."""
    p = _paths(spark, d)
    return p.select("path", AN.parse_filename_default(F.col("path")).alias("m")).select(
        "path", "m.annotator", "m.institution", "m.year", "m.MDN", "m.NotitieID", "m.batch")


@register("parse_filename_legacy8", "SELECT path, lower(lang) AS annotator, lower(source) AS institution, "
          "'2020' AS year, MDN, NotitieID, 'pilot' AS batch FROM (SELECT 'x/' || source || '--' || CAST(doc_id AS VARCHAR) || '--' || "
          "'p' || CAST(doc_id // 8 AS VARCHAR) || '--' || CAST(doc_id AS VARCHAR) || '--0--2020-05-18--q1_q2--Search1.conll/' || lang || '.tsv' AS path, "
          "source, lang, 'p' || CAST(doc_id // 8 AS VARCHAR) AS MDN, CAST(doc_id AS VARCHAR) AS NotitieID FROM documents)")
def parse_filename_legacy8_q(spark, d):
    """Eight-part legacy names built from the documents."""
    doc = b.table(spark, d, "documents")
    path = F.concat(F.lit("x/"), F.col("source"), F.lit("--"), F.col("doc_id").cast("string"), F.lit("--p"),
                    (F.col("doc_id") / 8).cast("bigint").cast("string"), F.lit("--"), F.col("doc_id").cast("string"),
                    F.lit("--0--2020-05-18--q1_q2--Search1.conll/"), F.col("lang"), F.lit(".tsv"))
    p = doc.select(path.alias("path"))
    return p.select("path", AN.parse_filename_legacy8(F.col("path")).alias("m")).select(
        "path", "m.annotator", "m.institution", "m.year", "m.MDN", "m.NotitieID", "m.batch")


@register("parse_filename_legacy_rowref", f"SELECT path, d.doc_id AS NotitieID, '{LEGACY_ROWREF_DEFAULTS['institution']}' AS institution, 'notes_' || source || '.csv' AS legacy_rawfile "
          "FROM (SELECT doc_id, source, 'x/notes_' || source || '.csv---' || CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR) "
          "|| '.conll/ann_a.tsv' AS path FROM documents) d")
def parse_filename_legacy_rowref_q(spark, d):
    """A8: 'rawfile---idx+1' names resolved through the rows of raw files: the
    documents, texts with line breaks and all, are written as one raw file per
    source (in parts, in id order) and scanned in ranges, which number the rows."""
    from noteframe.operators.sampling import global_rank
    from noteframe.sources.quoted_csv import read_quoted_csv
    doc = b.table(spark, d, "documents").select("source", "doc_id", "text")
    out = _scratch(spark, "raw_notes")
    (doc.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
        .select(F.col("doc_id").cast("string"), "text", "source")
        .write.partitionBy("source").option("sep", ";").option("header", False).option("escape", '"').csv(out))
    name = F.concat(F.lit("notes_"), F.regexp_extract(SN.decoded_path(F.col("file")), "source=([^/]+)", 1), F.lit(".csv"))
    raw = read_quoted_csv(spark, out, n_columns=2, name=name).selectExpr("name AS rawfile", "row AS row_no", "_c0 AS notitieID")
    # the names that an annotation tool gave: places within a source are global ranks less the source's first
    ranked = global_rank(doc.select("source", "doc_id"), ["source", "doc_id"], "_rank")
    first = ranked.groupBy("source").agg(F.min("_rank").alias("_first"))
    files = ranked.join(first, "source").select(F.concat(F.lit("x/notes_"), "source", F.lit(".csv---"),
                                                         (F.col("_rank") - F.col("_first") + 1).cast("string"),
                                                         F.lit(".conll/ann_a.tsv")).alias("path"))
    found = AN.parse_filename_legacy_rowref(files, raw)
    return found.select("path", F.col("NotitieID").cast("bigint").alias("NotitieID"), "institution", "legacy_rawfile")


@register("concat_core_external", f"""WITH t AS ({TK.PARSED_SQL}), core AS (SELECT * FROM t WHERE institution IN ('inst0', 'inst1')),
ext AS (SELECT * FROM t WHERE (institution NOT IN ('inst0', 'inst1') OR annotator = 'ann_b') AND NotitieID NOT IN (SELECT NotitieID FROM core))
SELECT NotitieID, annotator, count(*) AS n_tokens FROM (SELECT * FROM core UNION ALL SELECT * FROM ext) GROUP BY ALL""")
def concat_core_external_q(spark, d):
    """Core annotations + external ones for notes the core lacks."""
    t = TK.parsed(spark, d)
    core = t.filter(F.col("institution").isin("inst0", "inst1"))
    # the external team annotated its own notes and, by ann_b, some of the core's
    ext = t.filter(~F.col("institution").isin("inst0", "inst1") | (F.col("annotator") == "ann_b"))
    return AN.concat_core_external(core, ext).groupBy("NotitieID", "annotator").agg(F.count("*").alias("n_tokens"))


@register("update_register", f"""WITH reg AS (SELECT n.institution, '2020' AS year, n.MDN, n.NotitieID, 'week_13' AS batch
  FROM ({_N}) n JOIN labels l ON CAST(n.NotitieID AS BIGINT) = l.doc_id),
new AS (SELECT DISTINCT institution, year, MDN, NotitieID, batch FROM ({b.TOKENS_RAW_SQL}) UNION ALL
        SELECT institution, '2021', MDN, NotitieID, 'week_40' FROM ({_N}))
SELECT * FROM reg UNION ALL SELECT institution, year, MDN, NotitieID, batch FROM (
  SELECT *, row_number() OVER (PARTITION BY NotitieID ORDER BY batch, institution, MDN) AS rn FROM new
  WHERE NotitieID NOT IN (SELECT NotitieID FROM reg)) WHERE rn = 1""")
def update_register_q(spark, d):
    """A10: register (labelled documents) + first row of each new id."""
    n = b.notes(spark, d)
    lab = b.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("NotitieID"))
    reg = n.join(lab, "NotitieID").select("institution", F.lit("2020").alias("year"), "MDN", "NotitieID",
                                          F.lit("week_13").alias("batch"), F.lit(None).cast("string").alias("legacy_rawfile"))
    new = b.tokens_raw(spark, d).select("institution", "year", "MDN", "NotitieID", "batch").distinct().unionByName(
        n.select("institution", F.lit("2021").alias("year"), "MDN", "NotitieID", F.lit("week_40").alias("batch")))
    return RG.update_register(reg, new).select("institution", "year", "MDN", "NotitieID", "batch")


@register("concat_sources_labelled", "SELECT source, count(*) AS n FROM (SELECT CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END AS source "
          "FROM documents UNION ALL SELECT 'pages' FROM pages) GROUP BY 1")
def concat_sources_labelled_q(spark, d):
    """Named frames -> one frame with a source column."""
    doc = b.table(spark, d, "documents")
    named = ["en", "de", "fr", "es"]
    known = F.coalesce(F.col("lang").isin(named), F.lit(False))
    frames = {**{x: doc.filter(F.col("lang") == x).select("doc_id") for x in named}, "other": doc.filter(~known).select("doc_id"),
              "pages": b.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"))}
    return SN.concat_sources_labelled(frames).groupBy("source").agg(F.count("*").alias("n"))


_CONLL_SQL = ("array_to_string(list_transform(" + _sents("trim(all_text)") + ", lambda s: array_to_string(list_transform("
              f"regexp_extract_all(s, '{_TOK_SQL_RX}'), lambda t: t || ' O'), chr(10))), chr(10) || chr(10))")


CONLL_SQL = f"""SELECT annotator, concat_ws('--', institution, substr(Notitiedatum, 1, 4), MDN, NotitieID, 'week_14') || '.conll' AS file_name,
  md5({_CONLL_SQL}) AS conll_md5 FROM ({_N}) n JOIN (SELECT DISTINCT NotitieID, annotator FROM ({TK.info_sql(b.TOKENS_RAW_SQL)})) a USING (NotitieID)"""


@register("export_conll", CONLL_SQL)
def export_conll_q(spark, d):
    """A13 layout: CoNLL body per (annotator, note file), hashed."""
    batch = b.notes(spark, d).join(b.tokens_raw(spark, d).select("NotitieID", "annotator").distinct(), "NotitieID")
    lay = SK.conll_layout(batch, "week_14")
    return lay.select("annotator", "file_name", F.md5("conll").alias("conll_md5"))


def _follow_up_sql():
    from noteframe.plans.q_timeline import _FU_SQL
    v = b.VISITS_SQL
    return (f"SELECT * FROM ({v}) WHERE MDN IN (SELECT MDN FROM ({v}) WHERE MDN IN (SELECT MDN FROM ({_FU_SQL}) "
            "WHERE first_follow_up AND second_follow_up) GROUP BY MDN HAVING count(*) <= 100)")


@register("export_per_patient", "SELECT MDN, NotitieID, Typenotitie, Notitiedatum, "
          + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in LEVEL_COLS) + f" FROM ({_follow_up_sql()})")
def export_per_patient_q(spark, d):
    """A14 layout (+E5): visits of the patients selected for follow-up
    annotation, first columns plus empty level columns."""
    from noteframe.operators.timeline import select_follow_up_patients
    v = select_follow_up_patients(b.visits(spark, d))
    return SK.per_patient_layout(v, 4, LEVEL_COLS)


@register("export_chunks", f"""SELECT chunk, count(*) AS n_rows, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (
  SELECT doc_id, (row_number() OVER (ORDER BY doc_id, sen_no) - 1) // 5000 AS chunk FROM (
    SELECT doc_id, unnest(range(len({_sents('text')}))) AS sen_no FROM documents)) GROUP BY chunk""")
def export_chunks_q(spark, d):
    """A15 (+G7): sentences numbered globally and cut into 5000-row chunks."""
    s = NL.split_sentences(b.table(spark, d, "documents"), "doc_id", "text")
    c = SK.chunk_layout(s, ["doc_id", "sen_no"], 5000)
    return c.groupBy("chunk").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_doc"),
                                  F.max("doc_id").alias("last_doc"))


@register("export_flat", f"SELECT MDN, NotitieID, Typenotitie, Notitiedatum, institution FROM ({_N})")
def export_flat_q(spark, d):
    """A16 layout: the notes without the text column."""
    return b.notes(spark, d).drop("all_text")


@register("split_sentences", f"SELECT doc_id, unnest(range(len(s))) AS sen_no, unnest(s) AS sentence FROM (SELECT doc_id, {_sents('text')} AS s FROM documents)")
def split_sentences_q(spark, d):
    """Note -> sentences (rule-based)."""
    return NL.split_sentences(b.table(spark, d, "documents"), "doc_id", "text")


@register("tokenize", f"""SELECT doc_id, sen_no, len(t) AS n_tokens, t[1] AS first_token, md5(array_to_string(t, chr(9))) AS tokens_md5 FROM (
  SELECT doc_id, sen_no, regexp_extract_all(sentence, '{_TOK_SQL_RX}') AS t FROM (
    SELECT doc_id, unnest(range(len(s))) AS sen_no, unnest(s) AS sentence FROM (SELECT doc_id, {_sents('text')} AS s FROM documents)))""")
def tokenize_q(spark, d):
    """Tokens per sentence: count, first one, and a hash of all in order."""
    # dealt by document before the split: the sentences' tokens are gathered where they are made
    doc = b.table(spark, d, "documents").select("doc_id", "text")
    t = NL.tokenize(doc.repartition(b.parts_by_size(b.table(spark, d, "documents"), 4 << 20), "doc_id"), "doc_id", "text")
    inside = F.transform(F.array_sort(F.collect_list(F.struct("tok", "token"))), lambda x: x["token"])  # one sentence
    return t.groupBy("doc_id", "sen_no").agg(F.count("*").alias("n_tokens"), F.min_by("token", "tok").alias("first_token"),
                                             F.md5(F.array_join(inside, "\t")).alias("tokens_md5"))


_RULES = {"PERSON": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ID": r"[0-9]{12,19}"}


@register("anonymize_text", f"""SELECT doc_id, md5(t) AS text_md5, len(regexp_extract_all(t, '{_TOK_SQL_RX}')) AS len_text FROM (
  SELECT doc_id, regexp_replace(regexp_replace(text, '{_RULES['PERSON']}', 'PERSON', 'g'), '{_RULES['ID']}', 'ID', 'g') AS t FROM documents)""")
def anonymize_text_q(spark, d):
    """Detected e-mail addresses and long id numbers replaced by their
    entity type; token count of the result."""
    doc = b.table(spark, d, "documents").select("doc_id", "text")
    a = NL.anonymize_by_rules(doc, _RULES, "text")
    return a.select("doc_id", F.md5("text").alias("text_md5"), "len_text")


# ---- scans of files that Spark writes from the given tables first -------
def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    import uuid
    from noteframe.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("scan_notes_csv", "SELECT NotitieID, institution, MDN, concat_ws(' ', " + ", ".join(
    f"trim(regexp_replace(p{i}, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g'))" for i in (1, 2, 3))
    + ") AS all_text FROM (SELECT CAST(doc_id AS VARCHAR) AS NotitieID, source AS institution, "
    "'p' || CAST(doc_id // 8 AS VARCHAR) AS MDN, l[1] AS p1, l[2] AS p2, CASE WHEN len(l) > 2 THEN array_to_string(l[3:], chr(10)) END AS p3 "
    "FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents))")
def scan_notes_csv_q(spark, d):
    """A1 + A2 + A4 (+B1, B2): the whole notes written as headerless ';'
    files (one folder per source, text in three part columns), scanned back
    with positional projection and the source taken from the file path."""
    from noteframe.plans.q_clean import text_parts
    doc = b.table(spark, d, "documents")
    out = _scratch(spark, "notes_csv")
    (doc.select(F.concat(F.lit("p"), (F.col("doc_id") / 8).cast("bigint").cast("string")).alias("mdn"),
                F.col("doc_id").cast("string").alias("id"), F.col("lang"), F.lit("2020-01-01").alias("dt"),
                F.lit("x").alias("unused"), *text_parts("text"), "source")
        .write.partitionBy("source").option("sep", ";").option("header", False).option("escape", '"').csv(out))
    n = SN.scan_notes_csv(spark, out, "any", sep=";", positions=[0, 1, 2, 3, 5, 6, 7], source_pattern=r"source=([^/]+)")
    return n.select("NotitieID", "institution", "MDN", "all_text")


@register("scan_diagnoses", "SELECT ICD10_diagnose, count(DISTINCT MDN) AS n_patients, count(*) AS n_contacts FROM ("
          "SELECT 'p' || CAST(doc_id // 8 AS VARCHAR) AS MDN, CASE WHEN toxic = 1 THEN 'T78' ELSE 'Z00' END AS ICD10_diagnose FROM labels) GROUP BY 1")
def scan_diagnoses_q(spark, d):
    """A3: a headerless ';' diagnosis file derived from the labels, scanned
    with the fixed eight string columns."""
    lab = b.table(spark, d, "labels")
    out = _scratch(spark, "diagnoses_csv")
    lab.select(F.concat(F.lit("p"), (F.col("doc_id") / 8).cast("bigint").cast("string")).alias("MDN"),
               F.col("doc_id").cast("string").alias("CSN"), F.lit("poli"), F.lit("1"), F.lit("LON"), F.lit("ep"),
               F.lit("d"), F.when(F.col("toxic") == 1, "T78").otherwise("Z00")).write.option("sep", ";").csv(out)
    dg = SN.scan_diagnoses(spark, out)
    return dg.groupBy("ICD10_diagnose").agg(F.countDistinct("MDN").alias("n_patients"), F.count("*").alias("n_contacts"))


@register("persist_stage", f"SELECT institution, count(*) AS n_notes, count(DISTINCT MDN) AS n_patients FROM ({_N}) GROUP BY 1")
def persist_stage_q(spark, d):
    """A stage written as parquet to shared storage and read back."""
    n = SK.persist_stage(b.notes(spark, d).drop("all_text"), _scratch(spark, "stage"))
    return n.groupBy("institution").agg(F.count("*").alias("n_notes"), F.countDistinct("MDN").alias("n_patients"))


@register("load_tagset", "SELECT category, count(*) AS n_tags FROM (SELECT DISTINCT tag, CASE WHEN regexp_matches(tag, '^\\.') THEN 'domains' "
          "WHEN regexp_matches(tag, '^[a-z]{3}\\d') THEN 'levels' WHEN starts_with(tag, 'other_disregard_file') THEN 'disregard' "
          "WHEN starts_with(tag, 'other_target') THEN 'target' WHEN starts_with(tag, 'other_background') THEN 'background' "
          "WHEN starts_with(tag, 'mbw_plus') THEN 'plus' END AS category FROM (SELECT unnest(string_split(label, '|')) AS tag "
          f"FROM ({b.TOKENS_RAW_SQL}) WHERE label <> '_')) GROUP BY 1")
def load_tagset_q(spark, d):
    """A11 (+P1): the tags used in the annotations written as a tag-set JSON
    document (one bounded row: a tag set holds tens of tags), loaded back
    and categorised."""
    from noteframe.operators import labels as P
    tags = (b.tokens_raw(spark, d).filter(F.col("label") != "_")
            .select(F.explode(F.split("label", r"\|")).alias("tag_name")).distinct())
    doc = tags.agg(F.array_sort(F.collect_list(F.struct(F.col("tag_name"), F.lit("").alias("tag_description")))).alias("tags")) \
              .select(F.lit("derived").alias("name"), "tags")
    out = _scratch(spark, "tagset_json")
    doc.coalesce(1).write.json(out)
    cat = P.categorize_tags_df(P.load_tagset(spark, out))
    return cat.groupBy("category").agg(F.count("*").alias("n_tags"))
