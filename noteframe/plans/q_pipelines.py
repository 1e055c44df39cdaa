"""Composed queries: batch preparation, domain and level datasets, the
patient timeline, and files written and scanned back."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS, LEVEL_COLS
from noteframe.functions.hashing import md5_bucket, sql_md5_bucket as H
from noteframe.functions.text import normalize_whitespace, pad_number
from noteframe.operators import assemble as A
from noteframe.operators import clean as C
from noteframe.operators import cohort as CO
from noteframe.operators import keywords as KW
from noteframe.operators import nlp as NL
from noteframe.operators import report as R
from noteframe.operators import sampling as S
from noteframe.operators import sets as U
from noteframe.plans import bindings as b
from noteframe.plans import tokens as TK
from noteframe.plans import q_sampling as QS
from noteframe.plans.q_sampling import BATCH, SEED, select_sql
from noteframe.plans.q_sources import _RULES, _TOK_SQL_RX, _scratch, CONLL_SQL
from noteframe.plans.registry import register
from noteframe.session import write_shared
from noteframe.sources import annotations as AN
from noteframe.sources import sinks as SK
from noteframe.sources.small_files import folder_value, read_lines

# ---- a batch from the raw notes: exclusions, cap per source, search, draw --
# fixed value: the cap of a source
CAP = 50_000
_REG = "SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1"
_OUT = f"SELECT NotitieID FROM ({b.NOTES_SQL}) WHERE {H('NotitieID', chr(39) + 'out' + chr(39))} % 20 = 0"
_POOL_SQL = f"""SELECT * FROM ({b.NOTES_SQL}) WHERE NotitieID NOT IN ({_REG}) AND NotitieID NOT IN ({_OUT})
  QUALIFY row_number() OVER (PARTITION BY institution ORDER BY {H('45', 'NotitieID')}, NotitieID) <= {CAP}"""


def _prepared(spark, d, cap=CAP):
    n = b.notes(spark, d)
    register_ids = b.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("NotitieID"))
    out = n.filter(md5_bucket("NotitieID", F.lit("out")) % 20 == 0).select("NotitieID")
    pool = S.cap_sample(CO.exclude_annotated(n, register_ids, out), "NotitieID", cap, 45, source="institution")
    pool = pool.select("institution", "MDN", "NotitieID", normalize_whitespace("all_text").alias("all_text"))
    found = KW.find_keywords(TK.with_info(pool).drop("samp_meth"), KW.domain_regex(b.KEYWORDS))
    return S.select_notes(found, seed=SEED, allow_short=True, **BATCH)


_PREP = select_sql(_POOL_SQL)


@register("batch_preparation", _PREP + " SELECT * FROM batch")
def batch_preparation_q(spark, d):
    """Notes neither annotated nor out for annotation, capped per source, searched, drawn."""
    return _prepared(spark, d).select("NotitieID", "source", "annotator", "samp_meth")


@register("batch_preparation_overview", _PREP + """ SELECT coalesce(annotator, 'total') AS annotator, coalesce(sm, 'total') AS source_samp_meth,
  count(*) AS n FROM (SELECT annotator, source || '/' || samp_meth AS sm FROM batch) GROUP BY CUBE (annotator, sm)""")
def batch_preparation_overview_q(spark, d):
    """D10 over the prepared batch."""
    return R.batch_overview(_prepared(spark, d))


# ---- the domain dataset: sentences, anonymised text, split, background, pilot mix --
_SPLIT_SQL = TK.split_sql(TK.SENT_SQL)
_ANON = f"regexp_replace(regexp_replace(text_raw, '{_RULES['PERSON']}', 'PERSON', 'g'), '{_RULES['ID']}', 'ID', 'g')"
_GIVEN_SQL = f"CASE WHEN {H('NotitieID', chr(39) + 'given' + chr(39))} % 10 = 0 THEN 'dev' WHEN {H('NotitieID', chr(39) + 'given' + chr(39))} % 10 = 1 THEN 'test' ELSE 'train' END"


# positive sentences of the pilot, with the text of their tokens: four domains, the others 0
_PILOT_TEXT_SQL = f"""SELECT 'pilot_' || p.id AS pad_sen_id, labels, t.text_raw FROM (
  SELECT replace(pad_sen_id, 'pilot_', '') AS id, labels FROM ({QS._PILOT_SQL}) WHERE list_max(labels) > 0) p JOIN (
  SELECT NotitieID || '_' || CASE WHEN length(sen) >= 4 THEN sen ELSE lpad(sen, 4, '0') END AS id, string_agg(token, ' ' ORDER BY tok) AS text_raw
  FROM (SELECT DISTINCT NotitieID, split_part(sen_tok, '-', 1) AS sen, CAST(split_part(sen_tok, '-', 2) AS INTEGER) AS tok, token
        FROM ({b.TOKENS_RAW_SQL})) GROUP BY 1) t USING (id)"""


def _pilot_sql(split: str) -> str:
    return f"""SELECT '{split}' AS mode, pad_sen_id, 'train' AS split, md5(t) AS text_md5, len(regexp_extract_all(t, '{_TOK_SQL_RX}')) AS len_text,
  array_to_string(labels, ',') AS labels FROM (SELECT *, {_ANON} AS t FROM ({_PILOT_TEXT_SQL}))"""


def pilot_with_text(spark, d):
    """(pad_sen_id, labels, text, len_text): positive pilot sentences, their tokens joined and anonymised."""
    place = F.split("sen_tok", "-")
    t = b.tokens_by_note(spark, d).select("NotitieID", F.get(place, 0).alias("sen"), F.get(place, 1).cast("int").alias("tok"), "token").distinct()
    text = (t.groupBy("NotitieID", F.concat(F.lit("pilot_"), "NotitieID", F.lit("_"), pad_number("sen")).alias("pad_sen_id"))
            .agg(F.array_sort(F.collect_list(F.struct("tok", "token"))).alias("w"))  # one sentence's tokens
            .select("pad_sen_id", F.array_join(F.transform("w", lambda x: x["token"]), " ").alias("text_raw")))
    return NL.anonymize_by_rules(QS._pilot_sentences(spark, d).join(text, "pad_sen_id"), _RULES, "text_raw", out="text")


def _domain_sql(split: str) -> str:
    base = _SPLIT_SQL if split == "drawn" else f"SELECT *, {_GIVEN_SQL} AS split FROM ({TK.SENT_SQL})"
    return f"""SELECT '{split}' AS mode, pad_sen_id, split, md5(t) AS text_md5, len(regexp_extract_all(t, '{_TOK_SQL_RX}')) AS len_text,
  array_to_string(labels, ',') AS labels FROM (SELECT *, {_ANON} AS t FROM ({base}))
  WHERE NOT (split = 'train' AND (coalesce(background_sent, false) OR coalesce(target_sent, false)) AND list_max(labels) = 0)"""


@register("domain_dataset", " UNION ALL ".join(f(mode) for mode in ("drawn", "given") for f in (_domain_sql, _pilot_sql)))
def domain_dataset_q(spark, d):
    """D2, G6, S8 or C5, B11, S11: sentences with anonymised text and length; split 80/10/10 by note,
    or by given dev and test ids; background sentences without labels leave the training part, positive
    sentences of the pilot join it."""
    # written: the two modes and their parts come of it
    s = write_shared(NL.anonymize_by_rules(TK.sentences(spark, d), _RULES, "text_raw", out="text").drop("text_raw"), "sentences")
    bucket = md5_bucket("NotitieID", F.lit("given")) % 10
    given = (s.select("NotitieID").distinct().filter(bucket < 2)
             .withColumn("split", F.when(bucket == 0, "dev").otherwise("test")))
    drawn = S.group_split_3way(s, "NotitieID", 0.8, TK.SPLIT_SEED).withColumn("mode", F.lit("drawn"))
    both = drawn.unionByName(CO.split_by_reference(s, given).withColumn("mode", F.lit("given")))
    train = C.exclude_background_negatives(both.filter("split = 'train'"))
    pilot = (pilot_with_text(spark, d).withColumns({"split": F.lit("train"), "mode": F.explode(F.array(F.lit("drawn"), F.lit("given")))}))
    mixed = S.seeded_annotation_mix(train, pilot.select("mode", "pad_sen_id", "split", "text", "len_text", "labels"))
    rows = mixed.unionByName(both.filter("split <> 'train'"), allowMissingColumns=True)
    return rows.select("mode", "pad_sen_id", "split", F.md5("text").alias("text_md5"), "len_text",
                       F.array_join("labels", ",").alias("labels"))


# ---- the level datasets: nine domains, sentences and notes, gold or predicted domain --
_SEN_LVL = f"SELECT NotitieID, pad_sen_id, {', '.join(f'avg({c}) AS {c}' for c in LEVEL_COLS)} FROM ({TK.CLEAN_SQL}) GROUP BY ALL"
_NOTE_LVL = f"SELECT NotitieID, NotitieID AS pad_sen_id, {', '.join(f'avg({c}) AS {c}' for c in LEVEL_COLS)} FROM ({TK.CLEAN_SQL}) GROUP BY ALL"


def _long_levels(sql: str, unit: str) -> str:
    return " UNION ALL ".join(f"SELECT '{unit}' AS unit, '{dm}' AS domain, NotitieID, pad_sen_id AS key, {dm}_lvl AS level FROM ({sql})"
                              for dm in DOMAINS)


_LEVELS_SQL = f"""WITH l AS ({_long_levels(_SEN_LVL, 'sent')} UNION ALL {_long_levels(_NOTE_LVL, 'note')}),
p AS (SELECT DISTINCT 'sent' AS unit, domains AS domain, pad_sen_id AS key FROM ({TK.LONG_SQL}) WHERE preds = 1
      UNION SELECT DISTINCT 'note', domains, NotitieID FROM ({TK.LONG_SQL}) WHERE preds = 1),
s AS (SELECT DISTINCT NotitieID, split FROM ({_SPLIT_SQL}))
SELECT unit, domain, split, count(level) AS n_gold, count(CASE WHEN p.key IS NOT NULL THEN 1 END) AS n_predicted,
  count(CASE WHEN p.key IS NOT NULL THEN level END) AS n_both, avg(level) AS mean_gold
FROM l LEFT JOIN p USING (unit, domain, key) JOIN s USING (NotitieID) GROUP BY ALL"""


def level_rows(spark, d):
    """(unit, domain, NotitieID, key, level): sentence and note levels of all nine domains."""
    arr = F.array(*[F.struct(F.lit(dm).alias("domain"), F.col(f"{dm}_lvl").cast("double").alias("level")) for dm in DOMAINS])
    sent = A.sentence_mean_levels(TK.clean(spark, d)).select(F.lit("sent").alias("unit"), "NotitieID", F.col("pad_sen_id").alias("key"), F.inline(arr))
    note = A.note_mean_levels(TK.clean(spark, d)).select(F.lit("note").alias("unit"), "NotitieID", F.col("NotitieID").alias("key"), F.inline(arr))
    return sent.unionByName(note)


@register("level_datasets", _LEVELS_SQL)
def level_datasets_q(spark, d):
    """Per unit, domain and split the rows with a gold level, with a predicted
    domain, with both, and the mean gold level."""
    # written, without the text: split and predictions come of it
    every = write_shared(TK.long_preds(spark, d).select("NotitieID", "pad_sen_id", "domains", "preds"), "long-preds")
    lp = every.filter("preds = 1")
    on = ["unit", "domain", "key"]
    pred = (lp.select(F.lit("sent").alias("unit"), F.col("domains").alias("domain"), F.col("pad_sen_id").alias("key"))
            .unionByName(lp.select(F.lit("note").alias("unit"), F.col("domains").alias("domain"), F.col("NotitieID").alias("key")))
            .distinct().withColumn("hit", F.lit(True)))
    split = S.group_split_3way(every.select("NotitieID").distinct(), "NotitieID", 0.8, TK.SPLIT_SEED)
    rows = level_rows(spark, d).join(pred, on, "left").join(split, "NotitieID")
    return rows.groupBy("unit", "domain", "split").agg(
        F.count("level").alias("n_gold"), F.count("hit").alias("n_predicted"),
        F.count(F.when(F.col("hit"), F.col("level"))).alias("n_both"), F.avg("level").alias("mean_gold"))


# ---- the timeline: two extracts, gold, routed predictions, note means --
_ARR = "[" + ", ".join(f"'{dm}'" for dm in DOMAINS) + "]"
_TIMELINE_SQL = f"""WITH notes AS (SELECT DISTINCT institution, MDN, NotitieID FROM ({TK.PARSED_SQL})),
gold AS (SELECT NotitieID, {', '.join(f'avg({c}) AS {c}' for c in LEVEL_COLS)} FROM ({TK.CLEAN_SQL})
  WHERE {H('NotitieID', chr(39) + 'gold' + chr(39))} % 2 = 0 GROUP BY NotitieID),
routed AS (SELECT NotitieID, domains, avg(CAST({H('pad_sen_id', 'domains')} % 5 AS DOUBLE)) AS v FROM ({TK.LONG_SQL}) WHERE preds = 1 GROUP BY ALL),
wide AS (SELECT NotitieID, {', '.join(f"max(v) FILTER (WHERE domains = '{dm}') AS {dm}_lvl" for dm in DOMAINS)} FROM routed GROUP BY NotitieID)
SELECT n.institution, n.MDN, n.NotitieID, g.NotitieID IS NOT NULL AS annotated,
  {', '.join(f'CASE WHEN g.NotitieID IS NOT NULL THEN g.{c} ELSE w.{c} END AS {c}' for c in LEVEL_COLS)}
FROM notes n LEFT JOIN gold g USING (NotitieID) LEFT JOIN wide w USING (NotitieID)"""


@register("timeline_building", _TIMELINE_SQL)
def timeline_building_q(spark, d):
    """Two overlapping extracts deduplicated, notes flagged as annotated,
    gold levels joined, sentences routed to their predicted domains, nine level predictions averaged per
    note, gold kept for annotated notes."""
    keys = ["institution", "MDN", "NotitieID"]
    ids = TK.parsed(spark, d).select(*keys)
    notes = C.drop_exact_duplicates(U.union_all([ids, ids.distinct()]))
    gold = (A.note_mean_levels(TK.clean(spark, d)).filter(md5_bucket("NotitieID", F.lit("gold")) % 2 == 0)
            .select(*keys, *LEVEL_COLS))
    notes = CO.join_gold_levels(CO.flag_membership(notes, gold, keys, "annotated"), gold, keys)
    routed = TK.long_preds(spark, d).filter("preds = 1").withColumn("pred", (md5_bucket("pad_sen_id", "domains") % 5).cast("double"))
    sent = CO.assemble_routed_levels(TK.sentences(spark, d).select("NotitieID", "pad_sen_id"), routed, DOMAINS, key="pad_sen_id")
    per_note = A.mean_preds_per_note(sent, "NotitieID", LEVEL_COLS)
    return CO.backfill_predictions(notes, per_note, LEVEL_COLS).select(*keys, "annotated", *LEVEL_COLS)


# ---- files written and scanned back --
def _note_path():
    return F.concat_ws("--", "institution", "year", "MDN", "NotitieID", "batch")


@register("scan_annotation_tsv", f"""SELECT annotator, 'hosp ' || institution AS institution, year, MDN, NotitieID, batch, sen_tok, "char", token,
  label, relation FROM ({b.TOKENS_RAW_SQL})""")
def scan_annotation_tsv_q(spark, d):
    """A5 (+A6, B10): all tokens written as one TSV per note and annotator in the export's folder layout
    (with comment and blank lines, and a blank in the folder's name), scanned back with the path's metadata."""
    t = b.tokens_raw(spark, d).withColumn("institution", F.concat(F.lit("hosp "), "institution"))
    order = F.split("sen_tok", "-")
    line = F.concat_ws("\t", "sen_tok", "char", "token", "label", "relation")
    body = (t.withColumns({"folder": F.concat(_note_path(), F.lit(".conll")), "_s": F.get(order, 0).cast("int"), "_t": F.get(order, 1).cast("int"),
                           "line": line})
            .groupBy("folder", "annotator").agg(F.array_sort(F.collect_list(F.struct("_s", "_t", "line"))).alias("l")))  # one note's lines
    text = F.concat(F.lit("#FORMAT=WebAnno TSV 3.3\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    out = _scratch(spark, "annotation_tsv")
    SK.text_folders(body.select("folder", "annotator", text.alias("value")), out, ["folder", "annotator"])

    def parser(path):  # folder=<note>.conll/annotator=<name>/part
        return AN.parse_filename_default(F.regexp_replace(path, r"folder=([^/]+)/annotator=([^/]+)/[^/]+$", "$1/$2.tsv"))
    got = AN.scan_annotation_tsv(spark, out, parser, glob="*.txt")
    return got.select("annotator", "institution", "year", "MDN", "NotitieID", "batch", "sen_tok", "char", "token", "label", "relation")


@register("export_conll_files", CONLL_SQL)
def export_conll_files_q(spark, d):
    """The CoNLL files written, then read back whole and hashed per file."""
    batch = b.notes(spark, d).join(b.tokens_raw(spark, d).select("NotitieID", "annotator").distinct(), "NotitieID")
    out = _scratch(spark, "conll")
    SK.export_conll(batch, out, "week_14")
    files = spark.read.text(out, wholetext=True, recursiveFileLookup=True).select(
        AN.decoded_path(F.col("_metadata.file_path")).alias("p"), F.regexp_replace("value", "\n$", "").alias("conll"))
    return files.select(F.regexp_extract("p", "annotator=([^/]+)/", 1).alias("annotator"),
                        F.regexp_extract("p", "file_name=([^/]+)/", 1).alias("file_name"), F.md5("conll").alias("conll_md5"))


@register("export_flat_files", f"SELECT MDN, NotitieID, Typenotitie, Notitiedatum, institution FROM ({b.NOTES_SQL})")
def export_flat_files_q(spark, d):
    """The flat table written with a header and read back."""
    out = _scratch(spark, "flat")
    SK.export_flat(b.notes(spark, d), out, drop=["all_text"])
    return spark.read.option("header", True).option("sep", "\t").csv(out)


@register("export_patient_files", f"""SELECT MDN, NotitieID, Typenotitie, strftime(Notitiedatum, '%Y-%m-%d') AS Notitiedatum,
  CAST(row_number() OVER (PARTITION BY MDN ORDER BY Notitiedatum, NotitieID) AS INTEGER) AS line FROM ({b.VISITS_SQL})""")
def export_patient_files_q(spark, d):
    """Every patient's visits written in order, read back with their line number in the patient's file."""
    out = _scratch(spark, "patients")
    v = b.visits(spark, d).withColumn("Notitiedatum", F.col("Notitiedatum").cast("string"))
    SK.export_per_patient(v, out, 4, LEVEL_COLS, date=["Notitiedatum", "NotitieID"])
    schema = "NotitieID string, Typenotitie string, Notitiedatum string, " + ", ".join(f"{c} double" for c in LEVEL_COLS)
    per = read_lines(spark, out, "*.csv").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("r"))  # one patient
    # the first line is the header; behind a generator, so that a line is parsed once
    lines = per.select("path", F.posexplode(F.slice("r", F.lit(2), F.size("r"))).alias("pos", "x"))
    rows = lines.select(folder_value(F.col("path"), "MDN").alias("MDN"), "pos", F.explode(F.array(F.from_csv("x.value", schema))).alias("x"))
    return rows.select("MDN", "x.NotitieID", "x.Typenotitie", "x.Notitiedatum", (F.col("pos") + 1).alias("line"))


@register("export_chunk_files", "SELECT chunk, count(*) AS n_rows, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM ("
          "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS chunk FROM documents) GROUP BY chunk")
def export_chunk_files_q(spark, d):
    """Documents written in chunks of 300 rows, the chunks read back."""
    out = _scratch(spark, "chunks")
    SK.export_chunks(b.table(spark, d, "documents").select("doc_id"), out, ["doc_id"], 300)
    return (spark.read.parquet(out).groupBy(F.col("chunk").cast("bigint").alias("chunk"))
            .agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")))


# ---- sorted reports: the position of each row is part of the result --
@register("sort_dates", f"SELECT MDN, NotitieID, row_number() OVER (ORDER BY MDN, Notitiedatum, NotitieID) - 1 AS position FROM ({b.VISITS_SQL})")
def sort_dates_q(spark, d):
    """L1: visits sorted by patient and date, with the position that the sort gave them."""
    s = U.sort_dates(b.visits(spark, d), ["MDN", "Notitiedatum", "NotitieID"]).withColumn("_at", F.monotonically_increasing_id())
    return S.global_rank(s, ["_at"], "position").select("MDN", "NotitieID", "position")


@register("sort_index_report", f"SELECT Typenotitie, n, row_number() OVER (ORDER BY Typenotitie) - 1 AS position FROM (SELECT Typenotitie, count(*) AS n FROM ({b.NOTES_SQL}) GROUP BY 1)")
def sort_index_report_q(spark, d):
    """L2: a small report in key order, with positions."""
    r = U.sort_index_report(R.value_counts(b.notes(spark, d), "Typenotitie"), ["Typenotitie"])
    return S.global_rank(r.withColumn("_at", F.monotonically_increasing_id()), ["_at"], "position").select("Typenotitie", "n", "position")
