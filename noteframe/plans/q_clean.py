"""Queries for note-level cleaning (B1-B5, B9, B10, B18-B22) and sets/sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS
from noteframe.functions.text import cap_group_values, round_discretize, year_from_date
from noteframe.operators import clean as C
from noteframe.operators import sets as U
from noteframe.plans import bindings as b
from noteframe.plans.registry import register

_WS_SQL = r"[\s\p{Z}\x{85}]+"


@register("drop_exact_duplicates", "SELECT DISTINCT source, lang, n_chars, md5(text) AS text_md5 FROM documents")
def drop_exact_duplicates_q(spark, d):
    """B1: identical rows over all columns (ids excluded) dropped."""
    doc = b.table(spark, d, "documents").drop("doc_id")
    return C.drop_exact_duplicates(doc).select("source", "lang", "n_chars", F.md5("text").alias("text_md5"))


def _parts_sql():
    """Whole text as three parts: line 1, line 2 and all remaining lines."""
    return ("l[1] AS p1, l[2] AS p2, CASE WHEN len(l) > 2 THEN array_to_string(l[3:], chr(10)) END AS p3")


def text_parts(text: str = "text"):
    """Spark twin of ``_parts_sql``: the whole note split into three parts."""
    lines = F.split(text, "\n")
    return [F.get(lines, 0).alias("p1"), F.get(lines, 1).alias("p2"),
            F.when(F.size(lines) > 2, F.array_join(F.slice(lines, 3, F.size(lines)), "\n")).alias("p3")]


@register("combine_text_columns", "SELECT doc_id, concat_ws(' ', "
          + ", ".join(f"trim(regexp_replace(p{i}, '{_WS_SQL}', ' ', 'g'))" for i in (1, 2, 3))
          + f") AS all_text FROM (SELECT doc_id, {_parts_sql()} FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def combine_text_columns_q(spark, d):
    """B2 + B3: a note stored as three text parts (first line, second line,
    the rest), merged with one space after whitespace normalisation."""
    doc = b.table(spark, d, "documents")
    parts = doc.select("doc_id", *text_parts("text"))
    return C.combine_text_columns(parts, ["p1", "p2", "p3"]).select("doc_id", "all_text")


@register("cast_ids", f"SELECT MDN, NotitieID, Notitiedatum, institution FROM ({b.NOTES_SQL})")
def cast_ids_q(spark, d):
    """B4 (+ the notes binding): ids as strings, dates as text."""
    n = b.notes(spark, d)
    return C.cast_ids(n, ["MDN", "NotitieID"]).select("MDN", "NotitieID", "Notitiedatum", "institution")


@register("dedup_on_keys", "SELECT institution, NotitieID FROM (SELECT *, row_number() OVER (PARTITION BY institution, all_text "
          f"ORDER BY CAST(NotitieID AS BIGINT)) AS rn FROM ({b.NOTES_SQL})) WHERE rn = 1")
def dedup_on_keys_q(spark, d):
    """First note per (institution, text) in id order (exact copies)."""
    n = b.notes(spark, d).withColumn("_id", F.col("NotitieID").cast("bigint"))
    return C.dedup_on_keys(n, ["institution", "all_text"], ["_id"], hashed=["all_text"]).select("institution", "NotitieID")


@register("filter_note_type", "SELECT institution, count(*) FILTER (WHERE Typenotitie IN ('en', 'de')) AS n_kept, "
          "count(*) FILTER (WHERE Typenotitie IS NULL OR Typenotitie NOT IN ('en', 'de')) AS n_negated "
          f"FROM ({b.NOTES_SQL}) GROUP BY institution")
def filter_note_type_q(spark, d):
    """Type in list, and the negated form (NULL type kept there)."""
    n = b.notes(spark, d)
    k = C.filter_note_type(n, ["en", "de"]).groupBy("institution").agg(F.count("*").alias("n_kept"))
    x = C.filter_note_type(n, ["en", "de"], negate=True).groupBy("institution").agg(F.count("*").alias("n_negated"))
    return n.select("institution").distinct().join(k, "institution", "left").join(x, "institution", "left") \
        .fillna(0, ["n_kept", "n_negated"])


@register("drop_comment_blank_lines", "SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value "
          "FROM documents) WHERE value IS NOT NULL AND trim(value) <> '' AND NOT starts_with(value, '#') GROUP BY doc_id")
def drop_comment_blank_lines_q(spark, d):
    """Note lines without blanks and '#' comments, counted per note."""
    lines = b.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return C.drop_comment_blank_lines(lines).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@register("split_date_parts", "SELECT NotitieID, split_part(Notitiedatum, '-', 1) AS year, split_part(Notitiedatum, '-', 2) AS month, "
          f"split_part(Notitiedatum, '-', 3) AS day, substr(Notitiedatum, 1, 4) AS year4 FROM ({b.NOTES_SQL})")
def split_date_parts_q(spark, d):
    """B18 + B19: date string -> year, month, day; year by prefix."""
    n = C.split_date_parts(b.notes(spark, d))
    return n.select("NotitieID", "year", "month", "day", year_from_date("Notitiedatum").alias("year4"))


@register("cap_group_values", "SELECT user_id, least(count(*), 60) AS n_capped FROM events GROUP BY user_id")
def cap_group_values_q(spark, d):
    """Per-patient counts clamped (cap 60 for this table's scale)."""
    e = b.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", cap_group_values("n", 60).alias("n_capped"))


@register("round_discretize", "SELECT MDN, CAST(round_even(avg(ADM_lvl), 0) AS INTEGER) AS adm_class, "
          f"CAST(round_even(avg(FAC_lvl), 0) AS INTEGER) AS fac_class FROM ({b.TIMELINE_SQL}) GROUP BY MDN")
def round_discretize_q(spark, d):
    """Mean level rounded half-to-even to an integer class."""
    t = b.timeline(spark, d).groupBy("MDN").agg(F.avg("ADM_lvl").alias("a"), F.avg("FAC_lvl").alias("f"))
    return t.select("MDN", round_discretize("a").alias("adm_class"), round_discretize("f").alias("fac_class"))


@register("drop_incomplete_rows", f"SELECT MDN, count(*) AS n_complete FROM ({b.TIMELINE_SQL}) WHERE "
          + " AND ".join(f"{dm}_lvl IS NOT NULL" for dm in DOMAINS) + " GROUP BY MDN")
def drop_incomplete_rows_q(spark, d):
    """Rows with any NULL dropped; complete rows per patient."""
    t = C.drop_incomplete_rows(b.timeline(spark, d))
    return t.groupBy("MDN").agg(F.count("*").alias("n_complete"))


# ----------------------------------------------------------- sets, sorts --
@register("union_all", "SELECT source, lang, count(*) AS n FROM (SELECT source, lang FROM documents WHERE lang = 'en' "
          "UNION ALL SELECT source, lang FROM documents WHERE lang IS DISTINCT FROM 'en' UNION ALL SELECT source, NULL AS lang FROM pages, "
          "(SELECT 'web' AS source)) GROUP BY source, lang")
def union_all_q(spark, d):
    """Append frames with aligned (and missing) columns."""
    doc = b.table(spark, d, "documents").select("source", "lang")
    pages = b.table(spark, d, "pages").select(F.lit("web").alias("source"))
    u = U.union_all([doc.filter("lang = 'en'"), doc.filter("NOT (lang <=> 'en')"), pages])
    return u.groupBy("source", "lang").agg(F.count("*").alias("n"))


@register("union_distinct", "SELECT NotitieID, CASE WHEN bool_or(origin = 'register') THEN 'register' ELSE 'new' END AS origin FROM (SELECT CAST(doc_id AS VARCHAR) AS NotitieID, 'register' AS origin "
          "FROM labels UNION ALL SELECT CAST(doc_id AS VARCHAR), 'new' FROM documents) GROUP BY NotitieID")
def union_distinct_q(spark, d):
    """Register ids, then new ids not yet present (first row wins)."""
    reg = b.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("NotitieID"), F.lit("register").alias("origin"))
    new = b.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("NotitieID"), F.lit("new").alias("origin"))
    return U.union_distinct(reg, new, ["NotitieID"])


@register("except_rows", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def except_rows_q(spark, d):
    """Documents minus the toxic-labelled ones (by key)."""
    doc = b.table(spark, d, "documents").select("doc_id", "source")
    tox = b.table(spark, d, "labels").filter("toxic = 1")
    return U.except_rows(doc, tox, ["doc_id"])


@register("sort_head_columns", f"SELECT MDN, NotitieID, Typenotitie FROM ({b.VISITS_SQL})")
def sort_head_columns_q(spark, d):
    """L1 + L3: visits sorted by patient and date, first three columns."""
    return U.head_columns(U.sort_dates(b.visits(spark, d), ["MDN", "Notitiedatum", "NotitieID"]), 3)
