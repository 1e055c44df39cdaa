"""Bindings of the driver's tables to the clinical relations.

Each relation has a Spark builder and an exact DuckDB twin (``*_SQL``), so
every query on top of it can be checked by value. All derived keys come
from md5 buckets or integer arithmetic on ids, never from random draws.

* notes (M1)      <- documents: NotitieID=doc_id, institution=source,
                     Typenotitie=lang, all_text=text, MDN=doc_id div 8,
                     Notitiedatum=2020-01-01 + bucket(doc_id) % 730 days
* tokens (M7)     <- conversations: note=conv_id, sentence=turn+1, tokens =
                     whitespace-separated words; one annotator per note, or
                     three for the agreement sample (bucket % 4 = 0); labels
                     are tag strings chosen by md5 buckets (70 % shared by
                     all annotators of the token, so agreement is non-trivial)
* timeline (M13)  <- events: MDN=user_id, NotitieID=event_id,
                     Notitiedatum=date(ts), nine levels from value with NULLs
* visits          <- orders: MDN=o_custkey, date=o_orderdate (long gaps)
* register        <- labels (ids of annotated notes)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS, DOMAIN_TAG
from noteframe.functions.hashing import md5_bucket, sql_md5_bucket as H

ANNOTATORS = ["ann_a", "ann_b", "ann_c"]

_MEMO: dict = {}


def memo(fn):
    """Reuse the (immutable, lazy) DataFrame built for the same session and
    data folder: many queries share a base relation, and building a large
    plan in Python costs seconds of analysis each time."""
    def wrapped(spark, d):
        key = (fn.__module__, fn.__name__, id(spark), spark.sparkContext.applicationId, d)
        if key not in _MEMO:
            _MEMO[key] = fn(spark, d)
        return _MEMO[key]
    wrapped.__name__, wrapped.__doc__ = fn.__name__, fn.__doc__
    return wrapped


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin over ``spark.noteframe.spread`` tasks if the caller has set
    it (bench and tests: their files are single row groups). Off by default,
    whatever the input."""
    n = int(df.sparkSession.conf.get("spark.noteframe.spread", "0"))
    return df.repartition(n) if n else df


# ------------------------------------------------------------------ notes --
@memo
def notes(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return spread(doc).select(
        F.concat(F.lit("p"), (F.col("doc_id") / 8).cast("bigint").cast("string")).alias("MDN"),
        F.col("doc_id").cast("string").alias("NotitieID"),
        F.col("lang").alias("Typenotitie"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"),
                                 (md5_bucket("doc_id") % 730).cast("int")), "yyyy-MM-dd").alias("Notitiedatum"),
        F.col("text").alias("all_text"),
        F.col("source").alias("institution"),
    )


NOTES_SQL = f"""
SELECT 'p' || CAST(doc_id // 8 AS VARCHAR) AS MDN,
       CAST(doc_id AS VARCHAR) AS NotitieID,
       lang AS Typenotitie,
       strftime(DATE '2020-01-01' + CAST({H('doc_id')} % 730 AS INTEGER), '%Y-%m-%d') AS Notitiedatum,
       text AS all_text,
       source AS institution
FROM documents"""

# ------------------------------------------------------------- keywords ----
# Keyword configuration for the driver's invented multilingual prose
# (keyword, domain, regex_template_id), in file order.
KEYWORDS = [
    ("the", "ADM", 1), ("ent", "ADM", 0),
    ("and", "ATT", 1), ("with", "ATT", 1),
    ("sch", "BER", 0), ("und", "BER", 1),
    ("eau", "ENR", 0), ("les", "ENR", 1),
    ("ver", "ETN", 0),
    ("tion", "FAC", 0), ("for", "FAC", 1),
    ("die", "INS", 1), ("der", "INS", 1),
    ("qui", "MBW", 1), ("avec", "MBW", 1), ("ai", "MBW", 0),
    ("ing", "STM", 0), ("is", "STM", 1),
]
PAIR_KEYWORDS = [("and the", "ATT", 2), ("der die", "BER", 2), ("le la", "ENR", 2)]

# DuckDB twin of a word-or-stem domain regex: Python/Java ``\b`` are Unicode
# aware and RE2's is not, so the oracle works on Unicode word tokens instead
# (for templates 0 and 1 every match is exactly one whole word).
SQL_WORD = r"[\p{L}\p{M}\p{Nd}_]+"


def sql_domain_match(domain: str, tokens_expr: str) -> str:
    conds = []
    for kw, dom, tpl in KEYWORDS:
        if dom != domain:
            continue
        if tpl == 0:
            conds.append(f"starts_with(lower(x), '{kw.lower()}')")
        else:
            conds.append(f"lower(x) = '{kw.lower()}'")
    return f"list_filter({tokens_expr}, lambda x: {' OR '.join(conds)})"


# ----------------------------------------------------------------- tokens --
def _label_expr(b) -> "F.Column":
    """Tag string of one token for one annotator from its md5 bucket ``b``
    (a column computed once upstream: md5 is not re-evaluated per branch)."""
    kind = b % 100
    dom_i = ((b / 100).cast("bigint") % 9).cast("int")
    lvl = (b / 1000).cast("bigint") % 5
    dom_tags = F.array(*[F.lit(DOMAIN_TAG[d]) for d in DOMAINS])
    codes = F.array(*[F.lit(d.lower()) for d in DOMAINS])
    tag = F.element_at(dom_tags, dom_i + 1)
    lv = F.concat(F.element_at(codes, dom_i + 1), lvl.cast("string"))
    return (F.when(b % 2000 == 977, F.lit("other_disregard_file"))
             .when(kind < 70, F.lit("_"))
             .when(kind < 80, tag)
             .when(kind < 90, F.concat(tag, F.lit("|"), lv))
             .when(kind < 92, F.concat(tag, F.lit("|"), lv, F.lit("|mbw_plus")))
             .when(kind < 95, F.lit("other_target"))
             .when(kind < 97, F.concat(F.lit("other_background|"), tag))
             .otherwise(lv))


@memo
def tokens_raw(spark: SparkSession, d: str) -> DataFrame:
    """M7: one row per (token, annotator)."""
    return _tokens(spark, d, clustered=False)


@memo
def tokens_by_note(spark: SparkSession, d: str) -> DataFrame:
    """M7, its turn rows hash-partitioned by note before the token explode:
    every later key (note, sentence, annotator) contains the note id, so
    dedup, disregard, sentence flags and sentence assembly all reuse this
    partitioning instead of shuffling token rows again."""
    return _tokens(spark, d, clustered=True)


#: Bytes of turn rows, as stored, in one task of what works by note: the tokens that
#: they become are sorted there, and take some hundred times as much memory.
NOTE_PART_BYTES = 512 << 10


def parts_by_size(stored: DataFrame, part_bytes: int) -> int:
    """Tasks for the rows of a table, each of ``part_bytes`` as stored. As a number, because Spark joins
    small partitions by their bytes before a token explode, up to a share of the input for each core."""
    size = stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-int(str(size)) // part_bytes))


def _tokens(spark: SparkSession, d: str, clustered: bool) -> DataFrame:
    c = table(spark, d, "conversations").select(
        "conv_id", "turn", "text", F.col("conv_id").cast("string").alias("NotitieID"))
    if clustered:
        c = c.repartition(parts_by_size(table(spark, d, "conversations"), NOTE_PART_BYTES), "NotitieID")
    # note-level attributes are computed once per turn, before the explode
    iaa = md5_bucket("conv_id", F.lit("iaa")) % 4 == 0
    anns = F.array(*[F.lit(a) for a in ANNOTATORS])
    start = F.when(iaa, F.lit(1)).otherwise((md5_bucket("conv_id", F.lit("ann")) % 3 + 1).cast("int"))
    turn = c.select(
        "conv_id", "turn", "NotitieID", "text",
        F.slice(anns, start, F.when(iaa, F.lit(3)).otherwise(F.lit(1))).alias("_anns"),
        F.concat(F.lit("inst"), (md5_bucket("conv_id", F.lit("inst")) % 3).cast("string")).alias("institution"),
        (F.lit(2017) + md5_bucket("conv_id", F.lit("year")) % 4).cast("string").alias("year"),
        F.concat(F.lit("p"), (F.col("conv_id") / 4).cast("bigint").cast("string")).alias("MDN"),
        F.concat(F.lit("week_"), (F.lit(14) + md5_bucket("conv_id", F.lit("batch")) % 4).cast("string")).alias("batch"))
    note = turn.select(
        "conv_id", "turn", "NotitieID", "_anns", "institution", "year", "MDN", "batch",
        F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(r"\S+"), 0)).alias("pos", "token"))
    t = note.withColumn("annotator", F.explode("_anns"))
    # buckets first, as columns, so the label CASE reads them instead of
    # re-evaluating md5 in every branch
    t = t.select("*", md5_bucket("conv_id", "turn", "pos").alias("_bs"),
                 md5_bucket("conv_id", "turn", "pos", "annotator").alias("_bo"))
    t = t.select("*", F.when(F.col("_bo") % 10 < 7, F.col("_bs")).otherwise(F.col("_bo")).alias("_b"))
    s = (F.col("turn") + 1).cast("string")
    k = (F.col("pos") + 1).cast("string")
    return t.select(
        F.concat(s, F.lit("-"), k).alias("sen_tok"),
        F.concat((F.col("pos") * 10).cast("string"), F.lit("-"),
                 (F.col("pos") * 10 + F.length("token")).cast("string")).alias("char"),
        "token",
        _label_expr(F.col("_b")).alias("label"),
        F.lit("_").alias("relation"),
        "annotator", "institution", "year", "MDN", "NotitieID", "batch",
        F.lit(None).cast("string").alias("legacy_rawfile"),
    )


def _sql_label(bs: str, bo: str) -> str:
    b = f"(CASE WHEN {bo} % 10 < 7 THEN {bs} ELSE {bo} END)"
    dom_tags = "[" + ", ".join(f"'{DOMAIN_TAG[d]}'" for d in DOMAINS) + "]"
    codes = "[" + ", ".join(f"'{d.lower()}'" for d in DOMAINS) + "]"
    tag = f"{dom_tags}[CAST(({b} // 100) % 9 AS INTEGER) + 1]"
    lv = f"({codes}[CAST(({b} // 100) % 9 AS INTEGER) + 1] || CAST(({b} // 1000) % 5 AS VARCHAR))"
    return f"""(CASE WHEN {b} % 2000 = 977 THEN 'other_disregard_file'
         WHEN {b} % 100 < 70 THEN '_'
         WHEN {b} % 100 < 80 THEN {tag}
         WHEN {b} % 100 < 90 THEN {tag} || '|' || {lv}
         WHEN {b} % 100 < 92 THEN {tag} || '|' || {lv} || '|mbw_plus'
         WHEN {b} % 100 < 95 THEN 'other_target'
         WHEN {b} % 100 < 97 THEN 'other_background|' || {tag}
         ELSE {lv} END)"""


_ANN_LIST = "[" + ", ".join(f"'{a}'" for a in ANNOTATORS) + "]"

TOKENS_RAW_SQL = f"""
SELECT CAST(turn + 1 AS VARCHAR) || '-' || CAST(pos + 1 AS VARCHAR) AS sen_tok,
       CAST(pos * 10 AS VARCHAR) || '-' || CAST(pos * 10 + length(token) AS VARCHAR) AS char,
       token,
       {_sql_label(H('conv_id', 'turn', 'pos'), H('conv_id', 'turn', 'pos', 'annotator'))} AS label,
       '_' AS relation,
       annotator,
       'inst' || CAST({H('conv_id', "'inst'")} % 3 AS VARCHAR) AS institution,
       CAST(2017 + {H('conv_id', "'year'")} % 4 AS VARCHAR) AS year,
       'p' || CAST(conv_id // 4 AS VARCHAR) AS MDN,
       CAST(conv_id AS VARCHAR) AS NotitieID,
       'week_' || CAST(14 + {H('conv_id', "'batch'")} % 4 AS VARCHAR) AS batch,
       CAST(NULL AS VARCHAR) AS legacy_rawfile
FROM (
  SELECT conv_id, turn, pos, token, unnest(anns) AS annotator
  FROM (
    SELECT conv_id, turn, unnest(range(len(toks))) AS pos, unnest(toks) AS token,
           CASE WHEN {H('conv_id', "'iaa'")} % 4 = 0 THEN {_ANN_LIST}
                ELSE [{_ANN_LIST}[CAST({H('conv_id', "'ann'")} % 3 AS INTEGER) + 1]] END AS anns
    FROM (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS toks FROM conversations)
  )
)"""

# ---------------------------------------------------------------- timeline --
@memo
def timeline(spark: SparkSession, d: str) -> DataFrame:
    """M13 from events: one note per event, nine nullable double levels."""
    e = table(spark, d, "events")
    lv = [F.when(md5_bucket("event_id", F.lit(dom)) % 4 == 0, F.lit(None).cast("double"))
           .otherwise(((F.floor("value") + i) % 5).cast("double")).alias(f"{dom}_lvl")
          for i, dom in enumerate(DOMAINS)]
    return e.select(
        F.col("user_id").cast("string").alias("MDN"),
        F.concat(F.lit("inst"), (F.col("user_id") % 3).cast("string")).alias("institution"),
        F.col("event_id").cast("string").alias("NotitieID"),
        F.col("event_type").alias("Typenotitie"),
        F.col("ts").cast("date").alias("Notitiedatum"),
        F.col("ts"), F.col("event_id"),
        (md5_bucket("event_id", F.lit("annot")) % 5 == 0).alias("annotated"),
        *lv)


TIMELINE_SQL = "SELECT CAST(user_id AS VARCHAR) AS MDN, 'inst' || CAST(user_id % 3 AS VARCHAR) AS institution, " \
    "CAST(event_id AS VARCHAR) AS NotitieID, event_type AS Typenotitie, CAST(ts AS DATE) AS Notitiedatum, ts, event_id, " \
    f"{H('event_id', chr(39) + 'annot' + chr(39))} % 5 = 0 AS annotated, " + ", ".join(
        f"CASE WHEN {H('event_id', repr(dom))} % 4 = 0 THEN NULL ELSE CAST((CAST(floor(value) AS BIGINT) + {i}) % 5 AS DOUBLE) END AS {dom}_lvl"
        for i, dom in enumerate(DOMAINS)) + " FROM events"


# ------------------------------------------------------------------ visits --
@memo
def visits(spark: SparkSession, d: str) -> DataFrame:
    """Patient visits with multi-year gaps (orders): MDN, NotitieID, date."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("MDN"),
                    F.col("o_orderkey").cast("string").alias("NotitieID"),
                    F.col("o_orderpriority").alias("Typenotitie"),
                    F.col("o_orderdate").cast("date").alias("Notitiedatum"))


VISITS_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS MDN, CAST(o_orderkey AS VARCHAR) AS NotitieID,
 o_orderpriority AS Typenotitie, CAST(o_orderdate AS DATE) AS Notitiedatum FROM orders"""
