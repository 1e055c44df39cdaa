"""Queries over note text: keyword search (G1-G5, G9) and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.domains import DOMAINS
from noteframe.functions.text import normalize_whitespace
from noteframe.operators import keywords as kw
from noteframe.plans import bindings as b
from noteframe.plans.registry import register

_TOK = f"regexp_extract_all(all_text, '{b.SQL_WORD}')"


def _searched(spark, d):
    n = b.notes(spark, d).select("institution", "MDN", "NotitieID",
                                 normalize_whitespace("all_text").alias("all_text"))
    return kw.find_keywords(n, kw.domain_regex(b.KEYWORDS))


_MATCH_CTE = ("WITH n AS (" + b.NOTES_SQL + "), m AS (SELECT institution, MDN, NotitieID, "
              + ", ".join(f"{b.sql_domain_match(d, _TOK)} AS {d}" for d in DOMAINS)
              + " FROM n)")


def notes_per_source_domain(spark, d):
    """Flagship: notes per source mentioning each domain."""
    m = kw.count_matched_domains(_searched(spark, d), DOMAINS)
    return (m.groupBy("institution")
             .agg(F.count("*").alias("n_notes"),
                  *[F.count(F.when(F.size(dom) > 0, 1)).alias(f"n_{dom}") for dom in DOMAINS],
                  F.count(F.when(F.col("n_matched_domains") > 0, 1)).alias("n_any"),
                  F.sum("n_matched_domains").cast("bigint").alias("sum_matched_domains")))


register("notes_per_source_domain", _MATCH_CTE + " SELECT institution, count(*) AS n_notes, "
         + ", ".join(f"count(*) FILTER (WHERE len({dom}) > 0) AS n_{dom}" for dom in DOMAINS)
         + ", count(*) FILTER (WHERE " + " OR ".join(f"len({dom}) > 0" for dom in DOMAINS) + ") AS n_any, "
         + "CAST(sum(" + " + ".join(f"CAST(len({dom}) > 0 AS INTEGER)" for dom in DOMAINS) + ") AS BIGINT) AS sum_matched_domains"
         + " FROM m GROUP BY institution")(notes_per_source_domain)


@register("find_keywords", _MATCH_CTE + " SELECT NotitieID, "
          + ", ".join(f"CAST(len({dom}) AS INTEGER) AS n_{dom}, array_to_string({dom}, '|') AS m_{dom}" for dom in DOMAINS)
          + " FROM m")
def find_keywords_q(spark, d):
    """All matches per domain; count and '|'-joined matches."""
    m = _searched(spark, d)
    return m.select("NotitieID", *[c for dom in DOMAINS for c in
                                   (F.size(dom).alias(f"n_{dom}"), F.concat_ws("|", dom).alias(f"m_{dom}"))])


@register("count_matched_domains", _MATCH_CTE + " SELECT NotitieID, CAST("
          + " + ".join(f"CAST(len({dom}) > 0 AS INTEGER)" for dom in DOMAINS) + " AS INTEGER) AS n_matched_domains FROM m")
def count_matched_domains_q(spark, d):
    """G4."""
    return kw.count_matched_domains(_searched(spark, d), DOMAINS).select("NotitieID", "n_matched_domains")


@register("keyword_hits_only", _MATCH_CTE + " SELECT institution, MDN, NotitieID, "
          + ", ".join(f"array_to_string({dom}, '|') AS {dom}" for dom in DOMAINS)
          + " FROM m WHERE " + " OR ".join(f"len({dom}) > 0" for dom in DOMAINS))
def keyword_hits_only_q(spark, d):
    """Notes with any match; ids + match columns."""
    h = kw.keyword_hits_only(_searched(spark, d), DOMAINS)
    return h.select("institution", "MDN", "NotitieID", *[F.concat_ws("|", dom).alias(dom) for dom in DOMAINS])


# Pair template (2): existence per note, per pair keyword. The oracle tests
# "both words occur as whole words in one full-stop-free stretch".
def _pair_sql_exists(kwd: str) -> str:
    a, c = kwd.split()
    seg_tokens = f"list_transform(string_split(all_text, '.'), lambda s: list_transform(regexp_extract_all(s, '{b.SQL_WORD}'), lambda x: lower(x)))"
    return f"len(list_filter({seg_tokens}, lambda t: list_contains(t, '{a}') AND list_contains(t, '{c}'))) > 0"


@register("keyword_pair_search", "WITH n AS (" + b.NOTES_SQL + ") SELECT institution, "
          + ", ".join(f"count(*) FILTER (WHERE {_pair_sql_exists(k)}) AS n_{dom}" for k, dom, _ in b.PAIR_KEYWORDS)
          + " FROM n GROUP BY institution")
def keyword_pair_search(spark, d):
    """G1 template 2: notes per source with a two-word match."""
    n = b.notes(spark, d)
    m = kw.find_keywords(n, kw.domain_regex(b.PAIR_KEYWORDS))
    return m.groupBy("institution").agg(
        *[F.count(F.when(F.size(dom) > 0, 1)).alias(f"n_{dom}") for _, dom, _ in b.PAIR_KEYWORDS])


@register("text_length_stats", "WITH n AS (" + b.NOTES_SQL + ") SELECT institution, "
          "CAST(min(length(all_text)) AS INTEGER) AS min_len, CAST(max(length(all_text)) AS INTEGER) AS max_len, "
          "CAST(trunc(median(length(all_text))) AS INTEGER) AS median_len, CAST(trunc(avg(length(all_text))) AS INTEGER) AS mean_len "
          "FROM n GROUP BY institution")
def text_length_stats_q(spark, d):
    """min/max/median/mean of note lengths per source, truncated."""
    n = b.notes(spark, d).withColumn("len_text", F.length("all_text"))
    return kw.text_length_stats(n, "len_text", by=["institution"])
