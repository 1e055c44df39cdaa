"""Keyword search over note text.

Regexes are compiled once on the driver from the (small, bounded) keyword
table and applied as one JVM projection: the text column is read once and
matched once per domain, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteframe.functions.text import keyword_regex

# Java needs (?U) for Unicode-aware \b and \w, which Python's str regexes
# have by default; (?i) is the IGNORECASE flag of the search.
REGEX_FLAGS = "(?iU)"


def domain_regex(keywords: Iterable[tuple[str, str, int]]) -> dict[str, str]:
    """Join all keyword patterns of a domain with '|', in file order.

    ``keywords`` is an iterable of (keyword, domain, template) rows, e.g. the
    collected rows of a keyword table (a bounded configuration dimension)."""
    out: dict[str, list[str]] = {}
    for kw, dom, tpl in keywords:
        out.setdefault(dom, []).append(keyword_regex(kw, int(tpl)))
    return {d: "|".join(v) for d, v in out.items()}


def find_keywords(df: DataFrame, reg_dict: Mapping[str, str], text: str = "all_text") -> DataFrame:
    """Per domain, an array of all non-overlapping, case-insensitive
    matches of the domain regex in ``text`` (one column per domain)."""
    cols = [F.regexp_extract_all(F.col(text), F.lit(REGEX_FLAGS + rx), 0).alias(dom)
            for dom, rx in reg_dict.items()]
    return df.select("*", *cols)


def count_matched_domains(df: DataFrame, domains: Iterable[str],
                          out: str = "n_matched_domains") -> DataFrame:
    """Number of domains with at least one match."""
    terms = [(F.size(F.col(d)) > 0).cast("int") for d in domains]
    return df.withColumn(out, reduce(lambda a, b: a + b, terms))


def any_match(domains: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.size(F.col(d)) > 0 for d in domains])


def keyword_hits_only(df: DataFrame, domains: list[str],
                      keys=("institution", "MDN", "NotitieID")) -> DataFrame:
    """Notes with any match; ids plus the match columns."""
    return df.filter(any_match(domains)).select(*keys, *domains)


def text_length_stats(df: DataFrame, length: str = "len_text", by: list[str] | None = None) -> DataFrame:
    """Min / max / median / mean of a length column, truncated to int.

    The median is the exact pandas median (mean of the two middle values),
    via ``percentile`` (exact, distributed partial aggregation)."""
    aggs = [F.min(length).cast("int").alias("min_len"),
            F.max(length).cast("int").alias("max_len"),
            F.percentile(F.col(length), 0.5).cast("int").alias("median_len"),
            F.avg(length).cast("int").alias("mean_len")]
    return df.groupBy(*(by or [])).agg(*aggs)


def rebuild_sentence_text(tokens: DataFrame, sentences: DataFrame | None = None,
                          annotator: str | None = None, sen="sen_id", tok="tok",
                          token="token") -> DataFrame:
    """Text of chosen sentences for one annotator, tokens in order."""
    t = tokens
    if annotator is not None:
        t = t.filter(F.col("annotator") == annotator)
    if sentences is not None:
        t = t.join(sentences.select(sen).distinct(), sen, "left_semi")
    return (t.groupBy(sen)
             .agg(F.array_sort(F.collect_list(F.struct(F.col(tok).alias("k"),
                                                        F.coalesce(F.col(token), F.lit("")).alias("v")))).alias("_t"))
             .select(sen, F.concat_ws(" ", F.transform("_t", lambda x: x["v"])).alias("text")))
