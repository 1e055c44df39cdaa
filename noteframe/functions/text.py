"""Scalar column expressions (B3, B17-B21, G1-G2 pattern builders)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace, as Python's str-mode ``\s`` sees it.
_WS = r"(?U)\s+"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def normalize_whitespace(c) -> Column:
    """Collapse every whitespace run to one space, then strip."""
    return F.trim(F.regexp_replace(_col(c), _WS, " "))


def pad_sentence_id(c, width: int = 4) -> Column:
    """``<note>_<n>`` -> ``<note>_<n zero-padded to width>``.

    Plain ``lpad`` truncates longer numbers, so the pad width is the larger
    of ``width`` and the number's own length (never truncates).
    """
    c = _col(c)
    note = F.regexp_extract(c, r"^(.*)_([^_]*)$", 1)
    num = F.regexp_extract(c, r"^(.*)_([^_]*)$", 2)
    return F.concat(note, F.lit("_"), pad_number(num, width))


def pad_number(num, width: int = 4) -> Column:
    num = _col(num).cast("string")
    return F.when(F.length(num) >= width, num).otherwise(F.lpad(num, width, "0"))


def year_from_date(c) -> Column:
    """First four characters of a ``YYYY-MM-DD`` string."""
    return F.substring(_col(c), 1, 4)


def cap_group_values(c, cap: int = 500) -> Column:
    """Clamp at ``cap``."""
    return F.least(_col(c), F.lit(cap))


def round_discretize(c) -> Column:
    """Round half to even (numpy semantics) to an integer class."""
    return F.bround(_col(c), 0).cast("int")


# ---------------------------------------------------------------- keywords --
# fixed values: the template numbers of keyword files and their patterns
TEMPLATE_STEM, TEMPLATE_WORD, TEMPLATE_PAIR = 0, 1, 2


def keyword_regex(keyword: str, template: int) -> str:
    """G1: regex for one keyword. 0 = stem to word end, 1 = whole word,
    2 = two words in either order with no full stop between them.
    Keywords are used verbatim (not escaped), as in the source rules."""
    if template == TEMPLATE_STEM:
        return rf"\b{keyword}.*?\b"
    if template == TEMPLATE_WORD:
        return rf"\b{keyword}\b"
    if template == TEMPLATE_PAIR:
        words = keyword.split()
        if len(words) != 2:
            raise ValueError(f"pair keyword needs exactly two words: {keyword!r}")
        a, b = words
        return rf"\b{a}\b[^.]*?\b{b}\b|\b{b}\b[^.]*?\b{a}\b"
    raise ValueError(f"unknown regex template {template}")
