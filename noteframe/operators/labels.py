"""Label parsing (P1-P5): tag set -> fixed projection -> parsed tokens.

The tag set is a small configuration table; it is resolved on the driver
once and turned into a fixed list of column expressions, so parsing is one
codegen'd projection over the token table (no UDF, no shuffle).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.functions.domains import PILOT_CODE_MAP, PILOT_FLAGS

# fixed values: (category, anchored pattern) of the guideline
_CATEGORY_RULES = [
    ("domains", r"\..*"), ("levels", r"[a-z]{3}\d"), ("disregard", "other_disregard_file"),
    ("target", "other_target"), ("background", "other_background"), ("plus", "mbw_plus"),
]


def load_tagset(spark: SparkSession, path: str) -> DataFrame:
    """JSON ``{"name":..., "tags":[{"tag_name","tag_description"}]}`` ->
    one row per tag, file order kept in ``pos``."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.posexplode("tags").alias("pos", "t")).select(
        "pos", F.col("t.tag_name").alias("tag_name"), F.col("t.tag_description").alias("tag_description"))


def categorize_tags(tag_names: Sequence[str]) -> dict[str, list[str]]:
    """Tag names -> categories (patterns anchored at the start)."""
    return {cat: [t for t in tag_names if re.match(rx, t)] for cat, rx in _CATEGORY_RULES}


def categorize_tags_df(tags: DataFrame, col: str = "tag_name") -> DataFrame:
    """P1 as a DataFrame: (tag_name, category); first matching rule wins."""
    expr = None
    for cat, rx in _CATEGORY_RULES:
        cond = F.col(col).rlike("^(" + rx + ")")
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return tags.withColumn("category", expr)


def parse_index(cats: Mapping[str, list[str]]) -> list[str]:
    """Domain codes (last 3 chars of the domain tags), their ``_lvl``
    columns, then the four flags."""
    doms = [t[-3:] for t in cats["domains"]]
    return doms + [f"{d}_lvl" for d in doms] + ["disregard", "target", "background", "plus"]


def parse_labels(df: DataFrame, tag_names: Sequence[str], label: str = "label") -> DataFrame:
    """One column per parse-index entry.

    Flag = case-sensitive substring test; level = first digit after the
    lower-case domain code, else NULL. Rows whose label is '_' or NULL get
    NULL everywhere (three-valued: 'unlabelled' is not 'False')."""
    idx = parse_index(categorize_tags(tag_names))
    lab = F.col(label)
    has = lab.isNotNull() & (lab != "_")
    cols = {}
    for name in idx:
        if name.endswith("_lvl"):
            code = name[:3].lower()  # looked for first: the pattern costs more, and once a label
            val = F.when(lab.contains(code), F.regexp_extract(lab, f"{code}(\\d)", 1).try_cast("int"))
        else:
            val = lab.contains(name)
        cols[name] = F.when(has, val)
    return df.withColumns(cols)


def parse_labels_legacy(df: DataFrame, tag_names: Sequence[str], label: str = "label",
                        code_map: Mapping[str, str] = PILOT_CODE_MAP,
                        flags: Mapping[str, str] = PILOT_FLAGS) -> DataFrame:
    """Pilot tag set. Domain flag = code substring, level = first digit
    after ``<DOM> ``, flags are the escaped tag names (annotation exports
    escape '_' as '\\_'), ``other`` = all residual tags found in the label."""
    names = [t.split(":")[0] for t in tag_names]
    known = set(code_map) | {n for n in names if re.match(r"[A-Z]{3} \d", n)} | \
        {n for n in names if re.match("disregard_file|target|type_Background", n)}
    other_rx = "|".join(n for n in names if n not in known)
    lab = F.col(label)
    has = lab.isNotNull() & (lab != "_")
    cols = {}
    for code, dom in code_map.items():
        cols[dom] = F.when(has, lab.contains(code))
        digit = F.regexp_extract(lab, f"{dom} (\\d)", 1)
        cols[f"{dom}_lvl"] = F.when(has & (digit != ""), digit.cast("int"))
    for flag, tag in flags.items():
        cols[flag] = F.when(has, lab.contains(tag.replace("_", "\\_")))
    cols["other"] = F.when(has, F.regexp_extract_all(lab, F.lit(other_rx), 0))
    return df.withColumns(cols)


def align_tagset_variants(frames: Sequence[DataFrame]) -> DataFrame:
    """P5: parsed frames from different tag-set versions, aligned by name
    (columns missing in one version become NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
