"""Rule-based text units and anonymisation (G6-G8), re-aimed from a
per-row NLP library to JVM expressions.

Tokens are runs of word characters or single other non-space characters;
sentences end at '.', '!' or '?' followed by whitespace, or at a line break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"\p{L}\p{M}\p{Nd}_"
TOKEN_RX = rf"[{WORD}]+|[^{WORD}\s]"


def sentence_array(text) -> Column:
    """Note text -> array of trimmed, non-empty sentences."""
    t = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(t, r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def token_array(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(TOKEN_RX), 0)


def split_sentences(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Note -> one row per sentence (id, sen_no from 0, sentence)."""
    return df.select(id_col, F.posexplode(sentence_array(text)).alias("sen_no", "sentence"))


def tokenize(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Note -> one row per token (id, sen_no, tok, token); the first
    token of each sentence has tok = 0 (sentence start)."""
    s = split_sentences(df, id_col, text)
    return s.select(id_col, "sen_no", F.posexplode(token_array("sentence")).alias("tok", "token"))


def conll_text(text) -> Column:
    """Note -> CoNLL body: one 'token O' line per token, a blank line
    between sentences (A13 layout)."""
    sents = sentence_array(text)
    lines = F.transform(sents, lambda s: F.array_join(F.transform(token_array(s), lambda t: F.concat(t, F.lit(" O"))), "\n"))
    return F.array_join(lines, "\n\n")


def anonymize_text(df: DataFrame, entities: DataFrame, id_col: str, text: str = "text",
                   out: str = "text", len_out: str = "len_text") -> DataFrame:
    """Replace every detected entity string in the note by its label,
    in order of first appearance; also return the token count.

    ``entities`` holds (id, ent_text, label[, start]) per note, as an
    entity recogniser emits them; they are gathered per note with a
    group-by and applied with a higher-order ``aggregate`` (no UDF, no
    broadcast of a global dictionary)."""
    e = entities
    if "start" not in e.columns:
        e = e.withColumn("start", F.lit(0))
    per = (e.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), F.col("ent_text").alias("e"),
                                                                   F.col("label").alias("l")))).alias("_ents")))
    j = df.join(per, id_col, "left")
    replaced = F.aggregate(F.coalesce(F.col("_ents"), F.array().cast("array<struct<s:int,e:string,l:string>>")),
                           F.col(text), lambda acc, x: F.replace(acc, x["e"], x["l"]))
    return j.withColumn(out, replaced).withColumn(len_out, F.size(token_array(out))).drop("_ents")


def anonymize_by_rules(df: DataFrame, rules: dict[str, str], text: str = "text",
                       out: str = "text", len_out: str = "len_text") -> DataFrame:
    """G6 with ``label: regex`` rules as the recogniser: the same result as
    :func:`anonymize_text` over :func:`regex_entities`, but the entities are
    built and replaced within the row: the text is read once and neither
    shuffled nor joined."""
    t = F.col(text)

    def matches(label, rx):
        hits = F.array_distinct(F.regexp_extract_all(t, F.lit(rx), 0))
        return F.transform(hits, lambda e: F.struct(F.position(e, t).alias("s"), e.alias("e"), F.lit(label).alias("l")))
    found = F.concat(*[matches(label, rx) for label, rx in rules.items()])
    replaced = F.aggregate(F.array_sort(found), t, lambda acc, x: F.replace(acc, x["e"], x["l"]))
    return df.withColumn(out, replaced).withColumn(len_out, F.size(token_array(out)))


def regex_entities(df: DataFrame, id_col: str, text: str, rules: dict[str, str]) -> DataFrame:
    """A simple entity recogniser: (id, ent_text, label, start) for every
    distinct match of each ``label: regex`` rule; ``start`` is the first
    character position of the string in the note."""
    out = None
    for label, rx in rules.items():
        m = df.select(id_col, F.col(text).alias("_t"), F.explode(F.regexp_extract_all(F.col(text), F.lit(rx), 0)).alias("ent_text"))
        m = m.select(id_col, "ent_text", F.lit(label).alias("label"), F.expr("locate(ent_text, _t)").alias("start"))
        out = m if out is None else out.unionByName(m)
    return out.groupBy(id_col, "ent_text", "label").agg(F.min("start").cast("int").alias("start"))
