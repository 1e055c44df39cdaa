"""Persons and places by a name table (G6): a longest-match dictionary join.

Names are sequences of tokens, of any number of names and any length. A text
meets the table in two joins: its distinct tokens meet the first tokens of
names, and only at their places its phrases, of the lengths that such names
have, meet the names. Of overlapping matches the leftmost stays, of those at
one place the longest. Every match is replaced where it stands, so that a name inside a
longer word is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteframe.operators.keyword_index import fold_case
from noteframe.operators.nlp import TOKEN_RX
from noteframe.session import write_shared

#: tokens with the white space before them, and what is left at the end: the n-th piece holds the n-th token
_PIECES = rf"\s*(?:{TOKEN_RX})|\s+"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_RX), 0)


def name_table(names: DataFrame, ignore_case: bool = False) -> DataFrame:
    """(first, n, phrase, label): names as phrases of tokens joined by a blank; names without tokens drop out.

    ``names`` has name and label; of several labels the least one holds."""
    token = (lambda t: fold_case(t)) if ignore_case else (lambda t: t)
    words = F.transform(_tokens(F.col("name")), token)
    return (names.select(words.alias("w"), "label").where(F.size("w") > 0)
            .select(F.col("w")[0].alias("first"), F.size("w").alias("n"), F.array_join("w", " ").alias("phrase"), "label")
            .groupBy("first", "n", "phrase").agg(F.min("label").alias("label")))


def mark_names(df: DataFrame, names: DataFrame, text: str, ignore_case: bool = False) -> DataFrame:
    """``df`` with ``_m``, the matches (start, end, label) as places of the text's tokens, in order and none overlapping; null without any.

    Equal texts are searched under one key. Shuffled are each text once more than
    the result needs, the places of tokens that begin a name and the phrases
    there. The table and its first tokens are written to the shared folder when
    this is called.
    """
    token = fold_case if ignore_case else (lambda t: t)
    # written, so that Spark knows whether the table and its first tokens are small
    table = write_shared(name_table(names, ignore_case), "names")
    keyed = df.withColumn("_key", F.unhex(F.substring(F.sha2(text, 256), 1, 32)))
    texts = keyed.where(F.col("_key").isNotNull()).select("_key", F.col(text).alias("_text")).dropDuplicates(["_key"])
    lengths = write_shared(table.groupBy("first").agg(F.collect_set("n").alias("ns")), "first-tokens")
    own = texts.select("_key", F.posexplode(_tokens(F.col("_text"))).alias("i", "t")).select("_key", "i", token(F.col("t")).alias("first"))
    begun = own.join(lengths, "first").groupBy("_key").agg(F.collect_list(F.struct("i", "ns")).alias("_at"))
    some = texts.join(begun, "_key").select("_key", "_at", F.explode(F.array(_tokens(F.col("_text")))).alias("_t"))
    # within the row: an exploded row must not carry the whole text
    spans = F.flatten(F.transform("_at", lambda x: F.transform(F.filter(x["ns"], lambda n: x["i"] + n <= F.size("_t")), lambda n: F.struct(
        x["i"].alias("start"), (x["i"] + n - 1).alias("end"), F.slice("_t", x["i"] + 1, n).alias("a")))))
    phrases = (some.select("_key", F.inline(spans))
               .select("_key", "start", "end", F.array_join(F.transform("a", token), " ").alias("phrase")))
    found = phrases.join(table.select("phrase", "label"), "phrase").groupBy("_key", "start").agg(F.max(F.struct("end", "label")).alias("m"))
    # matches are chosen from left to right within runs that overlap
    past = Window.partitionBy("_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_key").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    flat = found.select("_key", "start", "m.end", "m.label").withColumn("_new", F.coalesce(F.col("start") > F.max("end").over(past), F.lit(True)))
    runs = (flat.withColumn("_run", F.sum(F.col("_new").cast("int")).over(upto)).groupBy("_key", "_run")
            .agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("all")))
    chosen = F.expr("aggregate(all, struct(-1 AS last, filter(all, m -> false) AS taken), "
                    "(t, m) -> if(m.start > t.last, struct(m.end AS last, concat(t.taken, array(m)) AS taken), t)).taken")
    kept = (runs.select("_key", F.explode(chosen).alias("m")).groupBy("_key")
            .agg(F.array_sort(F.collect_list(F.struct("m.start", "m.end", "m.label"))).alias("_m")))
    return keyed.join(kept, "_key", "left").drop("_key")


def anonymize_names(df: DataFrame, names: DataFrame, text: str = "text", out: str = "text", len_out: str = "len_text",
                    ignore_case: bool = False) -> DataFrame:
    """Every name of the table ``names`` (name, label) in the text is replaced by its label; ``len_out`` counts the text's tokens.

    Tokens are word runs or single other signs; a name matches where its tokens
    follow each other, whatever white space is between them. A null text stays
    null, with a null count.
    """
    j = mark_names(df, names, text, ignore_case).withColumn("_p", F.explode(F.array(F.regexp_extract_all(F.col(text), F.lit(_PIECES), 0))))
    # what stands between two matches, with the white space before the second, then the label
    begin = "if(k = 0, 0, _m[k - 1].end + 1)"
    parts = F.expr(f"transform(_m, (m, k) -> concat(array_join(slice(_p, {begin} + 1, m.start - {begin}), ''), regexp_extract(_p[m.start], '^\\\\s*', 0), m.label))")
    rest = F.expr("array_join(slice(_p, _m[size(_m) - 1].end + 2, size(_p)), '')")
    made = F.when(F.col("_m").isNull(), F.col(text)).otherwise(F.concat(F.array_join(parts, ""), rest))
    count = F.size("_p") - F.when(F.try_element_at("_p", F.lit(-1)).rlike(r"^\s+$"), 1).otherwise(0)
    return (j.withColumn("_out", made).withColumn("_len", F.when(F.col(text).isNotNull(), count))
            .select(*[c for c in df.columns if c not in (out, len_out)], F.col("_out").alias(out), F.col("_len").alias(len_out)))
