"""Sentence ends learned from the corpus (G7), after Kiss and Strunk (2006).

A full stop after a word ends a sentence unless the word is an abbreviation, an
initial or an ordinal number. Which words are abbreviations, and which ones
begin sentences, is read from counts over the whole corpus by log-likelihood
ratios; no word list is given. The counts are aggregations with map-side
combine, whose results, rows per distinct word, are written to the shared folder; the learned words meet a text only where it has a full stop that could
be one of an abbreviation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteframe.operators.nlp import WORD
from noteframe.session import write_shared

#: least scores of an abbreviation and of a sentence starter
ABBREVIATION, STARTER = 0.3, 30.0
#: a stretch up to a sign that may end a sentence and the white space after it, to a line break, or to the end
CHUNK = r"(?s).+?(?:[.!?]\s+|\n|\z)"
# white space within a line
_BLANKS = " \t\x0b\f\r"
_OPENING, _CLOSING = rf"^[^{WORD}]+", rf"[^{WORD}.]+$"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), 0)


def _once(c: Column) -> Column:
    """``c`` behind a generator, so that Catalyst does not write it into every expression that uses it."""
    return F.explode(F.array(c))


def word_type(token: Column) -> Column:
    """A token without what opens or closes it, lower case; its last full stop stays."""
    bare = F.regexp_replace(F.regexp_replace(token, _OPENING, ""), _CLOSING, "")
    return F.lower(F.when(token.rlike(r"^[A-Za-z]+\.?$"), token).otherwise(bare))


def _plain(word: Column) -> Column:
    return F.regexp_replace(word, r"\.$", "")


def stops(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(*keep, k, word, next, upper): full stops within a line that another stretch follows, with the words around them."""
    bare = lambda c: F.rtrim(c, F.lit(_BLANKS))
    # mostly one blank follows the full stop: then its last run without blank is enough, and most other stretches need no look at all
    plain = lambda c: c.endswith(". ")
    stop = lambda c: plain(c) | (~c.endswith("\n") & bare(c).endswith("."))
    tail = lambda c: F.when(plain(c), F.substring_index(F.rtrim(c), " ", -1)).otherwise(bare(c))
    pairs = F.transform(F.col("_c"), lambda c, k: F.when(
        (k + 1 < F.size("_c")) & stop(c), F.struct(k.alias("k"), tail(c).alias("c"), F.get(F.col("_c"), k + 1).alias("d"))))
    at = (df.select(*keep, chunks(F.col(text)).alias("_c"))
          .select(*keep, F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("x")))
    first = F.regexp_extract("x.d", rf"^[^{WORD}]*([{WORD}]+)", 1)
    word = word_type(F.substring_index(F.translate("x.c", _BLANKS[1:] + "\n", " " * 5), " ", -1))
    return at.select(*keep, F.col("x.k").alias("k"), _once(F.struct(_plain(word).alias("w"), first.alias("f"))).alias("y")).select(
        *keep, "k", F.col("y.w").alias("word"), F.lower("y.f").alias("next"), F.col("y.f").rlike(r"^\p{Lu}").alias("upper"))


def _log_likelihood(ab, a, b, n):
    """-2 log of the ratio that two events, seen ``a`` and ``b`` times and ``ab`` times together in ``n``, are independent."""
    def term(k, m, p):
        return (F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(m > k, (m - k) * F.log(1 - p)).otherwise(0.0))
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    return -2 * (term(ab, a, p) + term(b - ab, n - a, p) - term(ab, a, p1) - term(b - ab, n - a, p2))


def count_tokens(df: DataFrame, text: str) -> DataFrame:
    """(t, n): the tokens between white space as they stand, so that each distinct one is looked at once."""
    tokens = df.select(F.explode(F.split(F.col(text), r"\s+")).alias("t")).where("t <> ''")
    return write_shared(tokens.groupBy("t").agg(F.count("*").alias("n")), "tokens")


def learn_abbreviations(tokens: DataFrame, least: float = ABBREVIATION) -> DataFrame:
    """(word, score): words that stand before a full stop so much more often than others that it is theirs.

    ``tokens`` as :func:`count_tokens` gives them. The log-likelihood of the
    word's full stops against the corpus's share of full stops, times the
    number of its inner full stops and one, over e to its length, and over its
    length to the power of its occurrences without stop. Numbers and words of
    one letter are judged by their form instead.
    """
    words = tokens.select(_once(word_type(F.col("t"))).alias("w"), "n").where("w <> ''")
    counts = write_shared(words.select(_plain(F.col("w")).alias("word"), "n", F.when(F.col("w").endswith("."), F.col("n")).otherwise(0).alias("k"))
                          .where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("stops")), "word-stops")
    all_n, all_stops = counts.agg(F.sum("n"), F.sum("stops")).first()
    if not all_stops:
        return counts.select("word", F.lit(0.0).alias("score")).limit(0)
    n, k = F.col("n"), F.col("stops")
    p = F.lit(min(all_stops / all_n, 0.98))
    likelier = 2 * (k * F.log(F.lit(0.99)) + (n - k) * F.log(F.lit(0.01)) - k * F.log(p) - (n - k) * F.log(1 - p))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit(""))) + 1
    size = F.length(F.replace("word", F.lit("."), F.lit("")))
    score = likelier * inner * F.exp(-size.cast("double")) * F.pow(size.cast("double"), -(n - k).cast("double"))
    fits = F.col("word").rlike(r"\p{L}") & (F.length("word") > 1) & (k > 0)
    return write_shared(counts.where(fits).select("word", score.alias("score")).where(F.col("score") >= least), "abbreviations")


def learn_starters(df: DataFrame, text: str, tokens: DataFrame, abbreviations: DataFrame, least: float = STARTER) -> DataFrame:
    """(word, score): words that follow sure sentence ends more often than chance has it.

    Sure ends are full stops after a word that is no abbreviation, initial or number."""
    sure = (stops(df, text).where(~F.col("word").rlike(r"^(\p{L}|[\p{Nd}.,]+)$") & (F.col("next") != ""))
            .join(abbreviations.select("word"), "word", "left_anti"))
    after = write_shared(sure.groupBy(F.col("next").alias("word")).agg(F.count("*").alias("ab")), "after-stops")
    runs = tokens.select(F.explode(F.split("t", f"[^{WORD}]+")).alias("w"), "n").where("w <> ''")
    every = write_shared(runs.groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("b")), "words")
    both = after.join(every, "word")
    ends = after.agg(F.sum("ab")).first()[0]
    n = every.agg(F.sum("b")).first()[0]
    if not ends or ends >= n:
        return both.select("word", F.lit(0.0).alias("score")).limit(0)
    a, total = F.lit(float(ends)), F.lit(float(n))
    score = _log_likelihood(F.col("ab").cast("double"), a, F.col("b").cast("double"), total)
    found = both.where(F.col("ab") / a > F.col("b") / total).select("word", score.alias("score")).where(F.col("score") >= least)
    return write_shared(found, "starters")


def learn(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(abbreviations, starters) of a corpus; jobs run when this is called."""
    tokens = count_tokens(df, text)
    abbreviations = learn_abbreviations(tokens)
    return abbreviations, learn_starters(df, text, tokens, abbreviations)


def learned_sentences(df: DataFrame, text: str, abbreviations: DataFrame, starters: DataFrame, out: str = "sentences") -> DataFrame:
    """``df`` with the array of trimmed, non-empty sentences of the text.

    Line breaks, exclamation and question marks end sentences, and a full stop
    before white space does, but

    - after an abbreviation or an initial only if a capitalised starter follows,
    - after a number not before a word in lower case.

    A null text has a null array; equal texts are looked at under one key.
    """
    keyed = df.withColumn("_key", F.unhex(F.substring(F.sha2(text, 256), 1, 32)))
    own = F.coalesce("_abbr", F.lit(False)) | F.col("word").rlike(r"^\p{L}$")
    number = F.col("word").rlike(r"^\p{Nd}+$") & ~F.col("upper") & (F.col("next") != "")
    at = (stops(keyed, text, "_key").join(abbreviations.select("word", F.lit(True).alias("_abbr")), "word", "left").where(own | number)
          .join(starters.select(F.col("word").alias("next"), F.lit(True).alias("_starts")), "next", "left"))
    begins = F.col("upper") & F.coalesce("_starts", F.lit(False))
    inside = at.where(~begins | number)
    marks = inside.groupBy("_key").agg(F.collect_set("k").alias("_inside"))
    joined = keyed.join(marks, "_key", "left")
    none = F.array().cast("array<int>")
    # a map: looking a place up costs the same however many there are
    joined = joined.withColumn("_at", F.map_from_entries(F.transform(F.coalesce("_inside", none), lambda k: F.struct(k, F.lit(True)))))
    ended = F.transform(chunks(F.col(text)), lambda c, k: F.when(F.element_at("_at", k).isNotNull(), c).otherwise(F.concat(c, F.lit("\n"))))
    parts = F.transform(F.split(F.array_join(ended, ""), "\n"), lambda s: F.trim(s))
    return joined.withColumn(out, _once(F.when(F.col(text).isNotNull(), F.filter(parts, lambda s: s != "")))).select(
        *[c for c in df.columns if c != out], out)


def split_sentences_learned(df: DataFrame, id_col: str, text: str, corpus: DataFrame | None = None) -> DataFrame:
    """Note -> one row per sentence (id, sen_no from 0, sentence), with ends learned from ``corpus`` (default: ``df``).

    ``nlp.split_sentences`` is the form without learning."""
    made = learned_sentences(df.select(id_col, text), text, *learn(df if corpus is None else corpus, text))
    return made.select(id_col, F.posexplode("sentences").alias("sen_no", "sentence"))
