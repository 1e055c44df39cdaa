"""Queries over names in texts (G6) and learned sentence ends.

The given texts hold neither names nor abbreviations, so the notes of both
queries have them written in: persons and places of the given tables around
the text, and words that always stand with a full stop in place of others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from noteframe.functions.hashing import md5_bucket, sql_md5_bucket as H
from noteframe.operators import names as N
from noteframe.operators import nlp
from noteframe.operators import sentences as S
from noteframe.plans import bindings as b
from noteframe.plans.registry import register

_W = nlp.WORD
_TOKENS = rf"[{_W}]+|[^{_W}\s]"


# ---- G6 ------------------------------------------------------------------
@b.memo
def named_notes(spark, d):
    """doc_id and a text that a customer of a nation and region heads and another ends; half of the customers are none of the table's."""
    who = lambda salt: F.format_string("Customer#%09d", md5_bucket("doc_id", F.lit(salt)) % F.col("n2"))
    nation = (b.table(spark, d, "nation").join(b.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select("n_nationkey", "n_name", "r_name"))
    size = b.table(spark, d, "customer").count() * 2
    doc = (b.table(spark, d, "documents").withColumns({"n2": F.lit(size), "k": md5_bucket("doc_id", F.lit("nation")) % 25})
           .join(F.broadcast(nation), F.col("k") == F.col("n_nationkey")))
    return doc.select("doc_id", F.concat(who("a"), F.lit(" of "), "n_name", F.lit(", "), "r_name", F.lit(" wrote:\n"), "text", F.lit(" ("),
                                         who("b"), F.lit(", "), "n_name", F.lit(" not "), F.lit("X"), "n_name", F.lit(")")).alias("text"))


def known_names(spark, d):
    """(name, label): customers are persons; nations, regions and 'nation, region' are places."""
    nation = b.table(spark, d, "nation").join(b.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = (nation.select(F.col("n_name").alias("name")).unionByName(b.table(spark, d, "region").select(F.col("r_name").alias("name")))
             .unionByName(nation.select(F.concat("n_name", F.lit(", "), "r_name").alias("name"))))
    return (b.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("PERSON").alias("label"))
            .unionByName(place.withColumn("label", F.lit("GPE"))))


def _who(salt: str) -> str:
    bucket = H("doc_id", f"'{salt}'")
    return f"format('Customer#{{:09d}}', {bucket} % (2 * (SELECT count(*) FROM customer)))"


@register("anonymize_names", rf"""
WITH na AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT '\b(' || string_agg(n_name || '\s*,\s*' || r_name, '|') || '|' || string_agg(n_name, '|') || '|'
             || (SELECT string_agg(r_name, '|') FROM region) || ')\b' AS rx FROM na),
t AS (SELECT doc_id, {_who('a')} AS c1, {_who('b')} AS c2, n_name, r_name, text
      FROM documents JOIN na ON n_nationkey = {H('doc_id', "'nation'")} % 25),
f AS (SELECT doc_id, c1, c2, c1 || ' of ' || n_name || ', ' || r_name || ' wrote:' || chr(10) || text || ' (' || c2 || ', ' || n_name
             || ' not X' || n_name || ')' AS text FROM t),
a AS (SELECT doc_id, f.text AS original, regexp_replace(
        replace(replace(f.text, c1, CASE WHEN x.c_name IS NULL THEN c1 ELSE 'PERSON' END), c2, CASE WHEN y.c_name IS NULL THEN c2 ELSE 'PERSON' END),
        (SELECT rx FROM p), 'GPE', 'g') AS text
      FROM f LEFT JOIN customer x ON x.c_name = c1 LEFT JOIN customer y ON y.c_name = c2)
SELECT doc_id, md5(text) AS text_md5, CAST(len(regexp_extract_all(original, '{_TOKENS}')) AS INTEGER) AS len_text FROM a
""")
def anonymize_names_q(spark, d):
    """Persons and places of the given tables replaced by their types wherever they stand in the notes; tokens of the note."""
    a = N.anonymize_names(named_notes(spark, d), known_names(spark, d))
    return a.select("doc_id", F.md5("text").alias("text_md5"), "len_text")


# ---- G7 ------------------------------------------------------------------
# words of the invented prose that stand for abbreviations, as they are written in
_WRITTEN = [(" of ", " approx. "), (" with ", " dr. "), (" der ", " bzw. "), (" les ", " p.ex. ")]


def stop_notes(spark, d):
    text = F.col("text")
    for a, z in _WRITTEN:
        text = F.replace(text, F.lit(a), F.lit(z))
    return b.table(spark, d, "documents").select("doc_id", text.alias("text"))


_TEXT = "text"
for _a, _z in _WRITTEN:
    _TEXT = f"replace({_TEXT}, '{_a}', '{_z}')"
_CHUNK = S.CHUNK


def _type(token: str) -> str:
    return f"lower(regexp_replace(regexp_replace({token}, '{S._OPENING}', ''), '{S._CLOSING}', ''))"


def _term(k: str, m: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN ({k}) * ln({p}) ELSE 0 END + CASE WHEN {m} > {k} THEN (({m}) - ({k})) * ln(1 - {p}) ELSE 0 END)"


_LL = (f"-2 * ({_term('ab', 'a', '(b / n)')} + {_term('(b - ab)', '(n - a)', '(b / n)')} - {_term('ab', 'a', '(ab / a)')} "
       f"- {_term('(b - ab)', '(n - a)', '((b - ab) / (n - a))')})")

_LAST = r"regexp_extract(x, '(\S+)\s*$', 1)"
LEARNED_SQL = rf"""
d AS (SELECT doc_id, {_TEXT} AS text FROM documents),
w AS (SELECT {_type('t')} AS w FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS t FROM d)),
c AS (SELECT regexp_replace(w, '\.$', '') AS word, count(*) AS n, sum(CAST(ends_with(w, '.') AS BIGINT)) AS k FROM w WHERE w <> ''
      GROUP BY 1 HAVING word <> ''),
s AS (SELECT least(sum(k) / sum(n), 0.98) AS p FROM c),
abbr AS (SELECT word, 2 * (k * ln(0.99) + (n - k) * ln(0.01) - k * ln(p) - (n - k) * ln(1 - p))
                * (length(word) - length(replace(word, '.', '')) + 1) * exp(-length(replace(word, '.', '')))
                * pow(length(replace(word, '.', '')), -(n - k)) AS score
         FROM c, s WHERE regexp_matches(word, '\p{{L}}') AND length(word) > 1 AND k > 0),
ab AS (SELECT * FROM abbr WHERE score >= 0.3),
ch AS (SELECT doc_id, regexp_extract_all(text, '{_CHUNK}') AS cs FROM d),
st AS (SELECT doc_id, i - 1 AS k, regexp_replace({_type(_LAST)}, '\.$', '') AS word,
              regexp_extract(y, '^[^{_W}]*([{_W}]+)', 1) AS nx
       FROM (SELECT doc_id, i, cs[i] AS x, cs[i + 1] AS y FROM (SELECT doc_id, cs, unnest(range(1, len(cs))) AS i FROM ch))
       WHERE regexp_matches(x, '\.[ \t\r\f\v]+$') AND y <> ''),
sure AS (SELECT lower(nx) AS word, count(*) AS ab FROM st WHERE NOT regexp_matches(word, '^(\p{{L}}|[\p{{Nd}}.,]+)$') AND nx <> ''
         AND word NOT IN (SELECT word FROM ab) GROUP BY 1),
ev AS (SELECT lower(t) AS word, count(*) AS b FROM (SELECT unnest(regexp_extract_all(text, '[{_W}]+')) AS t FROM d) GROUP BY 1),
tot AS (SELECT CAST((SELECT sum(ab) FROM sure) AS DOUBLE) AS a, CAST((SELECT sum(b) FROM ev) AS DOUBLE) AS n),
start AS (SELECT word, {_LL} AS score FROM (SELECT word, CAST(ab AS DOUBLE) AS ab, CAST(b AS DOUBLE) AS b, a, n FROM sure JOIN ev USING (word), tot)
          WHERE ab / a > b / n),
sr AS (SELECT * FROM start WHERE score >= 30)"""


@register("learned_words", f"WITH {LEARNED_SQL} SELECT 'abbreviation' AS kind, word, round(score, 3) AS score FROM ab "
          "UNION ALL SELECT 'starter', word, round(score, 3) FROM sr")
def learned_words_q(spark, d):
    """Abbreviations and sentence starters of the corpus with their scores."""
    t = stop_notes(spark, d)
    a, starters = S.learn(t, "text")
    made = a.withColumn("kind", F.lit("abbreviation")).unionByName(starters.withColumn("kind", F.lit("starter")))
    return made.select("kind", "word", F.round("score", 3).alias("score"))


@register("split_sentences_learned", f"""WITH {LEARNED_SQL},
ins AS (SELECT DISTINCT doc_id, k FROM st WHERE
  ((word IN (SELECT word FROM ab) OR regexp_matches(word, '^\\p{{L}}$')) AND NOT (regexp_matches(nx, '^\\p{{Lu}}') AND lower(nx) IN (SELECT word FROM sr)))
  OR (regexp_matches(word, '^\\p{{Nd}}+$') AND NOT regexp_matches(nx, '^\\p{{Lu}}') AND nx <> '')),
cu AS (SELECT doc_id, unnest(range(0, len(cs))) AS k, unnest(cs) AS c FROM ch),
m AS (SELECT cu.doc_id, string_agg(c || CASE WHEN ins.k IS NULL THEN chr(10) ELSE '' END, '' ORDER BY cu.k) AS t
      FROM cu LEFT JOIN ins ON ins.doc_id = cu.doc_id AND ins.k = cu.k GROUP BY cu.doc_id),
o AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(t, ''), chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS ss
      FROM d LEFT JOIN m USING (doc_id))
SELECT doc_id, CAST(len(ss) AS INTEGER) AS n_sentences, md5(array_to_string(ss, chr(10))) AS md5 FROM o""")
def split_sentences_learned_q(spark, d):
    """Notes split into sentences at the learned ends: number of sentences and digest per note."""
    t = stop_notes(spark, d)
    s = S.learned_sentences(t, "text", *S.learn(t, "text"))
    return s.select("doc_id", F.size("sentences").alias("n_sentences"), F.md5(F.array_join("sentences", "\n")).alias("md5"))
