"""Operator 13: filter interaction audit by a recursive common table expression.

Every document gets a mask of the filters that it fails. The masks of a part
are counted in at most 2^filters cells; a recursive query then extends filter
prefixes by each unused letter, joins the part's cells, carries the bits
applied so far and emits the metrics of that step. All orders share their
prefixes, so five filters need 325 steps a part instead of 600.

All of it is DataFrame or SQL work. Texts are read once; the rows kept per
document are its id, its part, a digest of its text and the mask.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words are runs of bytes beyond blank, tab, line feed, vertical tab, form feed and carriage return.
NO_WORD = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The letter of the filter against copies, which no single text decides.
COPY = "E"


def text_tests(text: Column) -> dict[str, Column]:
    """Failure conditions that one text decides: A short, B repetitive, C shouting, D signs."""
    words = F.filter(F.split(text, NO_WORD), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"A": n < 200, "B": distinct * 100 < n * 50, "C": upper.cast("long") * 100 > F.length(text).cast("long") * 3,
            "D": text.rlike(r"[#$%&*|]")}


def failure_cells(docs: DataFrame, labels: DataFrame, tests=text_tests, copies: str | None = COPY, id_col: str = "doc_id",
                  text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): rows of ``docs`` per part and set of failed filters.

    ``tests(text)`` gives the failure conditions by letter; the i-th letter is
    bit i of the mask. ``copies`` is the letter, and the last bit, of the
    filter that fails a row whose text is that of any row with a smaller id,
    table-wide. A null text is an empty one and a null part the empty string. A
    row without id is a copy of nothing, and nothing is its copy; it has no
    label. Rows that repeat an id count each, and none of them is a copy of
    another by that id. A row counts as good (toxic) if a label row of its id
    has ``quality`` (``toxic``) 1; repeated label rows count once.
    """
    text = F.coalesce(C.text_column(docs, text_col), F.lit(""))
    bits = tests(F.col("_text"))
    mask = sum((F.when(cond, F.lit(1 << i)).otherwise(0) for i, cond in enumerate(bits.values())), F.lit(0))
    rows = (docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
                        text.alias("_text"))
            .select("id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), mask.alias("mask")))
    rows = C.write_table(rows, "audit")
    # one hot text is one row a task in the first aggregation, and is dealt by (digest, id) in the join
    named = rows.where("id IS NOT NULL")
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("long")).alias("good"),
                  F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("long")).alias("toxic")))
    marked = (named.join(marks, "id", "left").select("id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"),
                                                     F.coalesce("toxic", F.lit(0)).alias("toxic"))
              .unionByName(rows.where("id IS NULL").selectExpr("id", "part", "digest", "mask", "0L AS good", "0L AS toxic")))
    if copies:
        first = named.groupBy("digest").agg(F.min("id").alias("id")).select("digest", "id", F.lit(0).alias("copy"))
        marked = (marked.where("id IS NOT NULL").join(first, ["digest", "id"], "left")
                  .withColumn("mask", F.col("mask") + F.coalesce("copy", F.lit(1 << len(bits)))).drop("copy")
                  .unionByName(marked.where("id IS NULL")))
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


_RECURSION = """
WITH RECURSIVE letters(letter, bit) AS (VALUES {letters}),
steps AS (
  SELECT part, '' AS prefix, '' AS letter, 0 AS step, 0 AS applied, 0L AS kept, 0L AS removed, 0L AS redundant,
         0L AS unique_fails, 0L AS good_lost, 0L AS toxic_lost
  FROM {grid}
  UNION ALL
  SELECT s.part, concat(s.prefix, f.letter), f.letter, s.step + 1, s.applied | f.bit,
         aggregate(g.cells, 0L, (t, c) -> t + if(c.mask & (s.applied | f.bit) = 0, c.n, 0L)),
         aggregate(g.cells, 0L, (t, c) -> t + if(c.mask & s.applied = 0 AND c.mask & f.bit <> 0, c.n, 0L)),
         aggregate(g.cells, 0L, (t, c) -> t + if(c.mask & s.applied <> 0 AND c.mask & f.bit <> 0, c.n, 0L)),
         aggregate(g.cells, 0L, (t, c) -> t + if(c.mask = f.bit, c.n, 0L)),
         aggregate(g.cells, 0L, (t, c) -> t + if(c.mask & s.applied = 0 AND c.mask & f.bit <> 0, c.good, 0L)),
         aggregate(g.cells, 0L, (t, c) -> t + if(c.mask & s.applied = 0 AND c.mask & f.bit <> 0, c.toxic, 0L))
  FROM steps s JOIN letters f ON s.applied & f.bit = 0 JOIN {grid} g ON g.part = s.part)
SELECT * FROM steps WHERE step > 0
"""
#: Spark ends a recursion at a million rows by default; parts times prefixes may be more.
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def filter_steps(cells: DataFrame, letters: str) -> DataFrame:
    """(part, prefix, letter, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) per prefix of any order."""
    spark = cells.sparkSession
    grid = C.write_table(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "grid")
    sql = _RECURSION.format(letters=", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters)), grid="{grid}")
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        return C.write_table(spark.sql(sql, grid=grid), "steps")
    finally:
        spark.conf.unset(_ROW_LIMIT) if before is None else spark.conf.set(_ROW_LIMIT, before)


def filter_interactions(cells: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of all ``letters`` and step, with the metrics of that step.

    ``cells`` as :func:`failure_cells` gives them; bit i is the i-th letter.
    kept: rows that fail none of the filters so far; removed: rows that this
    step takes out; redundant: rows that fail its filter and were out before;
    unique_fails: rows that fail its filter alone; good_lost, toxic_lost:
    labelled rows among the removed; shapley: the removed of its filter summed
    over all orders (a prefix of s letters begins (k - s)! of them). Without
    rows there are no parts and no rows.
    """
    k = len(letters)
    steps = filter_steps(cells, letters)
    weight = F.element_at(F.array(*(F.lit(factorial(k - s)) for s in range(1, k + 1))), F.col("step"))
    share = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    orders = steps.where(F.col("step") == k).select("part", F.col("prefix").alias("filter_order"))
    each = (orders.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
            .withColumn("prefix", F.expr("substring(filter_order, 1, step)")))
    return (each.join(steps.drop("step"), ["part", "prefix"]).join(share, ["part", "letter"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """:func:`filter_interactions` of the filters A to D of :func:`text_tests` and E, copies."""
    return filter_interactions(failure_cells(docs, labels, **columns), "ABCD" + COPY)
