"""Names of a table replaced in texts, against a plain left-to-right search."""

import random
import re

import pytest

from noteframe.operators import names as N
from noteframe.operators.nlp import TOKEN_RX

# Python's re lacks \p classes; its \w is letters, marks (few), digits and underscore, as these texts need
TOKEN = re.compile(r"\w+|[^\w\s]")
NAMES = [("Anna", "PERSON"), ("Anna de Vries", "PERSON"), ("de Vries", "PERSON"), ("New York", "GPE"), ("New York City", "GPE"),
         ("York", "GPE"), ("Vries New", "ORG"), ("Customer#1", "PERSON"), ("Customer#10", "PERSON"), ("O'Neil", "PERSON"), ("É.", "PERSON"),
         ("a b c d e f", "PERSON"), ("York", "CITY"), (" ", "X"), ("", "X"), (None, "X")]


def by_hand(text, names, fold=str):
    table = {}
    for n, label in names:
        key = tuple(fold(t) for t in TOKEN.findall(n or ""))
        if key:
            table[key] = min(label, table.get(key, label))
    spans = [m.span() for m in TOKEN.finditer(text)]
    out, at, i = [], 0, 0
    while i < len(spans):
        for n in range(min(len(spans) - i, max(map(len, table))), 0, -1):
            key = tuple(fold(text[a:z]) for a, z in spans[i:i + n])
            if key in table:
                out += [text[at:spans[i][0]], table[key]]
                at, i = spans[i + n - 1][1], i + n
                break
        else:
            i += 1
    return "".join(out) + text[at:], len(spans)


def texts():
    rng = random.Random(6)
    words = ["Anna", "de", "Vries", "New", "York", "City", "Customer#1", "Customer#10", "Customer#100", "Annas", "O'Neil", "É.", "a b c d e f",
             "a b c d e", "x", "anna", ",", ".", "york"]
    out = ["", "Anna", "Anna de Vries New York City", "de Vries New York", "Anna  de\nVries", " New\tYork ", "YorkNew York"]
    for _ in range(250):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "", ", "]) for _ in range(rng.randrange(30))))
    return out + ["Anna de Vries " * 3000]


@pytest.mark.parametrize("ignore_case", [False, True])
def test_replaces_as_a_plain_search(spark, ignore_case):
    rows = [(i if i % 4 else None, t, "k") for i, t in enumerate(texts())] + [(1, None, "k"), (2, "Anna", "k"), (2, "Anna", "k")]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    table = spark.createDataFrame(NAMES, "name string, label string")
    got = N.anonymize_names(df, table, ignore_case=ignore_case)
    assert got.columns == ["id", "label", "text", "len_text"]
    want = [(i, lab, *(by_hand(t, NAMES, str.lower if ignore_case else str) if t is not None else (None, None))) for i, t, lab in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert TOKEN_RX  # the library's tokens


def test_output_columns_and_no_names(spark):
    df = spark.createDataFrame([(1, "Anna in York")], "id long, text string")
    table = spark.createDataFrame(NAMES, "name string, label string")
    r = N.anonymize_names(df, table, "text", "masked", "n").first()
    assert (r["text"], r["masked"], r["n"]) == ("Anna in York", "PERSON in CITY", 3)
    assert N.anonymize_names(df, table.limit(0)).first()["text"] == "Anna in York"
    assert N.anonymize_names(df.limit(0), table).count() == 0


def test_a_long_table(spark):
    table = spark.range(20000).selectExpr("concat('name', id, ' of place', id % 7) AS name", "'P' AS label")
    df = spark.createDataFrame([(f"name{i} of place{i % 9} and name{i}",) for i in range(200)], "text string")
    got = {r["text"] for r in N.anonymize_names(df, table).collect()}
    assert got == {(f"P and name{i}" if i % 9 == i % 7 else f"name{i} of place{i % 9} and name{i}") for i in range(200)}


def test_places_come_from_a_join(spark):
    names = spark.createDataFrame([(f"n{i} x", "P") for i in range(3000)], "name string, label string")
    text = " \t" + "\n".join(f"n{i}  x, y" for i in range(3000)) + "  "
    made = N.anonymize_names(spark.createDataFrame([(1, text), (2, ""), (3, "  "), (4, None), (5, "a n1")], "id int, text string"), names)
    assert "element_at(_firsts" not in made._jdf.queryExecution().optimizedPlan().toString()  # a lookup is as long as a text's first tokens are many
    got = {r["id"]: (r["text"], r["len_text"]) for r in made.collect()}
    assert got == {1: (" \t" + "\n".join(["P, y"] * 3000) + "  ", 12000), 2: ("", 0), 3: ("  ", 0), 4: (None, None), 5: ("a n1", 2)}
