"""Delimited files with line breaks in quotes, scanned in byte ranges.

Spark's ``multiLine`` reader makes one task of a file, because only the start
of the file tells whether a line break is inside quotes. Here a file is many
tasks:

1. Every range (Spark's own file splits of plain lines) is read under both
   assumptions, "begins outside" and "begins inside quotes". A line is a
   function of two states, and so is a range; it is one row, with the number of
   records that begin in it and the pieces of records at its two ends.
2. A window over the ranges of a file composes these functions, which gives the
   state at the start of each range and, by a prefix sum, the number of its
   first record in file order.
3. Every range is read again in its true state and gives its whole records;
   records that cross ranges are put together from the pieces.

No text is shuffled. Records go through Spark's ``from_csv``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteframe.session import write_shared

# states of the reader within a line
_FIELD, _PLAIN, _QUOTED, _CLOSED = range(4)
# bits of a line's code: inside quotes after it, if it began outside; if it began inside; nothing on it
OUT, IN, BLANK = 1, 2, 4


def _literal(sign: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in sign)


def _inside_after(line: Column, entry: int, sep: str, quote: str) -> Column:
    """Whether a line that begins in state ``entry`` ends inside quotes.

    A quote opens a field only at its start, is literal in a plain field, and
    closes a quoted one unless doubled."""
    def text(state, part):
        return (F.when((state == _QUOTED) | (part == ""), state).when(part.endswith(sep), F.lit(_FIELD)).otherwise(F.lit(_PLAIN)))

    def after_quote(state):
        return (F.when(state == _FIELD, F.lit(_QUOTED)).when(state == _QUOTED, F.lit(_CLOSED))
                .when(state == _CLOSED, F.lit(_QUOTED)).otherwise(state))
    parts = F.split(line, _literal(quote))
    first = text(F.lit(entry), F.element_at(parts, 1))
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), first, lambda s, p: text(after_quote(s), p)) == _QUOTED


def line_codes(line: Column, sep: str, quote: str, escape: str | None) -> Column:
    """The function of two states that a line is, and whether it is blank, as bits."""
    seen = line if escape in (None, quote) else F.regexp_replace(line, f"(?s){_literal(escape)}.", "")
    out, inside = (F.when(F.instr(line, quote) == 0, F.lit(entry == _QUOTED)).otherwise(_inside_after(seen, entry, sep, quote))
                   for entry in (_FIELD, _QUOTED))
    return (out.cast("int") * OUT + inside.cast("int") * IN + (line.isin("", "\r")).cast("int") * BLANK).cast("tinyint")


def scan_lines(spark: SparkSession, path: str, sep: str, quote: str, escape: str | None, encoding: str) -> DataFrame:
    """(file, start, at, line, code): lines with their break, in file order within a range."""
    raw = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding.upper().replace("-", "") in ("UTF8", "UTF8SIG") else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                      F.monotonically_increasing_id().alias("at"), F.concat(value, F.lit("\n")).alias("line"),
                      line_codes(value, sep, quote, escape).alias("code"))


# ---------------------------------------------------------------- records of a range

def walk(code: np.ndarray, entry: int) -> tuple[np.ndarray, np.ndarray]:
    """State (1: inside quotes) before and after each line, from the state before the first."""
    out, inside = code & OUT, (code & IN) >> 1
    fixed = out == inside  # the line ends in this state however it began
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(code)), -1))
    turns = np.cumsum(out > inside)
    known = last >= 0
    base = np.where(known, out[last], entry)
    after = base ^ ((turns - np.where(known, turns[last], 0)) & 1)
    return np.r_[entry, after[:-1]], after


class Range:
    """The records of a range, fed with runs of lines: whole ones come back, the ends stay."""

    def __init__(self, entry: int):
        self.entry = self.state = entry
        self.head, self.tail, self.starts = b"", b"", 0

    def feed(self, data: np.ndarray, off: np.ndarray, code: np.ndarray, want: bool = True):
        """(number, text) arrays of the records that end in these lines and began in the range."""
        before, after = walk(code, self.state)
        ends = np.flatnonzero(after == 0)
        starts = np.flatnonzero((before == 0) & (code & BLANK == 0))
        number, texts = np.zeros(0, np.int64), pa.array([], pa.string())
        if self.state:  # lines of the record that is open
            until = int(ends[0]) + 1 if len(ends) else len(code)
            more = data[off[0]:off[until]].tobytes()
            if self.starts:
                self.tail += more
                if len(ends):
                    number, texts = np.array([self.starts - 1]), pa.array([self.tail.decode("utf-8")])
                    self.tail = b""
            else:
                self.head += more
        e = np.searchsorted(ends, starts)
        whole = e < len(ends)
        first, last = starts[whole], ends[e[whole]] + 1
        if want and len(first):
            size = off[last] - off[first]
            new = np.zeros(len(first) + 1, np.int64)
            np.cumsum(size, out=new[1:])
            take = np.arange(new[-1]) + np.repeat(off[first] - new[:-1], size)
            made = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(new.tobytes()), pa.py_buffer(data[take].tobytes()))
            number = np.r_[number, self.starts + np.flatnonzero(whole)]
            texts = pa.concat_arrays([texts, made.cast(pa.string())])
        if len(starts) and not whole[-1]:
            self.tail = data[off[starts[-1]]:off[-1]].tobytes()
        self.starts += len(starts)
        self.state = int(after[-1]) if len(after) else self.state
        return number, texts


def _runs(batches):
    """(file, start, first of its range, other columns' batch, bytes, offsets, codes) for each run of lines of one range."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        file, start = (b.column(b.schema.get_field_index(c)) for c in ("file", "start"))
        at = start.to_numpy()
        name = file.dictionary_encode().indices.to_numpy()
        cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (name[1:] != name[:-1])])
        for a, z in zip(cut.tolist(), np.r_[cut[1:], len(at)].tolist()):
            part = b.slice(a, z - a)
            line = part.column(b.schema.get_field_index("line")).cast(pa.large_binary())
            off = np.frombuffer(line.buffers()[1], np.int64)[line.offset:line.offset + len(line) + 1]
            data = np.frombuffer(line.buffers()[2], np.uint8)
            key = (file[a].as_py(), int(at[a]))
            yield key, key != held, part, data, off, part.column(b.schema.get_field_index("code")).to_numpy().astype(np.int64)
            held = key


def survey_ranges(lines: DataFrame) -> DataFrame:
    """(file, start, entry, leave, starts, head, tail): two rows a range, one for each state that it may begin in."""
    def run(batches):
        now, key = None, None

        def rows():
            return pa.RecordBatch.from_pylist(
                [{"file": key[0], "start": key[1], "entry": r.entry, "leave": r.state, "starts": r.starts,
                  "head": r.head.decode("utf-8"), "tail": r.tail.decode("utf-8")} for r in now],
                pa.schema([("file", pa.string()), ("start", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()),
                           ("starts", pa.int64()), ("head", pa.string()), ("tail", pa.string())]))
        for k, new, _, data, off, code in _runs(batches):
            if new:
                if now:
                    yield rows()
                now, key = [Range(0), Range(1)], k
            for r in now:
                r.feed(data, off, code, want=False)
        if now:
            yield rows()
    return lines.select("file", "start", "line", "code").mapInArrow(
        run, "file string, start long, entry int, leave int, starts long, head string, tail string")


def place_ranges(survey: DataFrame, name: Column) -> DataFrame:
    """(file, start, name, entry, leave, starts, head, tail, first, owner): the row of each range's true state.

    ``first`` is the number of its first record among those of ``name``, files
    in the order of their paths; ``owner`` the start of the range in which the
    record that is open at its start began. One row a range is windowed.
    """
    both = survey.groupBy("file", "start").agg(*[F.max(F.when(F.col("entry") == e, F.col("leave"))).alias(f"f{e}") for e in (0, 1)])
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turned = both.withColumn("turns", F.sum((F.col("f0") > F.col("f1")).cast("int")).over(upto))
    fixed = F.when(F.col("f0") == F.col("f1"), F.struct("f0", "turns"))
    state = turned.withColumn("fixed", F.last(fixed, ignorenulls=True).over(past)).withColumn("t", F.lag("turns", 1, 0).over(
        Window.partitionBy("file").orderBy("start")))
    entry = (F.coalesce("fixed.f0", F.lit(0)) + F.col("t") - F.coalesce("fixed.turns", F.lit(0))) % 2
    true = state.select("file", "start", entry.cast("int").alias("entry")).join(survey, ["file", "start", "entry"])
    in_name = Window.partitionBy("name").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    return (true.withColumn("name", name)
            .withColumn("first", F.coalesce(F.sum("starts").over(in_name), F.lit(0)))
            .withColumn("owner", F.last(F.when(F.col("starts") > 0, F.col("start")), ignorenulls=True).over(past)))


def whole_records(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, name, row, record): records that begin and end in one range."""
    def run(batches):
        now = None
        for key, new, part, data, off, code in _runs(batches):
            col = {c: part.column(part.schema.get_field_index(c)) for c in ("file", "name", "entry", "first")}
            if new:
                now = Range(col["entry"][0].as_py())
            number, texts = now.feed(data, off, code)
            n = len(number)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array([col["name"][0].as_py()] * n, pa.string()),
                 pa.array(number + col["first"][0].as_py()), texts], ["file", "name", "row", "record"])
    known = ranges.select("file", "start", "name", "first", F.col("entry").alias("_entry"))
    lost = F.raise_error(F.lit("the files were split in other ranges than before: scan them again"))
    placed = (lines.join(known, ["file", "start"], "left")
              .withColumn("entry", F.coalesce("_entry", lost.cast("int"))).drop("_entry"))
    # a range's lines are in one task; only a join by shuffle would have changed their order
    return (placed.sortWithinPartitions("file", "start", "at").select("file", "start", "name", "entry", "first", "line", "code")
            .mapInArrow(run, "file string, name string, row long, record string"))


def crossing_records(ranges: DataFrame) -> DataFrame:
    """(file, name, row, record): records that end in a later range, or never."""
    tails = ranges.where("leave = 1 AND starts > 0").select(
        "file", F.col("start").alias("owner"), F.col("start").alias("at"), "name", (F.col("first") + F.col("starts") - 1).alias("row"),
        F.col("tail").alias("piece"))
    heads = ranges.where("entry = 1").select("file", "owner", F.col("start").alias("at"), F.lit(None).cast("string").alias("name"),
                                             F.lit(None).cast("long").alias("row"), F.col("head").alias("piece"))
    return (tails.unionByName(heads).groupBy("file", "owner")
            .agg(F.max("name").alias("name"), F.max("row").alias("row"),
                 F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
            .select("file", "name", "row", F.concat_ws("", F.transform("p", lambda x: x["piece"])).alias("record")))


def scan_records(spark: SparkSession, path: str, sep: str = ";", quote: str = '"', escape: str | None = None,
                 encoding: str = "UTF-8", name: Column | None = None) -> DataFrame:
    """(file, name, row, record) of the delimited files under ``path``.

    ``row`` numbers the records of a file from 0 in file order; blank lines
    between records are none. ``name``, an expression over ``file``, may join
    several files, in the order of their paths, to one numbering (default: each
    file its own). ``escape`` is a sign that takes the meaning of the next one
    away; without it a doubled quote is a quote. The encoding must keep ASCII
    bytes as they are. The first pass, a job over the files that leaves a row a
    range, runs when this is called; its result is written to the shared folder.
    """
    if len(sep) != 1 or len(quote) != 1 or (escape is not None and len(escape) != 1):
        raise ValueError("separator, quote and escape are single signs")
    lines = scan_lines(spark, path, sep, quote, escape, encoding)
    survey = write_shared(survey_ranges(lines), "range-survey")
    ranges = write_shared(place_ranges(survey, F.col("file") if name is None else name), "ranges")
    both = whole_records(lines, ranges).unionByName(crossing_records(ranges))
    return both.withColumn("record", F.regexp_replace("record", r"\r?\n\z", ""))


def read_quoted_csv(spark: SparkSession, path: str, sep: str = ";", quote: str = '"', escape: str | None = None,
                    encoding: str = "UTF-8", n_columns: int | None = None, name: Column | None = None) -> DataFrame:
    """Headerless delimited files as strings ``_c0``, ``_c1``, ... with ``file``, ``name`` and ``row`` of :func:`scan_records`.

    Missing fields are null and further ones dropped, as in Spark's reader.
    ``n_columns`` defaults to the fields of the first record of the first file.
    """
    records = scan_records(spark, path, sep, quote, escape, encoding, name)
    options = {"sep": sep, "quote": quote, "escape": escape or quote}
    if n_columns is None:
        first = records.where("row = 0").agg(F.min_by("record", "file").alias("record")).first()["record"]
        n_columns = 0 if first is None else len(re.findall(r"`?_c\d+`?:? ", spark.range(1).select(
            F.schema_of_csv(F.lit(first), options)).first()[0]))
    schema = ", ".join(f"_c{i} STRING" for i in range(n_columns))
    fields = [F.col(f"_r._c{i}").alias(f"_c{i}") for i in range(n_columns)]
    if not fields:
        return records.select("file", "name", "row")
    return records.withColumn("_r", F.from_csv("record", schema, options)).select(*fields, "file", "name", "row")
