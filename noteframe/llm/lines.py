"""Operator 7: line deduplication by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased). Words are ordered by
rarity; two lines within Jaccard ``t`` share a word among their first
``n - ceil(t*n) + 1`` (prefix filter), agree in length within ``t`` (length
filter) and leave enough words behind the shared one (positional filter).
What passes is verified on the sets. A line goes if an earlier one, by
(doc_id, line number), matches it.

Lines with equal sets are one class that its earliest line stands for, so
copies are settled by a minimum per class and only classes are joined. A line
is first compared with the ``FIRST`` earliest partners that a word gives it,
and with all the others only if none of these matches: groups of near copies
are not expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import U64, mix
from .phrases import LOWER, KeyFilter, key_filter, word_hashes

PERCENT = 80
#: Counters for word frequencies: fixed, so the table that tasks receive never grows.
COUNTERS = 1 << 20
SLICES = 16
#: Partners by one word that a line is compared with before all others are tried.
FIRST = 2
#: Sets that a block is asked for at once.
ASK = 100_000
#: Bits of the filter of words whose later lines are still open.
OPEN_BITS = 24
#: Buckets of the table of blocks, at most.
TABLE_BUCKETS = 4096


def _lines(ch: C.Chunk):
    """(line starts, line ends, document of each line, number of each line in its document)."""
    newline = np.flatnonzero(ch.buf == 10)
    doc_of_newline = np.searchsorted(ch.off, newline, side="right") - 1
    per_doc = np.bincount(doc_of_newline, minlength=ch.n) + 1
    first = C.offsets(per_doc)
    starts = np.empty(first[-1], np.int64)
    starts[first[:-1]] = ch.off[:-1]
    ends = np.empty(first[-1], np.int64)
    ends[first[1:] - 1] = ch.off[1:]
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[inner] = newline + 1
    inner[:] = True
    inner[first[1:] - 1] = False
    ends[inner] = newline
    doc = np.repeat(np.arange(ch.n), per_doc)
    return starts, ends, doc, np.arange(len(doc)) - first[:-1][doc]


class _Sets:
    """Word sets of the lines of a chunk that have a word, as distinct word hashes."""

    def __init__(self, ch: C.Chunk, id_col: str):
        starts, _, doc, number = _lines(ch)
        ids = ch.arrow(id_col)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        id_values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ws, we = C.word_spans(ch.buf, ch.off)
        h = word_hashes(LOWER[ch.buf], ws, we)
        cut = np.searchsorted(ws, np.r_[starts, len(ch.buf)])
        off = np.r_[cut[:-1], len(h)]
        # an empty document between two others starts where its neighbour does
        off = np.maximum.accumulate(off)
        keep = C.sort_within(h, off)
        sizes = C.segment_counts(keep, off)
        good = (sizes > 0) & known[doc]
        word_keep = keep & np.repeat(good, np.diff(off))
        self.words = h[word_keep]
        self.off = C.offsets(sizes[good])
        self.n = sizes[good]
        self.doc_id = id_values[doc[good]]
        self.line = number[good].astype(np.int32)

    def by_rarity(self, counters: np.ndarray) -> np.ndarray:
        """The words of each set in order of their frequency, then their hash."""
        often = np.minimum(counters[(self.words & U64(COUNTERS - 1)).astype(np.int64)], (1 << 24) - 1)
        words = (often.astype(U64) << U64(40)) | (self.words >> U64(24))
        C.sort_within(words, self.off)
        return words

    def prints(self) -> np.ndarray:
        """64 bits per set, by which it is named in pairs."""
        return mix(C.reduce_segments(np.add, mix(self.words), self.off, U64(0)) + self.n.astype(U64))

    def classes(self) -> np.ndarray:
        """64 more bits per set, independent of :meth:`prints`: copies are told by 128 bits."""
        return mix(C.reduce_segments(np.add, mix(self.words ^ U64(0xA5A5A5A5A5A5A5A5)), self.off, U64(0)) + U64(1))

    def sketches(self) -> np.ndarray:
        """64 parities per set: two sets differ in as many words as bits, at least."""
        return C.reduce_segments(np.bitwise_xor, np.left_shift(U64(1), self.words & U64(63)), self.off, U64(0))


def _after_first(first: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which entries lie behind the first of their run; the same line of a repeated row does not."""
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    return (doc != doc[head]) | (line != line[head])


def _sorted_classes(fp, more, doc, line):
    """The entries in order of class, document and line, and which of them begin a class."""
    order = np.lexsort((line, doc, more, fp))
    fp, more, doc, line = fp[order], more[order], doc[order], line[order]
    first = np.ones(len(fp), bool)
    first[1:] = (fp[1:] != fp[:-1]) | (more[1:] != more[:-1])
    return fp, more, doc, line, first


def _survey(blocks: DataFrame, id_col: str, text_col: str, n_buckets: int) -> DataFrame:
    """One pass: (kind, bucket, data) with 0 word counters, 1 set classes, 2 later copies within a task, 3 the ids of a block (its number as bucket)."""
    def run(batches):
        counters = np.zeros(COUNTERS, np.int64)
        held, entries, seen = [], 0, False

        def row(kind, bucket, blob):
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int64()), pa.array([blob], pa.binary())],
                                              ["kind", "bucket", "data"])

        def flush():
            fp, more, doc, line, first = _sorted_classes(*(np.concatenate(c) for c in zip(*held)))
            rows = C.pack_rows(fp[first], [fp[first].view(np.int64), more[first].view(np.int64), doc[first], line[first]], n_buckets)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(rows.num_rows, np.int32)), *rows.columns], ["kind", "bucket", "data"])
            again = _after_first(first, doc, line)
            if again.any():
                yield row(2, 0, C.pack(doc[again], line[again]))

        for block, ch, _ in C.block_chunks(batches, text_col):
            s = _Sets(ch, id_col)
            seen = True
            counters += np.bincount((s.words & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            yield row(3, block, C.pack(np.unique(ch.arrow(id_col).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))))
            held.append((s.prints(), s.classes(), s.doc_id, s.line))
            entries += len(s.line)
            if entries >= C.FLUSH_ENTRIES:
                yield from flush()
                held, entries = [], 0
        if held:
            yield from flush()
        if seen:
            parts = [C.pack(x) for x in counters.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(SLICES, np.int32)), pa.array(np.arange(SLICES)),
                                              pa.array(parts, pa.binary())], ["kind", "bucket", "data"])
    return C.write_table(blocks.mapInArrow(C.tidy(run), "kind int, bucket long, data binary"), "survey")


def _homes(survey: DataFrame) -> DataFrame:
    """(block_id, doc_id): where the rows of an id are."""
    def run(batches):
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, = C.unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids)], ["block_id", "doc_id"])
    return survey.where("kind = 3").select("bucket", "data").mapInArrow(C.tidy(run), "block_id long, doc_id long")


def _frequencies(survey: DataFrame) -> np.ndarray:
    """Word counters over all lines: COUNTERS numbers at any input size."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(C.unpack(b)[0] for b in table.column("data").to_pylist())
        return pa.table({"bucket": table.column("bucket")[:1], "data": pa.array([C.pack(total)], pa.binary())})
    rows = (survey.where("kind = 0").select("bucket", "data").groupBy("bucket")
            .applyInArrow(C.tidy(add), "bucket long, data binary").collect())
    out = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for r in rows:
        out[r["bucket"]] = C.unpack(r["data"])[0]
    return out.reshape(-1)


def _unpack_lines(batches):
    for b in batches:
        for blob in b.column(0).to_pylist():
            doc, line = C.unpack(blob)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(line)], ["doc_id", "line"])


def _copies(survey: DataFrame) -> DataFrame:
    """(doc_id, line) of lines with an earlier line of the same words."""
    local = survey.where("kind = 2").select("data").mapInArrow(C.tidy(_unpack_lines), "doc_id long, line int")

    # each task sent a class once: what a bucket gathers is bounded by tasks, not by copies
    def later(table: pa.Table) -> pa.Table:
        _, columns = C.unpack_rows(table.column("data").to_pylist())
        _, _, doc, line, first = _sorted_classes(*columns)
        again = _after_first(first, doc, line)
        return pa.table({"doc_id": doc[again], "line": line[again]})
    across = (survey.where("kind = 1").select("bucket", "data").groupBy("bucket")
              .applyInArrow(C.tidy(later), "doc_id long, line int"))
    return local.unionByName(across)


def removed_lines(blocks: DataFrame, survey: DataFrame, id_col: str, text_col: str, percent: int, n_buckets: int) -> DataFrame:
    """(doc_id, line) of every line that an earlier line matches."""
    spark = blocks.sparkSession
    # sets that can match another one than themselves: with a word more or less, at best
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 30
    counters = spark.sparkContext.broadcast(_frequencies(survey))

    def emit(batches, wanted: KeyFilter | None = None):
        sent: dict[int, tuple[int, int]] = {}  # a class again only from an earlier line
        for block, ch, _ in C.block_chunks(batches, text_col):
            s = _Sets(ch, id_col)
            fp = s.prints()
            fresh = np.zeros(len(fp), bool)
            for i, x in enumerate(zip(fp.tolist(), s.doc_id.tolist(), s.line.tolist())):
                if x[0] not in sent or x[1:] < sent[x[0]]:
                    sent[x[0]], fresh[i] = x[1:], True
            if len(sent) > 500_000:
                sent.clear()
            words, sketch = s.by_rarity(counters.value), s.sketches()
            prefix = s.n - -(-percent * s.n // 100) + 1
            row = np.repeat(np.arange(len(s.n)), s.n)
            pos = np.arange(len(row)) - s.off[:-1][row]
            take = (pos < prefix[row]) & (fresh & (s.n >= least))[row]
            row, pos, keys = row[take], pos[take], mix(words[take])
            if wanted is not None:
                open_ = wanted.has(keys << U64(32))
                row, pos, keys = row[open_], pos[open_], keys[open_]
            yield keys, [fp[row].view(np.int64), s.doc_id[row], s.line[row], s.n[row].astype(np.int32),
                                     pos.astype(np.int32), np.full(len(row), block), sketch[row].view(np.int64)]

    def in_order(blobs):
        """(bucket's keys, run, ordinal, first of run, columns): entries of shared keys, earlier lines first."""
        keys, cols, run = C.shared_entries(blobs, 1)
        fp, doc, line, n, pos, block, sketch = cols
        order = np.lexsort((line, doc, run))
        run, keys, cols = run[order], keys[order], [c[order] for c in (fp, doc, line, n.astype(np.int64), pos.astype(np.int64), block, sketch)]
        head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, int)
        first = np.repeat(head, np.diff(np.r_[head, len(run)]))
        return keys.astype(np.int64), first, np.arange(len(run)) - first, cols

    def rows_of(kind, key, bucket, cols, x, y):
        fp, doc, line, _, _, block, _ = cols
        # a line that only asks for its other partners has none yet
        none = kind == 1
        return pa.table({"kind": kind, "bucket": np.full(len(x), bucket), "key": key[x], "fp": fp[x], "doc_id": doc[x], "line": line[x],
                         "block": block[x], "fp2": pa.array(fp[y], mask=none), "block2": pa.array(block[y], mask=none)})

    def meet(table: pa.Table) -> pa.Table:
        key, first, ordinal, cols = in_order(table.column("data").to_pylist())
        fp, doc, line, n, pos, _, sketch = cols
        found, many = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        x, j = np.flatnonzero(ordinal > 0), 0
        while len(x):  # the j-th earliest of a key against all later ones that are still short of partners
            y = first[x] + j
            ok = _may_match(n[x], n[y], pos[x], pos[y], sketch[x], sketch[y], percent) & (fp[x] != fp[y]) & ((doc[x] != doc[y]) | (line[x] != line[y]))
            many[x[ok & (found[x] == FIRST)]] = True
            hit = ok & (found[x] < FIRST)
            xs.append(x[hit])
            ys.append(y[hit])
            found[x[hit]] += 1
            j += 1
            x = x[(ordinal[x] > j) & ~many[x]]
        x, y, more = np.concatenate(xs), np.concatenate(ys), np.flatnonzero(many)
        kind = np.r_[np.zeros(len(x), np.int32), np.ones(len(more), np.int32)]
        return rows_of(kind, key, table.column("bucket")[0].as_py(), cols, np.r_[x, more], np.r_[y, more])

    def meet_all(table: pa.Table, open_lines: pa.Table) -> pa.Table:
        key, first, ordinal, cols = in_order(table.column("data").to_pylist())
        fp, doc, line, n, pos, _, sketch = cols
        wanted = set(zip(open_lines.column("key").to_pylist(), open_lines.column("fp").to_pylist()))
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(np.isin(fp, open_lines.column("fp").to_numpy())):
            if (int(key[i]), int(fp[i])) in wanted:
                y = np.arange(first[i], i)
                y = y[(doc[y] != doc[i]) | (line[y] != line[i])]
                y = y[_may_match(n[i], n[y], pos[i], pos[y], sketch[i], sketch[y], percent) & (fp[y] != fp[i])]
                xs.append(np.full(len(y), i))
                ys.append(y)
        x, y = np.concatenate(xs), np.concatenate(ys)
        bucket = open_lines.column("bucket")[0].as_py() if open_lines.num_rows else 0
        return rows_of(np.zeros(len(x), np.int32), key, bucket, cols, x, y)

    schema = "kind int, bucket long, key long, fp long, doc_id long, line int, block long, fp2 long, block2 long"
    pair = ["fp", "doc_id", "line", "block", "fp2", "block2"]
    entries = C.packed(blocks.select("block_id", "data"), emit, n_buckets)
    found = C.write_table(entries.groupBy("bucket").applyInArrow(C.tidy(meet), schema), "prefixes")
    pairs = C.write_table(found.where("kind = 0").select(*pair).distinct(), "pairs")
    gone = C.write_table(_verified(pairs, blocks, id_col, text_col, percent), "gone")

    # lines that no first partner matches meet every earlier one of their words
    short = C.write_table(found.where("kind = 1").select("bucket", "key", "fp", "block").join(gone, ["fp", "block"], "left_anti")
                          .select("bucket", "key", "fp").distinct(), "short")
    lines = pairs.select("fp", "block", "doc_id", "line")
    if not short.isEmpty():
        # the words of open lines alone are sent again; the filter lets others through, but none of these is missed
        wanted = key_filter(short.selectExpr("shiftleft(key, 32) AS key"), OPEN_BITS)
        entries = C.packed(blocks.select("block_id", "data"), lambda batches: emit(batches, wanted), n_buckets)
        rest = (entries.groupBy("bucket").cogroup(short.groupBy("bucket")).applyInArrow(C.tidy(meet_all), schema)
                .select(*pair).distinct().join(pairs.select("fp", "fp2"), ["fp", "fp2"], "left_anti"))
        rest = C.write_table(rest, "pairs")
        gone = gone.unionByName(_verified(rest, blocks, id_col, text_col, percent)).distinct()
        lines = lines.unionByName(rest.select("fp", "block", "doc_id", "line"))
    unlike = lines.distinct().join(gone, ["fp", "block"]).select("doc_id", "line")
    return _copies(survey).unionByName(unlike).distinct()


def _may_match(n, n2, pos, pos2, sketch, sketch2, percent: int) -> np.ndarray:
    """Length and positional filters and the sketches' bound for lines that share the words at ``pos`` and ``pos2``.

    Words are in one order in both, so what the two can share are words from
    the shared one on, if it is the first; and a pair that shares an earlier
    word too is also met there, where this bound is no tighter.
    """
    need = -(-percent * (n + n2) // (100 + percent))
    apart = np.bitwise_count((sketch ^ sketch2).view(np.uint64)).astype(np.int64)
    return ((100 * np.minimum(n, n2) >= percent * np.maximum(n, n2)) & (np.minimum(n - pos, n2 - pos2) >= need)
            & (apart * (100 + percent) <= (100 - percent) * (n + n2)))


def _verified(pairs: DataFrame, blocks: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(fp, block) of the later lines of pairs that reach the similarity.

    The earlier line's set travels, once to each block where a later line
    asks for it; the texts stay where they are.
    """
    # a block whose lines very many others ask for is asked in parts, so that no row lists them all
    asked = pairs.select("fp2", "block2", "block").distinct()
    parts = asked.groupBy("block2").agg((F.floor(F.count("*") / ASK) + 1).alias("parts"))
    asked = (asked.join(parts, "block2").groupBy("block2", F.pmod(F.xxhash64("block"), F.col("parts")).alias("part"))
             .agg(F.collect_list(F.struct(F.col("fp2").alias("f"), F.col("block").alias("b"))).alias("asked")))

    def lend(batches):
        for _, ch, row in C.block_chunks(batches, text_col):
            s = _Sets(ch, id_col)
            rows = row["asked"].values
            fps, to = (rows.field(c).to_numpy() for c in ("f", "b"))
            mine = s.prints().view(np.int64)
            at = dict(zip(mine.tolist(), range(len(mine))))
            short = (s.words >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # 40 bits a word
            here = [at[f] for f in fps.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(fps), pa.array([short[s.off[i]:s.off[i + 1]].tobytes() for i in here], pa.binary())],
                                             ["block_id", "f", "words"])
    sets = (blocks.join(asked, blocks.block_id == asked.block2).select("block_id", "data", "asked")
            .mapInArrow(C.tidy(lend), "block_id long, f long, words binary")
            .groupBy("block_id").agg(F.collect_list(F.struct("f", "words")).alias("sets")))
    work = pairs.groupBy(F.col("block").alias("block_id")).agg(F.collect_set(F.struct("fp", "fp2")).alias("work"))

    def verify(batches):
        for block, ch, row in C.block_chunks(batches, text_col):
            s = _Sets(ch, id_col)
            mine = s.prints().view(np.int64)
            at = dict(zip(mine.tolist(), range(len(mine))))
            lent = dict(zip(row["sets"].values.field("f").to_pylist(), row["sets"].values.field("words").to_pylist()))
            words, keep = s.words >> U64(24), set()
            for x, y in zip(*(row["work"].values.field(c).to_pylist() for c in ("fp", "fp2"))):
                if x in keep:
                    continue
                i = at[x]
                mine_x = words[s.off[i]:s.off[i + 1]]
                theirs = np.zeros((len(lent[y]) // 5, 8), np.uint8)
                theirs[:, :5] = np.frombuffer(lent[y], np.uint8).reshape(-1, 5)
                inter = len(np.intersect1d(mine_x, theirs.view("<u8")[:, 0], assume_unique=True))
                if 100 * inter >= percent * (len(mine_x) + len(theirs) - inter):
                    keep.add(x)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keep), pa.int64()), pa.array([block] * len(keep), pa.int64())], ["fp", "block"])
    return (blocks.join(sets, "block_id").join(work, "block_id").select("block_id", "data", "sets", "work")
            .mapInArrow(C.tidy(verify), "fp long, block long"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                added: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` without the lines that an earlier line matches at ``percent`` Jaccard of their word sets.

    All columns of ``docs`` stay, under their names and types; two are added,
    or replaced if present, under the names ``added``: the lines of the text
    (0 for a null or empty one) and how many of them went. Lines end at a newline and are judged on the input.
    Earlier means a smaller id, or the same id and a smaller line number;
    rows that repeat an id are treated alike. Lines without a word stay, as do
    rows whose id is null. A text whose lines all go becomes empty; a null
    text stays null.
    """
    n_buckets = C.bucket_count(C.text_bytes(docs, text_col))
    source = docs.drop(*added).withColumn(text_col, C.text_column(docs, text_col)).withColumn(id_col, docs[id_col].cast("long"))
    # blocks are joined where they lie, in at most so many parts: the table's limit of buckets does not bound the input
    blocks = C.write_blocks(source, "lines", min(n_buckets, TABLE_BUCKETS), text_col)
    survey = _survey(blocks, id_col, text_col, n_buckets)
    gone = C.write_table(removed_lines(blocks, survey, id_col, text_col, percent, n_buckets), "removed")
    sent = (gone.join(_homes(survey), "doc_id")
            .groupBy("block_id").agg(F.collect_list("doc_id").alias("_docs"), F.collect_list("line").alias("_lines")))
    schema = source.schema

    def rewrite(batches):
        for _, ch, row in C.block_chunks(batches, text_col):
            starts, ends, doc, number = _lines(ch)
            ids = ch.arrow(id_col).to_pylist()
            drop = set(zip(row["_docs"].as_py() or (), row["_lines"].as_py() or ()))
            text, raw = [], ch.buf.tobytes()
            col = ch.arrow(text_col)
            valid = col.is_valid().to_numpy(zero_copy_only=False)
            n_lines, n_gone = np.zeros(ch.n, np.int64), np.zeros(ch.n, np.int64)
            at = 0
            for d in range(ch.n):
                end = at
                while end < len(doc) and doc[end] == d:
                    end += 1
                kept = [i for i in range(at, end) if (ids[d], int(number[i])) not in drop]
                whole = raw[ch.off[d]:ch.off[d + 1]]
                n_lines[d] = end - at if whole else 0
                n_gone[d] = end - at - len(kept)
                text.append(None if not valid[d] else whole if len(kept) == end - at
                            else b"\n".join(raw[starts[i]:ends[i]] for i in kept))
                at = end
            columns = [pa.array(text, pa.binary()).cast(pa.string()) if f.name == text_col else ch.arrow(f.name)
                       for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(n_lines), pa.array(n_gone)],
                                             [*schema.names, *added])

    from pyspark.sql.types import LongType, StructType
    out = StructType(list(schema.fields)).add(added[0], LongType()).add(added[1], LongType())
    return (blocks.join(sent, "block_id", "left").select("block_id", "data", "_docs", "_lines")
            .mapInArrow(C.tidy(rewrite), out))
