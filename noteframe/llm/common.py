"""Helpers shared by the training-data operators.

Texts are handled inside tasks as Arrow buffers: one ``uint8`` array per
chunk of documents plus document offsets, so that every per-byte step is a
numpy expression and memory is bounded by ``CHUNK_BYTES`` (a longer single
document is its own chunk). Spark does the distribution: scans, shuffles,
joins and aggregations.

Tables that a later job reads again are written to the shared folder that
``spark.checkpoint.dir`` names, which survives a lost executor.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteframe.session import ensure_checkpoint_dir

#: Text bytes that one numpy step works on at once.
CHUNK_BYTES = 1 << 20
#: Text bytes of a stored block.
BLOCK_BYTES = 2 << 20
#: Entries that a task collects before it writes its packed rows.
FLUSH_ENTRIES = 1_000_000
#: Text bytes that one bucket of a packed exchange stands for.
BUCKET_TEXT_BYTES = 8 << 20

U64 = np.uint64


def _own_heap() -> None:
    """Keep Python workers' arrays on one heap, which :func:`tidy` can give back (glibc; elsewhere nothing changes)."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    for option, value in ((-3, 32 << 20), (-1, 256 << 20), (-8, 1)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
        mallopt(option, value)
    pa.set_memory_pool(pa.system_memory_pool())


_own_heap()


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(fn: Callable) -> Callable:
    """``fn`` for mapInArrow (a generator) or applyInArrow, which gives its memory back at its end.

    Idle workers stay for later tasks and would otherwise hold the most that
    any task needed."""
    if inspect.isgeneratorfunction(fn):
        @functools.wraps(fn)
        def run(batches):
            yield from fn(batches)
            _trim()
    elif len(inspect.signature(fn).parameters) == 2:  # cogrouped
        @functools.wraps(fn)
        def run(left, right):
            out = fn(left, right)
            _trim()
            return out
    else:
        @functools.wraps(fn)
        def run(table):
            out = fn(table)
            _trim()
            return out
    return run


# ---------------------------------------------------------------- tables

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship_code(spark: SparkSession) -> None:
    """Send this package to the session's Python workers once (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if getattr(sc, "_noteframe_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="noteframe-code-"), "noteframe.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "noteframe")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(target)
    sc._noteframe_shipped = True


def text_column(docs: DataFrame, text_col: str = "text"):
    """The text as string; a table without rows may carry it as void."""
    return docs[text_col].cast("string")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage durably."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_blocks(docs: DataFrame, name: str, n_buckets: int, text_col: str = "text") -> DataFrame:
    """(block_id, data): the rows of ``docs`` as compressed record batches of ``BLOCK_BYTES`` of text.

    The table is bucketed by block, so joins that send something back to the
    texts move only what is sent, not the texts.
    """
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, name)
    table = f"llm_{name}_{uuid.uuid4().hex}"

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for i, ch in enumerate(chunks(batches, text_col, BLOCK_BYTES)):
            yield pa.RecordBatch.from_arrays([pa.array([first + i], pa.int64()), pa.array([to_blob(ch.batch)], pa.binary())],
                                             ["block_id", "data"])

    (docs.mapInArrow(tidy(run), "block_id long, data binary")
         .write.option("compression", "uncompressed").option("path", path)
         .bucketBy(n_buckets, "block_id").saveAsTable(table))
    return spark.table(table)


def to_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        # a slice would carry the whole batch's buffers
        writer.write_batch(pa.concat_batches([batch.slice(0, 0), batch]) if batch.num_rows else batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def from_blob(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_next_batch()


def block_chunks(batches: Iterator[pa.RecordBatch], text_col: str = "text"):
    """(block_id, chunk, other columns' values) of each block row."""
    for rows in batches:
        names = rows.schema.names
        for i in range(rows.num_rows):
            row = {n: rows.column(k)[i] for k, n in enumerate(names)}
            yield row["block_id"].as_py(), Chunk(from_blob(row["data"].as_py()), text_col), row


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total text bytes, from which bucket counts are derived."""
    row = docs.agg(F.sum(F.octet_length(text_column(docs, text_col))).alias("n")).first()
    return int(row["n"] or 0)


def bucket_count(n_bytes: int, per_bucket: int = BUCKET_TEXT_BYTES) -> int:
    return max(1, -(-n_bytes // per_bucket))


# ---------------------------------------------------------------- chunks of texts

class Chunk:
    """Some documents of one Arrow batch: bytes, offsets and the other columns."""

    def __init__(self, batch: pa.RecordBatch, text_col: str):
        i = batch.schema.get_field_index(text_col)
        col = batch.column(i).cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
        data = col.buffers()[2]
        self.n = len(col)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf = whole[off[0]:off[-1]]
        self.off = off - off[0]
        self.batch = batch
        # a null may still span bytes in a sliced buffer; offsets of nulls are empty by Arrow's writers

    def column(self, name: str) -> np.ndarray:
        return self.batch.column(self.batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    def arrow(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))


def chunks(batches: Iterator[pa.RecordBatch], text_col: str = "text",
           max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut Arrow batches into chunks of at most ``max_bytes`` of text (or one document)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = Chunk(batch, text_col).off
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(off, off[a] + max_bytes, side="right")) - 1
            b = min(max(b, a + 1), batch.num_rows)
            yield Chunk(batch.slice(a, b - a), text_col)
            a = b


# ---------------------------------------------------------------- hashing and words

def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE_VALUE_LOWER = _BYTE_VALUE[_LOWER]
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    t = _powers.get(base)
    if t is None or len(t) < n:
        t = np.full(max(n, CHUNK_BYTES + 1), base, U64)
        t[0] = 1
        _powers[base] = t = np.multiply.accumulate(t)
        if len(t) > 4 * CHUNK_BYTES:  # an outsized document: do not keep its table
            _powers.pop(base)
    return t[:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each byte span (equal spans, equal hashes, wherever they stand)."""
    values = (_BYTE_VALUE_LOWER if lower else _BYTE_VALUE)[buf]
    values *= _power_table(_BASE, len(buf))
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(values, out=total[1:])
    h = total[ends] - total[starts]
    h *= _power_table(_BASE_INVERSE, len(buf) + 1)[starts]
    h += (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)
    return mix(h)


def word_spans(buf: np.ndarray, off: np.ndarray, extra_breaks: np.ndarray | None = None):
    """Starts and ends of the words (runs of non-separators) that never cross a document."""
    word = ~_SEPARATOR[buf]
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    if extra_breaks is not None:
        cut[extra_breaks] = True
    first, last = word.copy(), word.copy()
    if n:
        first[1:] &= ~word[:-1] | cut[1:n]
        last[:-1] &= ~word[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def sort_within(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sort each segment in place; returns the mask of each segment's first copies."""
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    if len(values):
        keep[1:] = values[1:] != values[:-1]
        keep[off[:-1][off[:-1] < len(values)]] = True
    return keep


def segment_counts(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def offsets(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def reduce_segments(ufunc, values: np.ndarray, off: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over each segment; ``empty`` for segments without values."""
    out = np.full(len(off) - 1, empty, values.dtype)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, off[:-1][full])
    return out


# ---------------------------------------------------------------- packed columns

def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Columns as one compressed blob, byte plane by byte plane."""
    head = np.array([len(arrays)] + [len(a) for a in arrays], "<i8").tobytes()
    kinds = b"".join(a.dtype.str.encode().ljust(8) for a in arrays)
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
              for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(head + kinds + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    lens = np.frombuffer(raw, "<i8", k, 8)
    at, out = 8 + 8 * k, []
    kinds = [raw[at + 8 * i:at + 8 * i + 8].strip().decode() for i in range(k)]
    at += 8 * k
    for n, kind in zip(lens.tolist(), kinds):
        size = np.dtype(kind).itemsize
        plane = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(kind))
        at += n * size
    return out


def to_bucket(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(n_buckets)) >> U64(32)


KEY_BITS = 32
KEY_MASK = U64((1 << KEY_BITS) - 1)


def pack_rows(keys: np.ndarray, columns: list[np.ndarray], n_buckets: int) -> pa.RecordBatch:
    """One packed row per bucket that the keys fall in; 32 key bits stay beside the bucket."""
    order = np.argsort(keys)
    keys = keys[order]
    bucket = to_bucket(keys, n_buckets).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, int)
    last = np.r_[first[1:], len(keys)].astype(int)
    columns = [c[order] for c in columns]
    low = (keys & KEY_MASK).astype(np.uint32)
    order = np.lexsort((low, bucket))  # neighbouring keys are near: they compress
    low, columns = low[order], [c[order] for c in columns]
    steps = low.copy()
    steps[1:] -= low[:-1]
    steps[first] = low[first]
    blobs = [pack(steps[a:b], *(c[a:b] for c in columns)) for a, b in zip(first, last)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int64()), pa.array(blobs, pa.binary())],
                                      ["bucket", "data"])


def unpack_keys(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint32).astype(U64)


def unpack_rows(blobs) -> tuple[np.ndarray, list[np.ndarray]]:
    parts = [unpack(b) for b in blobs]
    cols = [np.concatenate(c) for c in zip(*(p[1:] for p in parts))]
    return np.concatenate([unpack_keys(p[0]) for p in parts]), cols


def packed(df: DataFrame, emit: Callable, n_buckets: int) -> DataFrame:
    """(bucket, data): what ``emit(batches)`` yields as ``(keys, [column arrays])``, packed per task and bucket.

    Keys travel sorted and compressed, so that the many that occur once never
    become rows. A bucket stands for ``BUCKET_TEXT_BYTES`` of text at any
    input size.
    """
    def to_rows(batches):
        held, n = [], 0
        for keys, cols in emit(batches):
            held.append((keys, cols))
            n += len(keys)
            if n >= FLUSH_ENTRIES:
                yield _flush(held, n_buckets)
                held, n = [], 0
        if n:
            yield _flush(held, n_buckets)
    return df.mapInArrow(tidy(to_rows), "bucket long, data binary")


def shared_entries(blobs, item: int):
    """(keys, columns, run number) of the entries in a bucket whose key also occurs with another item, sorted.

    The first ``item`` columns name the item; of entries that repeat a key and
    an item the least by columns stays.
    """
    keys, cols = unpack_rows(blobs)
    order = np.lexsort((*reversed(cols), keys))
    keys, cols = keys[order], [c[order] for c in cols]
    again = np.r_[False, keys[1:] == keys[:-1]]
    same = again.copy()
    for c in cols[:item]:
        same &= np.r_[False, c[1:] == c[:-1]]
    run = np.cumsum(~again) - 1
    items = np.bincount(run, ~same) if len(keys) else np.zeros(0)
    keep = (items[run] > 1) & ~same
    return keys[keep], [c[keep] for c in cols], run[keep]


def shared_keys(df: DataFrame, emit: Callable, columns: dict[str, str], n_buckets: int,
                item: int = 1) -> DataFrame:
    """Entries of :func:`packed` whose key also occurs with another item: (key, *columns).

    A key is unique within 32 bits and its bucket, so that now and then two
    keys meet: callers verify what they find.
    """
    names = list(columns)

    def reduce(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, cols, _ = shared_entries(table.column("data").to_pylist(), item)
        full = (U64(bucket) << U64(KEY_BITS)) | keys
        arrays = [pa.array(full.astype(np.int64))] + [pa.array(c) for c in cols]
        return pa.Table.from_arrays(arrays, ["key", *names]).cast(out_arrow)

    kinds = {"long": pa.int64(), "int": pa.int32()}
    out_arrow = pa.schema([("key", pa.int64())] + [(c, kinds[t]) for c, t in columns.items()])
    schema = "key long, " + ", ".join(f"{c} {t}" for c, t in columns.items())
    return packed(df, emit, n_buckets).groupBy("bucket").applyInArrow(tidy(reduce), schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int):
    """The rows of each group, as columns of numpy arrays (binary columns: lists).

    For partitions that hold whole groups, sorted by the first ``n_keys``
    columns: many small groups cost no call each, and no more than one group
    and one Arrow batch is in memory.
    """
    def columns(table):
        return [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in table.columns]

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        n = table.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for i in range(n_keys):
            k = table.column(i).to_numpy()
            new[1:] |= k[1:] != k[:-1]
        cut = np.flatnonzero(new)
        if not len(cut):
            held = table
            continue
        held = table.slice(int(cut[-1]))
        cols = columns(table.slice(0, int(cut[-1])))
        for a, b in zip(np.r_[0, cut[:-1]].tolist(), cut.tolist()):
            yield [c[a:b] for c in cols]
    if held is not None and held.num_rows:
        yield columns(held)


def _flush(held: list, n_buckets: int) -> pa.RecordBatch:
    keys = np.concatenate([k for k, _ in held])
    cols = [np.concatenate(c) for c in zip(*(c for _, c in held))]
    return pack_rows(keys, cols, n_buckets)


# ---------------------------------------------------------------- components

def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that an edge (a, b) names: the smallest id reachable.

    Label propagation with pointer jumping: each round takes the smallest
    label among the neighbours and then the label's own label, so that a
    chain of n ids needs about log n rounds. Every round is a shuffled
    aggregation with map-side combine and is written to the shared folder.
    """
    both = write_table(edges.select("a", "b").where("a <> b")
                       .unionByName(edges.where("a <> b").selectExpr("b AS a", "a AS b")).distinct(), "edges")
    labels = write_table(both.groupBy(F.col("a").alias("id"))
                         .agg(F.min("b").alias("m"))
                         .select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = (both.join(labels, both.a == labels.id)
                .groupBy(F.col("b").alias("id")).agg(F.min("component").alias("near")))
        step = (labels.join(near, "id")
                .select("id", "component", F.least("component", "near").alias("c")))
        jump = step.select(F.col("id").alias("c"), F.col("c").alias("up"))
        new = write_table(step.join(jump, "c", "left")
                          .select("id", F.least("c", F.coalesce("up", "c")).alias("component"),
                                  (F.least("c", F.coalesce("up", "c")) < F.col("component")).alias("moved")),
                          "labels")
        labels = new.select("id", "component")
        if new.where("moved").isEmpty():
            return labels
