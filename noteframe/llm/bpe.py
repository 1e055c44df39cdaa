"""Operator 9: byte-level BPE through a table of distinct words.

Texts are split into the tokenizer's words once. Each block of texts keeps
the positions as numbers of its distinct words and sends these words, packed,
to buckets by hash; there every distinct word of the corpus is encoded once,
and its ids return to the blocks, which put them back by position. Decoding
looks ids up in the id-to-piece table of the vocabulary, whose size is the
vocabulary's.

The splitting is the byte-level pattern (contractions; runs of letters,
numbers or other signs with one blank in front; white space), as array steps
over code points. Special tokens' strings are cut out first, as the
tokenizers library does.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import U64

#: Text of a block, whose distinct words travel once; texts are split a chunk at a time.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Compression of what is stored and sent.
LEVEL = 6
SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)

# fixed values: the code points with the White_Space property
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
               0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# fixed values: letters of a contraction, after the apostrophe
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    kind = np.array([LETTER if c[0] == "L" else NUMBER if c[0] == "N" else OTHER
                     for c in map(unicodedata.category, map(chr, range(0x110000)))], np.uint8)
    kind[WHITE_SPACE] = SPACE
    return kind


@functools.lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


@functools.lru_cache(4)
def _specials(path: str) -> dict[bytes, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"].encode(): t["id"] for t in json.load(f)["added_tokens"]}


@functools.lru_cache(4)
def _pieces(path: str):
    """(bytes of all pieces, offsets by id)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    tok = _tokenizer(path)
    special = {i: s for s, i in _specials(path).items()}
    words = [b""] * (max(tok.get_vocab().values(), default=-1) + 1)
    for piece, i in tok.get_vocab().items():
        words[i] = special[i] if i in special else bytes(byte_of[c] for c in piece)
    return np.frombuffer(b"".join(words), np.uint8), C.offsets(np.array([len(w) for w in words], np.int64))


def split(buf: np.ndarray, off: np.ndarray, specials=()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, is special) of the words, in bytes; ``off`` are the documents' offsets."""
    raw = buf.tobytes()
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    n = len(cp)
    byte = np.r_[np.flatnonzero((buf & 0xC0) != 0x80), len(buf)]
    kind = _classes()[cp].copy()
    cut = np.zeros(n + 1, bool)
    cut[np.searchsorted(byte, off)] = True
    for s in specials:
        at = raw.find(s)
        while at >= 0:
            d = np.searchsorted(off, at, side="right")
            if at + len(s) <= off[d]:  # not across documents
                a, z = np.searchsorted(byte, [at, at + len(s)])
                kind[a:z] = SPECIAL
                cut[[a, z]] = True
                at = raw.find(s, at + len(s))
            else:
                at = raw.find(s, at + 1)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    start = cut[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(start)
    last = np.r_[first[1:], n]
    k = kind[first]
    followed = ~cut[last]  # the run is followed by another of its segment
    # the last sign of white space goes to the next run if it is a blank, else alone
    w = np.flatnonzero((k == SPACE) & followed)
    x = last[w] - 1
    start[x] = True
    blank = x[cp[x] == 0x20]
    start[blank + 1] = False
    # contractions: a lone apostrophe that starts a word, and letters
    lone = first[(k == OTHER) & followed & (last - first == 1)]
    lone = lone[(cp[lone] == 0x27) & start[lone]]
    if len(lone):
        nxt = np.searchsorted(first, lone) + 1
        lone, nxt = lone[k[nxt] == LETTER], nxt[k[nxt] == LETTER]
        room = last[nxt] - first[nxt]
        one = np.isin(cp[lone + 1], [ord(c) for c in ONE_LETTER])
        second = cp[np.minimum(lone + 2, n - 1)]
        two = np.zeros(len(lone), bool)
        for a, b in TWO_LETTERS:
            two |= (cp[lone + 1] == ord(a)) & (second == ord(b)) & (room >= 2)
        size = np.where(one, 1, np.where(two, 2, 0))
        hit = size > 0
        start[lone[hit] + 1] = False
        longer = hit & (room > size)
        start[lone[longer] + 1 + size[longer]] = True
    s = np.flatnonzero(start)
    return byte[s], byte[np.r_[s[1:], n]], kind[s] == SPECIAL


def _gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    off = C.offsets(size)
    return buf[np.arange(off[-1]) + np.repeat(start - off[:-1], size)]


def _first_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    padded = np.r_[buf, np.zeros(8, np.uint8)]
    out = np.zeros(len(start), U64)
    for i in range(8):
        out = (out << U64(8)) | np.where(start + i < end, padded[np.minimum(start + i, len(buf))], 0).astype(U64)
    return out


def _words_table(docs: DataFrame, path: str, n_buckets: int, n_bytes: int) -> DataFrame:
    """Bucketed by block: the positions of a block (kind 0) and its distinct words per bucket (kind 1)."""
    spark = docs.sparkSession

    def block_rows(block, held):
        ids, valid, per_doc, h, special, size, buf = (np.concatenate(x) for x in zip(*held))
        start = C.offsets(size)[:-1]
        _, at, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        end = start + size
        bucket = C.to_bucket(h[at], n_buckets).astype(np.int64)
        order = np.lexsort((_first_bytes(buf, start[at], end[at]), bucket))
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        at, bucket = at[order], bucket[order]
        # positions name words by frequency, which compresses; ``often`` leads to the words as they are sent
        often = np.argsort(-count[order], kind="stable").astype(np.uint32)
        place = np.empty(len(often), np.uint32)
        place[often] = np.arange(len(often), dtype=np.uint32)
        seq = C.pack(ids, valid, per_doc, place[rank[inverse]], often, level=LEVEL)
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
        blobs = []
        for a, z in zip(edge, np.r_[edge[1:], len(bucket)].astype(int)):
            w = at[a:z]
            blobs.append(C.pack(size[w].astype(np.uint32), special[w].astype(np.uint8), _gather(buf, start[w], size[w]), level=LEVEL))
        n = len(blobs)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * (n + 1)), pa.array([None] + bucket[edge].tolist(), pa.int64()),
             pa.array([seq] + [None] * n, pa.binary()), pa.array([None] + blobs, pa.binary())],
            ["block_id", "bucket", "seq", "words"])

    def run(batches):
        block, held, n_held = TaskContext.get().partitionId() << 32, [], 0
        for ch in C.chunks(batches, "_text"):
            start, end, special = split(ch.buf, ch.off, tuple(_specials(path)))
            h = C.span_hashes(ch.buf, start, end, lower=False)
            h[special] ^= U64(0x5BD1E995)
            ids = ch.arrow("_id")
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                         ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8),
                         np.diff(np.searchsorted(start, ch.off)).astype(np.uint32), h, special, end - start, ch.buf.copy()))
            n_held += len(ch.buf) + 64 * ch.n
            if n_held >= BLOCK_BYTES:
                yield block_rows(block, held)
                block, held, n_held = block + 1, [], 0
        if held:
            yield block_rows(block, held)

    table = f"llm_words_{uuid.uuid4().hex}"
    (docs.mapInArrow(C.tidy(run), "block_id long, bucket long, seq binary, words binary")
         .write.option("compression", "uncompressed").option("path", C.shared_path(spark, "words"))
         .bucketBy(C.bucket_count(n_bytes, BUCKET_BYTES), "block_id").saveAsTable(table))
    return spark.table(table)


def _encode_words(table: DataFrame, path: str) -> DataFrame:
    """(block_id, bucket, ids): per block the ids of its words of a bucket, each distinct word encoded once."""
    def run(rows: pa.Table) -> pa.Table:
        parts = [C.unpack(b) for b in rows.column("words").to_pylist()]
        size = np.concatenate([p[0] for p in parts]).astype(np.int64)
        special = np.concatenate([p[1] for p in parts])
        buf = np.concatenate([p[2] for p in parts])
        off = C.offsets(size)
        h = C.span_hashes(buf, off[:-1], off[1:], lower=False) ^ (special.astype(U64) * U64(0x5BD1E995))
        _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        tok, raw, names = _tokenizer(path), buf.tobytes(), _specials(path)
        ids, count = [], []
        for s in range(0, len(at), 4096):
            part = at[s:s + 4096]
            words = [raw[off[w]:off[w + 1]] for w in part]
            for w, e, is_special in zip(words, tok.encode_batch([w.decode() for w in words], add_special_tokens=False),
                                        special[part]):
                own = [names[w]] if is_special else e.ids
                count.append(len(own))
                ids.extend(own)
        ids, count = np.array(ids, np.uint32), np.array(count, np.int64)
        start = C.offsets(count)
        out, a = [], 0
        for p in parts:
            w = inverse[a:a + len(p[0])]
            a += len(p[0])
            out.append(C.pack(count[w].astype(np.uint32),
                              ids[np.arange(count[w].sum()) + np.repeat(start[:-1][w] - C.offsets(count[w])[:-1], count[w])], level=LEVEL))
        return pa.table({"block_id": rows.column("block_id"), "bucket": rows.column("bucket"),
                         "ids": pa.array(out, pa.binary())})
    return (table.where("words IS NOT NULL").select("block_id", "bucket", "words")
            .groupBy("bucket").applyInArrow(C.tidy(run), "block_id long, bucket long, ids binary"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) per row: ``ids`` are little-endian unsigned 32-bit numbers.

    The ids are those of the tokenizers library for the byte-level BPE file at
    ``path``, without added special tokens, truncation or padding. A null
    text counts as empty and has no ids. Rows that repeat an id, or have
    none, are encoded like others. Other columns are ignored. ``path`` must
    be readable on the executors (it is part of their installation).
    """
    n_bytes = C.text_bytes(docs, text_col)
    source = docs.select(docs[id_col].cast("long").alias("_id"), C.text_column(docs, text_col).alias("_text"))
    table = _words_table(source, path, C.bucket_count(n_bytes, BUCKET_BYTES), n_bytes)
    replies = (_encode_words(table, path).groupBy("block_id")
               .agg(F.collect_list(F.struct("bucket", "ids")).alias("words")))

    def place(batches):
        for rows in batches:
            for i in range(rows.num_rows):
                ids, valid, per_doc, seq, often = C.unpack(rows.column(0)[i].as_py())
                words = sorted(rows.column(1)[i].as_py() or (), key=lambda r: r["bucket"])
                parts = [C.unpack(w["ids"]) for w in words] or [[np.zeros(0, np.uint32)] * 2]
                count = np.concatenate([p[0] for p in parts]).astype(np.int64)
                values = np.concatenate([p[1] for p in parts])
                start = C.offsets(count)[:-1]
                docs_off = C.offsets(per_doc.astype(np.int64))
                d = 0
                while d < len(ids):  # some documents at a time
                    z = max(d + 1, int(np.searchsorted(docs_off, docs_off[d] + 250_000, side="right")) - 1)
                    w = often[seq[docs_off[d]:docs_off[z]]]
                    n = count[w]
                    out_off = C.offsets(n)
                    flat = values[np.arange(out_off[-1]) + np.repeat(start[w] - out_off[:-1], n)].astype("<u4")
                    cut = out_off[docs_off[d:z + 1] - docs_off[d]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[d:z], mask=valid[d:z] == 0), pa.array(np.diff(cut)),
                         pa.array([flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                        ["doc_id", "n_tokens", "ids"])
                    d = z
    return (table.where("seq IS NOT NULL").select("block_id", "seq").join(replies, "block_id", "left")
            .select("seq", "words").mapInArrow(C.tidy(place), "doc_id long, n_tokens long, ids binary"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids, special tokens included.

    Ids are looked up in the id-to-piece table of the vocabulary at ``path``;
    bytes that are no UTF-8 become U+FFFD, ids outside the table nothing. Null
    ids give a null text.
    """
    from pyspark.sql.types import StringType, StructType
    schema = StructType(list(encoded.schema.fields)).add("decoded", StringType())
    at = encoded.columns.index("ids")

    def run(batches):
        pieces, off = _pieces(path)
        for batch in batches:
            text = []
            for blob in batch.column(at):
                if not blob.is_valid:
                    text.append(None)
                    continue
                ids = np.frombuffer(blob.as_buffer(), "<u4").astype(np.int64)
                ids = ids[ids < len(off) - 1]
                text.append(_gather(pieces, off[ids], off[ids + 1] - off[ids]).tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], schema.names)
    return encoded.mapInArrow(C.tidy(run), schema)
