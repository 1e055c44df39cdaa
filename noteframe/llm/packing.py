"""Operator 2: best-fit packing of documents into bins, under conflicts.

Documents, longest first, go into the bin with the least room that still holds
them and has neither their source nor their duplicate cluster. The open bins
of a shard are ordered by residual room and carry two bitmaps, of sources and
of clusters; the search starts at the first bin with enough room and goes on
to its successors until one is compatible, so the tightest compatible bin is
found; else a bin is opened.

Shards are drawn by hash and hold ``SHARD`` documents on average whatever the
source, cluster or input size: a hot source spreads over all of them, and a
shard's work and memory are bounded.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import U64, mix

CAPACITY = 2048
SHARD = 4096


def best_fit(length, source, cluster, capacity: int):
    """Bin of each item, in the given order. Source and cluster are small numbers, -1 for none.

    Lengths are 1..capacity.
    """
    open_bins: list[tuple[int, int]] = []  # (residual room, bin), ordered
    sources, clusters = [], []  # bitmaps by bin
    out = []
    for need, s, c in zip(length, source, cluster):
        s_bit, c_bit = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        at = bisect_left(open_bins, (need, -1))
        while at < len(open_bins):
            room, b = open_bins[at]
            if not (sources[b] & s_bit or clusters[b] & c_bit):
                del open_bins[at]
                break
            at += 1
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s_bit
        clusters[b] |= c_bit
        if room > need:
            insort(open_bins, (room - need, b))
        out.append(b)
    return out


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, words, cluster): the cluster is the hash of the lower-cased word sequence."""
    def run(batches):
        for ch in C.chunks(batches, "_text"):
            ws, we = C.word_spans(ch.buf, ch.off)
            h = C.span_hashes(ch.buf, ws, we, lower=True)
            w_off = np.searchsorted(ws, ch.off)
            n = np.diff(w_off)
            place = np.arange(len(h)) - np.repeat(w_off[:-1], n)
            cluster = C.reduce_segments(np.add, mix(h + place.astype(U64) * U64(0x9E3779B97F4A7C15)), w_off, U64(0))
            yield pa.RecordBatch.from_arrays([ch.arrow("_id"), ch.arrow("_source"), pa.array(n), pa.array(cluster.view(np.int64))],
                                             ["id", "source", "words", "cluster"])
    return (docs.select(docs[id_col].cast("long").alias("_id"), docs[source_col].cast("string").alias("_source"),
                        C.text_column(docs, text_col).alias("_text"))
            .mapInArrow(C.tidy(run), "id long, source string, words long, cluster long"))


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, bin_id, start, n_words): where each document lies.

    A text longer than ``capacity`` words is cut into pieces of that length,
    each filling a bin of its own, and a rest that is packed like a document;
    ``start`` is the piece's first word in the document. No bin holds two
    documents of one source or of one duplicate cluster (equal word sequences
    up to the case of A-Z). A null source conflicts with nothing. A text
    without words, or null, has one row with null ``bin_id``. Rows that repeat
    an id, or have none, are packed like others. Ties of length go to the
    smaller id, then cluster, then source; of room, to the bin opened first.
    """
    sizes = C.write_table(_sizes(docs, id_col, text_col, source_col), "sizes")
    n_shards = max(1, -(-sizes.where("words > 0").count() // shard))
    sharded = sizes.where("words > 0").withColumn("shard", F.pmod(F.xxhash64("id", "cluster"), F.lit(n_shards)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("words", "descending"), ("id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        first = t.column("shard")[0].as_py() << 32
        ids, words = t.column("id").to_pylist(), t.column("words").to_numpy()
        rest = words % capacity
        source = t.column("source").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        _, number, copies = np.unique(t.column("cluster").to_numpy(), return_inverse=True, return_counts=True)
        several = copies[number] > 1
        cluster = np.full(len(ids), -1)
        if several.any():
            cluster[several] = np.unique(number[several], return_inverse=True)[1]
        # the rests in order of their own length
        order = np.argsort(-rest, kind="stable")
        order = order[rest[order] > 0]
        placed = best_fit(rest[order].tolist(), source[order].tolist(), cluster[order].tolist(), capacity)
        used = max(placed, default=-1) + 1
        rows = {"doc_id": [ids[i] for i in order], "piece": [int(words[i] // capacity) for i in order],
                "bin_id": [first + b for b in placed], "start": [int(words[i] - rest[i]) for i in order],
                "n_words": rest[order].tolist()}
        for i in np.flatnonzero(words >= capacity):
            for p in range(int(words[i] // capacity)):
                for name, value in (("doc_id", ids[i]), ("piece", p), ("bin_id", first + used), ("start", p * capacity),
                                    ("n_words", capacity)):
                    rows[name].append(value)
                used += 1
        return pa.table({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    packed = sharded.groupBy("shard").applyInArrow(C.tidy(run), "doc_id long, piece long, bin_id long, start long, n_words long")
    empty = sizes.where("words = 0").selectExpr("id AS doc_id", "0L AS piece", "cast(null AS bigint) AS bin_id",
                                                "0L AS start", "words AS n_words")
    return packed.unionByName(empty)
