"""Operator 1: exact top-k inner products by a three-phase uniform threshold.

A score is the sum of partial scores over ``lists`` groups of dimensions, so
each query has one sorted list of candidates per group. Phase 1 gathers the
k best entries of every local list; the k-th best total among them is a lower
bound ``t`` of the answer's last score. A candidate that reaches ``t`` has a
partial score of at least ``t / lists`` in some list (or the sum would be
smaller), whatever the signs: this uniform cutoff is sent out in phase 2 and
every entry at or above it collected. Unseen partial scores lie below the
cutoff, so sums that cannot reach ``t`` are dropped, and phase 3 looks the
missing partial scores of the rest up and ranks exact totals.

Candidates and queries travel as packed blocks of bounded size; a pair of
blocks is one step of a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LISTS = 2
#: Rows of a block of candidates and of a block of queries.
CANDIDATES, QUERIES = 4096, 512


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows without a usable vector are left out."""
    x = F.col("_v").cast("array<double>")
    return (table.select(table[id_col].cast("long").alias("id"), table[vector_col].alias("_v"))
            .select("id", x.alias("x"))
            .where("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0 "
                   "AND forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))")
            .select("id", F.expr(f"transform(x, e -> floor({scale} * e))").alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def _blocks(rows: DataFrame, per_block: int, n: int, name: str) -> DataFrame:
    """(block, name): rows packed as (ids, lengths, values), about ``per_block`` a block."""
    count = max(1, -(-n // per_block))

    def run(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks()
        data = C.pack(t.column("id").to_numpy(), np.asarray(v.value_lengths(), np.int32),
                      v.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.table({"block": t.column("block")[:1], name: pa.array([data], pa.binary())})
    return (rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)))
            .groupBy("block").applyInArrow(C.tidy(run), f"block long, {name} binary"))


def _matrix(blob: bytes):
    """(ids, matrix); shorter vectors end in zeros."""
    ids, size, flat = C.unpack(blob)
    m = np.zeros((len(ids), int(size.max(initial=0))), np.int64)
    m[np.arange(m.shape[1]) < size[:, None]] = flat
    return ids, m


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(d, 1) < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)  # exact: integers below 2^53
    return a @ b.T


def _groups(width: int, lists: int):
    edge = np.linspace(0, width, lists + 1).astype(int)
    return list(zip(edge[:-1], edge[1:]))


def _partials(q: np.ndarray, c: np.ndarray, lists: int, width: int) -> list[np.ndarray]:
    """Partial scores per list; ``width`` fixes the groups of dimensions for all blocks."""
    return [_product(q[:, a:z], c[:, a:z]) for a, z in _groups(width, lists)]


def top_k(table: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 1024, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best inner products with the other rows.

    ``queries`` are rows of ``table`` (same columns). Components become
    ``floor(scale * x)``; a null vector, an empty one or one with a null or
    non-finite component takes no part, nor does a row without id. Rows that
    repeat an id count once, with the smallest vector. A shorter vector is
    continued with zeros. Ties go to the smaller id; with fewer than ``k``
    other rows all are returned; an empty table gives no rows. Scores are
    exact while they fit 64 bits.
    """
    vectors = C.write_table(integer_vectors(table, id_col, vector_col, scale), "vectors")
    ids = queries.select(queries[id_col].cast("long").alias("id")).distinct()
    asked = C.write_table(vectors.join(ids, "id", "left_semi"), "queries")
    about = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    n, width = about["n"], about["w"] or 0
    n_blocks = max(1, -(-n // CANDIDATES))
    cands = C.write_table(_blocks(vectors, CANDIDATES, n, "cand"), "candidates")
    query_blocks = C.write_table(_blocks(asked, QUERIES, asked.count(), "quer").withColumnRenamed("block", "qb"), "queryblocks")

    def meet(rows: DataFrame) -> DataFrame:
        """Each block of queries is sent to every block of candidates."""
        return (rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
                .join(cands, "block"))

    def local_lists(batches):  # phase 1
        for b in batches:
            for quer, cand in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                qi, q = _matrix(quer)
                ci, c = _matrix(cand)
                parts = _partials(q, c, lists, width)
                total = sum(parts)
                for p in parts:
                    m = min(k + 1, len(ci))  # one more: the query itself may be among them
                    best = np.argpartition(-p, m - 1, axis=1)[:, :m]
                    r = np.repeat(np.arange(len(qi)), m)
                    j = best.reshape(-1)
                    ok = ci[j] != qi[r]
                    r, j = r[ok], j[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(ci[j]), pa.array(p[r, j]), pa.array(total[r, j])],
                                                     ["query_id", "vec_id", "part", "total"])

    found = (meet(query_blocks).select("quer", "cand")
             .mapInArrow(C.tidy(local_lists), "query_id long, vec_id long, part long, total long"))
    in_order = Window.partitionBy("query_id").orderBy(F.desc("total"), "vec_id")
    seen = (found.groupBy("query_id", "vec_id").agg(F.max("total").alias("total"))
            .withColumn("r", F.row_number().over(in_order)).where(f"r <= {k}"))
    # fewer than k seen: no cutoff
    cut = seen.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("total")).alias("cut"))
    cut = C.write_table(cut, "cutoffs")
    per_block = (asked.select(F.col("id").alias("query_id"), F.pmod(F.xxhash64("id"), F.lit(max(1, -(-asked.count() // QUERIES)))).alias("qb"))
                 .join(cut, "query_id").groupBy("qb").agg(F.collect_list(F.struct("query_id", "cut")).alias("cuts")))

    def entries(batches):  # phase 2
        for b in batches:
            for quer, cand, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                qi, q = _matrix(quer)
                ci, c = _matrix(cand)
                low = {x["query_id"]: x["cut"] for x in cuts}
                t = np.array([low[i] if low.get(i) is not None else np.iinfo(np.int64).min // 2 for i in qi.tolist()])
                parts = _partials(q, c, lists, width)
                # partial >= t / lists, in whole numbers; below it, a partial is at most the next one down
                least = -(-t // lists)
                hits = [p >= least[:, None] for p in parts]
                some = np.logical_or.reduce(hits) & (ci[None, :] != qi[:, None])
                bound = sum(np.where(h, p, least[:, None] - 1) for h, p in zip(hits, parts))
                r, j = np.nonzero(some & (bound >= t[:, None]))
                known = sum(np.where(h, p, 0) for h, p in zip(hits, parts))[r, j]
                missing = sum((~h).astype(np.int64) << i for i, h in enumerate(hits))[r, j]
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(ci[j]), pa.array(known), pa.array(missing)],
                                                 ["query_id", "vec_id", "known", "missing"])

    kept = (meet(query_blocks.join(per_block, "qb")).select("quer", "cand", "cuts")
            .mapInArrow(C.tidy(entries), "query_id long, vec_id long, known long, missing long"))

    def resolve(batches):  # phase 3
        edges = _groups(width, lists)
        for b in batches:
            known, missing = (b.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3))
            for i in np.flatnonzero(missing):
                q, c = (np.array(b.column(j)[int(i)].as_py() or [], np.int64) for j in (4, 5))
                d = min(len(q), len(c))
                for g, (a, z) in enumerate(edges):
                    if missing[i] >> g & 1:
                        known[i] += int(q[a:min(z, d)] @ c[a:min(z, d)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(known)], ["query_id", "vec_id", "score"])

    open_rows, done = kept.where("missing <> 0"), kept.where("missing = 0")
    exact = (open_rows.join(vectors.select(F.col("id").alias("vec_id"), F.col("v").alias("c")), "vec_id")
             .join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
             .select("query_id", "vec_id", "known", "missing", "q", "c")
             .mapInArrow(C.tidy(resolve), "query_id long, vec_id long, score long"))
    scores = done.select("query_id", "vec_id", F.col("known").alias("score")).unionByName(exact)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (scores.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
            .select("query_id", "rank", "vec_id", "score"))
