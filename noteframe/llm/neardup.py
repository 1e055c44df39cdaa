"""Operator 3: near-duplicate vectors by spherical-cap filters.

Unit vectors are compared with the directions of a random product code: the
space is turned at random and cut into blocks, each block has its own random
unit directions, and a direction of the code is one choice per block, so that
all directions near a vector are list-decoded block by block without looking
at the whole code. A vector is stored under every direction whose product
with it is within ``margin`` of its best one, and asks only under its best.
Two vectors at cosine ``t`` differ by a vector of length sqrt(2 - 2t), whose
product with a direction is small: the margin of several standard deviations
makes a miss rarer than one in ten thousand links (tests measure it), and the
cosine in double precision decides.

As a vector asks in one place, its links are counted there, pairs are never
written: a task sends each vector's count and the edges of a spanning forest.
Equal vectors are one class with a weight. Large groups are dealt out in
blocks of both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

COSINE = 0.98
#: In products with a unit vector; the difference of two vectors at the threshold has a deviation of 0.2 / sqrt(dims).
MARGIN_DEVIATIONS = 6.5
BLOCKS = 2
#: Vectors that one direction of a label's code stands for.
PER_DIRECTION = 32
BLOCK = 4096
SEED = 20240229


def _unit(rng, n: int, d: int) -> np.ndarray:
    m = rng.standard_normal((n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class ProductCode:
    """Random directions of ``dims`` dimensions: ``per_block ** BLOCKS`` of them."""

    def __init__(self, dims: int, per_block: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        edge = np.linspace(0, dims, min(BLOCKS, dims) + 1).astype(int)
        self.blocks = [(a, z, _unit(rng, per_block, z - a) / np.sqrt(len(edge) - 1)) for a, z in zip(edge[:-1], edge[1:])]
        self.per_block = per_block

    def decode(self, unit: np.ndarray, margin: float):
        """(best direction of each vector, rows, directions): all directions within ``margin`` of the best."""
        turned = unit @ self.turn
        scores = [turned[:, a:z] @ code.T for a, z, code in self.blocks]
        best = np.zeros(len(unit), np.int64)
        for s in scores:
            best = best * self.per_block + s.argmax(axis=1)
        rest = [s.max(axis=1) for s in scores]
        floor = sum(rest) - margin
        rows, names, partial = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for i, s in enumerate(scores):
            after = sum(rest[i + 1:], np.zeros(len(unit)))
            reach = partial[:, None] + s[rows]
            r, c = np.nonzero(reach + after[rows][:, None] >= floor[rows][:, None])
            partial, names, rows = reach[r, c], names[r] * self.per_block + c, rows[r]
        return best, rows, names


def _classes(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(rep, label, copies, u): vectors that can link, one row per distinct vector of a label."""
    x = F.col("_v").cast("array<double>")
    return (table.select(table[id_col].cast("long").alias("id"), table[label_col].cast("string").alias("label"),
                         table[vector_col].alias("_v"))
            .select("id", "label", x.alias("u"))
            .where("id IS NOT NULL AND label IS NOT NULL AND u IS NOT NULL "
                   "AND forall(u, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity')) "
                   "AND exists(u, e -> e <> 0)"))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per id of ``table``.

    Vectors link if their labels are equal and not null and their cosine in
    double precision reaches ``cosine``. A vector that is null, empty, zero,
    or holds null or non-finite components links with nothing, as do vectors
    of unlike lengths. Rows that repeat an id count once, with the smallest
    (label, vector). Rows without id are returned with no links and null
    ``component_id`` and ``kept``. Other columns are ignored.
    """
    single = (_classes(table, id_col, vector_col, label_col)
              .groupBy("id").agg(F.min(F.struct("label", "u")).alias("v")).select("id", "v.label", "v.u"))
    single = C.write_table(single.withColumn("dims", F.size("u"))
                           .withColumn("print", F.xxhash64("label", "u")), "vectors")
    classes = (single.groupBy("label", "dims", "print", "u").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    classes = C.write_table(classes, "classes")
    sizes = {r["dims"]: r["n"] for r in classes.groupBy("dims", "label").count()
             .groupBy("dims").agg(F.max("count").alias("n")).collect()}  # one row per vector length
    per_block = {d: max(2, round((n / PER_DIRECTION) ** (1 / min(BLOCKS, d)))) for d, n in sizes.items()}

    def place(batches):
        codes = {}
        for b in batches:
            dims = b.column(2).to_numpy()
            flat = b.column(3)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d not in codes:
                    codes[d] = ProductCode(int(d), per_block[int(d)])
                for s in range(0, len(at), 2000):
                    part = at[s:s + 2000]
                    v = np.array(flat.take(pa.array(part)).flatten()).reshape(len(part), d)
                    # the largest component is taken out first: squares neither overflow nor vanish
                    v = v / np.abs(v).max(axis=1, keepdims=True)
                    v /= np.linalg.norm(v, axis=1, keepdims=True)
                    margin = MARGIN_DEVIATIONS * np.sqrt((2 - 2 * cosine) / d)
                    best, rows, names = codes[d].decode(v, margin)
                    blobs = [r.tobytes() for r in v]
                    pick = pa.array(part[rows])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pick), b.column(1).take(pick), b.column(2).take(pick), b.column(4).take(pick),
                         pa.array(names), pa.array(best[rows] == names), pa.array([blobs[r] for r in rows], pa.binary())],
                        ["rep", "label", "dims", "copies", "filter", "asks", "unit"])

    stored = C.write_table(classes.select("rep", "label", "dims", "u", "copies").mapInArrow(
        C.tidy(place), "rep long, label string, dims int, copies long, filter long, asks boolean, unit binary"), "filters")
    key = ["label", "dims", "filter"]
    groups = (stored.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"))
              .where("n > 1 AND q > 0")
              .select(*key, F.ceil(F.col("n") / BLOCK).cast("long").alias("sides"),
                      F.ceil(F.col("q") / BLOCK).cast("long").alias("asking")))
    rows = stored.join(groups, key)
    to = F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)
    members = (rows.withColumn("s", F.pmod(F.xxhash64("rep"), F.col("sides"))).withColumn("t", F.explode(to))
               .withColumn("asks", F.lit(False)))
    to = F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)
    askers = (rows.where("asks").withColumn("t", F.pmod(F.xxhash64("rep"), F.col("asking"))).withColumn("s", F.explode(to)))
    columns = [*key, "s", "t", "rep", "copies", "unit", "asks"]

    def compare(t: pa.Table) -> pa.Table:
        rep, copies, asks = (t.column(c).to_numpy() for c in ("rep", "copies", "asks"))
        unit = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(len(rep), -1)
        asks = asks.astype(bool)
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        n_links = np.zeros(len(q), np.int64)
        root = {int(r): int(r) for r in rep}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        edges = []
        for s in range(0, len(q), 256):
            part = q[s:s + 256]
            near = unit[part] @ unit[m].T >= cosine
            near &= rep[m][None, :] != rep[part][:, None]
            n_links[s:s + 256] = near @ copies[m]
            for i, j in zip(*np.nonzero(near)):
                a, b = int(rep[part[i]]), int(rep[m[j]])
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    edges.append((a, b))
        a = np.array([e[0] for e in edges], np.int64)
        b = np.array([e[1] for e in edges], np.int64)
        return pa.table({"a": np.r_[rep[q], a], "b": np.r_[np.full(len(q), -1), b].astype(np.int64),
                         "n": np.r_[n_links, np.zeros(len(a), np.int64)], "edge": np.r_[np.zeros(len(q), bool), np.ones(len(a), bool)]})

    out = C.write_table(members.select(*columns).unionByName(askers.select(*columns))
                        .groupBy(*key, "s", "t").applyInArrow(C.tidy(compare), "a long, b long, n long, edge boolean"), "links")
    counts = out.where("NOT edge").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = C.connected_components(out.where("edge").select("a", "b")).toDF("rep", "component")
    known = (single.drop("dims").join(classes.select("label", "print", "u", "rep", "copies"), ["label", "print", "u"])
             .join(counts, "rep", "left").join(labels, "rep", "left")
             .select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    ids = table.select(table[id_col].cast("long").alias("id"))
    every = ids.where("id IS NOT NULL").distinct().unionByName(ids.where("id IS NULL"))
    return (every.join(known, "id", "left")
            .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
