"""Exact k nearest neighbours (H29): of a bounded matrix (:func:`nearest_rows`) and of any number of fitted rows.

For any number, fitted rows are cut into cells of bounded size by a tree of
hyperplanes, made of means and variances over all of them: at each node along
the axes of largest variance, in turned coordinates (turning changes no
distance). A cell shows the others boxes, each of a share of its rows. A query
first meets the cell in which it lies, which gives it a distance that its k-th
neighbour cannot exceed. Then it meets the cells that have a box within that
distance, and only what is as near leaves a task. In a task, a smaller tree of
the cell does the same for groups of queries. Cells and queries travel by a
shuffle, a cell to a task; only the tree and the boxes are collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteframe.session import cut_lineage

#: bytes of a cell's vectors, and rows of a cell at least where the rows would make fewer cells than the session has cores
CELL_BYTES, CELL_ROWS = 8 << 20, 4_000
#: queries of a cell that one task answers, and of them at once
QUERY_ROWS, AT_ONCE = 65_536, 65_536
#: rows of a leaf of a cell's own tree, boxes that a cell shows, queries of a group, pairs that a group holds
LEAF, BOXES, GROUPED, HELD = 1_024, 16, 1_024, 50_000
#: what rounding may take from a distance in turned coordinates, as a share of the largest length
SLACK = 1e-9
#: a node of more rows than a cell is cut along so many axes in a round; rows that are alike stay together after so many rounds
AXES, ROUNDS = 3, 40


#: fitted rows whose least value is looked at first, such groups that are opened, and rows of them measured exactly beyond k
GROUP, OPENED, SPARE = 32, 9, 29
#: queries that meet the fitted rows at once: their values stay in the processor's cache
TOGETHER = 32


def nearest_rows(k: int):
    """A function that fits points and returns another: the row numbers of each query's ``k`` nearest of them, nearest first.

    Ties go to the smaller row number. One matrix product gives each query a
    value per point that orders the points by distance. They are read in groups
    of ``GROUP``: the ``k`` smallest values lie in the ``k`` groups of smallest
    minimum, so only some groups are opened, and only the distances of some
    points there are taken exactly. A query for which rounding or ties could
    hide a point as near outside them looks at all points that could be.

    The functions are local: workers get them by value, without this package.
    """
    def fit(points: np.ndarray):
        n, dim = points.shape
        most, groups = min(k, n), -(-n // GROUP)
        size = (points * points).sum(axis=1)
        table = np.zeros((dim + 1, GROUP * groups))
        table[:dim, :n], table[dim, :n], table[dim, n:] = -2 * points.T, size, np.inf
        far, rounding = np.sqrt(size.max()), 4 * (dim + 4) * np.finfo("float64").eps

        def near(q: np.ndarray) -> np.ndarray:
            value = np.column_stack([q, np.ones(len(q))]) @ table
            least, edge = value.reshape(len(q), GROUP, groups).min(axis=1), np.full(len(q), np.inf)
            opened = np.broadcast_to(np.arange(groups), least.shape)
            if (m := most + OPENED) < groups:
                opened = np.argpartition(least, m, axis=1)
                edge, opened = np.take_along_axis(least, opened[:, m:m + 1], axis=1)[:, 0], opened[:, :m]
            cand = (opened[:, None, :] + (np.arange(GROUP) * groups)[:, None]).reshape(len(q), -1)
            if (m := most + SPARE) < cand.shape[1]:
                inside = np.take_along_axis(value, cand, axis=1)
                order = np.argpartition(inside, m, axis=1)
                edge = np.minimum(edge, np.take_along_axis(inside, order[:, m:m + 1], axis=1)[:, 0])
                cand = np.take_along_axis(cand, order[:, :m], axis=1)
            cand = np.sort(cand, axis=1)
            d = np.sqrt(((q[:, None, :] - points[np.minimum(cand, n - 1)]) ** 2).sum(axis=2))
            d[cand >= n] = np.inf
            first = np.argsort(d, axis=1, kind="stable")[:, :most]
            out, kth = np.take_along_axis(cand, first, axis=1), np.take_along_axis(d, first[:, -1:], axis=1)[:, 0]
            own = (q * q).sum(axis=1)
            limit = kth ** 2 - own + rounding * (np.sqrt(own) + far) ** 2  # no point beyond is as near
            for i in np.flatnonzero(~(limit < edge) & ((edge < np.inf) | ~np.isfinite(limit))).tolist():
                some = np.flatnonzero(value[i, :n] <= limit[i]) if np.isfinite(limit[i]) else np.arange(n)
                away = np.sqrt(((q[i] - points[some]) ** 2).sum(axis=1))
                out[i] = some[np.argsort(away, kind="stable")[:most]]
            return out

        def all_near(queries: np.ndarray) -> np.ndarray:
            parts = [near(queries[a:a + TOGETHER]) for a in range(0, len(queries), TOGETHER)]
            return np.concatenate(parts) if parts else np.zeros((0, most), np.int64)
        return all_near
    return fit


def _numbered(df: DataFrame, name: str, vec: Column, *columns: Column) -> DataFrame:
    """Columns, vector ``v`` and a number ``name`` of the rows whose vector is finite, written."""
    v = vec.cast("array<double>")
    finite = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) < float("inf")  # a null or NaN is not
    return cut_lineage(df.where(finite).select(*columns, v.alias("v")).withColumn(name, F.monotonically_increasing_id()))


def _tools():
    """Functions that workers get by value, without this package: matrix, descent, grow, search."""
    def matrix(column: pa.Array) -> np.ndarray:
        """A list column's rows."""
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def descent(axis, cut, left):
        """A function that gives the leaf of a tree in which each row lies (above a cut: right)."""
        axis, cut, left = np.array(axis), np.array(cut), np.array(left)

        def leaf(x: np.ndarray) -> np.ndarray:
            node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(rows := rows[axis[node[rows]] >= 0]):
                at = node[rows]
                node[rows] = left[at] + (x[rows, axis[at]] > cut[at])
            return node
        return leaf

    def grow(x: np.ndarray, most: int):
        """(order, starts, low, high, leaf): a tree of points whose leaves have ``most`` rows at most, and their boxes."""
        axis, cut, left, parts, todo = [-1], [0.0], [0], {}, [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= most:
                parts[node] = rows
                continue
            some = x[rows]
            a, half = int(np.argmax(some.var(axis=0))), len(rows) // 2
            order = np.argpartition(some[:, a], half)
            axis[node], cut[node], left[node] = a, float(some[order[half], a]), len(axis)
            todo += [(left[node], rows[order[:half]]), (left[node] + 1, rows[order[half:]])]
            axis, cut, left = axis + [-1, -1], cut + [0.0, 0.0], left + [0, 0]
        nodes = sorted(parts)
        low, high = (np.array([f(x[parts[i]], axis=0) for i in nodes]) for f in (np.min, np.max))
        place = np.zeros(len(axis), np.int64)
        place[nodes] = np.arange(len(nodes))
        down = descent(axis, cut, left)
        return np.concatenate([parts[i] for i in nodes]), np.cumsum([0] + [len(parts[i]) for i in nodes]), low, high, lambda q: place[down(q)]

    def search(points: np.ndarray, turned: np.ndarray, k: int):
        """A function of queries, turned ones and the bounds of their distances: (query, point, distance) of each query's
        ``k`` nearest points within its bound, nearest first, ties to the smaller row number."""
        order, starts, low, high, leaf = grow(turned, LEAF)
        size = (turned * turned).sum(axis=1)
        table = np.ascontiguousarray(np.column_stack([turned, size])[order].T)
        far = size.max()

        def group(q, t, bound, own):
            length = (t * t).sum(axis=1)
            wide = SLACK * (far + length.max())  # of a square
            ask = np.column_stack([-2 * t, np.ones(len(t))])
            bound = bound.copy()
            if (free := np.flatnonzero(np.isinf(bound))).size:
                a, z = (starts[own], starts[own + 1]) if starts[own + 1] - starts[own] >= k else (0, len(order))
                if z - a >= k:
                    value = np.partition(ask[free] @ table[:, a:z], k - 1, axis=1)[:, k - 1]
                    bound[free] = np.sqrt(np.maximum(value + length[free], 0) + wide)
            gap = np.maximum(np.maximum(low - t.max(axis=0), t.min(axis=0) - high), 0)
            gap = np.sqrt((gap * gap).sum(axis=1))
            gap[own] = 0
            held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

            def best():
                a, b, d = (np.concatenate(c) for c in zip(*held))
                by = np.lexsort((b, d, a))
                a, b, d = a[by], b[by], d[by]
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                last = rank == k - 1
                bound[a[last]] = np.minimum(bound[a[last]], d[last])
                return a[rank < k], b[rank < k], d[rank < k]
            for met, j in enumerate(np.argsort(gap, kind="stable").tolist()):
                if gap[j] ** 2 > bound.max() ** 2 + wide:
                    break
                away = np.maximum(np.maximum(low[j] - t, t - high[j]), 0)
                near = np.flatnonzero((away * away).sum(axis=1) <= bound * bound + wide)
                if not len(near):
                    continue
                value = ask[near] @ table[:, starts[j]:starts[j + 1]]
                a, b = np.nonzero(value <= (bound[near] ** 2 - length[near] + wide)[:, None])
                a, b = near[a], order[starts[j] + b]
                d = np.sqrt(((q[a] - points[b]) ** 2).sum(axis=1))
                stay = d <= bound[a]
                held.append((a[stay], b[stay], d[stay]))
                n += int(stay.sum())
                if n > HELD or met == 3:
                    held, n = [best()], 0
            return (*best(), bound)

        def answer(q: np.ndarray, t: np.ndarray, bound: np.ndarray):
            """Per group of queries: (their rows, query, point, distance, bounds that were found)."""
            own = leaf(t)
            rows = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(own[rows]) > 0, True])
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for s in range(a, z, GROUPED):
                    some = rows[s:min(z, s + GROUPED)]
                    yield (some, *group(q[some], t[some], bound[some], int(own[some[0]])))
        return answer
    return matrix, descent, grow, search


def _cells(fitted: DataFrame, limit: int | None):
    """(turn, cell): functions of vectors; ``cell`` takes turned ones and row numbers. At most some ``limit`` rows lie in a cell.

    Only rows that are all alike are dealt to cells by their number.
    """
    matrix, descent, _, _ = _tools()

    def moments(batches):
        n, s, squares = 0, 0.0, 0.0
        for b in batches:
            x = matrix(b.column(0))
            n, s, squares = n + len(x), s + x.sum(axis=0), squares + x.T @ x
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "s": s.tolist(), "o": squares.ravel().tolist()}])
    rows = fitted.select("v").mapInArrow(moments, "n long, s array<double>, o array<double>").collect()  # a row a task
    if not rows:
        return None
    n = sum(r["n"] for r in rows)
    centre = sum(np.array(r["s"]) for r in rows) / n
    dim = len(centre)
    spread = sum(np.array(r["o"]) for r in rows).reshape(dim, dim) / n - np.outer(centre, centre)
    axes = np.linalg.eigh(spread)[1] if np.isfinite(spread).all() else np.eye(dim)
    if limit is None:
        cores = fitted.sparkSession.sparkContext.defaultParallelism
        limit = max(CELL_ROWS, min(CELL_BYTES // (8 * dim), -(-n // (2 * cores))))

    def turn(x: np.ndarray) -> np.ndarray:
        return (x - centre) @ axes
    axis, cut, left, size = [-1], [0.0], [0], {0: n}
    open_ = [0] if n > limit else []
    for _ in range(ROUNDS):
        if not open_:
            break
        leaf, wanted = descent(axis, cut, left), np.array(open_)

        def sums(batches):
            n, s, squares = np.zeros(len(wanted)), 0.0, 0.0
            for b in batches:
                x = turn(matrix(b.column(0)))
                node = leaf(x)
                at = np.minimum(np.searchsorted(wanted, node), len(wanted) - 1)
                stay = wanted[at] == node
                x, at = x[stay], at[stay]
                n += np.bincount(at, minlength=len(wanted))
                s = s + np.column_stack([np.bincount(at, c, len(wanted)) for c in x.T])
                squares = squares + np.column_stack([np.bincount(at, c * c, len(wanted)) for c in x.T])
            if n.any():
                yield pa.RecordBatch.from_pylist([{"node": int(wanted[i]), "n": int(n[i]), "s": s[i].tolist(), "o": squares[i].tolist()}
                                                  for i in np.flatnonzero(n)])
        per = fitted.select("v").mapInArrow(sums, "node long, n long, s array<double>, o array<double>")
        total = lambda c: F.array(*[F.sum(F.get(c, i)) for i in range(dim)]).alias(c)
        found = per.groupBy("node").agg(F.sum("n").alias("n"), total("s"), total("o")).collect()  # a row a node
        more = []
        size.update(dict.fromkeys(open_, 0))
        for r in found:
            size[r["node"]] = r["n"]
            mean = np.array(r["s"]) / r["n"]
            square = np.array(r["o"]) / r["n"]
            var = square - mean * mean
            along = [a for a in np.argsort(-var)[:min(AXES, math.ceil(math.log2(max(r["n"] / limit, 1))))].tolist() if var[a] > 1e-12 * square[a]]
            ends = [r["node"]] if along else []
            for a in along:
                for e in ends:
                    axis[e], cut[e], left[e] = a, float(mean[a]), len(axis)
                    axis, cut, left = axis + [-1, -1], cut + [0.0, 0.0], left + [0, 0]
                ends = [left[e] + side for e in ends for side in (0, 1)]
            more += ends
            size.update(dict.fromkeys(ends, r["n"]))
        open_ = sorted(more)
    pieces = np.array([max(1, -(-size.get(i, 0) // limit)) if axis[i] < 0 else 0 for i in range(len(axis))])
    first = np.cumsum(pieces) - pieces
    leaf = descent(axis, cut, left)

    def cell(x: np.ndarray, number: np.ndarray) -> np.ndarray:
        node = leaf(x)
        return (first[node] + number % pieces[node]).astype(np.int32)
    return turn, cell


def _slots(work: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(cell, slot, parts) of the cells that queries meet, and the number of slots: a slot has a cell and some ``rows`` of its queries."""
    counts = sorted((r["cell"], r["n"]) for r in work.groupBy("cell").agg(F.count("*").alias("n")).collect())  # a row a cell
    out, slot = [], 0
    for cell, n in counts:
        parts = -(-n // rows)
        out.append((cell, slot, parts))
        slot += parts
    return work.sparkSession.createDataFrame(out, "cell int, first int, parts int"), slot


def _search(train: DataFrame, asked: DataFrame, k: int, id_col: str, vec: str, label: str, fit_rows: int | None, query_rows: int):
    """(number, near): of the queries (number, v), the (d, i, l) of the ``k`` nearest fitted rows, ties to the smaller id; None without any."""
    fitted = _numbered(train, "m", F.col(vec), F.col(id_col).alias("i"), F.col(label).alias("l"))
    made = _cells(fitted, fit_rows)
    if made is None:
        return None
    turn, cell = made
    matrix, _, grow, search = _tools()

    def placed(number):
        def run(batches):
            for b in batches:
                at = cell(turn(matrix(b.column(b.schema.get_field_index("v")))), b.column(b.schema.get_field_index(number)).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "cell"])
        return run
    kind = {c: train.schema[c].dataType.simpleString() for c in (id_col, label)}
    tasks = lambda n: max(1, min(n, 10_000))
    fits = fitted.mapInArrow(placed("m"), f"i {kind[id_col]}, l {kind[label]}, v array<double>, m long, cell int").drop("m")
    fits = cut_lineage(fits)

    # boxes of a share of a cell's rows each
    def boxes(batches):
        held, now = [], None

        def shown():
            x = turn(np.concatenate(held))
            order, starts, low, high, _ = grow(x, -(-len(x) // BOXES))
            return pa.RecordBatch.from_pylist([{"cell": now, "n": int(n), "low": lo.tolist(), "high": hi.tolist()}
                                               for n, lo, hi in zip(np.diff(starts), low, high)],
                                              pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))
        for b in batches:
            at, x = b.column(0).to_numpy(), matrix(b.column(1))
            cuts = np.flatnonzero(np.r_[True, np.diff(at) != 0, True]) if len(at) else []
            for a, z in zip(cuts[:-1], cuts[1:]):
                if int(at[a]) != now and held:
                    yield shown()
                    held = []
                now = int(at[a])
                held.append(x[a:z])
        if held:
            yield shown()
    cells = fits.select("cell").distinct().count()
    seen = (fits.select("cell", "v").repartition(tasks(cells), "cell").sortWithinPartitions("cell")
            .mapInArrow(boxes, "cell int, n long, low array<double>, high array<double>").collect())  # BOXES rows a cell, or a few more
    seen.sort(key=lambda r: (r["cell"], r["low"], r["high"]))
    owner, rows = np.array([r["cell"] for r in seen]), np.array([r["n"] for r in seen])
    low, high = np.array([r["low"] for r in seen]), np.array([r["high"] for r in seen])
    spark = train.sparkSession
    shown = spark.sparkContext.broadcast((owner, rows, low, high))
    full = np.unique(owner)

    def home(batches):  # a cell without rows gives its queries to the next
        for b in placed("number")(batches):
            at = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(full[np.minimum(np.searchsorted(full, at), len(full) - 1)], pa.int32())],
                                             ["number", "v", "cell"])

    def others(t, bound, cell):
        """(query, cell): the other cells that have a box within the queries' bounds."""
        owner, rows, low, high = shown.value
        bound = bound.copy()
        for i in np.flatnonzero(np.isinf(bound)).tolist():  # a box of k rows bounds the distance
            wide = np.maximum(np.abs(t[i] - low), np.abs(t[i] - high))[rows >= k]
            bound[i] = np.sqrt((wide * wide).sum(axis=1).min(initial=np.inf))
        slack = SLACK * ((t * t).sum(axis=1).max() + max((low * low).sum(axis=1).max(), (high * high).sum(axis=1).max()))
        gap = np.maximum(np.maximum(low - t.max(axis=0), t.min(axis=0) - high), 0)
        some = np.flatnonzero(((gap * gap).sum(axis=1) <= bound.max() ** 2 + slack) & (owner != cell))
        pairs = [np.zeros(0, np.int64)]
        for c in range(0, len(some), 64):
            part = some[c:c + 64]
            away = np.maximum(np.maximum(low[part] - t[:, None, :], t[:, None, :] - high[part]), 0)
            a, b = np.nonzero((away * away).sum(axis=2) <= (bound * bound + slack)[:, None])
            pairs.append(a * (int(owner.max()) + 1) + owner[part[b]])
        pairs = np.unique(np.concatenate(pairs))
        return pairs // (int(owner.max()) + 1), pairs % (int(owner.max()) + 1)

    def lists(a, n, values):
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(a, np.arange(n + 1)), pa.int32()), values)

    def meet(work: DataFrame, first: bool) -> DataFrame:
        """Queries (number, v, bound, cell) with what they find in their cell; the first time also with the cells to look at."""
        def answered(model, now, held):
            ids, labels, answer = model
            number = np.concatenate([b.column(b.schema.get_field_index("number")).to_numpy() for b in held])
            q = np.concatenate([matrix(b.column(b.schema.get_field_index("v"))) for b in held])
            bound = np.concatenate([b.column(b.schema.get_field_index("bound")).to_numpy() for b in held])
            t = turn(q)
            for some, a, b, d, found in answer(q, t, bound):
                near = pa.StructArray.from_arrays([pa.array(d), ids.take(pa.array(b)), labels.take(pa.array(b))], ["d", "i", "l"])
                n, asked = len(some), number[some]
                if first:
                    at, cells = others(t[some], found, now)
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * q.shape[1], pa.int32()), pa.array(q[some].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(asked), vectors, pa.array(found), lists(at, n, pa.array(cells, pa.int32())),
                                                      lists(a, n, near)], ["number", "v", "bound", "cells", "near"])
                elif len(a):
                    kept = np.unique(a)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[kept]), lists(np.searchsorted(kept, a), len(kept), near)], ["number", "near"])

        def run(batches):
            now, points, model, held, n = None, [], None, [], 0
            for batch in batches:
                col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy()  # noqa: E731, B023
                slot, query, cell = col("slot"), col("query"), col("cell")
                cuts = np.flatnonzero(np.r_[True, (np.diff(slot) != 0) | (np.diff(query) != 0), True]) if len(slot) else []
                for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    part = batch.slice(a, z - a)
                    if (slot[a], cell[a]) != now or n >= AT_ONCE:
                        if held:
                            yield from answered(model, now[1].item(), held)
                        held, n = [], 0
                    if (slot[a], cell[a]) != now:
                        now, points, model = (slot[a], cell[a]), [], None
                    if not query[a]:
                        points.append(part)
                        continue
                    if model is None:
                        whole = pa.Table.from_batches(points).combine_chunks().to_batches()[0]
                        points = []
                        x = matrix(whole.column(whole.schema.get_field_index("v")))
                        model = (whole.column(whole.schema.get_field_index("i")), whole.column(whole.schema.get_field_index("l")), search(x, turn(x), k))
                    held.append(part)
                    n += z - a
            if held:
                yield from answered(model, now[1].item(), held)
        slots, n = _slots(work, query_rows)
        slots = F.broadcast(slots)  # a row a cell
        left = fits.join(slots, "cell").select(F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("slot"), F.lit(0).alias("query"),
                                               "cell", "i", "l", "v", F.lit(0).cast("long").alias("number"), F.lit(0.0).alias("bound"))
        right = work.join(slots, "cell").select((F.col("first") + F.pmod(F.xxhash64("number"), "parts")).cast("int").alias("slot"), F.lit(1).alias("query"),
                                                "cell", F.lit(None).cast(kind[id_col]).alias("i"), F.lit(None).cast(kind[label]).alias("l"), "v", "number", "bound")
        near = f"near array<struct<d: double, i: {kind[id_col]}, l: {kind[label]}>>"
        return (left.unionByName(right).repartitionById(tasks(n), F.col("slot") % tasks(n)).sortWithinPartitions("slot", "query", "i", "l")
                .mapInArrow(run, "number long, v array<double>, bound double, cells array<int>, " + near if first else "number long, " + near))
    work = cut_lineage(asked.select("number", "v").mapInArrow(home, "number long, v array<double>, cell int"))
    once = cut_lineage(meet(work.withColumn("bound", F.lit(float("inf"))), True))
    again = once.select("number", "v", "bound", F.explode("cells").alias("cell"))
    both = once.select("number", "near").unionByName(meet(again, False))
    return both.groupBy("number").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _asked(test: DataFrame, vec: str) -> tuple[DataFrame, DataFrame, str]:
    """The test rows with a number, written; (number, v) of those whose vector is finite; and the number's name."""
    name = "number"
    while name in (c.lower() for c in test.columns):
        name = "_" + name
    rows = cut_lineage(test.withColumn(name, F.monotonically_increasing_id()))
    v = F.col(vec).cast("array<double>")
    finite = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) < float("inf")
    return rows, rows.where(finite).select(F.col(name).alias("number"), v.alias("v")), name


def nearest(train: DataFrame, test: DataFrame, k: int, id_col: str, vec: str, label: str, fit_rows: int | None = None,
            query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query, id, label, distance, rank): the ``k`` nearest fitted rows of every test row, ties to the smaller id.

    Rows whose vector is null or not finite take no part; all vectors have
    the same length.
    """
    rows, asked, name = _asked(test, vec)
    found = _search(train, asked, k, id_col, vec, label, fit_rows, query_rows)
    kind = {c: train.schema[c].dataType.simpleString() for c in (id_col, label)}
    if found is None:
        found = asked.limit(0).select("number", F.array().cast(f"array<struct<d: double, i: {kind[id_col]}, l: {kind[label]}>>").alias("near"))
    each = rows.select(F.col(id_col).alias("query"), F.col(name).alias("number")).join(found, "number")
    return each.select("query", F.posexplode("near").alias("r", "x")).select(
        "query", F.col("x.i").alias("id"), F.col("x.l").alias("label"), F.col("x.d").alias("distance"), (F.col("r") + 1).alias("rank"))


def classify_exact(train: DataFrame, test: DataFrame, k: int = 7, id_col: str = "id", vec: str = "vec", label: str = "label",
                   fit_rows: int | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``test`` with ``pred``, the most frequent label among the ``k`` nearest (ties: smallest label).

    A test row without vector, or without fitted rows, has a null prediction. Ids may repeat or be null."""
    rows, asked, name = _asked(test, vec)
    found = _search(train, asked, k, id_col, vec, label, fit_rows, query_rows)
    if found is None:
        return rows.select(*test.columns, F.lit(None).cast(train.schema[label].dataType).alias("pred"))
    votes = F.expr("transform(array_distinct(transform(near, x -> x.l)), c -> struct(-size(filter(near, x -> x.l <=> c)) AS n, c IS NULL AS none, c AS l))")
    best = found.select(F.col("number").alias(name), F.array_min(votes)["l"].alias("pred"))
    return rows.join(best, name, "left").select(*test.columns, "pred")
