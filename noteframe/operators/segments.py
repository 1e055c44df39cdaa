"""One segmented scan for features in row order.

Rows are cut once into slices, ranges over (patient, order) of balanced size,
so a patient of any size is many tasks' work. Each feature is a monoid: within
a slice it is a window, a slice hands over a summary of the patient's rows in
it, and the summaries of the slices before and after combine to what the
slice's own rows lack. All features asked for share the slices, the summary
aggregation and the one join that brings the combined values back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slices(df: DataFrame, part: str, order: Sequence[str]) -> DataFrame:
    """Rows tagged with a slice number ``_pid``: ranges over (patient, order).

    Nearly all patients lie within one slice. The rows are materialised in the
    shared checkpoint folder, because every use below must see the same slices,
    also after a lost executor. Rows that already carry ``_pid`` keep their
    slices: features chained on them cut once."""
    from noteframe.session import cut_lineage
    if "_pid" in df.columns:
        return df
    return cut_lineage(df.repartitionByRange(part, *order).withColumn("_pid", F.spark_partition_id()))


@dataclass
class Frames:
    """Windows over a patient's rows in a slice, and over the patient's slices."""
    part: str
    order: Sequence[str]

    @property
    def whole(self):
        return Window.partitionBy("_pid", self.part)

    @property
    def rows(self):
        return self.whole.orderBy(*self.order)

    @property
    def so_far(self):
        return self.rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def from_end(self):
        """This row and the later ones, as a growing frame from the end: linear, which a frame to the end is not."""
        return self.whole.orderBy(*[F.col(c).desc() for c in self.order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def slices(self):
        return Window.partitionBy(self.part).orderBy("_pid")

    @property
    def earlier(self):
        return self.slices.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def later(self):
        return Window.partitionBy(self.part).orderBy(F.col("_pid").desc()).rowsBetween(Window.unboundedPreceding, -1)


@dataclass
class Feature:
    """Columns by step: ``local`` per row within the slice, ``summary`` per patient and slice, ``carry`` over a patient's
    slices, ``result`` per row from all of them. ``local`` and ``carry`` go in stages, later ones from earlier ones."""
    result: dict[str, Column]
    local: list[dict[str, Column]] = field(default_factory=list)
    summary: dict[str, Column] = field(default_factory=dict)
    carry: list[dict[str, Column]] = field(default_factory=list)
    #: the carry columns that rows need, with the value for a patient that is whole in a slice
    brought: dict[str, Column] = field(default_factory=dict)


def _stages(df: DataFrame, features: Sequence[Feature], name: str) -> DataFrame:
    for stage in zip_longest(*[getattr(f, name) for f in features], fillvalue={}):
        df = df.withColumns({k: v for s in stage for k, v in s.items()})
    return df


def bring(rows: DataFrame, per_slice: DataFrame, part: str, columns: dict[str, Column]) -> DataFrame:
    """``columns`` of ``per_slice`` (patient, slice) added to the rows.

    Only patients that span slices have other slices to hear from. Two at most
    end or begin in a slice, so this table has no more than two rows a slice,
    and is broadcast on that bound."""
    spans = (per_slice.withColumn("_k", F.count("*").over(Window.partitionBy(part))).filter("_k > 1")
             .select(F.col(part).alias("_cp"), F.col("_pid").alias("_cs"), *columns))
    joined = rows.join(F.broadcast(spans), (F.col("_cs") == F.col("_pid")) & F.col("_cp").eqNullSafe(F.col(part)), "left")
    return joined.withColumns({c: F.coalesce(c, alone) for c, alone in columns.items()}).drop("_cp", "_cs")


def segmented_scan(df: DataFrame, part: str, order: Sequence[str], features: Sequence[Feature]) -> DataFrame:
    """``df`` with the results of all features, over one slicing, one aggregation and one join."""
    cut = slices(df, part, order)
    rows = _stages(cut, features, "local")
    summary = [v.alias(k) for f in features for k, v in f.summary.items()]
    if summary:
        per = _stages(rows.groupBy(part, "_pid").agg(*summary), features, "carry")
        rows = bring(rows, per, part, {k: v for f in features for k, v in f.brought.items()})
    made = {k: v for f in features for k, v in f.result.items()}
    out = rows.withColumns(made)
    return out.select(*[c for c in df.columns], *[c for c in made if c not in df.columns])


# ---------------------------------------------------------------- features

def _array_type(kind: str) -> str:
    return f"array<{kind}>"


class Tail:
    """The last ``n`` values of a patient before the slice, and the row's number in the slice."""

    def __init__(self, f: Frames, col: str, kind: str, n: int, name: str):
        self.f, self.col, self.n, self.name = f, col, n, name
        self.number, self.before, self.kind = f"_r_{name}", f"_before_{name}", kind
        self.empty = F.array().cast(_array_type(kind))

    def feature(self, result: dict[str, Column]) -> Feature:
        r, left, tail = self.number, f"_left_{self.name}", f"_tail_{self.name}"
        in_tail = F.when(F.col(left) < self.n, F.struct(F.col(r).alias("r"), F.col(self.col).alias("v")))
        ends = F.transform(F.array_sort(F.collect_list(in_tail)), lambda x: x["v"])
        return Feature(result,
                       local=[{r: F.row_number().over(self.f.rows), left: F.count("*").over(self.f.whole)}, {left: F.col(left) - F.col(r)}],
                       summary={tail: ends}, carry=[{self.before: last_of_earlier(self.f, tail, self.n, self.empty)}],
                       brought={self.before: self.empty})


def last_of_earlier(f: Frames, tail: str, n: int, empty: Column) -> Column:
    """The last ``n`` values of the arrays ``tail`` of earlier slices. Each slice has one at least, so ``n`` slices are enough."""
    earlier = F.concat(*[F.coalesce(F.lag(tail, k).over(f.slices), empty) for k in range(n, 0, -1)])
    return F.slice(earlier, F.greatest(F.size(earlier) - (n - 1), F.lit(1)), F.lit(n))


def lag_of(f: Frames, col: str, number: str, before: str, k: int) -> Column:
    return F.when(F.col(number) > k, F.lag(col, k).over(f.rows)).otherwise(
        F.get(F.col(before), (F.size(before) - (k - F.col(number) + 1)).cast("int")))


def rolling_of(f: Frames, col: str, number: str, before: str, n: int, aggs: Sequence[str]) -> dict[str, Column]:
    """Rolling aggregates over ``n`` rows; null unless all are there and not null."""
    w = f.rows.rowsBetween(-(n - 1), 0)
    b = F.col(before)
    missing = F.greatest(n - F.col(number), F.lit(0))  # rows that the window takes from earlier slices
    past = F.filter(F.slice(b, F.greatest(F.size(b) - missing + 1, F.lit(1)), missing), lambda x: x.isNotNull())
    full = F.count(col).over(w) + F.size(past) == n
    total = F.sum(col).over(w) + F.aggregate(past, F.lit(0).cast("double"), lambda a, x: a + x)
    made = {"sum": total, "mean": total / n, "min": F.least(F.min(col).over(w), F.array_min(past)),
            "max": F.greatest(F.max(col).over(w), F.array_max(past))}
    return {f"rolling_{a}_{n}": F.when(full, made[a]) for a in aggs}


def running(f: Frames, col: str, name: str, total: Column | None = None, count: Column | None = None) -> Feature:
    """Sum ``_s`` and count ``_c`` of the values so far."""
    s, c = f"_s_{name}", f"_c_{name}"
    return Feature({}, local=[{s: F.sum(col).over(f.so_far), c: F.count(col).over(f.so_far)}],
                   summary={f"_ts_{name}": F.sum(col), f"_tc_{name}": F.count(col)},
                   carry=[{f"_os_{name}": F.sum(f"_ts_{name}").over(f.earlier), f"_oc_{name}": F.sum(f"_tc_{name}").over(f.earlier)}],
                   brought={f"_os_{name}": F.lit(0.0), f"_oc_{name}": F.lit(0)})


def expanding(f: Frames, col: str, name: str, min_n: int, out: str) -> Feature:
    made = running(f, col, name)
    total = F.coalesce(f"_s_{name}", F.lit(0)) + F.col(f"_os_{name}")
    n = F.col(f"_c_{name}") + F.col(f"_oc_{name}")
    made.result[out] = F.when(n >= min_n, total / n)
    return made


def known(position: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.col(position).cast("long").alias("p"), value.cast("double").alias("v")))


def shifted(k: Column, by: Column) -> Column:
    return F.when(k.isNotNull(), F.struct((k["p"] + by).alias("p"), k["v"].alias("v")))


def on_line(at: Column, p: Column, q: Column) -> Column:
    """Value at a position between the known places ``p`` and ``q``."""
    return p["v"] + (q["v"] - p["v"]) * (at - p["p"]) / (q["p"] - p["p"])


def interpolated(f: Frames, col: str, name: str, out: str, leading: bool = False) -> Feature:
    """Linear fill by row position; after the last known value that value, before the first one null or, if ``leading``, that one."""
    i, lp, ln = f"_i_{name}", f"_lp_{name}", f"_ln_{name}"
    off, first, last, prior, later = (f"_{x}_{name}" for x in ("off", "sf", "sl", "pp", "nn"))
    here = known(i, F.col(col))
    feature = Feature({}, local=[{i: F.row_number().over(f.rows)},
                                 {lp: F.last(here, ignorenulls=True).over(f.so_far), ln: F.last(here, ignorenulls=True).over(f.from_end)}],
                      summary={f"_n_{name}": F.count("*"), last: F.max(here), first: F.min(here)},
                      carry=[{off: F.coalesce(F.sum(f"_n_{name}").over(f.earlier), F.lit(0))},
                             {last: shifted(F.col(last), F.col(off)), first: shifted(F.col(first), F.col(off))},
                             {prior: F.last(last, ignorenulls=True).over(f.earlier), later: F.last(first, ignorenulls=True).over(f.later)}],
                      brought={off: F.lit(0), prior: F.lit(None), later: F.lit(None)})
    p = F.coalesce(shifted(F.col(lp), F.col(off)), F.col(prior))
    q = F.coalesce(shifted(F.col(ln), F.col(off)), F.col(later))
    value = (F.when(F.col(col).isNotNull(), F.col(col).cast("double")).when(p.isNull(), q["v"] if leading else F.lit(None).cast("double"))
             .when(q.isNull(), p["v"]).otherwise(on_line(F.col(i) + F.col(off), p, q)))
    feature.result[out] = value.cast("double")
    return feature


def next_known(f: Frames, col: str, name: str, out: str) -> Feature:
    """The value or the next one that is not null."""
    here, first, later = f"_loc_{name}", f"_sf_{name}", f"_nx_{name}"
    rank = F.struct(*[F.col(c) for c in f.order])
    return Feature({out: F.coalesce(here, later)}, local=[{here: F.last(col, ignorenulls=True).over(f.from_end)}],
                   summary={first: F.min_by(F.col(col), F.when(F.col(col).isNotNull(), rank))},
                   carry=[{later: F.last(first, ignorenulls=True).over(f.later)}], brought={later: F.lit(None)})


def any_so_far(f: Frames, flag: Column, name: str, out: str) -> Feature:
    """1 from the first row on whose ``flag`` is 1."""
    m, s, before = f"_m_{name}", f"_sm_{name}", f"_pm_{name}"
    return Feature({out: F.greatest(m, before)}, local=[{m: F.max(flag).over(f.so_far)}], summary={s: F.max(flag)},
                   carry=[{before: F.coalesce(F.max(s).over(f.earlier), F.lit(0))}], brought={before: F.lit(0)})
