"""Profiling aggregates: one wide aggregation + one unpivot, never one job per column.

Quantiles are exact by default (pandas ``linear`` interpolation): a distributed
histogram (``groupBy(column, value)``) and exact running totals find the order
statistics, so no single task ever holds every distinct value.  ``approx=True``
switches to the mergeable ``percentile_approx`` sketch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marquee.functions.columns import epoch_micros, select_dtypes
from marquee.operators.rank import in_ranges


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _missing(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    cond = _q(c).isNull()
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        cond = cond | F.isnan(_q(c))
    return cond


def _num(df: DataFrame, c: str) -> Column:
    """Numeric value with NaN as null (pandas treats both as missing)."""
    dt = df.schema[c].dataType
    x = _q(c).cast("double")
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        x = F.when(~F.isnan(_q(c)), x)
    return x


def _long(df: DataFrame, cols: list[str], value: Column | None = None) -> DataFrame:
    """Unpivot numeric columns to (column, v) with nulls dropped."""
    pairs = [F.struct(F.lit(c).alias("column"), _num(df, c).alias("v")) for c in cols]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.v").where(
        F.col("v").isNotNull())


def quantiles(df: DataFrame, cols: list[str], probs: list[float], approx: bool = False,
              accuracy: int = 10000) -> dict:
    """{column: [q(p) for p in probs]} with linear interpolation; None for all-null columns."""
    if not cols:
        return {}
    if approx:
        row = df.agg(*[F.percentile_approx(_num(df, c), probs, accuracy).alias(c) for c in cols]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}
    found = group_quantiles(_long(df, cols), "column", "v", probs)
    return {c: found.get(c, [None] * len(probs)) for c in cols}


#: error of the sketch that brackets a wanted rank (a share of the rows is 1 in so many), the share of the rows
#: kept on either side of it, and the rows up to which a group is taken whole
_SKETCH, _NEAR, _FEW = 1000, 0.002, 1000


def group_quantiles(rows: DataFrame, group: str, value: str, probs: list[float]) -> dict:
    """{group: [q(p) for p in probs]}, exact, for a bounded number of groups of non-null values.

    A sketch brackets each wanted rank; only values inside a bracket move one by one, those between brackets
    move as counts. Small groups, and groups where a rank lies outside its bracket after all, are taken whole.
    ``rows`` are read two or three times.
    """
    near = [min(1.0, max(0.0, p + d)) for p in probs for d in (-_NEAR, _NEAR)]
    sketch = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, near, _SKETCH).alias("_at")).collect()
    large = [r for r in sketch if r["_n"] > _FEW]
    found = {}
    if large:
        kinds = [rows.schema[c].dataType.simpleString() for c in (group, value)]
        ends = [f"_e{i}" for i in range(len(near))]
        cuts = rows.sparkSession.createDataFrame([(r[group], *r["_at"]) for r in large],
                                                 f"`{group}` {kinds[0]}, " + ", ".join(f"{e} {kinds[1]}" for e in ends))
        v = F.col(value)
        cell, inside = F.lit(0), F.lit(False)
        for lo, hi in zip(ends[::2], ends[1::2]):
            cell = cell + (v >= F.col(lo)).cast("int") + (v > F.col(hi)).cast("int")
            inside = inside | ((v >= F.col(lo)) & (v <= F.col(hi)))
        coarse = rows.join(F.broadcast(cuts), group).select(group, cell.alias("_cell"), F.when(inside, v).alias(value))
        found = _order_statistics(coarse, group, value, probs)
    whole = [r[group] for r in sketch if None in found.get(r[group], [None])]
    if whole:
        some = rows if len(whole) == len(sketch) else rows.where(F.col(group).isin(whole))
        found.update(_order_statistics(some.withColumn("_cell", F.lit(0)), group, value, probs))
    return found


def _order_statistics(rows: DataFrame, group: str, value: str, probs: list[float]) -> dict:
    """{group: [q(p) for p in probs]} of values ordered by (_cell, value); None where a rank falls on rows without a value.

    A histogram is written in ranges of (group, _cell, value). The ranges' totals, at most groups +
    ranges numbers, tell which range holds a wanted order statistic; only those are read again.
    """
    hist = rows.groupBy(group, "_cell", value).agg(F.count(F.lit(1)).alias("cnt"))
    h = in_ranges(hist, [group, "_cell", value])
    sizes, parts = {}, {}
    for r in h.groupBy(group, "_b").agg(F.sum("cnt").alias("n")).orderBy("_b").collect():
        parts.setdefault(r[group], []).append((r["_b"], sizes.get(r[group], 0), r["n"]))
        sizes[r[group]] = sizes.get(r[group], 0) + r["n"]
    wanted = {g: [((n - 1) * p, math.floor((n - 1) * p), math.ceil((n - 1) * p)) for p in probs] for g, n in sizes.items()}
    asked = []
    for g, at in wanted.items():
        ks = sorted({k for _, lo, hi in at for k in (lo, hi)})
        for b, before, n in parts[g]:
            inside = [k - before for k in ks if before <= k < before + n]
            if inside:
                asked.append((g, b, before, inside))
    if not asked:
        return {}
    kind = rows.schema[group].dataType.simpleString()
    asked = rows.sparkSession.createDataFrame(asked, f"`{group}` {kind}, _b int, _before long, _ks array<long>")
    le = F.sum("cnt").over(Window.partitionBy(group, "_b").orderBy("_cell", value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # order statistic k (0-based) is the value whose count range [le-cnt, le-1] holds k
    hit = h.join(F.broadcast(asked), [group, "_b"]).withColumn("_le", le).select(
        group, value, "_before", F.explode(F.filter("_ks", lambda k: (F.col("_le") - F.col("cnt") <= k) & (k < F.col("_le")))).alias("_k"))
    at_rank = {(r[group], r["_before"] + r["_k"]): r[value] for r in hit.collect()}

    def between(g, h, lo, hi):
        a, b = at_rank[(g, lo)], at_rank[(g, hi)]
        return None if a is None or b is None else a + (h - lo) * (b - a)
    return {g: [between(g, *x) for x in at] for g, at in wanted.items()}


# ---------------------------------------------------------------- shape / missing

def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)))


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, missing) for every column, from one aggregation."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _q(c).alias("missing"))
                                           for c in cols])).alias("p")).select("p.*")


def nan_pct_top(df: DataFrame, n: int = 10) -> DataFrame:
    """Columns with the largest null share (tie: column name)."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(_missing(df, c)).alias(c) for c in cols])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), (_q(c) / F.col("__n")).alias("nan_pct")) for c in cols])).alias("p"))
    return long.select("p.*").orderBy(F.desc("nan_pct"), "column").limit(n)


def duplicate_key_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first per key (null is a value); 0 / has_keys=false if a key is absent."""
    if not all(k in df.columns for k in keys):
        return df.sparkSession.createDataFrame([(0, False)], "duplicates long, has_keys boolean")
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return g.agg((F.sum("c") - F.count(F.lit(1))).cast("long").alias("duplicates")).select(
        F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.lit(True).alias("has_keys"))


# ---------------------------------------------------------------- numeric summaries

_SUMMARY_SCHEMA = ("column string, mean double, median double, std double, min double, "
                   "q1 double, q3 double, max double, missing long")


def num_summary(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, mean, median, std(ddof 1), min, q1, q3, max, missing) per numeric column."""
    num = [c for c in (cols or df.columns) if c in select_dtypes(df, "numeric")]
    spark = df.sparkSession
    if not num:
        return spark.createDataFrame([], _SUMMARY_SCHEMA)
    aggs = []
    for c in num:
        x = _num(df, c)
        aggs += [F.avg(x).alias(f"{c}|mean"), F.stddev_samp(x).alias(f"{c}|std"),
                 F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max"),
                 F.count_if(_missing(df, c)).alias(f"{c}|missing")]
    r = df.agg(*aggs).first()
    qs = quantiles(df, num, [0.5, 0.25, 0.75], approx=approx)
    rows = [(c, r[f"{c}|mean"], qs[c][0], r[f"{c}|std"], r[f"{c}|min"], qs[c][1], qs[c][2],
             r[f"{c}|max"], int(r[f"{c}|missing"])) for c in num]
    return spark.createDataFrame(rows, _SUMMARY_SCHEMA)


def imputation_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return num_summary(df, cols).select("column", "mean", "median", "missing")


def describe_all(df: DataFrame, approx: bool = False) -> DataFrame:
    """pandas ``describe(include='all')`` as a long table.

    numeric: count, mean, std, min, 25/50/75 %, max; datetime: count, mean, min,
    quartiles, max as epoch seconds (no std); other: count, unique, top, freq
    (top tie: smallest value).  Fields that do not apply are null.
    """
    spark = df.sparkSession
    num = select_dtypes(df, "numeric")
    tim = select_dtypes(df, "datetime")
    cat = [c for c in df.columns if c not in num and c not in tim]

    def ep(c):
        return epoch_micros(df, c).cast("double") / 1e6

    vals = {c: _num(df, c) for c in num}
    vals.update({c: ep(c) for c in tim})
    aggs = []
    for c, x in vals.items():
        aggs += [F.count(x).alias(f"{c}|count"), F.avg(x).alias(f"{c}|mean"),
                 F.stddev_samp(x).alias(f"{c}|std"), F.min(x).alias(f"{c}|min"),
                 F.max(x).alias(f"{c}|max")]
    aggs += [F.count(_q(c)).alias(f"{c}|count") for c in cat]
    r = df.agg(*aggs).first() if aggs else None
    qs = {}
    if vals:
        tmp = df.select(*[x.alias(c) for c, x in vals.items()])
        qs = quantiles(tmp, list(vals), [0.25, 0.5, 0.75], approx=approx)
    rows = []
    for c in df.columns:
        if c in vals:
            q = qs[c]
            rows.append((c, int(r[f"{c}|count"]), None, None, None, r[f"{c}|mean"],
                         r[f"{c}|std"] if c in num else None, r[f"{c}|min"], q[0], q[1], q[2],
                         r[f"{c}|max"]))
    schema = ("column string, count long, unique long, top string, freq long, mean double, "
              "std double, min double, p25 double, p50 double, p75 double, max double")
    out = spark.createDataFrame(rows, schema)
    if cat:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                      _q(c).cast("string").alias("value"))
                                             for c in cat])).alias("p")).select("p.*").where(
            F.col("value").isNotNull())
        vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        top = vc.groupBy("column").agg(
            F.count(F.lit(1)).alias("unique"),
            F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("t"))
        counts = spark.createDataFrame([(c, int(r[f"{c}|count"])) for c in cat], "column string, count long")
        cats = counts.join(top, "column", "left").select(
            "column", "count", F.coalesce("unique", F.lit(0)).cast("long").alias("unique"),
            F.col("t.value").alias("top"), F.col("t.n").cast("long").alias("freq"),
            *[F.lit(None).cast("double").alias(k) for k in ["mean", "std", "min", "p25", "p50", "p75", "max"]])
        out = out.unionByName(cats)
    return out


# ---------------------------------------------------------------- categorical summaries

def cat_summary(df: DataFrame, cols: list[str], top_n: int = 15) -> DataFrame:
    """Top values per column, null shown as 'Unknown' (tie: value)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                  F.coalesce(_q(c).cast("string"), F.lit("Unknown")).alias("value"))
                                         for c in cols])).alias("p")).select("p.*")
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return vc.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_n).drop("_r")


def value_counts_top(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """Top-n values by count, nulls excluded (tie: value)."""
    return (df.where(_q(col).isNotNull()).groupBy(_q(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(n))


def group_mean_top(df: DataFrame, cat: str, val: str, n: int = 20) -> DataFrame:
    """Mean of ``val`` per ``cat`` (null group kept), top-n by mean (tie: category)."""
    return (df.groupBy(_q(cat).alias("category")).agg(F.avg(_num(df, val)).alias("mean"))
            .orderBy(F.desc_nulls_last("mean"), F.asc_nulls_first("category")).limit(n))


def cardinality(df: DataFrame, cols: list[str], dropna: bool = False, approx: bool = False) -> DataFrame:
    """Distinct values per column; ``dropna=False`` counts null as one value."""
    aggs = []
    for c in cols:
        d = F.approx_count_distinct(_q(c)) if approx else F.count_distinct(_q(c))
        if not dropna:
            d = d + F.max(_q(c).isNull().cast("int"))
        aggs.append(d.cast("long").alias(c))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _q(c).alias("cardinality"))
                                           for c in cols])).alias("p")).select("p.*")


def mode_value(df: DataFrame, col: str) -> DataFrame:
    """Most frequent non-null value, smallest on ties.

    ``groupBy(value).count`` then ``min_by`` (partial aggregation) instead of the
    ``mode`` aggregate, whose single final buffer would hold every distinct value.
    """
    vc = df.where(_q(col).isNotNull()).groupBy(_q(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return vc.agg(F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v").alias("b"))).alias("mode"))


# ---------------------------------------------------------------- correlation

_MOMENTS = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double, " \
           "xlo double, xhi double, ylo double, yhi double"


def _pair_moments(p: int):
    """Per partition: moment sums of every pair of ``p`` columns over the rows where both are present."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((p, p)) for _ in range(4))
        lo, hi = np.full((p, p), np.inf), np.full((p, p), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = ~np.isnan(x)
            z, m = np.where(there, x, 0.0), there.astype(float)
            n += m.T @ m
            sx += z.T @ m
            sxx += (z * z).T @ m
            sxy += z.T @ z
            least, most = np.where(there, x, np.inf), np.where(there, x, -np.inf)
            for j in range(p):                  # extremes of every column where column j is present
                rows = there[:, j]
                if rows.any():
                    lo[:, j] = np.minimum(lo[:, j], least[rows].min(axis=0))
                    hi[:, j] = np.maximum(hi[:, j], most[rows].max(axis=0))
        i, j = np.triu_indices(p)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
             *[pa.array(a) for a in (n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j],
                                     lo[i, j], hi[i, j], lo[j, i], hi[j, i])]],
            names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy", "xlo", "xhi", "ylo", "yhi"])
    return scan


#: sums that one JVM aggregate adds at most; wider tables add numpy matrices instead
JVM_SUMS = 400


def _correlation(n, sx, sy, sxx, syy, sxy, varies):
    """Pearson from (shifted) moment sums; null unless both sides vary."""
    spread = F.sqrt(sxx - sx * sx / n) * F.sqrt(syy - sy * sy / n)
    return F.when((n > 0) & varies, F.when(spread > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (sxy - sx * sy / n) / spread))))


def corr_matrix(df: DataFrame, cols: list[str] | None = None, places: int | None = 3) -> DataFrame:
    """Pairwise-complete Pearson correlation as (col_a, col_b, corr); constant -> null.

    One aggregate gives means and counts, a second the sums of products of centred values.
    A pair of columns without missing values needs one sum of its own; other pairs sum over
    the rows where both are present. Where that makes more than ``JVM_SUMS`` sums, each
    partition turns its rows into one matrix of moment sums (numpy on Arrow batches), and the
    matrices are added by pair, so the plan does not grow with the number of columns.
    """
    num = list(cols or select_dtypes(df, "numeric"))
    p = len(num)
    if not num:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    xs = [_num(df, c) for c in num]
    first = df.agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{k}{i}") for i, x in enumerate(xs)
                                                   for k, f in (("m", F.avg), ("c", F.count), ("lo", F.min), ("hi", F.max))]).first()
    centre = [first[f"m{i}"] if first[f"m{i}"] is not None and math.isfinite(first[f"m{i}"]) else 0.0 for i in range(p)]
    whole = [first[f"c{i}"] == first["n"] for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    n_sums = p + sum(1 if whole[i] and whole[j] else 10 for i, j in pairs)
    if n_sums > JVM_SUMS:
        return _wide_corr(df, num, centre, places)
    z = [(x - F.lit(m)).alias(f"z{i}") for i, (x, m) in enumerate(zip(xs, centre))]
    zs = [F.col(f"z{i}") for i in range(p)]
    sums = [F.sum(zs[i]).alias(f"s{i}") for i in range(p)]
    for i, j in pairs:
        if whole[i] and whole[j]:
            sums.append(F.sum(zs[i] * zs[j]).alias(f"p{i}_{j}"))
            continue
        both = zs[i].isNotNull() & zs[j].isNotNull()
        a, b = F.when(both, zs[i]), F.when(both, zs[j])
        sums += [f(v).alias(f"{k}{i}_{j}") for k, f, v in (
            ("n", F.count, a), ("x", F.sum, a), ("y", F.sum, b), ("xx", F.sum, a * a), ("yy", F.sum, b * b), ("p", F.sum, a * b),
            ("xl", F.min, a), ("xh", F.max, a), ("yl", F.min, b), ("yh", F.max, b))]
    got = df.select(*z).agg(*sums).first()
    moments = []
    for i, j in pairs:
        if whole[i] and whole[j]:
            varies = all(first[f"lo{k}"] is not None and first[f"lo{k}"] < first[f"hi{k}"] for k in (i, j))
            row = (float(first["n"]), got[f"s{i}"], got[f"s{j}"], got[f"p{i}_{i}"], got[f"p{j}_{j}"], got[f"p{i}_{j}"], varies)
        else:
            v = {k: got[f"{k}{i}_{j}"] for k in ("n", "x", "y", "xx", "yy", "p", "xl", "xh", "yl", "yh")}
            varies = v["xl"] is not None and v["xl"] < v["xh"] and v["yl"] < v["yh"]
            row = (float(v["n"]), v["x"], v["y"], v["xx"], v["yy"], v["p"], varies)
        moments += [(num[a], num[b], *row) for a, b in {(i, j), (j, i)}]
    known = df.sparkSession.createDataFrame(moments, "col_a string, col_b string, n double, sx double, sy double, sxx double, "
                                                     "syy double, sxy double, varies boolean")
    r = _correlation(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "varies")])
    return known.select("col_a", "col_b", _rounded(r, places).alias("corr"))


def _rounded(r: Column, places: int | None) -> Column:
    return r if places is None else F.round(r, places) + F.lit(0.0)     # + 0.0 turns -0.0 into 0.0


def _wide_corr(df: DataFrame, num: list[str], centre: list[float], places: int | None) -> DataFrame:
    """Correlations from one matrix of moment sums a partition."""
    p = len(num)
    wide = df.select(*[(_num(df, c) - F.lit(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(num, centre))])
    parts = wide.mapInArrow(_pair_moments(p), _MOMENTS).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")],
        *[F.min(c).alias(c) for c in ("xlo", "ylo")], *[F.max(c).alias(c) for c in ("xhi", "yhi")])
    varies = (F.col("xlo") < F.col("xhi")) & (F.col("ylo") < F.col("yhi"))
    r = _rounded(_correlation(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")], varies), places)
    grid = df.sparkSession.range(p * p).select((F.col("id") / p).cast("int").alias("a"), (F.col("id") % p).cast("int").alias("b"))
    pairs = grid.join(parts, (F.least("a", "b") == F.col("i")) & (F.greatest("a", "b") == F.col("j")), "left")
    name = F.array(*[F.lit(c) for c in num])
    return pairs.select(name[F.col("a")].alias("col_a"), name[F.col("b")].alias("col_b"), r.alias("corr"))


# ---------------------------------------------------------------- datetime

def datetime_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, count, min, max, range_days, missing); range in whole days, floored."""
    tim = cols or select_dtypes(df, "datetime")
    aggs = []
    for c in tim:
        t = _q(c).cast("timestamp_ntz")
        aggs += [F.count(t).alias(f"{c}|n"), F.min(t).alias(f"{c}|min"), F.max(t).alias(f"{c}|max"),
                 F.count_if(t.isNull()).alias(f"{c}|miss")]
    wide = df.agg(*aggs)

    def rng(c):   # a difference of zone-less times knows no clock changes
        return F.extract(F.lit("DAY"), F.col(f"`{c}|max`") - F.col(f"`{c}|min`")).cast("long")

    items = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}|n`").alias("count"),
                      F.col(f"`{c}|min`").alias("min"), F.col(f"`{c}|max`").alias("max"),
                      rng(c).alias("range_days"), F.col(f"`{c}|miss`").alias("missing")) for c in tim]
    return wide.select(F.explode(F.array(*items)).alias("p")).select("p.*")


_FREQ = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def datetime_trend(df: DataFrame, col: str, freq: str = "M") -> DataFrame:
    """Rows per period (start of day/week(Monday)/month/quarter/year), ascending, sparse."""
    if col not in df.columns:
        return df.sparkSession.createDataFrame([], "period_start timestamp_ntz, count long")
    t = _q(col).cast("timestamp_ntz")
    per = F.date_trunc(_FREQ[freq.upper()], t).cast("timestamp_ntz")
    return (df.where(t.isNotNull()).groupBy(per.alias("period_start"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("period_start"))


def hour_histogram(df: DataFrame, col: str) -> DataFrame:
    """Row count per hour of day on the full 0..23 grid (zeros included)."""
    spark = df.sparkSession
    grid = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = (df.where(_q(col).isNotNull()).groupBy(F.hour(_q(col)).alias("hour"))
              .agg(F.count(F.lit(1)).alias("count")))
    return grid.join(F.broadcast(counts), "hour", "left").select(
        "hour", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


# ---------------------------------------------------------------- histogram / box

def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width counts over [min, max] (last bin closed); constant -> [v-0.5, v+0.5].

    (bin, lo, hi, count) with every bin present; one stats pass + one grouped pass.
    """
    x = _num(df, col)
    st = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    spark = df.sparkSession
    if st["lo"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    lo, hi = float(st["lo"]), float(st["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    idx = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def _box_from(df: DataFrame, x: Column, group: list, q: DataFrame) -> DataFrame:
    """Whiskers (never inside the box) and flier counts given per-group quartiles ``q`` (group..., q1, median, q3)."""
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    j = df.select(*group, x.alias("_x")).where(F.col("_x").isNotNull())
    j = j.join(F.broadcast(q), group)
    inside = (F.col("_x") >= lo_f) & (F.col("_x") <= hi_f)
    return j.groupBy(*group, "q1", "median", "q3").agg(
        F.least(F.min(F.when(inside, F.col("_x"))), F.col("q1")).alias("whisker_lo"),
        F.greatest(F.max(F.when(inside, F.col("_x"))), F.col("q3")).alias("whisker_hi"),
        F.count_if(~inside).alias("fliers"), F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """(column, q1, median, q3, whisker_lo, whisker_hi, fliers, n) per column."""
    qs = quantiles(df, cols, [0.25, 0.5, 0.75], approx=approx)
    spark = df.sparkSession
    qdf = spark.createDataFrame([(c, *qs[c]) for c in cols],
                                "column string, q1 double, median double, q3 double")
    long = _long(df, cols)
    return _box_from(long, F.col("v"), ["column"], qdf)


def month_box(df: DataFrame, ts: str, val: str, approx: bool = False) -> DataFrame:
    """Box statistics of ``val`` per month of ``ts`` (both non-null).

    Quartiles come from a distributed histogram, so no task sorts a whole month."""
    x = _num(df, val)
    base = df.where(_q(ts).isNotNull() & x.isNotNull()).select(F.month(_q(ts)).alias("month"), x.alias("v"))
    probs = [0.25, 0.5, 0.75]
    if approx:
        q = base.groupBy("month").agg(F.percentile_approx("v", probs, 10000).alias("_q")).select(
            "month", *[F.col("_q")[i].alias(k) for i, k in enumerate(("q1", "median", "q3"))])
    else:
        q = df.sparkSession.createDataFrame([(m, *v) for m, v in sorted(group_quantiles(base, "month", "v", probs).items())],
                                            "month int, q1 double, median double, q3 double")
    return _box_from(base, F.col("v"), ["month"], q)
