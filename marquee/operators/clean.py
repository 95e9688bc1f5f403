"""Cleaning: null handling, outliers, imputation, scaling, deduplication.

Each operator is fit (one aggregation returning a bounded set of scalars) +
transform (a lazy projection or filter).  Fits never collect rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.columns import epoch_micros, select_dtypes
from marquee.operators.profile import _num, _q, quantiles
from marquee.session import save_table


# ---------------------------------------------------------------- nulls / filters

def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.dropna(subset=subset)


def iqr_fences(df: DataFrame, cols: list[str], k: float = 1.5, approx: bool = False) -> dict:
    """{column: (low, high)} with q1 - k*iqr, q3 + k*iqr (exact linear quantiles)."""
    qs = quantiles(df, cols, [0.25, 0.75], approx=approx)
    out = {}
    for c in cols:
        q1, q3 = qs[c]
        out[c] = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def iqr_filter(df: DataFrame, column: str, k: float = 1.5, approx: bool = False) -> DataFrame:
    """Keep rows inside the IQR fences of ``column``; nulls are dropped."""
    lo, hi = iqr_fences(df, [column], k, approx)[column]
    if lo is None:
        return df.limit(0)
    x = _num(df, column)
    return df.where((x >= F.lit(lo)) & (x <= F.lit(hi)))


def _clip(x: Column, lo, hi) -> Column:
    """Clip keeping nulls (``greatest``/``least`` would skip them)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def winsorize(df: DataFrame, column: str, lower_q: float = 0.01, upper_q: float = 0.99,
              approx: bool = False) -> DataFrame:
    """Clip ``column`` at its lower/upper quantiles; nulls kept."""
    lo, hi = quantiles(df, [column], [lower_q, upper_q], approx=approx)[column]
    if lo is None:
        return df
    return df.withColumn(column, _clip(_num(df, column), lo, hi))


def outliers_filter(df: DataFrame, cols: list[str], k: float = 1.5, approx: bool = False):
    """Sequential IQR filter: fences of column i come from rows that survived columns < i.

    Returns ``(filtered_df, report)``; the report has (column, low, high, removed).
    Each step is one quantile job over the filtered lineage (filters are narrow and
    pushed to the scan); counts come from the same pass as the next fences.
    """
    spark = df.sparkSession
    rows = []
    cur = df
    n_before = cur.count()
    for c in cols:
        lo, hi = iqr_fences(cur, [c], k, approx)[c]
        x = _num(cur, c)
        cur = cur.where((x >= F.lit(lo)) & (x <= F.lit(hi))) if lo is not None else cur.limit(0)
        n_after = cur.count()
        rows.append((c, lo, hi, int(n_before - n_after)))
        n_before = n_after
    rep = spark.createDataFrame(rows, "column string, low double, high double, removed long")
    return cur, rep


def outliers_clip(df: DataFrame, cols: list[str], k: float = 1.5, approx: bool = False,
                  null_counts_as_changed: bool = True):
    """Clip each column at its own IQR fences (columns independent).

    Returns ``(clipped_df, report)`` with (column, low, high, clipped).  With
    ``null_counts_as_changed`` a null counts as changed (NaN != NaN in the reference).
    """
    fences = iqr_fences(df, cols, k, approx)
    out = df.withColumns({c: _clip(_num(df, c), *fences[c]) if fences[c][0] is not None else _q(c)
                          for c in cols})
    aggs = []
    for c in cols:
        lo, hi = fences[c]
        x = _num(df, c)
        changed = (x < F.lit(lo)) | (x > F.lit(hi)) if lo is not None else F.lit(False)
        if null_counts_as_changed:
            changed = changed | x.isNull()
        aggs.append(F.count_if(changed).alias(c))
    counts = df.agg(*aggs).first()
    rep = df.sparkSession.createDataFrame(
        [(c, fences[c][0], fences[c][1], int(counts[c])) for c in cols],
        "column string, low double, high double, clipped long")
    return out, rep


# fixed values: declared licence row bounds
UNITS_MIN, PRICE_MIN, WIN_DAYS_MIN, WIN_DAYS_MAX = 0, 0, 7, 365


def row_bounds(df: DataFrame) -> DataFrame:
    """Violation counts of the declared row bounds, in one aggregation."""
    days = F.datediff(F.to_date("window_end"), F.to_date("window_start"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("units") < UNITS_MIN).alias("units_below_min"),
        F.count_if(F.col("price") < PRICE_MIN).alias("price_below_min"),
        F.count_if((days < WIN_DAYS_MIN) | (days > WIN_DAYS_MAX)).alias("window_days_out_of_range"))


# ---------------------------------------------------------------- imputation

def impute(df: DataFrame, strategy: str = "median", columns: list[str] | None = None,
           approx: bool = False) -> DataFrame:
    """Numeric columns: fill with median or mean (other strategy: untouched);
    other columns: fill with the mode (all-null columns stay null)."""
    cols = columns or df.columns
    num = [c for c in cols if c in select_dtypes(df, "numeric")]
    oth = [c for c in cols if c not in num]
    fills: dict = {}
    if num and strategy == "median":
        qs = quantiles(df, num, [0.5], approx=approx)
        fills.update({c: qs[c][0] for c in num})
    elif num and strategy == "mean":
        r = df.agg(*[F.avg(_num(df, c)).alias(c) for c in num]).first()
        fills.update({c: r[c] for c in num})
    modes = _typed_modes(df, oth)
    fills.update(modes)
    exprs = {}
    for c, v in fills.items():
        if v is None:
            continue
        dt = df.schema[c].dataType
        if c in num:
            if isinstance(dt, T.DoubleType) or isinstance(dt, T.FloatType):
                exprs[c] = F.coalesce(_num(df, c), F.lit(float(v)))
            elif float(v) == int(v):
                exprs[c] = F.coalesce(_q(c), F.lit(int(v)).cast(dt))
            else:
                exprs[c] = F.coalesce(_q(c).cast("double"), F.lit(float(v)))
        else:
            exprs[c] = F.coalesce(_q(c), F.lit(v).cast(dt))
    return df.withColumns(exprs) if exprs else df


def _typed_modes(df: DataFrame, cols: list[str]) -> dict:
    """Mode per column (smallest value in the column's own type on ties).

    Distributed: one ``groupBy(column, value)`` count per type group, then a
    per-column ``min_by`` (partial aggregation) - no task holds every value.
    """
    out = {}
    for sub in _group_by_type(df, cols):
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), _q(c).alias("value")) for c in sub])).alias("p")
        ).select("p.*").where(F.col("value").isNotNull())
        vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = vc.groupBy("column").agg(F.min_by("value", F.struct((-F.col("n")).alias("a"),
                                                                    F.col("value").alias("b"))).alias("mode"))
        if df.schema[sub[0]].dataType.typeName().startswith("timestamp"):
            best = best.withColumn("mode", F.col("mode").cast("string"))     # as text no zone of the driver's changes it
        out.update({r["column"]: r["mode"] for r in best.collect()})
    return out


def _group_by_type(df: DataFrame, cols: list[str]) -> list[list[str]]:
    groups: dict = {}
    for c in cols:
        groups.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    return list(groups.values())


# ---------------------------------------------------------------- scaling

def scale_standard(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std; a constant column becomes 0; nulls kept."""
    r = df.agg(*[F.avg(_num(df, c)).alias(f"{c}|m") for c in cols],
               *[F.stddev_pop(_num(df, c)).alias(f"{c}|s") for c in cols]).first()
    ex = {}
    for c in cols:
        m, s = r[f"{c}|m"], r[f"{c}|s"]
        if m is None:
            ex[c] = _num(df, c)
            continue
        s = 1.0 if not s else s
        ex[c] = (_num(df, c) - F.lit(m)) / F.lit(s)
    return df.withColumns(ex)


def scale_minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0; nulls kept."""
    r = df.agg(*[F.min(_num(df, c)).alias(f"{c}|lo") for c in cols],
               *[F.max(_num(df, c)).alias(f"{c}|hi") for c in cols]).first()
    ex = {}
    for c in cols:
        lo, hi = r[f"{c}|lo"], r[f"{c}|hi"]
        if lo is None:
            ex[c] = _num(df, c)
            continue
        rng = (hi - lo) or 1.0
        ex[c] = (_num(df, c) - F.lit(lo)) / F.lit(rng)
    return df.withColumns(ex)


def scale(df: DataFrame, cols: list[str], method: str = "standard") -> DataFrame:
    return scale_standard(df, cols) if method == "standard" else scale_minmax(df, cols)


# ---------------------------------------------------------------- deduplication
#
# "Keep one row per key" is the smallest struct that begins with the sort key: map-side partial
# aggregation keeps one row per key per partition, so a key holding a third of the table
# never lands in one task whole (a window would sort it in one task). Each column moves once; rows tied
# in the sort key go by their other columns. As rows hold strings, Spark plans it as sort aggregates:
# each task sorts its rows by key, on disk if need be.

def _keep_best(df: DataFrame, keys: list[str], first: list[Column], order_by: list[str], keep_null_keys: bool,
               columns: list[str] | None = None) -> DataFrame:
    """The row per key that is smallest by ``first``, then ``order_by``. ``columns``: those returned (default all);
    where null keys are kept, the columns needed are written once, as the rows are read twice."""
    cols = list(columns or df.columns)
    ranks = [f"__rank{i}" for i in range(len(first))]
    held = list(dict.fromkeys([*keys, *order_by, *cols]))
    rows = df.withColumns(dict(zip(ranks, first))).select(*[_q(c) for c in [*held, *ranks]])
    nk = F.lit(False)
    for k in keys:
        nk = nk | _q(k).isNull()
    if keep_null_keys:
        rows = save_table(rows, "ranked")
    body = rows.where(~nk) if keep_null_keys else rows
    kinds = {c: df.schema[c].dataType.simpleString() for c in cols}
    # grouping makes -0.0 and 0.0 one value, so a fractional key is carried with its row
    grouped = [c for c in cols if c in keys and kinds[c] not in ("double", "float")]
    order = list(dict.fromkeys([*ranks, *order_by]))
    carried = [*order, *[c for c in cols if c not in grouped and c not in order]]
    row = F.struct(*[_q(c) for c in carried])
    if any("map<" in k or "variant" in k for k in kinds.values()):        # no order of their own
        best = F.min_by(row, F.struct(*[_q(c) for c in order]))
    else:
        best = F.min(row)
    out = body.groupBy(*[_q(k) for k in keys]).agg(best.alias("_w"))
    out = out.select(*[_q(c) if c in grouped else F.col(f"_w.`{c}`").alias(c) for c in cols])
    if keep_null_keys:
        out = out.unionByName(rows.where(nk).select(*[_q(c) for c in cols]))
    return out


def deduplicate(df: DataFrame, subset: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Keep the first row per ``subset`` (nulls equal) in ``order_by`` order;
    without an order any one row per key is kept (``dropDuplicates``)."""
    if not order_by:
        return df.dropDuplicates(subset)
    return _keep_best(df, subset, [], order_by, keep_null_keys=False)


def completeness(df: DataFrame, cols: list[str] | None = None) -> Column:
    cols = cols or df.columns
    s = F.lit(0)
    for c in cols:
        s = s + (~_missing_any(df, c)).cast("int")
    return s


def _missing_any(df, c):
    from marquee.operators.profile import _missing
    return _missing(df, c)


def dedup_most_complete(df: DataFrame, key: str, order_by: list[str], columns: list[str] | None = None) -> DataFrame:
    """Per key keep the row with most non-null fields (of all of ``df``), first in ``order_by`` on ties;
    rows with a null key are left untouched. ``columns``: those returned."""
    return _keep_best(df, [key], [-completeness(df)], order_by, keep_null_keys=True, columns=columns)


def dedup_latest(df: DataFrame, key: str, order_by: list[str], ts: str = "window_end", columns: list[str] | None = None) -> DataFrame:
    """Per key keep the latest ``ts`` (first in ``order_by`` on ties or all-null);
    without a ``ts`` column the first row in ``order_by`` order; null keys untouched. ``columns``: those returned."""
    first = []
    if ts in df.columns:
        t = epoch_micros(df, ts)
        first = [t.isNull(), -F.coalesce(t, F.lit(0))]
    return _keep_best(df, [key], first, order_by, keep_null_keys=True, columns=columns)


def dedup_report(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    nb, na = before.count(), after.count()
    return before.sparkSession.createDataFrame([(key, nb, na, nb - na)],
                                               "key string, rows_before long, rows_after long, removed long")
