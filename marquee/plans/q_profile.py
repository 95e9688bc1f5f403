"""Queries: profiling aggregates over the licensing view and driver tables."""

from __future__ import annotations

from marquee.operators import profile as P
from marquee.plans.registry import query, rnd, tables

LIC_NUM = ["release_year", "units", "price"]
LIC_TIME = ["window_start", "window_end"]
LIC_CAT = ["license_id", "title_id", "title", "territory", "media", "platform", "currency"]
LIC_ALL = ["license_id", "title_id", "title", "release_year", "territory", "media", "platform",
           "window_start", "window_end", "units", "price", "currency"]


def _lic(spark, sf_dir):
    return tables(spark, sf_dir)["licensing"]


def _union(parts):
    return "\nunion all\n".join(parts)


@query("shape", f"select count(*) as rows, {len(LIC_ALL)} as cols from licensing")
def q_shape(spark, sf_dir):
    return P.shape(_lic(spark, sf_dir))


@query("missing_counts", _union(
    [f"select '{c}' as column, count(*) filter (where {c} is null) as missing from licensing" for c in LIC_ALL]))
def q_missing_counts(spark, sf_dir):
    return P.missing_counts(_lic(spark, sf_dir))


@query("nan_pct_top", "select \"column\", round(nan_pct, 6) as nan_pct from (" + _union(
    [f"select '{c}' as column, count(*) filter (where {c} is null) / count(*) as nan_pct from licensing"
     for c in LIC_ALL]) + ") t order by nan_pct desc, \"column\" limit 10")
def q_nan_pct_top(spark, sf_dir):
    return rnd(P.nan_pct_top(_lic(spark, sf_dir)))


@query("duplicate_key_count",
       "select cast(count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem) d)"
       " as bigint) as duplicates, true as has_keys from lineitem")
def q_duplicate_key_count(spark, sf_dir):
    return P.duplicate_key_count(tables(spark, sf_dir)["lineitem"], ["l_orderkey", "l_linenumber"])


def _num_summary_sql(table, cols):
    return _union([
        f"select '{c}' as column, round(avg({c}), 6) as mean, round(quantile_cont({c}, 0.5), 6) as median, "
        f"round(stddev_samp({c}), 6) as std, round(cast(min({c}) as double), 6) as min, "
        f"round(quantile_cont({c}, 0.25), 6) as q1, round(quantile_cont({c}, 0.75), 6) as q3, "
        f"round(cast(max({c}) as double), 6) as max, count(*) filter (where {c} is null) as missing from {table}"
        for c in cols])


@query("num_summary", _num_summary_sql("licensing", LIC_NUM))
def q_num_summary(spark, sf_dir):
    return rnd(P.num_summary(tables(spark, sf_dir).stored("licensing", LIC_NUM), LIC_NUM))


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("num_summary_lineitem", _num_summary_sql("lineitem", LI_NUM))
def q_num_summary_lineitem(spark, sf_dir):
    return rnd(P.num_summary(tables(spark, sf_dir)["lineitem"], LI_NUM))


@query("num_summary_hist_path", _num_summary_sql("lineitem", ["l_extendedprice"]))
def q_num_summary_hist_path(spark, sf_dir):
    """Exact quantiles from the distributed histogram beside the sketched summary."""
    df = tables(spark, sf_dir)["lineitem"]
    qs = P.quantiles(df, ["l_extendedprice"], [0.5, 0.25, 0.75])
    base = P.num_summary(df, ["l_extendedprice"], approx=True)
    from pyspark.sql import functions as F
    q = qs["l_extendedprice"]
    return rnd(base.withColumns({"median": F.lit(q[0]), "q1": F.lit(q[1]), "q3": F.lit(q[2])}))


@query("imputation_summary", _union([
    f"select '{c}' as column, round(avg({c}), 6) as mean, round(quantile_cont({c}, 0.5), 6) as median, "
    f"count(*) filter (where {c} is null) as missing from licensing" for c in LIC_NUM]))
def q_imputation_summary(spark, sf_dir):
    return rnd(P.imputation_summary(tables(spark, sf_dir).stored("licensing", LIC_NUM), LIC_NUM))


def _describe_sql():
    parts = []
    for c in LIC_NUM + LIC_TIME:
        x = f"(epoch_us({c}) / 1e6)" if c in LIC_TIME else f"cast({c} as double)"
        std = f"round(stddev_samp({x}), 6)" if c in LIC_NUM else "cast(null as double)"
        parts.append(
            f"select '{c}' as column, count({c}) as count, cast(null as bigint) as unique, "
            f"cast(null as varchar) as top, cast(null as bigint) as freq, round(avg({x}), 6) as mean, {std} as std, "
            f"round(min({x}), 6) as min, round(quantile_cont({x}, 0.25), 6) as p25, "
            f"round(quantile_cont({x}, 0.5), 6) as p50, round(quantile_cont({x}, 0.75), 6) as p75, "
            f"round(max({x}), 6) as max from licensing")
    for c in LIC_CAT:
        parts.append(
            f"select '{c}' as column, (select count({c}) from licensing) as count, "
            f"(select count(distinct {c}) from licensing) as unique, v as top, n as freq, "
            + ", ".join(f"cast(null as double) as {k}" for k in ["mean", "std", "min", "p25", "p50", "p75", "max"])
            + f" from (select {c} as v, count(*) as n from licensing where {c} is not null group by {c} "
            f"order by n desc, v limit 1) t")
    return _union(parts)


@query("describe_all", _describe_sql())
def q_describe_all(spark, sf_dir):
    return rnd(P.describe_all(tables(spark, sf_dir).stored("licensing")))


CAT3 = ["territory", "media", "platform"]


@query("cat_summary", "select \"column\", value, count from (select *, row_number() over "
       "(partition by \"column\" order by count desc, value) as r from (" + _union([
           f"select '{c}' as column, coalesce(cast({c} as varchar), 'Unknown') as value, count(*) as count "
           f"from licensing group by 1, 2" for c in CAT3]) + ") a) b where r <= 15")
def q_cat_summary(spark, sf_dir):
    return P.cat_summary(_lic(spark, sf_dir), CAT3)


@query("value_counts_top", "select platform as value, count(*) as count from licensing where platform is not null "
       "group by platform order by count desc, value limit 20")
def q_value_counts_top(spark, sf_dir):
    return P.value_counts_top(_lic(spark, sf_dir), "platform", 20)


@query("group_mean_top", "select platform as category, round(avg(price), 6) as mean from licensing "
       "group by platform order by mean desc nulls last, category nulls first limit 20")
def q_group_mean_top(spark, sf_dir):
    return rnd(P.group_mean_top(_lic(spark, sf_dir), "platform", "price", 20))


CARD = ["title_id", "release_year", "territory", "units"]


@query("cardinality", _union([
    f"select '{c}' as column, cast(count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as bigint)"
    f" as cardinality from licensing" for c in CARD]))
def q_cardinality(spark, sf_dir):
    return P.cardinality(_lic(spark, sf_dir), CARD)


@query("mode_value", "select release_year as mode from licensing where release_year is not null "
       "group by release_year order by count(*) desc, release_year limit 1")
def q_mode_value(spark, sf_dir):
    return P.mode_value(_lic(spark, sf_dir), "release_year")


def _corr_sql(table, cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            xm = f"case when {b} is not null then cast({a} as double) end"
            ym = f"case when {a} is not null then cast({b} as double) end"
            r = (f"case when stddev_pop({xm}) * stddev_pop({ym}) > 0 then round(least(1.0, greatest(-1.0, "
                 f"covar_pop({xm}, {ym}) / (stddev_pop({xm}) * stddev_pop({ym})))), 3) + 0.0 end")
            parts.append(f"select '{a}' as col_a, '{b}' as col_b, {r} as corr from {table}")
            if a != b:
                parts.append(f"select '{b}' as col_a, '{a}' as col_b, {r} as corr from {table}")
    return _union(parts)


CORR_COLS = ["release_year", "units", "price"]


@query("corr_matrix", _corr_sql("licensing", CORR_COLS))
def q_corr_matrix(spark, sf_dir):
    return P.corr_matrix(_lic(spark, sf_dir), CORR_COLS)


@query("corr_matrix_lineitem", _corr_sql("lineitem", LI_NUM))
def q_corr_matrix_lineitem(spark, sf_dir):
    return P.corr_matrix(tables(spark, sf_dir)["lineitem"], LI_NUM)


@query("datetime_summary", _union([
    f"select '{c}' as column, count({c}) as count, min({c}) as min, max({c}) as max, "
    f"cast(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000) as bigint) as range_days, "
    f"count(*) filter (where {c} is null) as missing from licensing" for c in LIC_TIME]))
def q_datetime_summary(spark, sf_dir):
    return P.datetime_summary(_lic(spark, sf_dir), LIC_TIME)


@query("datetime_trend", "select date_trunc('month', window_start) as period_start, count(*) as count "
       "from licensing where window_start is not null group by 1 order by 1")
def q_datetime_trend(spark, sf_dir):
    return P.datetime_trend(_lic(spark, sf_dir), "window_start", "M")


@query("datetime_trend_weekly", "select date_trunc('week', ts) as period_start, count(*) as count "
       "from events where ts is not null group by 1 order by 1")
def q_datetime_trend_weekly(spark, sf_dir):
    return P.datetime_trend(tables(spark, sf_dir)["events"], "ts", "W")


@query("datetime_trend_quarterly", "select date_trunc('quarter', o_orderdate) as period_start, count(*) as count "
       "from orders group by 1 order by 1")
def q_datetime_trend_quarterly(spark, sf_dir):
    return P.datetime_trend(tables(spark, sf_dir)["orders"], "o_orderdate", "Q")


@query("hour_histogram", "select g.hour, cast(coalesce(c.n, 0) as bigint) as count from "
       "(select cast(range as integer) as hour from range(24)) g left join "
       "(select cast(hour(ts) as integer) as hour, count(*) as n from events where ts is not null group by 1) c "
       "on g.hour = c.hour")
def q_hour_histogram(spark, sf_dir):
    return P.hour_histogram(tables(spark, sf_dir)["events"], "ts")


def _hist_sql(table, col, bins=30):
    return (f"with st as (select min({col}) as lo, max({col}) as hi from {table}), "
            f"w as (select case when lo = hi then lo - 0.5 else lo end as lo, "
            f"case when lo = hi then hi + 0.5 else hi end as hi from st), "
            f"ww as (select lo, hi, (hi - lo) / {bins} as width from w), "
            f"c as (select cast(least(floor(({col} - lo) / width), {bins - 1}) as integer) as bin, count(*) as n "
            f"from {table}, ww where {col} is not null group by 1), "
            f"g as (select cast(range as integer) as bin from range({bins})) "
            f"select g.bin, round(lo + g.bin * width, 6) as lo, round(lo + (g.bin + 1) * width, 6) as hi, "
            f"cast(coalesce(c.n, 0) as bigint) as count from g cross join ww left join c on g.bin = c.bin")


@query("histogram", _hist_sql("licensing", "price"))
def q_histogram(spark, sf_dir):
    return rnd(P.histogram(_lic(spark, sf_dir), "price", 30))


@query("histogram_events", _hist_sql("events", "value"))
def q_histogram_events(spark, sf_dir):
    return rnd(P.histogram(tables(spark, sf_dir)["events"], "value", 30))


def _box_sql(cols):
    q = _union([f"select '{c}' as column, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as median, "
                f"quantile_cont({c}, 0.75) as q3 from licensing" for c in cols])
    v = _union([f"select '{c}' as column, cast({c} as double) as v from licensing where {c} is not null"
                for c in cols])
    return (f"with q as ({q}), v as ({v}), j as (select v.\"column\", v.v, q.q1, q.median, q.q3, "
            f"q.q1 - 1.5 * (q.q3 - q.q1) as lf, q.q3 + 1.5 * (q.q3 - q.q1) as hf from v join q on v.\"column\" = q.\"column\") "
            f"select \"column\", round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, "
            f"round(least(min(case when v >= lf and v <= hf then v end), q1), 6) as whisker_lo, "
            f"round(greatest(max(case when v >= lf and v <= hf then v end), q3), 6) as whisker_hi, "
            f"count(*) filter (where not (v >= lf and v <= hf)) as fliers, count(*) as n "
            f"from j group by \"column\", q1, median, q3")


BOX = ["price", "units"]


@query("box_stats", _box_sql(BOX))
def q_box_stats(spark, sf_dir):
    return rnd(P.box_stats(tables(spark, sf_dir).stored("licensing", BOX), BOX))


@query("month_box",
       "with v as (select month(window_start) as month, price as v from licensing "
       "where window_start is not null and price is not null), "
       "q as (select month, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, "
       "quantile_cont(v, 0.75) as q3 from v group by month), "
       "j as (select v.month, v.v, q1, median, q3, q1 - 1.5 * (q3 - q1) as lf, q3 + 1.5 * (q3 - q1) as hf "
       "from v join q on v.month = q.month) "
       "select cast(month as integer) as month, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, "
       "round(least(min(case when v >= lf and v <= hf then v end), q1), 6) as whisker_lo, "
       "round(greatest(max(case when v >= lf and v <= hf then v end), q3), 6) as whisker_hi, "
       "count(*) filter (where not (v >= lf and v <= hf)) as fliers, count(*) as n from j "
       "group by month, q1, median, q3")
def q_month_box(spark, sf_dir):
    return rnd(P.month_box(tables(spark, sf_dir).stored("licensing", ["window_start", "price"]), "window_start", "price"))
