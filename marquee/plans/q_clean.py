"""Queries: filters, outliers, imputation, scaling, dedup, encoding, validation, manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import clean as C
from marquee.operators import encode as E
from marquee.operators import validate as V
from marquee.plans import reports as R
from marquee.plans.registry import query, rnd, tables

LIC_ALL = ["license_id", "title_id", "title", "release_year", "territory", "media", "platform",
           "window_start", "window_end", "units", "price", "currency"]


def _lic(spark, sf_dir):
    return tables(spark, sf_dir)["licensing"]


def _kept(spark, sf_dir, columns=None):
    """The licences (or some of their columns) written once: the joins behind them are not made for each pass."""
    return tables(spark, sf_dir).stored("licensing", columns)


def _u(parts):
    return "\nunion all\n".join(parts)


def _fence(table, c, k=1.5):
    q1 = f"(select quantile_cont({c}, 0.25) from {table})"
    q3 = f"(select quantile_cont({c}, 0.75) from {table})"
    return f"({q1} - {k} * ({q3} - {q1}))", f"({q3} + {k} * ({q3} - {q1}))"


def _summary_sql(table, cols, extra=True):
    parts = []
    for c in cols:
        s = (f"select '{c}' as \"column\", avg({c}) as mean, quantile_cont({c}, 0.5) as median, "
             f"count(*) filter (where {c} is null) as missing")
        if extra:
            s += (f", stddev_samp({c}) as std, cast(min({c}) as double) as min, quantile_cont({c}, 0.25) as q1, "
                  f"quantile_cont({c}, 0.75) as q3, cast(max({c}) as double) as max")
        parts.append(s + f" from {table}")
    return _u(parts)


# ---------------------------------------------------------------- filters

@query("drop_null_rows", "select license_id, title_id, release_year from licensing "
       "where title_id is not null and release_year is not null")
def q_drop_null_rows(spark, sf_dir):
    return C.drop_null_rows(_lic(spark, sf_dir), ["title_id", "release_year"]).select(
        "license_id", "title_id", "release_year")


_lo, _hi = _fence("licensing", "price")


@query("iqr_filter", f"select license_id, round(price, 6) as price from licensing where price >= {_lo} and price <= {_hi}")
def q_iqr_filter(spark, sf_dir):
    return rnd(C.iqr_filter(_kept(spark, sf_dir, ["license_id", "price"]), "price").select("license_id", "price"))


@query("winsorize", "select license_id, round(case when units is null then null else least(greatest(units, "
       "(select quantile_cont(units, 0.01) from licensing)), (select quantile_cont(units, 0.99) from licensing)) end, 6)"
       " as units from licensing")
def q_winsorize(spark, sf_dir):
    return rnd(C.winsorize(_kept(spark, sf_dir, ["license_id", "units"]), "units", 0.01, 0.99).select("license_id", "units"))


_f1lo, _f1hi = _fence("licensing", "price")
_f2lo, _f2hi = _fence("f1", "units")
_OF_CTE = (f"with f1 as (select * from licensing where price >= {_f1lo} and price <= {_f1hi}), "
           f"f2 as (select * from f1 where units >= {_f2lo} and units <= {_f2hi}) ")


@query("outliers_filter", _OF_CTE + "select license_id, round(price, 6) as price, round(units, 6) as units from f2")
def q_outliers_filter(spark, sf_dir):
    out, _ = C.outliers_filter(_kept(spark, sf_dir, ["license_id", "price", "units"]), ["price", "units"], 1.5)
    return rnd(out.select("license_id", "price", "units"))


@query("outliers_filter_report", _OF_CTE +
       f"select 'price' as \"column\", round({_f1lo}, 6) as low, round({_f1hi}, 6) as high, "
       f"(select count(*) from licensing) - (select count(*) from f1) as removed "
       f"union all select 'units', round({_f2lo}, 6), round({_f2hi}, 6), "
       f"(select count(*) from f1) - (select count(*) from f2)")
def q_outliers_filter_report(spark, sf_dir):
    _, rep = C.outliers_filter(_kept(spark, sf_dir, ["price", "units"]), ["price", "units"], 1.5)
    return rnd(rep)


def _report_join_sql(before_sql, after_sql, cols, std_delta=False):
    stats = ["mean", "median", "missing", "std", "min", "q1", "q3", "max"]
    sel = ", ".join(
        f"round(b.{s}, 6) + 0.0 as {s}_before, round(a.{s}, 6) + 0.0 as {s}_after" if s != "missing"
        else f"b.{s} as {s}_before, a.{s} as {s}_after" for s in stats)
    if std_delta:
        sel += ", round(a.std - b.std, 6) + 0.0 as std_delta"
    return (f"select b.\"column\", {sel} from ({before_sql}) b join ({after_sql}) a on b.\"column\" = a.\"column\"")


@query("outliers_report", _OF_CTE + _report_join_sql(_summary_sql("licensing", ["price", "units"]),
                                                     _summary_sql("f2", ["price", "units"]), ["price", "units"], True))
def q_outliers_report(spark, sf_dir):
    lic = _kept(spark, sf_dir, ["price", "units"])
    out, _ = C.outliers_filter(lic, ["price", "units"], 1.5)
    return rnd(R.outliers_report(lic, out, ["price", "units"]))


def _clip_sql(c):
    lo, hi = _fence("licensing", c)
    return f"case when {c} is null then null else least(greatest({c}, {lo}), {hi}) end"


@query("outliers_clip", f"select license_id, round({_clip_sql('price')}, 6) as price, "
       f"round({_clip_sql('units')}, 6) as units from licensing")
def q_outliers_clip(spark, sf_dir):
    out, _ = C.outliers_clip(_kept(spark, sf_dir, ["license_id", "price", "units"]), ["price", "units"], 1.5)
    return rnd(out.select("license_id", "price", "units"))


@query("outliers_clip_report", _u([
    f"select '{c}' as \"column\", round({_fence('licensing', c)[0]}, 6) as low, round({_fence('licensing', c)[1]}, 6) as high, "
    f"count(*) filter (where {c} is null or {c} < {_fence('licensing', c)[0]} or {c} > {_fence('licensing', c)[1]}) as clipped "
    f"from licensing" for c in ["price", "units"]]))
def q_outliers_clip_report(spark, sf_dir):
    _, rep = C.outliers_clip(_kept(spark, sf_dir, ["price", "units"]), ["price", "units"], 1.5)
    return rnd(rep)


@query("row_bounds", "select count(*) as rows, count(*) filter (where units < 0) as units_below_min, "
       "count(*) filter (where price < 0) as price_below_min, count(*) filter (where "
       "date_diff('day', cast(window_start as date), cast(window_end as date)) < 7 or "
       "date_diff('day', cast(window_start as date), cast(window_end as date)) > 365) as window_days_out_of_range "
       "from licensing")
def q_row_bounds(spark, sf_dir):
    return C.row_bounds(_lic(spark, sf_dir))


# ---------------------------------------------------------------- imputation

_MODE_TID = ("(select title_id from licensing where title_id is not null group by title_id "
             "order by count(*) desc, title_id limit 1)")


@query("impute", "select license_id, round(coalesce(cast(release_year as double), "
       "(select quantile_cont(release_year, 0.5) from licensing)), 6) as release_year, "
       "round(coalesce(units, (select quantile_cont(units, 0.5) from licensing)), 6) as units, "
       f"coalesce(title_id, {_MODE_TID}) as title_id from licensing")
def q_impute(spark, sf_dir):
    out = C.impute(_kept(spark, sf_dir, ["license_id", "title_id", "release_year", "units"]), "median", ["release_year", "units", "title_id"])
    return rnd(out.select("license_id", F.col("release_year").cast("double").alias("release_year"),
                          "units", "title_id"))


@query("impute_mean", "select license_id, round(coalesce(units, (select avg(units) from licensing)), 6) as units, "
       "round(coalesce(cast(release_year as double), (select avg(release_year) from licensing)), 6) as release_year "
       "from licensing")
def q_impute_mean(spark, sf_dir):
    out = C.impute(_lic(spark, sf_dir), "mean", ["units", "release_year"])
    return rnd(out.select("license_id", "units", F.col("release_year").cast("double").alias("release_year")))


_IMP_CTE = ("with imp as (select license_id, coalesce(cast(release_year as double), "
            "(select quantile_cont(release_year, 0.5) from licensing)) as release_year, "
            "coalesce(units, (select quantile_cont(units, 0.5) from licensing)) as units, price from licensing), "
            f"lic as (select license_id, cast(release_year as double) as release_year, units, price from licensing) ")


def _impute_report_sql(cols, tol=2.0):
    b = _summary_sql("lic", cols, extra=False)
    a = _summary_sql("imp", cols, extra=False)
    eps = "1e-12"
    pct = lambda d, base: f"(({d}) / case when abs({base}) > {eps} then {base} else {eps} end * 100.0)"
    return (_IMP_CTE + f", b as ({b}), a as ({a}), j as (select b.\"column\", b.missing as missing_before, "
            f"a.missing as missing_after, b.mean as mean_before, a.mean as mean_after, b.median as median_before, "
            f"a.median as median_after from b join a on b.\"column\" = a.\"column\") "
            f"select \"column\", missing_before, missing_after, missing_before - missing_after as missing_reduction, "
            f"round(mean_before, 4) as mean_before, round(mean_after, 4) as mean_after, "
            f"round(mean_after - mean_before, 4) + 0.0 as mean_delta, "
            f"round({pct('mean_after - mean_before', 'mean_before')}, 4) + 0.0 as mean_delta_pct, "
            f"coalesce(abs({pct('mean_after - mean_before', 'mean_before')}) <= {tol}, false) as mean_stable, "
            f"round(median_before, 4) as median_before, round(median_after, 4) as median_after, "
            f"round(median_after - median_before, 4) as median_delta, "
            f"round({pct('median_after - median_before', 'median_before')}, 4) as median_delta_pct, "
            f"coalesce(abs({pct('median_after - median_before', 'median_before')}) <= {tol}, false) as median_stable "
            f"from j")


@query("impute_report", _impute_report_sql(["release_year", "units", "price"]))
def q_impute_report(spark, sf_dir):
    lic = _kept(spark, sf_dir, ["release_year", "units", "price"]).withColumn("release_year", F.col("release_year").cast("double"))
    after = C.impute(lic, "median", ["release_year", "units", "price"])
    # 4 places: the delta percentages amplify last-bit differences of two averages
    return rnd(R.impute_report(lic, after, ["release_year", "units", "price"], 2.0), 4)


@query("compare_summaries", _IMP_CTE + _report_join_sql(_summary_sql("lic", ["units", "price"]),
                                                        _summary_sql("imp", ["units", "price"]), ["units", "price"]))
def q_compare_summaries(spark, sf_dir):
    from marquee.operators import profile as P
    lic = _kept(spark, sf_dir, ["release_year", "units", "price"]).withColumn("release_year", F.col("release_year").cast("double"))
    after = C.impute(lic, "median", ["release_year", "units"])
    return rnd(R.compare_summaries(P.num_summary(lic, ["units", "price"]), P.num_summary(after, ["units", "price"])))


# ---------------------------------------------------------------- scaling

SC = ["l_quantity", "l_extendedprice", "l_discount"]


@query("scale_standard", "select l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - avg({c}) over ()) / case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end, 6) as {c}"
    for c in SC) + " from lineitem")
def q_scale_standard(spark, sf_dir):
    return rnd(C.scale_standard(tables(spark, sf_dir)["lineitem"], SC).select("l_orderkey", "l_linenumber", *SC))


@query("scale_minmax", "select l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - min({c}) over ()) / case when max({c}) over () = min({c}) over () then 1 else "
    f"max({c}) over () - min({c}) over () end, 6) as {c}" for c in SC) + " from lineitem")
def q_scale_minmax(spark, sf_dir):
    return rnd(C.scale_minmax(tables(spark, sf_dir)["lineitem"], SC).select("l_orderkey", "l_linenumber", *SC))


@query("scale_standard_nulls", "select license_id, round((units - avg(units) over ()) / stddev_pop(units) over (), 6)"
       " as units from licensing")
def q_scale_standard_nulls(spark, sf_dir):
    return rnd(C.scale_standard(_lic(spark, sf_dir), ["units"]).select("license_id", "units"))


_SC_CTE = ("with sc as (select " + ", ".join(
    f"({c} - avg({c}) over ()) / case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end as {c}"
    for c in SC) + " from lineitem) ")


@query("scaling_report", _SC_CTE + _report_join_sql(_summary_sql("lineitem", SC), _summary_sql("sc", SC), SC))
def q_scaling_report(spark, sf_dir):
    li = tables(spark, sf_dir)["lineitem"]
    return rnd(R.scaling_report(li, C.scale_standard(li, SC), SC))


# ---------------------------------------------------------------- dedup

_COMPLETE = " + ".join(f"(case when {c} is not null then 1 else 0 end)" for c in LIC_ALL)


@query("dedup_most_complete",
       f"select license_id, title_id from (select license_id, title_id, row_number() over (partition by title_id "
       f"order by {_COMPLETE} desc, license_id) as rn from licensing where title_id is not null) t where rn = 1 "
       f"union all select license_id, title_id from licensing where title_id is null")
def q_dedup_most_complete(spark, sf_dir):
    return C.dedup_most_complete(_lic(spark, sf_dir), "title_id", ["license_id"], ["license_id", "title_id"])


@query("dedup_latest",
       "select license_id, title_id, window_end from (select license_id, title_id, window_end, row_number() over "
       "(partition by title_id order by window_end desc nulls last, license_id) as rn from licensing "
       "where title_id is not null) t where rn = 1 union all "
       "select license_id, title_id, window_end from licensing where title_id is null")
def q_dedup_latest(spark, sf_dir):
    return C.dedup_latest(_lic(spark, sf_dir), "title_id", ["license_id"], columns=["license_id", "title_id", "window_end"])


@query("deduplicate",
       "select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over "
       "(partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as rn from lineitem) t where rn = 1")
def q_deduplicate(spark, sf_dir):
    li = tables(spark, sf_dir)["lineitem"]
    return C.deduplicate(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("dedup_report", "select 'title_id' as key, count(*) as rows_before, "
       "(select count(distinct title_id) from licensing) + (select count(*) from licensing where title_id is null) "
       "as rows_after, count(*) - (select count(distinct title_id) from licensing) - "
       "(select count(*) from licensing where title_id is null) as removed from licensing")
def q_dedup_report(spark, sf_dir):
    lic = _kept(spark, sf_dir)
    return C.dedup_report(lic, C.dedup_most_complete(lic, "title_id", ["license_id"], ["title_id"]), "title_id")


# ---------------------------------------------------------------- encoding

# fixed values: levels of the fixture views (market segments and ISO-3 territories)
MEDIA_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TERR_LEVELS = sorted(["USA", "GBR", "CAN", "AUS", "DEU", "IND", "FRA", "JPN", "ESP", "TUR", "RUS", "DNK",
                      "SRB", "BRA"])


def _norm_cat(c):
    return (f"(case when upper(trim(cast({c} as varchar))) is null or upper(trim(cast({c} as varchar))) = 'NAN' "
            f"then 'UNKNOWN' else upper(trim(cast({c} as varchar))) end)")


@query("one_hot", "select license_id, " + ", ".join(
    [f"case when {_norm_cat('media')} = '{v}' then 1 else 0 end as media_{v}" for v in MEDIA_LEVELS]
    + [f"case when {_norm_cat('territory')} = '{v}' then 1 else 0 end as territory_{v}" for v in TERR_LEVELS])
    + " from licensing")
def q_one_hot(spark, sf_dir):
    out = E.one_hot(_lic(spark, sf_dir), ["media", "territory"])
    return out.select("license_id", *[c for c in out.columns if c.startswith(("media_", "territory_"))])


@query("one_hot_drop_first", "select license_id, " + ", ".join(
    f"coalesce(media = '{v}', false) as media_{v}" for v in MEDIA_LEVELS[1:]) + " from licensing")
def q_one_hot_drop_first(spark, sf_dir):
    out = E.one_hot(_lic(spark, sf_dir), ["media"], normalise=False, drop_first=True, as_bool=True)
    return out.select("license_id", *[c for c in out.columns if c.startswith("media_")])


@query("one_hot_sparse", "select license_id, [" + ", ".join(
    f"case when {_norm_cat('media')} = '{v}' then 1.0::double else 0.0::double end" for v in MEDIA_LEVELS) + "] as media_ohe, [" + ", ".join(
    f"case when {_norm_cat('territory')} = '{v}' then 1.0::double else 0.0::double end" for v in TERR_LEVELS) + "] as territory_ohe from licensing")
def q_one_hot_sparse(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    out = E.one_hot_sparse(_lic(spark, sf_dir), ["media", "territory"])
    return out.select("license_id", vector_to_array("media_ohe").alias("media_ohe"),
                      vector_to_array("territory_ohe").alias("territory_ohe"))


# fixed values: order priority levels (5-LOW deliberately left out -> -1)
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


@query("ordinal", "select o_orderkey, cast(case o_orderpriority " + " ".join(
    f"when '{v}' then {i}" for i, v in enumerate(PRIORITY)) + " else -1 end as integer) as o_orderpriority from orders")
def q_ordinal(spark, sf_dir):
    return E.ordinal(tables(spark, sf_dir)["orders"], {"o_orderpriority": PRIORITY}).select(
        "o_orderkey", "o_orderpriority")


@query("target_encode", "select o_orderkey, round(p.m, 6) as o_orderpriority__target, round(s.m, 6) as o_orderstatus__target "
       "from orders o left join (select upper(trim(o_orderpriority)) as lv, avg(o_totalprice) as m from orders group by 1) p "
       "on upper(trim(o.o_orderpriority)) = p.lv left join (select upper(trim(o_orderstatus)) as lv, avg(o_totalprice) as m "
       "from orders group by 1) s on upper(trim(o.o_orderstatus)) = s.lv")
def q_target_encode(spark, sf_dir):
    out = E.target_encode(tables(spark, sf_dir)["orders"], ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return rnd(out.select("o_orderkey", "o_orderpriority__target", "o_orderstatus__target"))


@query("target_encode_train_only",
       "select o_orderkey, round(p.m, 6) as o_orderpriority__target from orders o left join "
       "(select upper(trim(o_orderpriority)) as lv, avg(o_totalprice) as m from orders where o_orderkey % 5 <> 0 group by 1) p "
       "on upper(trim(o.o_orderpriority)) = p.lv where o_orderkey % 5 = 0")
def q_target_encode_train_only(spark, sf_dir):
    """Fit on training rows (key not divisible by 5), apply to the held-out rows."""
    o = tables(spark, sf_dir)["orders"]
    enc = E.target_encode_fit(o.where(F.col("o_orderkey") % 5 != 0), ["o_orderpriority"], "o_totalprice")
    return rnd(enc.transform(o.where(F.col("o_orderkey") % 5 == 0)).select("o_orderkey", "o_orderpriority__target"))


@query("encoding_report", _u([
    f"select '{c}' as \"column\", cast(count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as bigint) "
    f"as cardinality_before, cast(-1 as bigint) as cardinality_after from licensing" for c in ["media", "territory"]]))
def q_encoding_report(spark, sf_dir):
    lic = _lic(spark, sf_dir)
    return R.encoding_report(lic, E.one_hot(lic, ["media", "territory"]), ["media", "territory"])


# ---------------------------------------------------------------- validation

def _probe(spark, sf_dir):
    """Licensing rows with deliberately broken fields (derived from the view)."""
    lic = _lic(spark, sf_dir)
    num = F.regexp_extract("license_id", r"-(\d+)$", 1).cast("int")
    return lic.select(
        "license_id", "title_id", "title", "territory", "media", "platform",
        F.when(num == 7, F.lit("unknown")).otherwise(F.col("release_year").cast("string")).alias("release_year"),
        F.when(num == 6, F.lit("not a date")).otherwise(F.col("window_start").cast("string")).alias("window_start"),
        "window_end", (F.col("price") / 1000.0 - 30.0).alias("price"))


_PROBE_SQL = ("with probe as (select license_id, case when cast(regexp_extract(license_id, '-(\\d+)$', 1) as integer) = 7 "
              "then 'unknown' else cast(release_year as varchar) end as release_year, "
              "case when cast(regexp_extract(license_id, '-(\\d+)$', 1) as integer) = 6 then 'not a date' "
              "else strftime(window_start, '%Y-%m-%d %H:%M:%S') end as window_start, price / 1000.0 - 30.0 as price "
              "from licensing) ")


@query("schema_validate", _PROBE_SQL +
       "select 'release_year' as \"column\", 'coerce_dtype(''int64'')' as \"check\", release_year as failure_case "
       "from probe where release_year is not null and try_cast(release_year as double) is null "
       "union all select 'window_start', 'coerce_dtype(''datetime64[ns]'')', window_start from probe "
       "where window_start is not null and try_cast(window_start as timestamp) is null "
       "union all select 'price', 'greater_than(0)', printf('%.6f', price) from probe where price <= 0")
def q_schema_validate(spark, sf_dir):
    res = V.schema_validate(_probe(spark, sf_dir))
    f = res.failures
    # price failure cases are printed doubles: compare on the parsed value
    return f.withColumn("failure_case", F.when(F.col("column") == "price",
                                               F.format_string("%.6f", F.col("failure_case").cast("double")))
                        .otherwise(F.col("failure_case")))


@query("schema_report")
def q_schema_report(spark, sf_dir):
    res = V.schema_validate(_lic(spark, sf_dir))
    return V.schema_report(res.frame)


@query("step_manifest")
def q_step_manifest(spark, sf_dir):
    """A cleaning run on the licensing view recorded as a manifest, read back as dashboard lines."""
    from marquee.operators import profile as P
    lic = _kept(spark, sf_dir).withColumn("release_year", F.col("release_year").cast("double"))
    imp = C.impute(lic, "median", ["release_year", "units"])
    rep_imp = R.impute_report(lic, imp, ["release_year", "units"])
    clipped, rep_out = C.outliers_clip(imp, ["price", "units"])
    enc = E.one_hot(clipped, ["media"])
    scaled = C.scale_standard(enc, ["price"])
    dedup = C.dedup_most_complete(scaled, "title_id", ["license_id"], ["title_id"])
    steps = [("post_impute_check", rep_imp),
             ("outliers", {"method": "Winsorize", "iqr_multiplier": 1.5,
                           "impact": [r.asDict() for r in rep_out.collect()]}),
             ("encoding", {"method": "One-Hot", "columns": ["media"]}),
             ("scaling", {"scaler": "StandardScaler", "method": "standard",
                          "summary": [r.asDict() for r in P.num_summary(scaled, ["price"]).collect()]}),
             ("deduplication", {"key": "title_id", "rule": "Most complete",
                                "removed_count": scaled.count() - dedup.count()})]
    return R.manifest_status(R.step_manifest(spark, steps))
